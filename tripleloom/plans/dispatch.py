"""Method choice from matrix features by a fitted formula, and the formula's evaluation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleloom.functions.scalar import log10_floor1
from tripleloom.matrix import Matrix
from tripleloom.operators.reshape import row_lengths

HASH, MERGE = "hash", "merge3"


@dataclass(frozen=True)
class Formula:
    """Weights for lg products, lg rows, lg longest row, lg skew; a score below 0 means hash."""

    products: float
    rows: float
    longest: float
    skew: float
    constant: float


# The fitted weights in use, and the ones before them.
CURRENT = Formula(-0.4259, -0.4215, -0.6441, -0.6420, 5.4297)
EARLIER = Formula(-1.3085, 1.2131, 1.9815, -2.4331, 1.2943)
# Fixed value: threshold of the rule in one variable, nnz²/n.
PRODUCT_THRESHOLD = 1.44e5


def features(m: Matrix) -> DataFrame:
    """One row: ``n, nnz, maxrow, skew, flop`` of the expanded matrix."""
    n = F.lit(float(max(m.rows, 1)))
    return (
        row_lengths(m)
        .agg(F.coalesce(F.sum("nnz"), F.lit(0)).alias("nnz"), F.coalesce(F.max("nnz"), F.lit(0)).alias("maxrow"))
        .select(
            F.lit(m.rows).cast("long").alias("n"), "nnz", "maxrow",
            F.coalesce(F.try_divide(F.col("maxrow").cast("double"), F.col("nnz") / n), F.lit(0.0)).alias("skew"),
            (F.col("nnz").cast("double") * F.col("nnz") / n).alias("flop"),
        )
    )


def score(formula: Formula = CURRENT) -> Column:
    """Over columns ``n, maxrow, skew, flop``."""
    return (
        F.lit(formula.products) * log10_floor1(F.col("flop"))
        + F.lit(formula.rows) * F.log10(F.col("n").cast("double"))
        + F.lit(formula.longest) * log10_floor1(F.col("maxrow"))
        + F.lit(formula.skew) * log10_floor1(F.col("skew"))
        + F.lit(formula.constant)
    )


def choice(formula: Formula = CURRENT) -> Column:
    return F.when(score(formula) < 0, F.lit(HASH)).otherwise(F.lit(MERGE))


def threshold_choice(threshold: float = PRODUCT_THRESHOLD) -> Column:
    """The rule in one variable: many products go to hash."""
    return F.when(F.col("flop") > threshold, F.lit(HASH)).otherwise(F.lit(MERGE))


def forced(force: Column, otherwise: Column) -> Column:
    """A text beginning with h means hash, any other merge3; null or empty leaves the choice as it is."""
    named = F.when(F.substring(force, 1, 1).isin("h", "H"), F.lit(HASH)).otherwise(F.lit(MERGE))
    return F.when(F.coalesce(force, F.lit("")) == "", otherwise).otherwise(named)


def choose(m: Matrix, force: str | None = None) -> str:
    """``hash`` or ``merge3`` for a matrix, or what ``force`` names."""
    if force:
        return HASH if force[0] in "hH" else MERGE
    return features(m).select(choice()).first()[0]


def executed(timings: DataFrame, force: Column, formula: Formula = CURRENT) -> DataFrame:
    """Adds ``choice``, ``ran`` and ``paid_ms``: a hash run that failed falls back to merge, and is named so."""
    picked = timings.withColumn("choice", forced(force, choice(formula)))
    failed = (F.col("choice") == HASH) & F.col("hash_ms").isNull()
    ran = F.when(failed, F.lit(f"{MERGE} (fallback)")).otherwise(F.col("choice"))
    paid = F.when((F.col("choice") == HASH) & ~failed, F.col("hash_ms")).otherwise(F.col("merge3_ms"))
    return picked.withColumn("ran", ran).withColumn("paid_ms", paid)


def method_for(m: Matrix, force: str | None = None) -> str:
    """The product method that matches the choice: hash aggregation behind the measured plan, or merge joins."""
    return "auto" if choose(m, force) == HASH else "merge"


# --- evaluation over a table of timings -------------------------------------------


def evaluated(timings: DataFrame, formula: Formula = CURRENT) -> DataFrame:
    """Adds the choice, the faster method, the paid and the best time.

    ``timings`` holds ``n, maxrow, skew, flop, hash_ms, merge3_ms``; a hash run
    that failed (NULL) pays the merge time.
    """
    hash_wins = F.coalesce(F.col("hash_ms") < F.col("merge3_ms"), F.lit(False))
    winner = F.when(hash_wins, F.lit(HASH)).otherwise(F.lit(MERGE))
    hash_paid = F.coalesce("hash_ms", "merge3_ms")
    paid = F.when(F.col("choice") == HASH, hash_paid).otherwise(F.col("merge3_ms"))
    best = F.least(hash_paid, F.col("merge3_ms"))
    margin = F.abs(F.col("hash_ms") - F.col("merge3_ms"))
    return (
        timings.withColumn("choice", choice(formula))
        .withColumn("winner", winner)
        .withColumn("paid_ms", paid)
        .withColumn("best_ms", best)
        .withColumn("decisive", F.coalesce(F.try_divide(margin, best) > 0.1, F.lit(True)))
    )


def evaluation(timings: DataFrame, formula: Formula = CURRENT) -> DataFrame:
    """One row: accuracy (overall and where the margin exceeds 10 %) and the cost of each policy."""
    right = (F.col("choice") == F.col("winner")).cast("double")
    return evaluated(timings, formula).agg(
        F.count(F.lit(1)).alias("matrices"),
        F.count_if(F.col("choice") == HASH).alias("picked_hash"),
        F.count_if(F.col("winner") == HASH).alias("hash_wins"),
        F.count_if("decisive").alias("decisive"),
        F.avg(right).alias("accuracy"),
        F.avg(F.when(F.col("decisive"), right)).alias("decisive_accuracy"),
        F.sum("paid_ms").alias("cost_ms"),
        F.sum("best_ms").alias("oracle_ms"),
        F.sum(F.coalesce("hash_ms", "merge3_ms")).alias("always_hash_ms"),
        F.sum("merge3_ms").alias("always_merge_ms"),
    )


def misclassified(timings: DataFrame, formula: Formula = CURRENT) -> DataFrame:
    """Rows where the choice was the slower method, with the time lost."""
    return (
        evaluated(timings, formula)
        .where("choice <> winner")
        .withColumn("lost_ms", F.col("paid_ms") - F.col("best_ms"))
    )
