"""The matrix corpus: derived metadata, density classes, representative picks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripleloom.functions.scalar import class_rank, density_class, geomean
from tripleloom.operators.scans import at_ranks, id_levels, medians, value_levels

# Positions picked by size and by density.
SIZE_POSITIONS = (0.10, 0.50, 0.90)
DENSITY_POSITIONS = (0.05, 0.95)
MORE_LOW, MORE_HIGH = 0.05, 0.95
HISTOGRAM_BINS = 60


@dataclass(frozen=True)
class Limits:
    """Largest rows and entries of the matrices picked from: tight ones, and loose ones for classes with few others."""

    tight: tuple[int, int]
    loose: tuple[int, int]
    fewest: int = 5


# The customary limits of the pool; no limit is set unless they are passed.
CUSTOMARY = Limits((500_000, 10_000_000), (2_000_000, 50_000_000))


def _within(limit: tuple[int, int]) -> Column:
    return (F.col("n") <= limit[0]) & (F.col("nnz") <= limit[1])


def enriched(index: DataFrame, base_url: str) -> DataFrame:
    """Adds positions, density, sparsity, entries per row, squareness, year and download address.

    The number of positions is DECIMAL: rows times columns may exceed BIGINT.
    """
    entries = F.col("rows").cast("decimal(19,0)") * F.col("cols").cast("decimal(19,0)")
    density = F.coalesce(F.try_divide(F.col("nnz").cast("double"), entries.cast("double")), F.lit(0.0))
    return (
        index.withColumn("num_entries", entries)
        .withColumn("density", density)
        .withColumn("sparsity_pct", (1.0 - F.col("density")) * 100.0)
        .withColumn("nnz_per_row", F.coalesce(F.try_divide(F.col("nnz").cast("double"), F.col("rows")), F.lit(0.0)))
        .withColumn("is_square", F.col("rows") == F.col("cols"))
        .withColumn("year", F.regexp_extract("date", r"(\d{4})", 1).try_cast("int"))
        .withColumn("url_mm", F.concat(F.lit(base_url + "/MM/"), "group", F.lit("/"), "name", F.lit(".tar.gz")))
    )


def classified(meta: DataFrame) -> DataFrame:
    """Square matrices with ``n``, ``density_pct`` and ``class``."""
    return (
        meta.where("is_square")
        .withColumn("density_pct", F.col("density") * 100.0)
        .withColumn("n", F.col("rows"))
        .withColumn("class", density_class(F.col("density_pct")))
    )


def class_summary(corpus: DataFrame) -> DataFrame:
    """Matrices, share and density range per class."""
    counts = corpus.groupBy("class").agg(
        F.count(F.lit(1)).alias("matrices"),
        F.min("density_pct").alias("lowest_pct"),
        F.max("density_pct").alias("highest_pct"),
    )
    # One row per class, so the window over all of them is tiny.
    total = F.sum("matrices").over(Window.partitionBy())
    return counts.withColumn("share_pct", F.col("matrices") * 100.0 / total)


def pool(corpus: DataFrame, limits: Limits | None = None) -> DataFrame:
    """All matrices, or those within the tight limits; within the loose ones for classes with fewer than ``fewest``."""
    if limits is None:
        return corpus
    tight = corpus.groupBy("class").agg(F.count_if(_within(limits.tight)).alias("__tight"))
    keep = F.when(F.col("__tight") >= limits.fewest, _within(limits.tight)).otherwise(_within(limits.loose))
    # Tables by class have as many rows as there are density classes.
    return corpus.join(F.broadcast(tight), "class").where(keep).drop("__tight")


def _positions(counts: DataFrame, at: tuple[float, ...]) -> DataFrame:
    """``(class, pick, rank)``; halves round to the even neighbour."""
    last = F.col("m") - 1
    ranks = F.array(*[F.least(last, F.greatest(F.lit(0), F.bround(F.lit(q) * last).cast("long"))) for q in at])
    return counts.select("class", F.posexplode(ranks).alias("pick", "rank"))


def representatives(corpus: DataFrame, largest_id: int, limits: Limits | None = None) -> DataFrame:
    """Per class: small, middle and large matrices by entries, thin and full ones by density.

    Equal keys are ordered by id.  A matrix picked twice appears once.
    """
    usable = pool(corpus, limits)
    counts = usable.groupBy("class").agg(F.count(F.lit(1)).alias("m"))
    by_size = at_ranks(
        usable, _positions(counts, SIZE_POSITIONS),
        [*value_levels("nnz"), *id_levels("id", largest_id + 1)], ("class",), ["id"],
    )
    by_density = at_ranks(
        usable, _positions(counts, DENSITY_POSITIONS),
        [*value_levels("density_pct"), *id_levels("id", largest_id + 1)], ("class",), ["id"],
    )
    picked = by_size.select("class", "id").unionByName(by_density.select("class", "id")).distinct()
    return usable.join(F.broadcast(picked), ["class", "id"])


def more_representatives(
    corpus: DataFrame, chosen: DataFrame, target: int, largest_id: int, limits: Limits | None = None
) -> DataFrame:
    """Further matrices for classes with fewer than ``target``, evenly spread over the density.

    With limits, candidates come from the tight ones; a class with too few of them
    uses all of its matrices.  Chosen names are left out.
    """
    current = chosen.groupBy("class").agg(F.count(F.lit(1)).alias("have"))
    free = corpus.join(chosen.select("name"), "name", "left_anti")
    tight = _within(limits.tight) if limits else F.lit(True)
    sizes = (
        free.groupBy("class")
        .agg(F.count_if(tight).alias("__tight"), F.count(F.lit(1)).alias("__all"))
        .join(current, "class", "left")
        .withColumn("need", F.lit(target) - F.coalesce("have", F.lit(0)))
        .where("need > 0")
    )
    candidates = free.join(F.broadcast(sizes.select("class", "__tight", "need")), "class").where(
        tight | (F.col("__tight") < F.col("need"))
    )
    m = F.when(F.col("__tight") < F.col("need"), F.col("__all")).otherwise(F.col("__tight"))
    step = F.coalesce(F.try_divide(F.lit(MORE_HIGH - MORE_LOW), F.col("need") - 1), F.lit(0.0))
    spots = sizes.withColumn("m", m).select(
        "class", "m", step.alias("step"), F.explode(F.sequence(F.lit(0), (F.col("need") - 1).cast("int"))).alias("pick")
    )
    at = (F.lit(MORE_LOW) + F.col("step") * F.col("pick")) * (F.col("m") - 1)
    rank = F.least(F.col("m") - 1, F.greatest(F.lit(0), F.bround(at).cast("long")))
    found = at_ranks(
        candidates, spots.select("class", "pick", rank.alias("rank")),
        [*value_levels("density_pct"), *id_levels("id", largest_id + 1)], ("class",), ["id"],
    )
    return free.join(F.broadcast(found.select("class", "id").distinct()), ["class", "id"])


def all_representatives(old: DataFrame, added: DataFrame, local: DataFrame) -> DataFrame:
    """Old and added picks in one table, an old one where both have the id; ``in_local_data`` says whether ``local`` has it."""
    both = old.unionByName(added.join(old.select("id"), "id", "left_anti"))
    mine = local.select("id").distinct().withColumn("in_local_data", F.lit(True))
    return both.drop("in_local_data").join(mine, "id", "left").withColumn("in_local_data", F.coalesce("in_local_data", F.lit(False)))


def ordered_classes(corpus: DataFrame) -> DataFrame:
    """Report order: class rank, then rows."""
    return corpus.orderBy(class_rank(F.col("class")), "n", "id")


def largest(corpus: DataFrame, by: str, k: int = 5) -> DataFrame:
    return corpus.orderBy(F.desc(by), "id").limit(k)


def summary(corpus: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """``(column, least, middle, average, greatest)`` in long form."""
    named = F.stack(F.lit(len(columns)), *[x for c in columns for x in (F.lit(c), F.col(c).cast("double"))])
    long = corpus.select(named.alias("column", "x"))
    numbers = long.groupBy("column").agg(
        F.min("x").alias("least"), F.avg("x").alias("average"), F.max("x").alias("greatest")
    )
    return numbers.join(medians(long, "x", ("column",)), "column").select(
        "column", "least", F.col("median").alias("middle"), "average", "greatest"
    )


def typical_density(corpus: DataFrame) -> DataFrame:
    return corpus.agg(geomean(F.col("density")).alias("density_geomean"))


def log_histogram(corpus: DataFrame, column: str, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """``(bin, n, lo, hi)``: equal bins over ``log10`` of the positive values, the last one closed."""
    logs = corpus.where(F.col(column) > 0).select(F.log10(column).alias("x"))
    lo, hi = logs.agg(F.min("x"), F.max("x")).first()
    lo, width = lo or 0.0, ((hi or 0.0) - (lo or 0.0)) / bins
    place = F.least(F.floor((F.col("x") - F.lit(lo)) / F.lit(width or 1.0)), F.lit(bins - 1))
    edge = lambda b: F.lit(lo) + F.lit(width) * b
    return (
        logs.groupBy(place.cast("long").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select("bin", "n", edge(F.col("bin")).alias("bin_lo"), edge(F.col("bin") + 1).alias("bin_hi"))
    )
