"""Approximate entries per product row from mergeable sketches of the rows of ``B``.

A sketch has 128 partitions, chosen by the low bits of a hash of the column.
HyperLogLog keeps the greatest rank per partition, the min-hash variant the
least hash.  Merging along the rows of ``A`` costs at most 128 rows per entry,
whatever the length of a row of ``B``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleloom.functions.hashing import leading_zeros32, with_murmur3
from tripleloom.functions.scalar import table_size
from tripleloom.matrix import Matrix
from tripleloom.operators.grouped import grouped_merge
from tripleloom.operators.scans import largest_group
from tripleloom.plans.sizing import BROADCAST_ROWS, has_at_most
from tripleloom.plans.workload import MOST_PARTITIONS, TASK_PRODUCTS
from tripleloom.session import written

# Sketch shape and estimator constants.
PARTITIONS = 128
INDEX_BITS = 7
HLL_ALPHA = 0.715
EXPANSION = 1.5
TWO_32 = 4294967296.0


def _hashed(b: Matrix) -> DataFrame:
    return with_murmur3(b.entries.select("i", "j"), "j").select(
        "i", "h", F.col("h").bitwiseAND(F.lit(PARTITIONS - 1)).alias("p")
    )


def hll_registers(b: Matrix) -> DataFrame:
    """``(i, p, reg)``: greatest capped rank of a leading one per row and partition."""
    rank = F.least(leading_zeros32(F.col("h")) + 1, F.lit(32 - INDEX_BITS + 1))
    return _hashed(b).groupBy("i", "p").agg(F.max(rank).cast("long").alias("reg"))


def minhash_registers(b: Matrix) -> DataFrame:
    """``(i, p, minh)``: least hash per row and partition."""
    return _hashed(b).groupBy("i", "p").agg(F.min("h").alias("minh"))


def _merged(a: Matrix, b: Matrix, registers: DataFrame, merge: Column, code: Column, value: Column) -> DataFrame:
    """Registers merged along the rows of ``A``.

    There are no more registers than entries of ``B``.  Where those were
    counted to be few, the registers go to every task, and ``A`` is hashed on
    its rows if the longest one fits a task, so the merge needs no shuffle.
    Else the registers of a row of ``B`` travel as one array to each group of rows of ``A`` that
    needs them; ``code`` is a register with its partition in the low bits, and ``value`` reads it back.
    """
    per_row = registers.withColumnRenamed("i", "k")
    entries = a.entries.select("i", F.col("j").alias("k"))
    if has_at_most(b.entries, BROADCAST_ROWS):
        per_row = F.broadcast(per_row)
        if largest_group(entries, ("i",)) * PARTITIONS <= TASK_PRODUCTS:
            entries = entries.repartition("i")
        return entries.join(per_row, "k").groupBy("i", "p").agg(merge)
    per_row = written(per_row)
    known, name = per_row.where("p is not null"), registers.columns[-1]
    largest = name == "reg"
    codes, rest = grouped_merge(entries, known.select("k", code.alias("code")), a.rows, PARTITIONS, largest)
    parts = [codes.select("i", F.col("code").bitwiseAND(F.lit(PARTITIONS - 1)).alias("p"), value.alias(name))]
    if rest is not None:
        parts.append(rest.join(known, "k").groupBy("i", "p").agg(merge))
    if not (unknown := per_row.where("p is null")).isEmpty():
        parts.append(entries.join(unknown, "k").groupBy("i", "p").agg(merge))
    return reduce(DataFrame.unionByName, parts)


def merged_hll(a: Matrix, b: Matrix) -> DataFrame:
    """Registers of the rows of ``A·B``."""
    return _merged(a, b, hll_registers(b), F.max("reg").alias("reg"), F.col("reg") * PARTITIONS + F.col("p"), F.expr(f"code div {PARTITIONS}"))


def merged_minhash(a: Matrix, b: Matrix) -> DataFrame:
    return _merged(a, b, minhash_registers(b), F.min("minh").alias("minh"), F.col("minh"), F.col("code"))


def _linear_count(empty: Column) -> Column:
    return F.lit(float(PARTITIONS)) * F.ln(F.lit(float(PARTITIONS)) / empty)


def _sized(estimate: DataFrame, expansion: float) -> DataFrame:
    """Adds the integer estimate with its safety factor and the table size."""
    wanted = F.greatest(F.floor(F.col("distinct_est") * F.lit(expansion)), F.lit(1)).cast("long")
    return estimate.withColumn("est", wanted).withColumn("slots", table_size(F.col("est")))


def hll_estimate(a: Matrix, b: Matrix, expansion: float = EXPANSION) -> DataFrame:
    """``(i, distinct_est, est, slots)`` by HyperLogLog with linear counting for short rows."""
    seen = F.count(F.lit(1))
    power = F.sum(F.pow(F.lit(2.0), -F.col("reg")))
    sums = merged_hll(a, b).groupBy("i").agg(seen.alias("seen"), power.alias("power"))
    empty = F.lit(PARTITIONS) - F.col("seen")
    raw = F.lit(HLL_ALPHA * PARTITIONS * PARTITIONS) / (F.col("power") + empty)
    estimate = F.when((empty > 0) & (raw <= 2.5 * PARTITIONS), _linear_count(F.nullif(empty, F.lit(0)))).otherwise(raw)
    return _sized(sums.select("i", estimate.alias("distinct_est")), expansion)


def minhash_estimate(a: Matrix, b: Matrix, expansion: float = EXPANSION, bounded: bool = False) -> DataFrame:
    """``(i, distinct_est, est, slots)`` by partition minima.

    With every partition filled the customary form ``2**32 * Σ 1/min - m`` has
    no finite expectation and over-estimates several times; ``bounded`` uses
    ``m (m - 1) / Σ (min / 2**32)`` there instead.
    """
    sums = merged_minhash(a, b).groupBy("i").agg(
        F.count(F.lit(1)).alias("seen"),
        # A least hash of 0 has no reciprocal; the partition then adds nothing.
        F.sum(F.try_divide(F.lit(1.0), F.col("minh"))).alias("inverse"),
        F.sum(F.col("minh") / F.lit(TWO_32)).alias("level"),
    )
    empty = F.lit(PARTITIONS) - F.col("seen")
    if bounded:
        full = F.lit(float(PARTITIONS * (PARTITIONS - 1))) / F.col("level")
    else:
        full = F.lit(TWO_32) * F.col("inverse") - PARTITIONS
    estimate = F.when(empty > 0, _linear_count(F.nullif(empty, F.lit(0)))).otherwise(full)
    return _sized(sums.select("i", estimate.alias("distinct_est")), expansion)


def row_estimate(a: Matrix, b: Matrix, method: str = "minhash") -> DataFrame:
    """Estimate of the product rows by the named method: ``bound`` (exact product counts), ``hll`` or ``minhash``."""
    from tripleloom.operators.rowstats import product_counts

    if method not in ("bound", "hll", "minhash"):
        raise ValueError(f"unknown method {method!r}, choose bound, hll or minhash")
    if method == "bound":
        return product_counts(a, b).select(
            "i", F.col("products").cast("double").alias("distinct_est"), F.col("products").alias("est"),
            table_size(F.col("products")).alias("slots"),
        )
    return hll_estimate(a, b) if method == "hll" else minhash_estimate(a, b)


#: Bytes of Spark's own sketches that are broadcast.
SKETCH_BYTES = 64_000_000
#: Sketches that one task merges, where they are shuffled.
SKETCHES = 1 << 18


def _beside(a: Matrix, b: Matrix, sketches: DataFrame, precision: int) -> DataFrame:
    """Entries of ``A`` beside the sketch of the row of ``B`` they refer to; few sketches are broadcast, by their counted rows."""
    rows = b.entries.agg(F.count_distinct("i")).first()[0]
    if rows << precision <= SKETCH_BYTES:
        return a.entries.select("i", F.col("j").alias("k")).join(F.broadcast(sketches), "k")
    # Merged once, where all sketches of a row are: a sketch merged per task is larger than those of the entries it was made from.
    beside = a.entries.select("i", F.col("j").alias("k")).join(sketches, "k")
    usual = int(beside.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return beside.repartition(min(MOST_PARTITIONS, max(usual, a.nnz() // SKETCHES)), "i")


def native_hll_estimate(a: Matrix, b: Matrix, precision: int = 12) -> DataFrame:
    """``(i, est)`` with Spark's own HLL sketches: built per row of ``B``, merged along ``A``."""
    rows = b.entries.groupBy(F.col("i").alias("k")).agg(F.hll_sketch_agg("j", precision).alias("sk"))
    merged = _beside(a, b, rows, precision).groupBy("i").agg(F.hll_union_agg("sk").alias("sk"))
    return merged.select("i", F.hll_sketch_estimate("sk").alias("est"))


def native_theta_estimate(a: Matrix, b: Matrix, precision: int = 12) -> DataFrame:
    """``(i, est)`` with Spark's own theta sketches."""
    rows = b.entries.groupBy(F.col("i").alias("k")).agg(F.theta_sketch_agg("j", precision).alias("sk"))
    # A theta sketch has eight bytes per kept hash.
    merged = _beside(a, b, rows, precision + 3).groupBy("i").agg(F.theta_union_agg("sk", precision).alias("sk"))
    return merged.select("i", F.theta_sketch_estimate("sk").alias("est"))


def estimated_entries(a: Matrix, b: Matrix, precision: int = INDEX_BITS) -> int:
    """Entries of ``A·B``, from one small sketch per row of ``B``."""
    return int(native_hll_estimate(a, b, precision).agg(F.sum("est")).first()[0] or 0)
