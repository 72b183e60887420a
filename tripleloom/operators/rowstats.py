"""Work estimates and shape statistics of rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleloom.functions.hashing import bit_length32, power_of_two
from tripleloom.functions.scalar import column_bucket, size_bin, table_size
from tripleloom.matrix import Matrix
from tripleloom.operators import bitmaps, blocks, grouped
from tripleloom.operators.multiply import in_blocks, in_groups, joined_positions, left_side, pair_positions, right_side, symbolic
from tripleloom.operators.reshape import row_lengths
from tripleloom.operators.scans import histogram, prefix_sum, prefix_sums, ranked
from tripleloom.plans.sizing import BROADCAST_ROWS


def _referenced(a: Matrix, per_row: DataFrame, facts: int) -> DataFrame:
    """Entries of ``A`` beside facts ``(k, …)`` of the rows of ``B`` they refer to.

    ``facts`` bounds the rows of ``per_row`` by the shape; within the broadcast
    limit no entry of ``A`` moves for the join.  Beyond it both sides shuffle,
    and adaptive execution splits a hot column of ``A``, as only the few facts
    of that one ``k`` have to be copied.
    """
    if facts <= BROADCAST_ROWS:
        per_row = F.broadcast(per_row)
    return a.entries.select("i", F.col("j").alias("k")).join(per_row, "k")


def product_counts(a: Matrix, b: Matrix) -> DataFrame:
    """Per row of ``A·B``: intermediate products and the largest single contribution."""
    per_row = b.entries.groupBy(F.col("i").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return (
        _referenced(a, per_row, b.rows)
        .groupBy("i")
        .agg(F.sum("n").alias("products"), F.max("n").alias("largest"))
    )


def products_by_inner_key(a: Matrix, b: Matrix) -> DataFrame:
    """Intermediate products per inner key: column length times row length."""
    left = a.entries.groupBy(F.col("j").alias("k")).agg(F.count(F.lit(1)).alias("col_nnz"))
    right = b.entries.groupBy(F.col("i").alias("k")).agg(F.count(F.lit(1)).alias("row_nnz"))
    return left.join(right, "k").select(
        "k", "col_nnz", "row_nnz", (F.col("col_nnz") * F.col("row_nnz")).alias("products")
    )


def products_by_column(a: Matrix, b: Matrix) -> DataFrame:
    """Intermediate products per column of ``A·B``."""
    lengths = a.entries.groupBy(F.col("j").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    if a.cols <= BROADCAST_ROWS:
        lengths = F.broadcast(lengths)
    return (
        b.entries.select(F.col("i").alias("k"), "j")
        .join(lengths, "k")
        .groupBy("j")
        .agg(F.sum("n").alias("products"))
    )


def product_totals(a: Matrix, b: Matrix) -> DataFrame:
    """One row: total products, operations (a multiply and an add each), largest row, longest row of ``A``."""
    per_row = product_counts(a, b)
    longest = row_lengths(a).agg(F.max("nnz").alias("longest_row"))
    totals = per_row.agg(F.sum("products").alias("products"), F.max("products").alias("largest_row_products"))
    # Two single rows, folded into one.
    facts = totals.unionByName(longest, allowMissingColumns=True).agg(
        *[F.max(c).alias(c) for c in ("products", "largest_row_products", "longest_row")]
    )
    return facts.select("products", (F.col("products") * 2).alias("operations"), "largest_row_products", "longest_row")


def output_column_range(a: Matrix, b: Matrix) -> DataFrame:
    """Per row of ``A·B``: first and last column, and the width class ``bit_length(last - first)``."""
    per_row = b.entries.groupBy(F.col("i").alias("k")).agg(F.min("j").alias("lo"), F.max("j").alias("hi"))
    ranges = _referenced(a, per_row, b.rows).groupBy("i").agg(F.min("lo").alias("first_col"), F.max("hi").alias("last_col"))
    width = bit_length32(F.col("last_col") - F.col("first_col")).cast("long")
    return ranges.select("i", "first_col", "last_col", width.alias("width_class"))


#: Buckets whose counts lie side by side in one row.
SIDE_BY_SIDE = 32


def bucket_products(a: Matrix, b: Matrix, buckets: int) -> DataFrame:
    """Upper bound per row and column bucket: intermediate products.

    The counts of a row of ``B`` lie side by side, so that tasks keep one group per row of ``A`` and not one per bucket of it;
    columns outside the shape, null ones among them, and more buckets than ``SIDE_BY_SIDE`` take a row per bucket.
    """
    columns = b.entries.select(F.col("i").alias("k"), "j")
    if buckets > SIDE_BY_SIDE:
        return _bucket_rows(a, columns, b, buckets)
    inside = F.coalesce(F.col("j").between(0, b.cols - 1), F.lit(False))
    names = [f"n{at}" for at in range(buckets)]
    placed = columns.where(inside).select("k", column_bucket(F.col("j"), buckets, b.cols).alias("b"))
    per_row = placed.groupBy("k").agg(*[F.count_if(F.col("b") == at).alias(name) for at, name in enumerate(names)])
    sums = _referenced(a, per_row, b.rows * buckets).groupBy("i").agg(*[F.sum(name).alias(name) for name in names])
    cells = sums.select("i", F.posexplode(F.array(*names)).alias("b", "products")).where("products > 0")
    found = cells.select("i", F.col("b").cast("long").alias("b"), "products")
    outside = columns.where(~inside)
    if outside.isEmpty():
        return found
    both = found.unionByName(_bucket_rows(a, outside, b, buckets))
    # Near the edge a column outside the shape may share a bucket with those inside.
    return both.groupBy("i", "b").agg(F.sum("products").alias("products"))


def _bucket_rows(a: Matrix, columns: DataFrame, b: Matrix, buckets: int) -> DataFrame:
    bucket = column_bucket(F.col("j"), buckets, b.cols).alias("b")
    per_row = columns.groupBy("k", bucket).agg(F.count(F.lit(1)).alias("n"))
    return _referenced(a, per_row, b.rows * buckets).groupBy("i", "b").agg(F.sum("n").alias("products"))


def bucket_lengths(a: Matrix, b: Matrix, buckets: int) -> DataFrame:
    """Exact entries per row and column bucket: from bitmaps of the buckets, or from the products where those are few."""
    group = bitmaps.bucket_group(buckets, b.cols)
    work = bitmaps.bitmap_work(a, b, group)

    def counted(positions: DataFrame) -> DataFrame:
        return positions.groupBy("i", column_bucket(F.col("j"), buckets, b.cols).alias("b")).agg(F.count(F.lit(1)).alias("nnz"))

    if in_blocks(work):
        lengths, rest = blocks.block_lengths(left_side(a), right_side(b), work["products"], "nnz", buckets, b.cols)
        parts = [lengths, *(counted(joined_positions(*sides)) for sides in rest)]
        return reduce(DataFrame.unionByName, parts).groupBy("i", "b").agg(F.sum("nnz").alias("nnz"))
    if in_groups(work):
        lengths, rest = grouped.grouped_lengths(left_side(a), right_side(b), a.rows, "nnz", buckets, b.cols)
        return lengths if rest is None else lengths.unionByName(counted(pair_positions(rest, b)))
    if bitmaps.by_bitmaps(work):
        return bitmaps.bitmap_lengths(a, b, group, work, "nnz")
    return counted(symbolic(a, b))


def length_statistics(m: Matrix) -> DataFrame:
    """Mean, sample deviation, least and greatest row length over every row of the shape.

    Empty rows enter through the shape, so no row has to be made for them.
    """
    rows = F.lit(float(m.rows))
    sums = row_lengths(m).agg(
        F.count(F.lit(1)).alias("stored"),
        F.coalesce(F.sum("nnz"), F.lit(0)).alias("total"),
        F.coalesce(F.sum(F.col("nnz").cast("double") * F.col("nnz")), F.lit(0.0)).alias("squares"),
        F.coalesce(F.max("nnz"), F.lit(0)).alias("max_nnz"),
        F.coalesce(F.min("nnz"), F.lit(0)).alias("min_stored"),
    )
    mean = F.col("total") / rows
    spread = F.col("squares") - F.col("total").cast("double") * F.col("total") / rows
    deviation = F.sqrt(F.greatest(spread, F.lit(0.0)) / F.lit(float(max(m.rows - 1, 1))))
    return sums.select(
        mean.alias("mean_nnz"),
        (deviation if m.rows > 1 else F.lit(0.0)).alias("std_nnz"),
        "max_nnz",
        F.when(F.col("stored") < m.rows, F.lit(0)).otherwise(F.col("min_stored")).cast("long").alias("min_nnz"),
    )


def sparsity(m: Matrix) -> DataFrame:
    """Shape, stored entries and percent of empty positions, in DOUBLE so no product overflows."""
    positions = F.lit(float(m.rows)) * F.lit(float(m.cols))
    return m.entries.agg(F.count(F.lit(1)).alias("nnz")).select(
        F.lit(m.rows).cast("long").alias("rows"),
        F.lit(m.cols).cast("long").alias("cols"),
        "nnz",
        ((1.0 - F.col("nnz") / positions) * 100.0).alias("sparsity_pct"),
    )


# --- bins ---------------------------------------------------------------------


def binned(estimates: DataFrame, estimate: Column) -> DataFrame:
    """``(i, est, slots, bin)``: accumulator size and bin of every row."""
    slots = table_size(estimate)
    return estimates.select("i", estimate.alias("est"), slots.alias("slots"), size_bin(slots).alias("bin"))


def bin_histogram(bins: DataFrame) -> DataFrame:
    return bins.groupBy("bin").agg(F.count(F.lit(1)).alias("rows"))


def bin_positions(bins: DataFrame, rows: int) -> DataFrame:
    """Each row's place when rows are laid out bin after bin, by row number inside a bin."""
    placed = ranked(bins, "i", rows, ("bin",), "pos")
    starts = prefix_sum(bin_histogram(bins), "bin", F.col("rows"), 64, name="start").select("bin", "start")
    return placed.join(starts, "bin").select("i", "bin", "pos", (F.col("start") + F.col("pos")).alias("slot"))


# --- accumulator choice per row -------------------------------------------------

SIZE_CLASSES = 6


def size_class(count: Column, largest_table: int) -> Column:
    """Class 1..5 for rows below ``largest_table``, halving per class; 0 for rows that need a spill."""
    rule = F.lit(0)
    for number in range(1, SIZE_CLASSES):
        rule = F.when(count < (largest_table >> (number - 1)), F.lit(number)).otherwise(rule)
    return rule.cast("long")


def accumulator_choice(a: Matrix, b: Matrix, largest_table: int = 8192, density_pct: int = 10) -> DataFrame:
    """Per row: accumulator kind and size class.

    ``direct`` for rows with one entry of ``A`` (a scaled copy), ``dense`` for
    rows whose entries may exceed the largest table or fill ``density_pct``
    percent of their column range, else ``hash``.
    """
    facts = (
        product_counts(a, b)
        .join(row_lengths(a), "i")
        .join(output_column_range(a, b), "i")
        .withColumn("bound", F.least(F.col("products"), F.lit(b.cols)))
    )
    wide = power_of_two(F.col("width_class"))
    column_range = F.least(F.lit(b.cols) - F.col("first_col"), wide)
    crowded = F.col("bound") * 100 > column_range * density_pct
    kind = (
        F.when(F.col("nnz") == 1, F.lit("direct"))
        .when((F.col("bound") >= largest_table) | crowded, F.lit("dense"))
        .otherwise(F.lit("hash"))
    )
    return facts.select(
        "i", "nnz", "products", kind.alias("kind"), size_class(F.col("bound"), largest_table).alias("size_class")
    )


# --- inequality of row work -----------------------------------------------------


def work_curve(work: DataFrame, value: str, largest: int) -> DataFrame:
    """Lorenz curve of the work, heaviest rows first: one point per distinct value.

    Rows of equal work are one histogram entry, so the scan runs over distinct
    values; ``largest`` bounds them.
    """
    counts = histogram(work, value).withColumn("down", F.lit(largest) - F.col(value))
    sums = counts.withColumn("work", F.col(value) * F.col("n"))
    both = prefix_sums(sums, "down", {"rows_before": F.col("n"), "work_before": F.col("work")}, largest + 1)
    return both.select(
        F.col(value).alias("value"), "n", "rows_before", "work_before",
        (F.col("rows_before") + F.col("n")).alias("rows_upto"),
        (F.col("work_before") + F.col("work")).alias("work_upto"),
    )


def top_share(curve: DataFrame, rows: int, work: int, share: float = 0.2) -> DataFrame:
    """Percent of the work held by the heaviest ``max(1, round(share * rows))`` rows."""
    k = max(1, round(share * rows))
    taken = F.least(F.col("n"), F.greatest(F.lit(k) - F.col("rows_before"), F.lit(0)))
    return curve.agg(
        F.lit(k).cast("long").alias("rows_taken"),
        (F.sum(taken * F.col("value")) * 100.0 / F.lit(float(work))).alias("share_pct"),
    )
