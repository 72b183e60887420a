"""Sparse products: a join on the inner index and a grouped sum.

All methods give the same entries.  An entry exists where at least one product
contributes, even if the sum is 0.0.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleloom.functions.scalar import column_bucket
from tripleloom.matrix import Matrix
from tripleloom.operators import bitmaps, blocks, grouped
from tripleloom.operators.masked import masked_product
from tripleloom.operators.reshape import mirrored
from tripleloom.operators.sketches import estimated_entries
from tripleloom.operators.tiles import tiled_product
from tripleloom.plans.sizing import BROADCAST_ROWS, broadcast_if_small
from tripleloom.session import written
from tripleloom.plans.workload import (
    MOST_PARTITIONS,
    TASK_PRODUCTS,
    Workload,
    co_partitioned,
    measure,
    split_hot_keys,
)

#: Entries of the result that one task is meant to add up, about 100 MB of rows.
RESULT_ROWS = 1 << 22
#: Products per entry of the sides from which row groups add up faster than a broadcast join.
CROWDED = 64
METHODS = ("auto", "rowwise", "columnwise", "outer", "inner", "merge", "broadcast", "bucketed", "tiled")


def left_side(a: Matrix) -> DataFrame:
    return a.entries.select("i", F.col("j").alias("k"), F.col("v").alias("lv"))


def right_side(b: Matrix) -> DataFrame:
    return b.entries.select(F.col("i").alias("k"), "j", F.col("v").alias("rv"))


def spgemm(
    a: Matrix,
    b: Matrix,
    method: str = "auto",
    upper: bool = False,
    buckets: int = 5,
    task_products: int = TASK_PRODUCTS,
    broadcast_rows: int = BROADCAST_ROWS,
    result_rows: int = RESULT_ROWS,
) -> Matrix:
    """``A·B``; with ``upper`` only entries with ``j >= i`` are made.

    ``auto`` measures the work per inner key, broadcasts a side of checked
    size, makes much work in groups of rows, or else joins on the inner key with
    hot keys cut into blocks and sends the products to as many partitions as the
    estimated result needs, ``result_rows`` each.
    """
    a.require_inner(b)
    method = method.lower()
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}, choose one of {', '.join(METHODS)}")
    if method == "tiled":
        return tiled_product(a, b, upper=upper)
    if method == "inner":
        # Positions come from bitmaps wherever two products share one, so that products are made once, in place.
        return masked_product(symbolic(a, b, upper, least=2), a, b)

    left, right = left_side(a), right_side(b)
    work = measure(left, right, task_products)
    if method == "auto":
        large = min(work.left_nnz, work.right_nnz) > broadcast_rows
        crowded = work.products > CROWDED * (work.left_nnz + work.right_nnz)
        if work.products > blocks.BLOCKED and (large or crowded):
            entries = added_in_blocks(left, right, work, upper, task_products)
        elif work.products > grouped.GROUPED and (large or crowded):
            entries, rest = grouped.grouped_sums(left, right, a.rows, upper, not large)
            if rest is not None:
                long = measure(rest, right, task_products)
                entries = entries.unionByName(sum_products(split_join(rest, right, long, upper, task_products)))
        elif large:
            entries = sized_sum(split_join(left, right, work, upper, task_products), a, b, work, task_products, result_rows)
        else:
            entries = over(planned_parts(left, right, work, upper, task_products, broadcast_rows), sum_products)
    elif method == "broadcast":
        entries = sum_products(broadcast_join(left, right, work, upper, broadcast_rows))
    elif method == "bucketed":
        entries = bucketed_sum(split_join(left, right, work, upper, task_products), buckets, b.cols).drop("b")
    elif method != "merge" and work.hot_keys and work.products > blocks.BLOCKED:
        # One grid of blocks for all hot keys, so that the products of a position meet where they are made.
        entries = added_in_blocks(left, right, work, upper, task_products, min(blocks.MADE, task_products))
    else:
        pairs = split_join(left, right, work, upper, task_products, method)
        entries = sized_sum(pairs, a, b, work, task_products, result_rows)
    return Matrix(entries, a.rows, b.cols)


def added_in_blocks(
    left: DataFrame, right: DataFrame, work: Workload, upper: bool, task_products: int, most: int = blocks.MADE
) -> DataFrame:
    """The sums ``(i, j, v)``, those of heavy lines by joins; no position has parts in both."""
    entries, rest = blocks.block_sums(left, right, work.products, upper, most)
    for mine, other in rest:
        long = measure(mine, other, task_products)
        entries = entries.unionByName(sum_products(split_join(mine, other, long, upper, task_products)))
    return entries


def outer_gram(a: Matrix, upper: bool = True, **options) -> Matrix:
    """``A·Aᵀ`` (rows by rows), by default its upper triangle."""
    return spgemm(a, a.T, upper=upper, **options)


def inner_gram(a: Matrix, upper: bool = True, **options) -> Matrix:
    """``Aᵀ·A`` (columns by columns), by default its upper triangle."""
    return spgemm(a.T, a, upper=upper, **options)


def self_product(a: Matrix, **options) -> Matrix:
    """``A·A`` for a square matrix, ``A·Aᵀ`` in full for any other."""
    return spgemm(a, a if a.is_square else a.T, **options)


def square_product(a: Matrix, **options) -> Matrix:
    """``A·A``; refuses a matrix that is not square."""
    a.require_square()
    return spgemm(a, a, **options)


def symmetric_from_upper(m: Matrix) -> Matrix:
    """The whole symmetric matrix from its upper triangle."""
    return mirrored(m)


def gram_by_symmetry(a: Matrix, **options) -> Matrix:
    """``A·Aᵀ`` in full at half the products: upper triangle, then its mirror image."""
    return symmetric_from_upper(outer_gram(a, upper=True, **options))


def symbolic(a: Matrix, b: Matrix, upper: bool = False, least: int = bitmaps.DENSE) -> DataFrame:
    """Positions ``(i, j)`` of the product, without values: from merged bitmaps, or from the products where those are few.

    ``least`` is the number of products per merged bitmap from which bitmaps are taken.
    """
    work = bitmaps.bitmap_work(a, b, {})
    if in_blocks(work):
        positions, rest = blocks.block_positions(left_side(a), right_side(b), work["products"], upper)
        return reduce(DataFrame.unionByName, [positions, *(joined_positions(*sides, upper) for sides in rest)])
    if in_groups(work):
        positions, rest = grouped.grouped_positions(left_side(a), right_side(b), a.rows, upper)
        return positions if rest is None else positions.unionByName(pair_positions(rest, b, upper))
    if bitmaps.by_bitmaps(work, least):
        positions = bitmaps.bitmap_positions(a, b, work)
        return positions.where("j >= i") if upper else positions
    return pair_positions(left_side(a), b, upper)


def in_groups(work: dict[str, int]) -> bool:
    """Whether the structure is made in row groups: much work, and more bitmaps than are broadcast."""
    return work["products"] > grouped.GROUPED and work["bitmaps"] > bitmaps.BROADCAST_BITMAPS


def in_blocks(work: dict[str, int]) -> bool:
    """Whether it is made in blocks: more work than few row groups do."""
    return work["products"] > blocks.BLOCKED and work["bitmaps"] > bitmaps.BROADCAST_BITMAPS


def pair_positions(left: DataFrame, b: Matrix, upper: bool = False) -> DataFrame:
    return joined_positions(left, right_side(b), upper)


def joined_positions(left: DataFrame, right: DataFrame, upper: bool = False) -> DataFrame:
    return over(planned(left, right, upper), lambda pairs: pairs.select("i", "j").distinct())


def output_row_lengths(a: Matrix, b: Matrix) -> DataFrame:
    """Exact entries per product row."""
    work = bitmaps.bitmap_work(a, b, {})
    if in_blocks(work):
        lengths, rest = blocks.block_lengths(left_side(a), right_side(b), work["products"], "c_nnz")
        parts = [lengths, *(joined_positions(*sides).groupBy("i").agg(F.count(F.lit(1)).alias("c_nnz")) for sides in rest)]
        return reduce(DataFrame.unionByName, parts).groupBy("i").agg(F.sum("c_nnz").alias("c_nnz"))
    if in_groups(work):
        lengths, rest = grouped.grouped_lengths(left_side(a), right_side(b), a.rows, "c_nnz")
        return lengths if rest is None else lengths.unionByName(pair_lengths(rest, b))
    if bitmaps.by_bitmaps(work):
        return bitmaps.bitmap_lengths(a, b, work=work)
    return pair_lengths(left_side(a), b)


def pair_lengths(left: DataFrame, b: Matrix) -> DataFrame:
    return pair_positions(left, b).groupBy("i").agg(F.count(F.lit(1)).alias("c_nnz"))


def numeric(structure: DataFrame, a: Matrix, b: Matrix) -> Matrix:
    """Values for a known structure; no other position is multiplied."""
    return masked_product(structure, a, b)


def bucketed_product(a: Matrix, b: Matrix, buckets: int = 5, upper: bool = False) -> DataFrame:
    """The product with the column bucket ``b`` of every entry as part of the shuffle key."""
    a.require_inner(b)
    left, right = left_side(a), right_side(b)
    pairs = split_join(left, right, measure(left, right), upper, TASK_PRODUCTS)
    return bucketed_sum(pairs, buckets, b.cols)


def products(a: Matrix, b: Matrix) -> DataFrame:
    """The intermediate products ``(i, j, p)`` before they are added up."""
    left, right = left_side(a), right_side(b)
    return split_join(left, right, measure(left, right), False, TASK_PRODUCTS)


# --- joins --------------------------------------------------------------------


def joined(one: DataFrame, other: DataFrame, keys: list[str], upper: bool) -> DataFrame:
    pairs = one.join(other, keys)
    if upper:
        pairs = pairs.where(F.col("j") >= F.col("i"))
    return pairs.select("i", "j", product_value().alias("p"))


def broadcast_join(left: DataFrame, right: DataFrame, work: Workload, upper: bool, broadcast_rows: int) -> DataFrame:
    """The products with ``B`` broadcast; above the bound in slices, one after another, whose products are written.

    Only one slice is then held by the driver and the tasks at a time.
    """
    if work.right_nnz <= broadcast_rows:
        return joined(left, F.broadcast(right), ["k"], upper)
    slices = -(-work.right_nnz * 5 // (broadcast_rows * 4))
    # A row of B beyond the bound is cut as well; its slices then meet the whole of A.
    cut = work.longest_right_row > broadcast_rows
    at = F.pmod(F.xxhash64("k", "j") if cut else F.xxhash64("k"), F.lit(slices))
    parts = []
    for n in range(slices):
        mine = left if cut else left.where(at == n)
        parts.append(written(joined(mine, F.broadcast(right.where(at == n)), ["k"], upper)))
    return reduce(DataFrame.unionByName, parts)


def product_value() -> Column:
    return F.col("lv") * F.col("rv")


def sum_products(pairs: DataFrame) -> DataFrame:
    """Added up per map task before the shuffle on ``(i, j)``, then once more after it."""
    return pairs.groupBy("i", "j").agg(F.sum("p").alias("v"))


def sized_sum(pairs: DataFrame, a: Matrix, b: Matrix, work: Workload, task_products: int, result_rows: int) -> DataFrame:
    """``sum_products`` with the exchange on ``(i, j)`` sized by the result.

    The products bound the result; only where they are many, or that bound needs more partitions than the session has,
    are its entries estimated, from sketches.  A position's products come from
    inner keys in different tasks then: adding up before the shuffle would not shrink it, unless
    positions have more products than there are tasks.
    """
    usual = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    many = work.products > grouped.GROUPED
    if work.products <= usual * result_rows and not many:
        return sum_products(pairs)
    entries = min(estimated_entries(a, b), work.products)
    wanted = min(MOST_PARTITIONS, -(-entries // result_rows))
    if many:
        wanted = max(wanted, usual + 1, work.partitions())
    if wanted <= usual or work.products > 2 * entries * max(usual, work.partitions(task_products)):
        return sum_products(pairs)
    return sum_products(pairs.repartition(wanted, "i", "j"))


def bucketed_sum(pairs: DataFrame, buckets: int, cols: int) -> DataFrame:
    return (
        pairs.withColumn("b", column_bucket(F.col("j"), buckets, cols))
        .groupBy("i", "b", "j")
        .agg(F.sum("p").alias("v"))
        .select("i", "j", "b", "v")
    )


def split_join(
    left: DataFrame, right: DataFrame, work: Workload, upper: bool, task_products: int, order: str = "outer"
) -> DataFrame:
    """Join on the inner key, hot keys cut into a grid of blocks.

    ``order`` decides which side is streamed: rows of ``A`` (``rowwise``),
    columns of ``B`` (``columnwise``), or both sides sorted on the inner key
    (``merge``).  ``outer`` fixes the partitions on the inner key beforehand
    where the products need more of them than the session has.
    """
    keys = ["k", "ls", "rs"] if work.hot_keys else ["k"]
    if work.hot_keys:
        left, right = split_hot_keys(left, right, work, task_products)
    if order == "merge":
        return joined(left, right.hint("merge"), keys, upper)
    left, right = co_partitioned(left, right, keys, work.partitions(task_products))
    return joined(right, left, keys, upper) if order == "columnwise" else joined(left, right, keys, upper)


def planned(left: DataFrame, right: DataFrame, upper: bool = False) -> list[DataFrame]:
    """The products by the measured plan, see ``planned_parts``."""
    return planned_parts(left, right, measure(left, right), upper, TASK_PRODUCTS, BROADCAST_ROWS)


def over(parts: list[DataFrame], aggregate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """An aggregation on ``(i, j)`` of every part, put together."""
    return reduce(DataFrame.unionByName, map(aggregate, parts))


def planned_parts(
    left: DataFrame, right: DataFrame, work: Workload, upper: bool, task_products: int, broadcast_rows: int
) -> list[DataFrame]:
    """The products in parts that share no position ``(i, j)``, so each is added up on its own."""
    if min(work.left_nnz, work.right_nnz) > broadcast_rows:
        return [split_join(left, right, work, upper, task_products)]
    if work.right_nnz <= work.left_nnz:
        return streamed_join(left, "i", work.longest_left_row, right, work.longest_right_row, work, upper, task_products)
    return streamed_join(right, "j", work.longest_right_column, left, work.longest_left_column, work, upper, task_products)


def streamed_join(
    streamed: DataFrame,
    line: str,
    longest_line: int,
    small: DataFrame,
    longest_match: int,
    work: Workload,
    upper: bool,
    task_products: int,
) -> list[DataFrame]:
    """Join a streamed side, hashed on its outer index ``line``, with a broadcast side.

    All products of a row (or column) of the result then meet in one task, so
    they are added up where they are made and never shuffled.  Lines that could
    exceed the budget of a task stay where they were read and take the usual
    way: added up per task, then shuffled on ``(i, j)``.
    """
    usual = int(streamed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    partitions = max(usual, work.partitions(task_products))
    small = F.broadcast(small)
    if longest_line * longest_match <= task_products:
        return [joined(streamed.repartition(partitions, line), small, ["k"], upper)]
    allowed = task_products // max(longest_match, 1)
    long_lines = streamed.groupBy(line).count().where(F.col("count") > allowed).select(line)
    # Few by their size: each holds more than ``allowed`` of the streamed entries.
    long_lines = broadcast_if_small(long_lines)
    short = streamed.join(long_lines, line, "left_anti").repartition(partitions, line)
    long = streamed.join(long_lines, line, "left_semi").repartition(partitions, line, "k")
    return [joined(short, small, ["k"], upper), joined(long, small, ["k"], upper)]
