"""Work profile of a product, and the split of its hot inner keys.

A product ``A·B`` makes ``nnz(A[:,k]) * nnz(B[k,:])`` intermediate products for
each inner key ``k``.  Input sizes do not show this, so neither size statistics
nor adaptive execution can balance it.  One aggregation over the keys measures
it; keys above the budget of a task are then cut into a grid of blocks.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleloom.plans.sizing import BROADCAST_ROWS

# Intermediate products one task is meant to make.
TASK_PRODUCTS = 1 << 22
# More join partitions than this cost more in scheduling than they balance.
MOST_PARTITIONS = 200_000


@dataclass(frozen=True)
class Workload:
    products: int
    largest_key: int
    inner_keys: int
    hot_keys: int
    left_nnz: int
    right_nnz: int
    longest_left_column: int
    longest_right_row: int
    longest_left_row: int = 0
    longest_right_column: int = 0

    def partitions(self, task_products: int = TASK_PRODUCTS) -> int:
        return max(1, min(MOST_PARTITIONS, -(-self.products // task_products)))


def key_counts(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(k, lc, rc)``: entries of both sides per inner key that occurs in both.

    ``left`` holds ``(i, k, lv)``, ``right`` holds ``(k, j, rv)``.
    """
    lc = left.groupBy("k").agg(F.count(F.lit(1)).alias("lc"))
    rc = right.groupBy("k").agg(F.count(F.lit(1)).alias("rc"))
    return lc.join(rc, "k")


def measure(left: DataFrame, right: DataFrame, task_products: int = TASK_PRODUCTS) -> Workload:
    """Run the profiling job: one row comes back, and each side is scanned once for all of its counts.

    An entry counts for its inner key (axis 0) and for its own line (axis 1 on the left, 2 on the right).
    """

    def counted(side: DataFrame, line: str, axis: int, name: str) -> DataFrame:
        places = F.array(F.struct(F.lit(0).alias("axis"), F.col("k").alias("at")), F.struct(F.lit(axis).alias("axis"), F.col(line).alias("at")))
        return side.select(F.inline(places)).groupBy("axis", "at").agg(F.count(F.lit(1)).alias(name))

    # Counts are multiplied as DECIMAL: two BIGINT counts may overflow.
    work = F.col("lc").cast("decimal(19,0)") * F.col("rc").cast("decimal(19,0)")
    of = lambda axis, name: F.when(F.col("axis") == axis, F.col(name))
    facts = {
        "products": F.sum("work"),
        "largest_key": F.max("work"),
        "inner_keys": F.count("work"),
        "hot_keys": F.count_if(F.col("work") > task_products),
        "left_nnz": F.sum(of(0, "lc")),
        "right_nnz": F.sum(of(0, "rc")),
        "longest_left_column": F.max(of(0, "lc")),
        "longest_right_row": F.max(of(0, "rc")),
        "longest_left_row": F.max(of(1, "lc")),
        "longest_right_column": F.max(of(2, "rc")),
    }
    both = counted(left, "i", 1, "lc").join(counted(right, "j", 2, "rc"), ["axis", "at"], "full_outer")
    by_key = both.select("axis", "lc", "rc", work.alias("work"))
    row = by_key.agg(*[column.alias(name) for name, column in facts.items()]).first()
    return Workload(**{name: int(row[name] or 0) for name in facts})


def hot_key_grid(left: DataFrame, right: DataFrame, task_products: int) -> DataFrame:
    """``(k, lparts, rparts)`` for keys whose products exceed the budget of a task.

    Both sides are cut so that a block pair makes about ``task_products``
    products.  A side shorter than ``sqrt(task_products)`` stays whole and the
    other one is cut finer, so copies stay below ``2 / sqrt(task_products)`` of
    the products.
    """
    edge = max(1, isqrt(task_products))

    def parts(own: str, other: str) -> Column:
        blocks = F.col(own).cast("double") * F.least(F.col(other), F.lit(edge)) / F.lit(float(task_products))
        return F.greatest(F.ceil(blocks), F.lit(1)).cast("int")

    work = F.col("lc").cast("double") * F.col("rc")
    return (
        key_counts(left, right)
        .where(work > float(task_products))
        .select("k", parts("lc", "rc").alias("lparts"), parts("rc", "lc").alias("rparts"))
    )


def split_hot_keys(
    left: DataFrame, right: DataFrame, workload: Workload, task_products: int = TASK_PRODUCTS
) -> tuple[DataFrame, DataFrame]:
    """Both sides with block columns ``(ls, rs)``; join on ``(k, ls, rs)``.

    Every pair of entries with equal ``k`` meets in exactly one block, so the
    join yields the same pairs as one on ``k`` alone.
    """
    grid = hot_key_grid(left, right, task_products)
    if workload.hot_keys <= BROADCAST_ROWS:
        grid = F.broadcast(grid)

    def own_block(coordinate: str, parts: str) -> Column:
        return F.pmod(F.xxhash64(coordinate), F.coalesce(F.col(parts), F.lit(1))).cast("int")

    def every_block(parts: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.coalesce(F.col(parts), F.lit(1)) - 1))

    cut_left = left.join(grid, "k", "left").select(
        "i", "k", "lv", own_block("i", "lparts").alias("ls"), every_block("rparts").alias("rs")
    )
    cut_right = right.join(grid, "k", "left").select(
        "k", "j", "rv", every_block("lparts").alias("ls"), own_block("j", "rparts").alias("rs")
    )
    return cut_left, cut_right


def co_partitioned(
    left: DataFrame, right: DataFrame, keys: list[str], partitions: int
) -> tuple[DataFrame, DataFrame]:
    """Both sides hashed on ``keys`` into a number of partitions that fits the products.

    The number is fixed where the products are more than one task is meant to make; adaptive
    execution would otherwise merge partitions that look small but multiply.
    """
    if partitions <= 1:
        return left, right
    partitions = max(partitions, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return left.repartition(partitions, *keys), right.repartition(partitions, *keys)
