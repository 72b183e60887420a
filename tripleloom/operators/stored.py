"""Products over a stored layout: both factors kept bucketed and sorted on the inner key.

The factors are written once as tables whose buckets are the join's partitions.  A product of them merges
bucket with bucket and shuffles no input, however often it is repeated; the products go by range of row and
column bucket, so the result's files can be pruned by both.  Hot inner keys are cut into blocks before they
are stored, and the blocks are part of the buckets' key.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleloom.functions.scalar import column_bucket
from tripleloom.matrix import Matrix
from tripleloom.operators.multiply import left_side, product_value, right_side
from tripleloom.plans.workload import TASK_PRODUCTS, measure, split_hot_keys
from tripleloom.session import keep_until_cleared, shared_folder


@dataclass(frozen=True)
class StoredFactors:
    """Names of both tables, the columns they meet on, the number of buckets, and the shape of the product."""

    left: str
    right: str
    keys: tuple[str, ...]
    buckets: int
    rows: int
    cols: int


def store_factors(a: Matrix, b: Matrix, task_products: int = TASK_PRODUCTS) -> StoredFactors:
    """Write both factors of ``A·B`` in as many buckets as the counted products need."""
    a.require_inner(b)
    left, right = left_side(a), right_side(b)
    work = measure(left, right, task_products)
    keys = ("k", "ls", "rs") if work.hot_keys else ("k",)
    if work.hot_keys:
        left, right = split_hot_keys(left, right, work, task_products)
    usual = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(usual, work.partitions(task_products))
    return StoredFactors(_stored(left, keys, "i", buckets), _stored(right, keys, "j", buckets), keys, buckets, a.rows, b.cols)


def _stored(side: DataFrame, keys: tuple[str, ...], outer: str, buckets: int) -> str:
    """One sorted file per bucket, in the shared folder."""
    spark = side.sparkSession
    name = f"tripleloom_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    dealt = side.repartition(buckets, *keys).write.format("parquet").option("path", path)
    dealt.bucketBy(buckets, *keys).sortBy(*keys, outer).saveAsTable(name)
    keep_until_cleared(path, name)
    return name


def stored_product(spark, factors: StoredFactors, buckets: int = 5, upper: bool = False) -> DataFrame:
    """``(i, j, b, v)``: the product by merging stored buckets, partitioned by range of ``(i, b)``."""
    left, right = spark.table(factors.left), spark.table(factors.right)
    pairs = left.join(right.hint("merge"), list(factors.keys))
    if upper:
        pairs = pairs.where("j >= i")
    placed = pairs.select("i", column_bucket(F.col("j"), buckets, factors.cols).alias("b"), "j", product_value().alias("p"))
    return placed.repartitionByRange(factors.buckets, "i", "b").groupBy("i", "b", "j").agg(F.sum("p").alias("v")).select("i", "j", "b", "v")
