"""Matrix times vector."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleloom.matrix import Matrix
from tripleloom.plans.sizing import broadcast_if_small


def spmv(a: Matrix, x: DataFrame, all_rows: bool = True) -> DataFrame:
    """``y = A·x`` for a vector ``(j, x)``, as ``(i, y)``.

    With ``all_rows`` every row of the matrix is present and empty ones are 0.
    """
    sums = (
        a.entries.join(broadcast_if_small(x), "j")
        .groupBy("i")
        .agg(F.sum(F.col("v") * F.col("x")).alias("y"))
    )
    return with_empty_rows(sums, a.rows) if all_rows else sums


def spmv_transposed(a: Matrix, x: DataFrame, all_rows: bool = True) -> DataFrame:
    """``y = Aᵀ·x`` for a vector ``(j, x)`` over the rows of ``A``."""
    return spmv(a.T, x, all_rows)


def with_empty_rows(sums: DataFrame, rows: int) -> DataFrame:
    every = sums.sparkSession.range(rows).select(F.col("id").alias("i"))
    return every.join(sums, "i", "left").select("i", F.coalesce("y", F.lit(0.0)).alias("y"))


def vector_diff(expected: DataFrame, actual: DataFrame, relative: float = 1e-8) -> DataFrame:
    """Positions ``(i, expected, actual)`` where ``|e - a| > relative * |e|`` or one side is missing."""
    e = expected.select("i", F.col("y").alias("expected"))
    a = actual.select("i", F.col("y").alias("actual"))
    bad = F.abs(F.col("expected") - F.col("actual")) > F.abs("expected") * F.lit(relative)
    return e.join(a, "i", "full_outer").where(bad | F.col("expected").isNull() | F.col("actual").isNull())
