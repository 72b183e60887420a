"""Comparison of two matrices: structure by keys, values by tolerance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleloom.matrix import Matrix


def aligned(expected: Matrix, actual: Matrix) -> DataFrame:
    """``(i, j, e, a)`` over the positions of either matrix; a missing side is NULL."""
    e = expected.entries.select("i", "j", F.col("v").alias("e"))
    a = actual.entries.select("i", "j", F.col("v").alias("a"))
    return e.join(a, ["i", "j"], "full_outer")


def difference(expected: Matrix, actual: Matrix, tolerance: float = 1e-9) -> DataFrame:
    """One row: key counts per side, errors against the largest magnitude, and the verdict.

    The scale is the largest ``|v|`` of both, at least 1: entries cancelled to
    nearly zero would look huge against themselves.
    """
    both = aligned(expected, actual).select(
        "e", "a", F.abs(F.col("e") - F.col("a")).alias("err"),
        F.greatest(F.abs("e"), F.abs("a")).alias("size"),
    )
    sums = both.agg(
        F.count_if(F.col("e").isNotNull() & F.col("a").isNotNull()).alias("common"),
        F.count_if(F.col("a").isNull()).alias("only_expected"),
        F.count_if(F.col("e").isNull()).alias("only_actual"),
        F.coalesce(F.max("err"), F.lit(0.0)).alias("max_abs_err"),
        F.greatest(F.coalesce(F.max("size"), F.lit(1.0)), F.lit(1.0)).alias("scale"),
    )
    relative = F.col("max_abs_err") / F.col("scale")
    same_keys = (F.col("only_expected") == 0) & (F.col("only_actual") == 0)
    return sums.select(
        "common", "only_expected", "only_actual", "max_abs_err", "scale",
        relative.alias("max_rel_err"), (same_keys & (relative <= tolerance)).alias("passed"),
    )


def mismatches(expected: Matrix, actual: Matrix, tolerance: float = 1e-9) -> DataFrame:
    """Positions that differ: missing on one side, or ``|e - a| > tolerance * max(|e|, |a|)``."""
    d = F.abs(F.col("e") - F.col("a"))
    size = F.greatest(F.abs("e"), F.abs("a"))
    bad = F.col("e").isNull() | F.col("a").isNull() | (d > size * F.lit(tolerance))
    return aligned(expected, actual).where(bad)


def equal(expected: Matrix, actual: Matrix, tolerance: float = 1e-9) -> bool:
    """Same shape, same positions, values within the tolerance of each pair."""
    if (expected.rows, expected.cols) != (actual.rows, actual.cols):
        return False
    return mismatches(expected, actual, tolerance).isEmpty()


def same_structure(expected: Matrix, actual: Matrix) -> bool:
    """Same shape and positions, values aside."""
    if (expected.rows, expected.cols) != (actual.rows, actual.cols):
        return False
    return aligned(expected, actual).where("e IS NULL OR a IS NULL").isEmpty()


def key_sets(expected: Matrix, actual: Matrix) -> DataFrame:
    """``(i, j, side)`` with side ``expected``, ``actual`` or ``both``."""
    side = (
        F.when(F.col("a").isNull(), F.lit("expected"))
        .when(F.col("e").isNull(), F.lit("actual"))
        .otherwise(F.lit("both"))
    )
    return aligned(expected, actual).select("i", "j", side.alias("side"))
