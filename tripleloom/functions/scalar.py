"""Scalar rules: column buckets, table sizes, bins, density classes, tolerant parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tripleloom.functions.hashing import bit_length32, power_of_two

# Accumulator sizing.
SMALLEST_TABLE = 32
LARGEST_TABLE = 16384
TINY_ROW = 16
TINY_BIN = 10
TABLE_BINS = 10

# Density classes by percent of stored positions, densest first.
DENSITY_CLASSES = (
    ("Dense", 10.0),
    ("Mildly sparse", 1.0),
    ("Highly sparse", 0.1),
    ("Extremely sparse", None),
)
UNKNOWN_CLASS = "?"


def column_bucket(j: Column, k: int, n: int) -> Column:
    """Bucket ``b`` of ``k`` with ``floor(b*n/k) <= j < floor((b+1)*n/k)``."""
    return whole((j.cast("long") + 1) * F.lit(k) - 1, n)


def whole(x: Column, y: int) -> Column:
    """Whole part of ``x / y`` for ``x >= 0``, in BIGINT arithmetic."""
    return F.call_function("div", x.cast("long"), F.lit(y).cast("long"))


def table_size(estimate: Column) -> Column:
    """Slots for an estimated row length: as is up to 16, else the next power of two in [32, 16384]."""
    e = estimate.cast("long")
    next_power = power_of_two(bit_length32(e - 1))
    return F.when(e <= TINY_ROW, e).otherwise(
        F.greatest(F.lit(SMALLEST_TABLE), F.least(F.lit(LARGEST_TABLE), next_power))
    )


def size_bin(size: Column) -> Column:
    """Bin 0..9 for table sizes 32..16384, bin 10 for tiny rows."""
    e = size.cast("long")
    wanted = F.least(F.greatest(bit_length32(e - 1) - 5, F.lit(0)), F.lit(TABLE_BINS - 1))
    return F.when(e <= TINY_ROW, F.lit(TINY_BIN)).otherwise(wanted).cast("long")


def doubling_bin(count: Column, first: int, tiny: int, bins: int) -> Column:
    """Bin of a row length for limits ``first * 2**b``.

    Rows up to ``tiny`` fall in bin 0, the last bin takes what exceeds every limit.
    """
    c = count.cast("long")
    rule = F.when(c <= tiny, F.lit(0))
    for b in range(bins - 2):
        rule = rule.when(c <= (first << b), F.lit(b + 1))
    return rule.otherwise(F.lit(bins - 1)).cast("long")


def density_class(density_pct: Column) -> Column:
    rule = F.when(density_pct.isNull() | F.isnan(density_pct), F.lit(UNKNOWN_CLASS))
    for name, floor in DENSITY_CLASSES[:-1]:
        rule = rule.when(density_pct >= floor, F.lit(name))
    return rule.otherwise(F.lit(DENSITY_CLASSES[-1][0]))


def looked_up(key: Column, names: dict, otherwise=None) -> Column:
    """The value of a short fixed mapping; ``otherwise`` for other keys."""
    found = F.lit(otherwise)
    for name, value in names.items():
        found = F.when(key == name, F.lit(value)).otherwise(found)
    return found


def class_rank(name: Column) -> Column:
    """Position of a class in reports; unknown names come last."""
    return looked_up(name, {label: n for n, (label, _) in enumerate(DENSITY_CLASSES)}, 99)


def number_or_null(text: Column) -> Column:
    """A measured time; blank, ``DNF``, ``timeout`` and ``fail`` become NULL."""
    return text.try_cast("double")


def geomean(x: Column) -> Column:
    """Geometric mean over the positive values."""
    return F.exp(F.avg(F.when((x > 0) & (x < float("inf")), F.ln(x))))


def log10_floor1(x: Column) -> Column:
    return F.log10(F.greatest(x.cast("double"), F.lit(1.0)))
