"""Prefix sums, ranks and order statistics without a window over a whole group.

The ordering key is cut into blocks.  A window runs inside each block, a second
one over the block totals; both stay near the square root of the key range, so
a group holding most of the data is still spread over many tasks.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripleloom.functions.scalar import whole
from tripleloom.plans.sizing import BROADCAST_ROWS, WINDOW_ROWS
from tripleloom.session import written


def block_edge(extent: int) -> int:
    """Edge of a block for keys in ``[0, extent)``."""
    return max(1, isqrt(max(extent - 1, 0)) + 1)


def largest_group(df: DataFrame, groups: tuple[str, ...]) -> int:
    """Rows of the largest group."""
    return int(df.groupBy(*groups).count().agg(F.max("count")).first()[0] or 0)


def prefix_sums(
    df: DataFrame, order: str, values: dict[str, Column], extent: int, groups: tuple[str, ...] = ()
) -> DataFrame:
    """``df`` with each named column = sum of its value over smaller ``order`` keys of the same group.

    ``order`` must be a whole number in ``[0, extent)``, once per group.  Groups
    that were counted to be small go through one window each.
    """
    keys = list(groups)
    names = list(values)
    upto = (Window.unboundedPreceding, -1)
    if keys and largest_group(df, groups) <= WINDOW_ROWS:
        whole_group = Window.partitionBy(*keys).orderBy(order).rowsBetween(*upto)
        return df.select("*", *[F.coalesce(F.sum(v).over(whole_group), F.lit(0)).alias(n) for n, v in values.items()])

    cut = df.select(
        "*", whole(F.col(order), block_edge(extent)).alias("__block"), *[v.alias(f"__{n}") for n, v in values.items()]
    )
    across = Window.partitionBy(*keys).orderBy("__block").rowsBetween(*upto)
    offsets = cut.groupBy(*keys, "__block").agg(*[F.sum(f"__{n}").alias(n) for n in names])
    offsets = offsets.select(
        *keys, "__block", *[F.coalesce(F.sum(n).over(across), F.lit(0)).alias(f"__offset_{n}") for n in names]
    )
    within = Window.partitionBy(*keys, "__block").orderBy(order).rowsBetween(*upto)
    local = cut.select(
        *df.columns, "__block", *[F.coalesce(F.sum(f"__{n}").over(within), F.lit(0)).alias(f"__local_{n}") for n in names]
    )
    return local.join(offsets, [*keys, "__block"]).select(
        *df.columns, *[(F.col(f"__offset_{n}") + F.col(f"__local_{n}")).alias(n) for n in names]
    )


def prefix_sum(
    df: DataFrame, order: str, value: Column, extent: int, groups: tuple[str, ...] = (), name: str = "before"
) -> DataFrame:
    """One exclusive prefix sum, see ``prefix_sums``."""
    return prefix_sums(df, order, {name: value}, extent, groups)


def ranked(df: DataFrame, order: str, extent: int, groups: tuple[str, ...] = (), name: str = "rank") -> DataFrame:
    """Zero-based position of each row in its group by ``order``."""
    return prefix_sum(df, order, F.lit(1).cast("long"), extent, groups, name)


def histogram(df: DataFrame, value: str, groups: tuple[str, ...] = ()) -> DataFrame:
    """``(groups, value, n)``; repeated values collapse before any scan."""
    return df.groupBy(*groups, value).agg(F.count(F.lit(1)).alias("n"))


def magnitude_block(x: Column, per_octave: int) -> Column:
    """A whole number that never falls as ``x`` rises: signed logarithmic steps, 0 for 0."""
    steps = F.floor(F.log2(F.abs(x)) * F.lit(per_octave)) + F.lit(2000 * per_octave)
    return F.when(x == 0, F.lit(0)).when(x > 0, steps).otherwise(-steps - 1).cast("long")


def value_levels(value: str) -> list[Column]:
    """Ordering levels for a numeric column: coarse blocks, fine blocks, the value."""
    x = F.col(value).cast("double")
    return [magnitude_block(x, 1 << 10), magnitude_block(x, 1 << 20), x]


def id_levels(key: str, extent: int) -> list[Column]:
    """Ordering levels for a whole-number column in ``[0, extent)``."""
    return [whole(F.col(key), block_edge(extent)), F.col(key)]


def at_ranks(
    df: DataFrame, targets: DataFrame, levels: list[Column], groups: tuple[str, ...], keep: list[str], weight: str | None = None
) -> DataFrame:
    """The row at each given position of its group's order.

    ``targets`` holds ``(groups, pick, rank)`` with zero-based ranks; ``groups``
    names at least one column.  The order is the lexicographic one of
    ``levels``.  A level counts its keys per group, finds the key that holds the
    rank, and narrows the rows to it, until the rows left for a target were
    counted to fit a window.  No group is sorted as a whole.

    With ``weight`` a row stands for so many equal ones; then the last level must be the
    one column of ``keep``, and its counted key is the answer.
    """
    keys = list(groups)
    names = [f"__level{n}" for n in range(len(levels))]
    size_of = [F.col(weight).alias("__w")] if weight else []
    rows = df.select(*keys, *keep, *size_of, *(c.alias(n) for c, n in zip(levels, names)))
    number = F.sum("__w") if weight else F.count(F.lit(1))
    found = targets.select(*keys, "pick", F.col("rank").alias("__rest"))
    depth = 0
    while True:
        name, fixed = names[depth], names[:depth]
        by = [*keys, "pick", "__rest", *fixed] if fixed else keys
        narrowed = rows.join(found, [*keys, *fixed]) if fixed else rows
        counts = narrowed.groupBy(*by, name).agg(number.alias("__n"))
        upto = Window.partitionBy(*by).orderBy(name).rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(upto), F.lit(0)))
        if not fixed:
            counts = counts.join(found, keys)
        inside = (F.col("__before") <= F.col("__rest")) & (F.col("__rest") < F.col("__before") + F.col("__n"))
        found = written(
            counts.where(inside).select(
                *keys, "pick", *fixed, name, (F.col("__rest") - F.col("__before")).alias("__rest"), "__n"
            )
        )
        size, largest = found.agg(F.count(F.lit(1)), F.max("__n")).first()
        found = found.drop("__n")
        if size <= BROADCAST_ROWS:
            found = F.broadcast(found)
        depth += 1
        if depth == len(names) and weight:
            return found.select(*keys, "pick", F.col(name).alias(keep[0]))
        if depth == len(names) or not weight and (largest or 0) <= WINDOW_ROWS:
            break
    left = rows.join(found, [*keys, *names[:depth]])
    inner = Window.partitionBy(*keys, "pick").orderBy(*(names[depth:] or [F.lit(0)]))
    return (
        left.withColumn("__at", F.row_number().over(inner) - 1)
        .where(F.col("__at") == F.col("__rest"))
        .select(*keys, "pick", *[k for k in keep if k not in keys])
    )


def values_at_ranks(df: DataFrame, value: str, targets: DataFrame, groups: tuple[str, ...]) -> DataFrame:
    """``(groups, pick, value)`` at the targeted positions of each group's sorted values.

    Equal values are counted first, so a column of few values is a few rows from then on.
    """
    counted = df.groupBy(*groups, F.col(value).cast("double").alias(value)).agg(F.count(F.lit(1)).alias("__weight"))
    return at_ranks(written(counted), targets, value_levels(value), groups, [value], "__weight")


def medians(df: DataFrame, value: str, groups: tuple[str, ...]) -> DataFrame:
    """``(groups, median)``, the mean of both middle values for an even count."""
    present = df.where(F.col(value).isNotNull())
    counts = present.groupBy(*groups).agg(F.count(F.lit(1)).alias("m"))
    ends = F.array(F.floor((F.col("m") - 1) / 2), F.floor(F.col("m") / 2))
    targets = counts.select(*groups, F.posexplode(ends).alias("pick", "rank"))
    return values_at_ranks(present, value, targets, groups).groupBy(*groups).agg(F.avg(value).alias("median"))


def quantiles(df: DataFrame, value: str, at: list[float], groups: tuple[str, ...]) -> DataFrame:
    """``(groups, q, x)``: exact quantiles, linear between the neighbouring values."""
    present = df.where(F.col(value).isNotNull())
    counts = present.groupBy(*groups).agg(F.count(F.lit(1)).alias("m"))
    spots = counts.select(*groups, "m", F.posexplode(F.array(*map(F.lit, at))).alias("n", "q")).select(
        *groups, "n", "q", (F.col("q") * (F.col("m") - 1)).alias("at")
    )
    ends = spots.select(
        *groups, "q", (F.col("at") - F.floor("at")).alias("share"),
        F.posexplode(F.array(F.floor("at"), F.ceil("at"))).alias("end", "rank"), "n",
    ).withColumn("pick", F.col("n") * 2 + F.col("end"))
    found = values_at_ranks(present, value, ends, groups)
    low = F.max(F.when(F.col("end") == 0, F.col(value)))
    high = F.max(F.when(F.col("end") == 1, F.col(value)))
    return (
        ends.join(found, [*groups, "pick"])
        .groupBy(*groups, "q")
        .agg((low + (high - low) * F.max("share")).alias("x"))
    )
