"""Shards as runs of a Hilbert curve over several metadata dimensions.

Native: DataFrame functions only.  Each dimension is quantised to equal depth, numbers by
cut points and texts by their counted rank; the cell's place on the curve orders the rows, ties go by a hash of
the row.  The law is ``rows``: runs of the curve are cut at equal counts, so
shards differ by one row at most, and a file holds a compact box of every
dimension, which min/max statistics can prune.

Places are counted in two levels: rows per (curve index, block of the hash), then
a window inside one block.  The number of blocks follows the row count, so no window holds
more than about ``per_block`` rows even if all rows share one cell.

Defined results: a null dimension counts as the smallest value, a null text as
empty; rows equal in key and text are told apart by their place only and get
different slots; an empty table gives an empty table.
"""

from __future__ import annotations

from functools import cache, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripleloom.plans.sizing import broadcast_if_small
from tripleloom.session import written

BITS = 4
#: Ranked values of one dimension that are broadcast.
VALUES = 500_000


@cache
def curve(dims: int, bits: int = BITS) -> tuple[int, ...]:
    """Hilbert index of every cell, by the cell number ``x0 | x1 << bits | …``."""
    return tuple(_index([(cell >> (bits * d)) % (1 << bits) for d in range(dims)], bits) for cell in range(1 << bits * dims))


def _index(x: list[int], bits: int) -> int:
    # Undo the rotations of each level, then Gray-decode across the dimensions.
    n = len(x)
    for level in range(bits - 1, 0, -1):
        q = 1 << level
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                swap = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= swap
                x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = 0
    for level in range(bits - 1, 0, -1):
        if x[-1] >> level & 1:
            turn ^= (1 << level) - 1
    x = [v ^ turn for v in x]
    return reduce(lambda h, bit: h << 1 | bit, (v >> level & 1 for level in range(bits - 1, -1, -1) for v in x), 0)


def cut_points(docs: DataFrame, numbers: list[str], bits: int = BITS) -> list[list[float]]:
    """Equal-depth cut points: ``2**bits - 1`` numbers per dimension from a mergeable sketch.

    Few distinct values give equal cut points, so their codes still lie over the whole range.
    """
    cells = 1 << bits
    shares = [n / cells for n in range(1, cells)]
    row = docs.agg(F.count("*"), *[F.percentile_approx(c, shares, 10000).alias(f"p{n}") for n, c in enumerate(numbers)]).first()
    return [row[f"p{n}"] or [] for n in range(len(numbers))]


def value_codes(docs: DataFrame, column: str, bits: int = BITS) -> DataFrame:
    """``(column, code)``: each distinct value's place among all rows, in ``2**bits`` equal parts.

    Values are counted and sorted by range; sums inside each range start from the sums of the ranges before, so
    any number of values of any length is ranked whole.  A value's code is that of its middle row, so few values spread
    over the whole range.
    """
    counts = docs.groupBy(column).agg(F.count("*").alias("_tl_n"))
    ranged = written(counts.repartitionByRange(F.col(column).asc_nulls_first()).withColumn("_tl_part", F.spark_partition_id()))
    # One row per range.
    totals = ranged.groupBy("_tl_part").agg(F.sum("_tl_n").alias("_tl_t"))
    starts = totals.select("_tl_part", (F.sum("_tl_t").over(Window.orderBy("_tl_part")) - F.col("_tl_t")).alias("_tl_start"))
    total = ranged.agg(F.sum("_tl_n")).first()[0] or 1
    upto = F.sum("_tl_n").over(Window.partitionBy("_tl_part").orderBy(F.col(column).asc_nulls_first()))
    placed = ranged.withColumn("_tl_upto", upto).join(F.broadcast(starts), "_tl_part")
    twice = F.col("_tl_start") * 2 + F.col("_tl_upto") * 2 - F.col("_tl_n")
    return placed.select(column, whole_div(twice * (1 << bits), 2 * total).cast("int").alias("code"))


def with_codes(docs: DataFrame, dims: dict[str, Column], bits: int = BITS) -> tuple[DataFrame, list[str]]:
    """``docs`` with a code per dimension: by rank for texts, by cut points for numbers."""
    named = docs.withColumns({f"_tl_d{n}": c for n, c in enumerate(dims.values())})
    types = {f.name: f.dataType.simpleString() for f in named.schema.fields}
    names = [f"_tl_d{n}" for n in range(len(dims))]
    numbers = [c for c in names if types[c] != "string"]
    named = named.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(float("-inf"))) for c in numbers})
    cuts = dict(zip(numbers, cut_points(named, numbers, bits))) if numbers else {}
    out = named
    for n, c in enumerate(names):
        if c in cuts:
            code = reduce(lambda total, p: total + (F.col(c) > p).cast("int"), cuts[c], F.lit(0))  # noqa: B023
            out = out.withColumn(f"_tl_c{n}", code)
        else:
            codes = value_codes(named, c, bits).select(F.col(c).alias(f"_tl_v{n}"), F.col("code").alias(f"_tl_c{n}"))
            out = out.join(broadcast_if_small(codes, VALUES), F.col(c).eqNullSafe(F.col(f"_tl_v{n}")), "left").drop(f"_tl_v{n}")
    return out.drop(*names), [f"_tl_c{n}" for n in range(len(dims))]


def curve_index(codes: list[str], bits: int = BITS) -> Column:
    """The place on the curve of each row's cell."""
    cell = reduce(lambda total, n: total + F.col(codes[n]) * (1 << bits * n), range(len(codes)), F.lit(0))
    return F.element_at(F.lit(list(curve(len(codes), bits))), cell + 1).cast("long")


def hilbert_shards(docs: DataFrame, dims: dict[str, Column], key: str, shards: int = 40, bits: int = BITS, per_block: int = 50_000) -> DataFrame:
    """``docs`` with ``curve`` (index), ``shard`` (0 to ``shards - 1``) and ``slot`` (gapless from 0).

    Only the columns of ``docs`` are moved, so leave large texts out and join or
    write them by shard afterwards.  Input columns named like the new ones are replaced.
    """
    coded, codes = with_codes(docs, dims, bits)
    kept = [c for c in docs.columns if c.lower() not in ("curve", "shard", "slot")]
    placed = written(coded.select(*kept, curve_index(codes, bits).alias("_tl_curve"), F.xxhash64(*map(F.col, docs.columns)).alias("_tl_h")))
    placed = placed.withColumnRenamed("_tl_curve", "curve")
    # At most one row per cell of the curve: 4,096 with three dimensions of four bits.
    cells = placed.groupBy("curve").agg(F.count("*").alias("_tl_cell"))
    upto = F.sum("_tl_cell").over(Window.orderBy("curve"))
    cells = cells.select("curve", "_tl_cell", (upto - F.col("_tl_cell")).alias("_tl_before"))
    block = F.pmod(F.shiftrightunsigned("_tl_h", 20), F.ceil(F.col("_tl_cell") / per_block))
    placed = placed.join(F.broadcast(cells), "curve").withColumn("_tl_block", block)
    counts = placed.groupBy("curve", "_tl_block", "_tl_before").agg(F.count("*").alias("_tl_n"))
    in_cell = F.sum("_tl_n").over(Window.partitionBy("curve").orderBy("_tl_block"))
    starts = counts.select("curve", "_tl_block", (F.col("_tl_before") + in_cell - F.col("_tl_n")).alias("_tl_start"))
    within = Window.partitionBy("curve", "_tl_block").orderBy("_tl_h", key)
    ranked = placed.withColumn("_tl_rn", F.row_number().over(within) - 1).join(starts, ["curve", "_tl_block"])
    rank = F.col("_tl_start") + F.col("_tl_rn")
    total = placed.count()
    shard = whole_div(rank * shards, total)
    slot = rank - whole_div(F.col("shard").cast("long") * total + (shards - 1), shards)
    return ranked.withColumn("shard", shard.cast("int")).withColumn("slot", slot).select(*kept, "curve", "shard", "slot")


def whole_div(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(max(b, 1)).cast("long"))
