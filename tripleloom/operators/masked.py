"""Values for a known structure: rows and columns meet as sorted arrays, position by position.

Only positions of the structure are looked at.  Row ``i`` of ``A`` and column ``j`` of ``B`` are arrays sorted by inner
index, cut into segments of it; where position ``(i, j)`` is wanted, the segments of both are intersected, so no product is made
for any other position.  ``masked_product`` adds the products up; ``product_plan`` keeps the pairs of entry numbers
that meet instead, and ``planned_product`` applies new values to them without an intersection.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleloom.functions.scalar import whole
from tripleloom.matrix import Matrix
from tripleloom.operators import blocks
from tripleloom.operators.grouped import grouped_positions_met
from tripleloom.operators.reshape import csr_positions
from tripleloom.operators.scans import largest_group
from tripleloom.plans.sizing import BROADCAST_ROWS, broadcast_if_small, has_at_most
from tripleloom.session import written

#: Entries an array is meant to hold, and the narrowest segment.
MOST, NARROWEST = 1_024, 512


def inner_segment(a: Matrix, b: Matrix) -> int:
    """Inner indices per segment, so that no array of either side is long: counted, not guessed."""
    segment = max(a.cols, 1)
    while True:
        longest = max(
            largest_group(a.entries.withColumn("seg", whole(F.col("j"), segment)), ("i", "seg")),
            largest_group(b.entries.withColumn("seg", whole(F.col("i"), segment)), ("j", "seg")),
        )
        if longest <= MOST or segment <= NARROWEST:
            return segment
        segment = max(NARROWEST, segment * MOST // (2 * longest))


def _lines(entries: DataFrame, line: str, inner: str, payload: str, segment: int, names: tuple[str, str]) -> DataFrame:
    """``(line, seg, *names)``: sorted inner indices and payloads of each line's segment."""
    cells = F.array_sort(F.collect_list(F.struct(F.col(inner).alias("k"), F.col(payload).alias("p")))).alias("cells")
    grouped = entries.groupBy(line, whole(F.col(inner), segment).alias("seg")).agg(cells)
    return grouped.select(line, "seg", F.col("cells.k").alias(names[0]), F.col("cells.p").alias(names[1]))


def met_lines(structure: DataFrame, a: DataFrame, b: DataFrame, payload: str, segment: int, small: bool) -> DataFrame:
    """``(i, j, ak, ap, bk, bp)``: the arrays that meet at each position of the structure; ``small`` columns are broadcast."""
    rows = _lines(a, "i", "j", payload, segment, ("ak", "ap"))
    columns = _lines(b, "j", "i", payload, segment, ("bk", "bp"))
    if small:
        columns = F.broadcast(columns)
    return structure.select("i", "j").join(rows, "i").join(columns, ["j", "seg"]).select("i", "j", "ak", "ap", "bk", "bp")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of each element, the elements, and each row's first one."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    return np.repeat(np.arange(len(column)), np.diff(offsets)), column.flatten().to_numpy(zero_copy_only=False), offsets


def common(ak: pa.Array, bk: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, place in a, place in b)`` of equal elements of sorted arrays, all rows at once; repeated ones pair up in full."""
    rows_a, a, _ = _flat(ak)
    rows_b, b, _ = _flat(bk)
    low = min(a.min(initial=0), b.min(initial=0))
    width = int(max(a.max(initial=0), b.max(initial=0)) - low) + 1
    keys_a, keys_b = rows_a * width + (a - low), rows_b * width + (b - low)
    first, last = np.searchsorted(keys_b, keys_a, "left"), np.searchsorted(keys_b, keys_a, "right")
    n = last - first
    at = np.repeat(np.arange(len(keys_a)), n)
    other = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    return rows_a[at], at, other


def _multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row, left, right = common(batch.column(2), batch.column(4))
        p = _flat(batch.column(3))[1][left] * _flat(batch.column(5))[1][right]
        met = np.unique(row)
        v = np.bincount(row, weights=p, minlength=batch.num_rows)[met]
        at = pa.array(met)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(v)], ["i", "j", "v"])


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row, left, right = common(batch.column(2), batch.column(4))
        at = pa.array(row)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(at), batch.column(1).take(at),
                pa.array(_flat(batch.column(3))[1][left]), pa.array(_flat(batch.column(5))[1][right]),
            ],
            ["i", "j", "le", "re"],
        )


def met_in_place(structure: DataFrame, a: DataFrame, b: DataFrame, payload: str, rows: int) -> tuple[DataFrame, DataFrame]:
    """Sums or pairs at the positions, in blocks or in row groups, and the positions that neither has."""
    return blocks.positions_met(structure, a, b, payload) or grouped_positions_met(structure, a, b, payload, rows)


def masked_product(structure: DataFrame, a: Matrix, b: Matrix) -> Matrix:
    """``A·B`` at the positions of the structure; 0.0 where no product contributes.

    Where the columns are too many to broadcast, rows and columns meet in groups of rows, so that no array travels with a position.
    """
    small = has_at_most(b.entries, BROADCAST_ROWS)
    if not small:
        structure = written(structure.select("i", "j"))
        made, structure = met_in_place(structure, a.entries, b.entries, "v", a.rows)
        if structure.isEmpty():
            return Matrix(made, a.rows, b.cols)
    met = met_lines(structure, a.entries, b.entries, "v", inner_segment(a, b), small)
    parts = met.mapInArrow(_multiplied, "i long, j long, v double")
    every = parts.unionByName(structure.select("i", "j", F.lit(0.0).alias("v")))
    sums = every.groupBy("i", "j").agg(F.sum("v").alias("v"))
    return Matrix(sums if small else sums.unionByName(made), a.rows, b.cols)


def numbered(m: Matrix) -> DataFrame:
    """``(i, j, v, at)``: the entries with their number, the place in row-major order, as a written table."""
    return written(csr_positions(m).select("i", "j", "v", "at"))


def entry_values(m: Matrix, numbers: DataFrame | None = None) -> DataFrame:
    """``(at, v)``: the values by entry number; ``numbers`` is what ``numbered`` made of ``m``, if it is there already."""
    return (csr_positions(m) if numbers is None else numbers).select("at", "v")


def product_plan(structure: DataFrame, a: Matrix, b: Matrix, numbers: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """``(i, j, le, re)``: the entry numbers that meet at each position; write it once and apply values as often as needed.

    Every position has one row without numbers, so it stays where nothing meets.  ``numbers`` are the written numbers of both sides.
    """
    left, right = (df.select("i", "j", "at") for df in numbers or (csr_positions(a), csr_positions(b)))
    small = has_at_most(b.entries, BROADCAST_ROWS)
    rest = structure
    if not small:
        structure = written(structure.select("i", "j"))
        left, right = (left, right) if numbers else (written(left), written(right))
        made, rest = met_in_place(structure, left, right, "at", a.rows)
    if small or not rest.isEmpty():
        met = met_lines(rest, left, right, "at", inner_segment(a, b), small)
        pairs = met.mapInArrow(_paired, "i long, j long, le long, re long")
        pairs = pairs if small else pairs.unionByName(made)
    else:
        pairs = made
    none = F.lit(None).cast("long")
    return pairs.unionByName(structure.select("i", "j", none.alias("le"), none.alias("re")))


def planned_product(plan: DataFrame, left: DataFrame, right: DataFrame, rows: int, cols: int) -> Matrix:
    """The product of values ``(at, v)`` of both sides by a plan: two look-ups and one sum, no join on the inner index.

    Rows of the plan without numbers look nothing up; in a join they would all meet in the one task of the null key.
    """
    lv = broadcast_if_small(left.select(F.col("at").alias("le"), F.col("v").alias("lv")))
    rv = broadcast_if_small(right.select(F.col("at").alias("re"), F.col("v").alias("rv")))
    pairs = F.col("le").isNotNull() & F.col("re").isNotNull()
    products = plan.where(pairs).join(lv, "le", "left").join(rv, "re", "left").select("i", "j", (F.col("lv") * F.col("rv")).alias("p"))
    every = products.unionByName(plan.where(~pairs).select("i", "j", F.lit(None).cast("double").alias("p")))
    sums = every.groupBy("i", "j").agg(F.coalesce(F.sum("p"), F.lit(0.0)).alias("v"))
    return Matrix(sums, rows, cols)
