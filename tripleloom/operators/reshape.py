"""Structural transforms: row and column forms, offsets, segments, dense grids, pruning."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleloom.functions.scalar import column_bucket, whole
from tripleloom.matrix import Matrix
from tripleloom.operators.scans import prefix_sum, ranked
from tripleloom.plans.sizing import BROADCAST_ROWS

# A row of the row form holds at most this many columns; longer rows continue in the next segment.
SEGMENT_COLUMNS = 65_536


def row_form(m: Matrix, segment: int = SEGMENT_COLUMNS) -> DataFrame:
    """``(i, seg, cols, vals)``: sorted columns and values of each row, by column segment.

    Segments bound the arrays, so one row may hold any share of the entries.
    Positions must not repeat (``Matrix.combined``).
    """
    return (
        m.entries.withColumn("seg", whole(F.col("j"), segment))
        .groupBy("i", "seg")
        .agg(F.array_sort(F.collect_list(F.struct("j", "v"))).alias("cells"))
        .select("i", "seg", F.col("cells.j").alias("cols"), F.col("cells.v").alias("vals"))
    )


def column_form(m: Matrix, segment: int = SEGMENT_COLUMNS) -> DataFrame:
    """``(j, seg, rows, vals)``: the row form of the transpose."""
    return row_form(m.T, segment).select(
        F.col("i").alias("j"), "seg", F.col("cols").alias("rows"), "vals"
    )


def from_row_form(rows: DataFrame, n_rows: int, n_cols: int) -> Matrix:
    cells = F.explode(F.arrays_zip(F.col("cols").alias("j"), F.col("vals").alias("v")))
    entries = rows.select("i", cells.alias("cell")).select("i", "cell.j", "cell.v")
    return Matrix(entries, n_rows, n_cols)


def row_lengths(m: Matrix, every_row: bool = False) -> DataFrame:
    """``(i, nnz)``, for stored rows or for every row of the shape."""
    counts = m.entries.groupBy("i").agg(F.count(F.lit(1)).alias("nnz"))
    if not every_row:
        return counts
    every = m.entries.sparkSession.range(m.rows).select(F.col("id").alias("i"))
    return every.join(counts, "i", "left").select("i", F.coalesce("nnz", F.lit(0)).alias("nnz"))


def row_offsets(m: Matrix) -> DataFrame:
    """``(i, nnz, row_ptr)`` for every row, and a last one ``i = rows`` that carries the total."""
    spark = m.entries.sparkSession
    counts = m.entries.groupBy("i").agg(F.count(F.lit(1)).alias("nnz"))
    every = spark.range(m.rows + 1).select(F.col("id").alias("i"))
    lengths = every.join(counts, "i", "left").select("i", F.coalesce("nnz", F.lit(0)).alias("nnz"))
    return prefix_sum(lengths, "i", F.col("nnz"), m.rows + 1, name="row_ptr").select("i", "nnz", "row_ptr")


def positions_in_row(m: Matrix) -> DataFrame:
    """Entries with their zero-based position among the columns of the row."""
    return ranked(m.entries, "j", m.cols, ("i",), "pos")


def csr_positions(m: Matrix) -> DataFrame:
    """Entries with their position in the row-major value array."""
    inside = positions_in_row(m)
    offsets = row_offsets(m).select("i", "row_ptr")
    # One offset per row of the shape, so the shape bounds what is sent.
    if m.rows <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    return inside.join(offsets, "i").select(
        "i", "j", "v", (F.col("row_ptr") + F.col("pos")).alias("at")
    )


def segment_lengths(m: Matrix, segment: int) -> DataFrame:
    """Entries per row and column segment, with the segment's first column."""
    return (
        m.entries.groupBy("i", whole(F.col("j"), segment).alias("seg"))
        .agg(F.count(F.lit(1)).alias("nnz"))
        .select("i", "seg", (F.col("seg") * segment).alias("first_col"), "nnz")
    )


def bucketed_columns(m: Matrix, buckets: int) -> DataFrame:
    """Entries with the bucket of their column."""
    return m.entries.select("i", "j", "v", column_bucket(F.col("j"), buckets, m.cols).alias("b"))


#: Positions of one dense piece.
PIECE = 65_536


def dense_pieces(m: Matrix, piece: int = PIECE) -> DataFrame:
    """``(i, first, vals)``: every row of the shape as arrays of up to ``piece`` values, absent ones as 0.0.

    Stored entries are gathered per block of rows and columns, beside one marker per block, and filled in
    there; the positions themselves are never shuffled.  Repeated positions are added.
    """
    width = max(1, min(m.cols, piece))
    height = max(1, piece // width)
    across = max(1, -(-m.cols // width))
    down = -(-m.rows // height) if m.cols else 0
    keys = [whole(F.col("i"), height).alias("block"), whole(F.col("j"), width).alias("seg")]
    markers = m.entries.sparkSession.range(down * across).select(
        whole(F.col("id"), across).alias("block"), F.pmod("id", F.lit(across)).alias("seg"),
        *[F.lit(None).cast(t).alias(c) for c, t in (("i", "long"), ("j", "long"), ("v", "double"))],
    )
    stored = m.entries.select(*keys, "i", "j", "v").unionByName(markers)
    fill = _filled(height, width, m.rows, m.cols)
    return stored.groupBy("block", "seg").applyInArrow(fill, "i long, first long, vals array<double>")


def _filled(height: int, width: int, rows: int, cols: int):
    def run(table: pa.Table) -> pa.Table:
        block, seg = table.column("block")[0].as_py(), table.column("seg")[0].as_py()
        tall, wide = min(height, rows - block * height), min(width, cols - seg * width)
        out = np.zeros((tall, wide))
        held = table.filter(pc.is_valid(table.column("i")))
        np.add.at(out, (held.column("i").to_numpy() - block * height, held.column("j").to_numpy() - seg * width), held.column("v").to_numpy())
        offsets = pa.array(np.arange(0, out.size + 1, wide, dtype=np.int32))
        return pa.table(
            {
                "i": pa.array(np.arange(tall) + block * height), "first": pa.array(np.full(tall, seg * width)),
                "vals": pa.ListArray.from_arrays(offsets, pa.array(out.ravel())),
            }
        )

    return run


def densified(m: Matrix) -> DataFrame:
    """Every position of the shape, absent ones as 0.0."""
    cells = dense_pieces(m).select("i", "first", F.posexplode("vals").alias("at", "v"))
    return cells.select("i", (F.col("first") + F.col("at")).alias("j"), "v")


def pruned(m: Matrix, eps: float) -> Matrix:
    """Without entries of ``|v| <= eps``."""
    return Matrix(m.entries.where(F.abs("v") > eps), m.rows, m.cols)


def mirrored(m: Matrix, sign: float = 1.0) -> Matrix:
    """Entries off the diagonal also at the mirrored position, times ``sign``."""
    own = F.struct("i", "j", "v")
    image = F.struct(F.col("j").alias("i"), F.col("i").alias("j"), (F.col("v") * F.lit(sign)).alias("v"))
    # One pass: the entries are made once and each row is doubled where it lies.
    both = F.inline(F.when(F.col("i") == F.col("j"), F.array(own)).otherwise(F.array(own, image)))
    return Matrix(m.entries.select(both), m.rows, m.cols)


def upper_triangle(m: Matrix) -> Matrix:
    return Matrix(m.entries.where("j >= i"), m.rows, m.cols)


def unsorted_rows(rows: DataFrame) -> DataFrame:
    """Segments of a row form whose columns do not strictly ascend."""
    return rows.where(F.col("cols") != F.array_sort(F.array_distinct("cols"))).select("i", "seg")


def as_single(m: Matrix) -> Matrix:
    """Values rounded to single precision."""
    return Matrix(m.entries.select("i", "j", F.col("v").cast("float").cast("double").alias("v")), m.rows, m.cols)
