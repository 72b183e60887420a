"""Binary compressed-row files.

A matrix of any size is a folder of parts, each a whole file of the format for its block of rows; the parts' names give the
order of the blocks.  Parts are read and written by Spark, so they may lie wherever Spark can read, and are committed
like any table.  ``read_binary_csr`` takes such a folder or one file below 2 GB; a larger single file, and the writer of single
files, need storage that every executor sees under the same path, where each task seeks to its slice.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tripleloom.functions.scalar import whole
from tripleloom.matrix import Matrix
from tripleloom.operators.reshape import csr_positions, row_offsets

# File layout (little endian, 8-byte alignment).
MAGIC = b"Hi\x01Compsd"
HEADER = struct.Struct("<9s7x8Q")
VALUE_TYPES = {8: ("<f8", "<d?7x"), 4: ("<f4", "<f?3x")}
INDEX_TYPE = "<u4"

SLICE_ENTRIES = 1 << 22
#: Bytes of a file that one row of Spark can hold; entries and rows of a part that is written.
LARGEST_PART = (1 << 31) - 1
PART_ENTRIES, PART_ROWS = 1 << 23, 1 << 24


class FormatError(ValueError):
    """The file is not a compressed-row matrix of the expected type."""


@dataclass(frozen=True)
class _Places:
    path: str
    value_type: str
    rows: int
    nnz: int
    values: int

    @property
    def columns(self) -> int:
        return self.values + self.nnz * np.dtype(self.value_type).itemsize

    @property
    def offsets(self) -> int:
        return self.columns + 4 * self.nnz


def _places(path: str, value_bytes: int, rows: int, nnz: int) -> _Places:
    value_type, state = VALUE_TYPES[value_bytes]
    return _Places(path, value_type, rows, nnz, HEADER.size + struct.calcsize(state))


def parse_header(head: bytes, path: str, length: int, value_bytes: int) -> tuple[_Places, int]:
    """Where the arrays lie, and the number of columns."""
    if len(head) < HEADER.size:
        raise FormatError(f"{path}: no header")
    magic, size, _, index, _, offset, rows, cols, nnz = HEADER.unpack(head[: HEADER.size])
    if magic != MAGIC:
        raise FormatError(f"{path}: not a compressed-row matrix")
    if size != value_bytes or index != 4 or offset != 4:
        raise FormatError(f"{path}: holds another value or index type")
    places = _places(path, value_bytes, rows, nnz)
    if length < places.offsets + 4 * (rows + 1):
        raise FormatError(f"{path}: cut short")
    return places, cols


def read_binary_csr(spark: SparkSession, path: str, value_bytes: int = 8) -> Matrix:
    """A matrix from parts, or one file, of doubles (8) or floats (4); any other type or magic is refused."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    # Names and lengths only: one row per part, no content.
    longest = files.agg(F.max("length")).first()[0]
    if longest is None:
        raise FormatError(f"no file at {path}")
    if longest > LARGEST_PART:
        return _read_mounted(spark, path, value_bytes)
    heads = files.select("path", "length", F.substring("content", 1, HEADER.size).alias("head")).orderBy("path").collect()
    found = [parse_header(bytes(h["head"]), h["path"], h["length"], value_bytes) for h in heads]
    if len({cols for _, cols in found}) > 1:
        raise FormatError(f"{path}: parts of different widths")
    rows = [p.rows for p, _ in found]
    bases = spark.createDataFrame([(h["path"], base) for h, base in zip(heads, np.cumsum([0, *rows]).tolist())], "path string, base long")
    # One row per part, each with a header read above.
    blobs = files.select("path", "content").join(F.broadcast(bases), "path").select("path", "base", "content")
    return Matrix(blobs.mapInArrow(_decoded(value_bytes), "i long, j long, v double"), sum(rows), found[0][1])


def _decoded(value_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base, content in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2)):
                raw = content.as_buffer()
                p, _ = parse_header(raw.slice(0, min(raw.size, 256)).to_pybytes(), path.as_py(), raw.size, value_bytes)
                offsets = np.frombuffer(raw, INDEX_TYPE, p.rows + 1, p.offsets).astype(np.int64)
                v, j = np.frombuffer(raw, p.value_type, p.nnz, p.values), np.frombuffer(raw, INDEX_TYPE, p.nnz, p.columns)
                for at in range(0, p.nnz, SLICE_ENTRIES):
                    to = min(p.nnz, at + SLICE_ENTRIES)
                    i = np.searchsorted(offsets, np.arange(at, to), side="right") - 1 + base
                    yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j[at:to].astype("i8")), pa.array(v[at:to].astype("f8"))], ["i", "j", "v"])

    return run


def write_csr_parts(m: Matrix, path: str, value_bytes: int = 8, part_entries: int = PART_ENTRIES, part_rows: int = PART_ROWS) -> None:
    """Write a folder of parts of whole rows: about ``part_entries`` entries each, and at most ``part_rows`` rows.

    Each part is a file of its own that starts with a header, so it can be read alone.  A row must fit into one
    part, and a matrix without rows has none.
    """
    if m.rows == 0 or m.cols >= 1 << 32:
        raise FormatError("the format needs a row, and holds 32-bit indices")
    part = F.format_string("%012d-%012d", whole(F.col("row_ptr"), part_entries), whole(F.col("i"), part_rows)).alias("part")
    rows = row_offsets(m).where(F.col("i") < m.rows).select(part, "i", "nnz")
    entries = m.entries.join(rows.select(F.col("part").alias("piece"), "i"), "i")
    packed = rows.groupBy("part").cogroup(entries.groupBy("piece")).applyInArrow(_packed(m.cols, value_bytes), "part string, content binary")
    # One row per part and folder; the text writer puts the bytes down as they are, and a line end behind the arrays.
    packed.select("part", F.col("content").cast("string").alias("value")).write.partitionBy("part").text(path)


def _head(value_bytes: int, rows: int, cols: int, nnz: int) -> bytes:
    return HEADER.pack(MAGIC, value_bytes, 0, 4, 0, 4, rows, cols, nnz) + struct.pack(VALUE_TYPES[value_bytes][1], 1.0, False)


def _packed(cols: int, value_bytes: int):
    def run(rows: pa.Table, entries: pa.Table) -> pa.Table:
        i, n = rows.column("i").to_numpy(), rows.column("nnz").to_numpy()
        order = np.argsort(i)
        first, sizes = int(i[order[0]]), n[order]
        held = [entries.column(c).to_numpy() for c in ("i", "j", "v")]
        at = np.lexsort((held[1], held[0]))
        if len(at) and (held[0][at] - first).max() >= len(i):
            raise FormatError("rows of a part do not follow each other")
        content = b"".join(
            [
                _head(value_bytes, len(i), cols, len(at)),
                held[2][at].astype(VALUE_TYPES[value_bytes][0]).tobytes(), held[1][at].astype(INDEX_TYPE).tobytes(),
                np.concatenate([[0], np.cumsum(sizes)]).astype(INDEX_TYPE).tobytes(),
            ]
        )
        return pa.table({"part": pa.array([rows.column("part")[0].as_py()]), "content": pa.array([content], pa.binary())})

    return run


def _read_mounted(spark: SparkSession, path: str, value_bytes: int) -> Matrix:
    """A single large file on storage that every task sees: each one seeks to its slice."""
    path = re.sub(r"^file:/*", "/", path)
    with open(path, "rb") as f:
        places, cols = parse_header(f.read(HEADER.size), path, os.path.getsize(path), value_bytes)
    rows, nnz = places.rows, places.nnz
    slices = spark.range(0, max(nnz, 1), SLICE_ENTRIES, numPartitions=max(1, -(-nnz // SLICE_ENTRIES)))
    return Matrix(slices.mapInArrow(_read_slices(places), "i long, j long, v double"), rows, cols)


def _read_slices(p: _Places):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        offsets = np.memmap(p.path, INDEX_TYPE, "r", p.offsets, (p.rows + 1,))
        for batch in batches:
            for start in batch.column(0).to_pylist():
                n = min(SLICE_ENTRIES, p.nnz - start)
                if n <= 0:
                    continue
                with open(p.path, "rb") as f:
                    f.seek(p.values + start * np.dtype(p.value_type).itemsize)
                    v = np.fromfile(f, p.value_type, n)
                    f.seek(p.columns + 4 * start)
                    j = np.fromfile(f, INDEX_TYPE, n)
                i = np.searchsorted(offsets, np.arange(start, start + n), side="right") - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(i, pa.int64()), pa.array(j.astype("i8")), pa.array(v.astype("f8"))],
                    names=["i", "j", "v"],
                )

    return run


def write_binary_csr(m: Matrix, path: str, value_bytes: int = 8) -> None:
    """Write the file; each task fills its own byte ranges, so a repeated task writes the same bytes."""
    nnz = m.nnz()
    if max(nnz, m.rows, m.cols) >= 1 << 32:
        raise FormatError("the format holds 32-bit indices")
    places = _places(path, value_bytes, m.rows, nnz)
    with open(path, "wb") as f:
        f.write(_head(value_bytes, m.rows, m.cols, nnz))
        f.truncate(places.offsets + 4 * (m.rows + 1))
    at = csr_positions(m).select("at", "j", "v").repartitionByRange("at").sortWithinPartitions("at")
    cells = at.mapInArrow(_write_cells(places), "written long")
    ptr = row_offsets(m).select(F.col("i").alias("at"), "row_ptr").repartitionByRange("at").sortWithinPartitions("at")
    ends = ptr.mapInArrow(_write_offsets(places), "written long")
    cells.unionByName(ends).agg(F.sum("written")).first()


def _runs(at: np.ndarray) -> list[np.ndarray]:
    return np.split(np.arange(len(at)), np.flatnonzero(np.diff(at) != 1) + 1) if len(at) else []


def _put(f, start: int, values: np.ndarray) -> None:
    f.seek(start)
    f.write(values.tobytes())


def _written(n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["written"])


def _write_cells(p: _Places):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = np.dtype(p.value_type).itemsize
        with open(p.path, "r+b") as f:
            for batch in batches:
                at, j, v = (batch.column(n).to_numpy(zero_copy_only=False) for n in range(3))
                for run_ in _runs(at):
                    first = int(at[run_[0]])
                    _put(f, p.values + first * width, v[run_].astype(p.value_type))
                    _put(f, p.columns + 4 * first, j[run_].astype(INDEX_TYPE))
                yield _written(len(at))

    return run


def _write_offsets(p: _Places):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(p.path, "r+b") as f:
            for batch in batches:
                at, ptr = (batch.column(n).to_numpy(zero_copy_only=False) for n in range(2))
                for run_ in _runs(at):
                    _put(f, p.offsets + 4 * int(at[run_[0]]), ptr[run_].astype(INDEX_TYPE))
                yield _written(len(at))

    return run
