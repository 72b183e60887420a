"""Blocks: every range of rows of ``A`` meets every range of columns of ``B``, and makes its part of the result whole.

Where rows of ``A`` share few rows of ``B``, a row group is brought about as many elements as it makes products.  Here the
entries of a range are packed once into one row, as narrow as they fit, and a task reads the packs of its two ranges by a
Cartesian product: entries are shuffled once whatever the number of blocks, and no product is.  A pack has at most about
``SIDE`` entries, and a task makes its results in slices, so that its memory depends on neither the products nor the result.
Lines that are several ranges by themselves are left to the caller's joins.
"""

from __future__ import annotations

import struct
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleloom.operators import grouped

#: Products from which blocks take the place of row groups.
BLOCKED = 1 << 28
#: Entries of a range, products of a block, and blocks wanted at least.
SIDE, MADE, LEAST = 1 << 23, 1 << 28, 64
PACK = "r int, low long, high long, pack binary"


@dataclass(frozen=True)
class Ranges:
    """``cuts`` between the ranges of a line number; ``heavy`` lines are in none of them."""

    cuts: list[float]
    heavy: list[int]

    @property
    def count(self) -> int:
        return len(self.cuts) + 1

    def placed(self, df: DataFrame, line: str, name: str = "r") -> DataFrame:
        """``df`` with the range of its line, without heavy ones; null lines are in the first range."""
        if self.heavy:
            df = df.where(F.coalesce(~F.col(line).isin(self.heavy), F.lit(True)))
        lowest = F.coalesce(F.col(line).cast("double"), F.lit(-float("inf")))
        return grouped.in_ranges(df, lowest, self.cuts, name).withColumn(name, F.col(name).cast("int"))


def line_ranges(entries: DataFrame, line: str, nnz: int, count: int) -> Ranges:
    """About ``count`` ranges of equal entries, by approximate quantiles."""
    shares = [n / count for n in range(1, count)]
    found = Counter(entries.select(line).approxQuantile(line, shares, 1 / (4 * count)) if shares else [])
    # A line that is the quantile of several shares has the entries between them.
    heavy = [line for line, times in found.items() if (times - 1) / count * nnz > 2 * SIDE]
    return Ranges(sorted(found), sorted(map(int, heavy)))


def grid(left_nnz: int, right_nnz: int, products: int, most: int) -> tuple[int, int]:
    """Ranges of rows and of columns, so that their copies read in all are few."""
    blocks = max(LEAST, ceil(products / most))
    rows = max(ceil(left_nnz / SIDE), ceil(sqrt(blocks * max(left_nnz, 1) / max(right_nnz, 1))))
    return rows, max(ceil(right_nnz / SIDE), ceil(blocks / rows))


# --- packs ------------------------------------------------------------------------


def _narrow(x: np.ndarray) -> tuple[int, np.ndarray]:
    """The least number, and the distances to it in as few bytes as they need."""
    low = int(x.min()) if len(x) else 0
    # Modulo 2**64, so that the distance from the number that stands for null is right too.
    far = x.astype(np.int64).view(np.uint64) - np.array(low, np.int64).view(np.uint64)
    high = int(far.max()) if len(x) else 0
    return low, far.astype(np.min_scalar_type(high))


def packed(columns: list[np.ndarray]) -> bytes:
    """BIGINT and DOUBLE columns in one buffer; ``unpacked`` gives them back exactly."""
    parts = [struct.pack("<q", len(columns))]
    for x in columns:
        kind, low = b"i", 0
        if x.dtype.kind == "f":
            kind = b"f"
            with np.errstate(invalid="ignore", over="ignore"):
                whole = x.astype(np.int64)
                if np.array_equal(whole, x) and not np.signbit(x[x == 0]).any() and (not len(x) or np.abs(x).max() < 1 << 53):
                    kind, x = b"w", whole
                elif np.array_equal(x.astype(np.float32), x):
                    x = x.astype(np.float32)
        elif len(x) > 1 and (x[1:] >= x[:-1]).all() and int(x[0]) != grouped.MISSING:
            kind, x = b"s", np.diff(x, prepend=np.int64(0))
        if x.dtype.kind != "f":
            low, x = _narrow(x)
        raw = pa.compress(x.tobytes(), codec="zstd", asbytes=True)
        parts += [kind, x.dtype.str.encode().ljust(4), struct.pack("<qqq", low, x.nbytes, len(raw)), raw]
    return b"".join(parts)


def unpacked(pack: memoryview) -> list[np.ndarray]:
    at, found = 8, []
    for _ in range(struct.unpack_from("<q", pack)[0]):
        kind, dtype = bytes(pack[at : at + 1]), np.dtype(bytes(pack[at + 1 : at + 5]).decode().strip())
        low, size, length = struct.unpack_from("<qqq", pack, at + 5)
        at += 29
        x = np.frombuffer(pa.decompress(pa.py_buffer(pack[at : at + length]), size, codec="zstd"), dtype)
        at += length
        if dtype.kind != "f":
            x = (x.astype(np.uint64) + np.array(low, np.int64).view(np.uint64)).view(np.int64)
        found.append(np.cumsum(x) if kind == b"s" else x.astype(np.float64, copy=False) if kind in b"wf" else x)
    return found


def _whole(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    return (column.fill_null(grouped.MISSING) if column.null_count else column).to_numpy(zero_copy_only=False)


def _order(k: np.ndarray, line: np.ndarray) -> np.ndarray:
    span = int(line.max()) - int(line.min()) + 1
    if (int(k.max()) - int(k.min()) + 1) * span < 1 << 62:
        return np.argsort((k - k.min()) * span + (line - line.min()))
    return np.lexsort((line, k))


def _entry_columns(table: pa.Table, line: str, k: str, payload: str | None) -> list[np.ndarray]:
    """Inner index, line, and the payload with what of it is not null, sorted by the first two."""
    columns = [_whole(table.column(k)), _whole(table.column(line))]
    if payload:
        v, there = grouped.numbers(table.column(payload).combine_chunks())
        columns += [v, there.astype(np.int64)] if there is not None else [v]
    order = _order(*columns[:2]) if table.num_rows else np.zeros(0, np.int64)
    return [x[order] for x in columns]


def _packer(pack: Callable[[pa.Table], dict[str, object]], names: list[str], line: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            ranges = batch.column("r").to_numpy()
            for r in np.unique(ranges).tolist():
                held.setdefault(r, []).append(batch if (ranges == r).all() else batch.filter(pa.array(ranges == r)))
        for r in sorted(held):
            table = pa.Table.from_batches(held.pop(r))
            lines = _whole(table.column(line))
            row = {"r": r, "low": int(lines.min()), "high": int(lines.max())} | pack(table)
            yield pa.RecordBatch.from_arrays([pa.array([row[name]], kind) for name, kind in names], [name for name, _ in names])

    return run


KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<binary>": pa.list_(pa.binary())}


def packs(df: DataFrame, found: Ranges, line: str, pack: Callable[[pa.Table], dict[str, object]], schema: str, prefix: str) -> DataFrame:
    """One row for each range of ``df``, in a partition of its own; its columns are named with the prefix."""
    names = [(name, KINDS[kind]) for name, kind in (column.split() for column in schema.split(", "))]
    dealt = found.placed(df, line).repartitionById(found.count, F.col("r"))
    made = dealt.mapInArrow(_packer(pack, names, line), schema).repartitionById(found.count, F.col("r"))
    return made.select(*[F.col(name).alias(f"{prefix}_{name}") for name, _ in names])


def entry_packs(entries: DataFrame, found: Ranges, line: str, payload: str | None, prefix: str) -> DataFrame:
    columns = [c for c in (line, "k", payload) if c]

    def pack(table: pa.Table) -> dict[str, object]:
        return {"pack": packed(_entry_columns(table, line, "k", payload))}

    return packs(entries.select(*columns).where("k is not null"), found, line, pack, PACK, prefix)


def met(rows: DataFrame, columns: DataFrame, upper: bool = False) -> DataFrame:
    """Every pack of rows beside every pack of columns, one pair in a task; with ``upper`` those that reach the upper triangle."""
    rows = rows.hint("shuffle_replicate_nl")
    return rows.join(columns, F.col("b_high") >= F.col("a_low")) if upper else rows.crossJoin(columns)


# --- inside a task ------------------------------------------------------------------


def _values(columns: list[np.ndarray]) -> pa.Array:
    return pa.array(columns[0], mask=columns[1] == 0 if len(columns) > 1 else None)


def as_entries(pack: memoryview, value: str) -> pa.Table:
    k, i, *payload = unpacked(pack)
    return pa.table({"i": i, "k": k} | ({value: _values(payload)} if payload else {}))


def as_arrays(pack: memoryview, line: str, value: str) -> pa.Table:
    """``(line, …)``: the arrays of each inner index, as the row groups are brought them."""
    k, j, *payload = unpacked(pack)
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
    offsets = pa.array(np.r_[first, len(k)].astype(np.int32))
    # Null columns are read back by what stands for them.
    lists = {line: pa.ListArray.from_arrays(offsets, pa.array(j))}
    if payload:
        lists[value] = pa.ListArray.from_arrays(offsets, _values(payload))
    return pa.table({"line": k[first]} | lists)


def _buffer(column: pa.Array) -> memoryview:
    return memoryview(column[0].as_buffer())


def _made(kernel: grouped.Kernel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                a, b = (batch.column(c).slice(n, 1) for c in ("a_pack", "b_pack"))
                yield from kernel(as_entries(_buffer(a), "lv"), as_arrays(_buffer(b), "j", "rv"))

    return run


# --- products -----------------------------------------------------------------------

Pairs = list[tuple[DataFrame, DataFrame]]


def product_blocks(
    left: DataFrame, right: DataFrame, products: int, kernel: grouped.Kernel, schema: str, values: bool, upper: bool = False, most: int = MADE
) -> tuple[DataFrame, Pairs]:
    """``kernel`` over every block of ``left(i, k, lv)`` and ``right(k, j, rv)``; and the pairs of sides that no block has, with heavy lines."""
    sizes = left.count(), right.count()
    counts = grid(*sizes, products, min(most, MADE))
    rows, columns = (line_ranges(df, line, n, count) for df, line, n, count in zip((left, right), "ij", sizes, counts))
    if upper:
        left = left.where("i is not null")
    a, b = entry_packs(left, rows, "i", "lv" if values else None, "a"), entry_packs(right, columns, "j", "rv" if values else None, "b")
    made = met(a, b, upper).select("a_pack", "b_pack").mapInArrow(_made(kernel), schema)
    rest = []
    if rows.heavy:
        rest.append((left.where(F.col("i").isin(rows.heavy)), right))
    if columns.heavy:
        others = left.where(F.coalesce(~F.col("i").isin(rows.heavy), F.lit(True))) if rows.heavy else left
        rest.append((others, right.where(F.col("j").isin(columns.heavy))))
    return made, rest


def block_sums(left: DataFrame, right: DataFrame, products: int, upper: bool, most: int = MADE) -> tuple[DataFrame, Pairs]:
    """The sums ``(i, j, v)``; a block makes ``most`` products or fewer, as far as lines can be parted."""
    return product_blocks(left, right, products, grouped.sums(upper), "i long, j long, v double", True, upper, most)


def block_positions(left: DataFrame, right: DataFrame, products: int, upper: bool) -> tuple[DataFrame, Pairs]:
    return product_blocks(left, right, products, grouped.positions(upper), "i long, j long", False, upper)


def block_lengths(left: DataFrame, right: DataFrame, products: int, name: str, buckets: int = 0, cols: int = 0) -> tuple[DataFrame, Pairs]:
    """``(i, name)``, or ``(i, b, name)``: entries of each row in each range of columns, to be added up."""
    schema = f"i long, {'b long, ' if buckets else ''}{name} long"
    return product_blocks(left, right, products, grouped.lengths(buckets, cols, name), schema, False)


# --- values at known positions --------------------------------------------------------


def _met_at(kernel: grouped.Kernel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                a, wanted, b = (_buffer(batch.column(c).slice(n, 1)) for c in ("a_pack", "wanted", "b_pack"))
                (j, i), (c, row, *p) = unpacked(wanted), unpacked(a)
                p = np.where(p[1] == 0, np.nan, p[0]) if len(p) > 1 else p[0]
                own = np.r_[np.zeros(len(i), bool), np.ones(len(c), bool)]
                left = {"i": np.r_[i, row], "k": np.r_[j, c], "p": np.r_[np.zeros(len(i), p.dtype), p], "own": own}
                yield from kernel(pa.table(left), as_arrays(b, "c", "p"))

    return run


def positions_met(structure: DataFrame, a: DataFrame, b: DataFrame, payload: str) -> tuple[DataFrame, DataFrame] | None:
    """As ``grouped.grouped_positions_met``, in blocks; None where row groups do: little work, heavy lines, far numbers.

    The pack of a range of rows has its positions as well, cut by the ranges of columns.
    """
    a = a.where("i is not null and j is not null").select("i", F.col("j").alias("k"), F.col(payload).alias("p"))
    b = b.where("i is not null and j is not null").select("j", F.col("i").alias("k"), F.col(payload).alias("p"))
    known = structure.where("i is not null and j is not null")
    facts = b.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("j").alias("j"), F.min("j").alias("low"), F.max("j").alias("high")).first()
    positions = known.count()
    work = positions * facts["n"] // max(facts["j"], 1)
    if work <= BLOCKED or max(-facts["low"], facts["high"]) >= 1 << 53:
        return None
    rows_of = a.select("i").unionAll(known.select("i"))
    entries = a.count() + positions
    counts = grid(entries, facts["n"], work, MADE)
    rows, columns = line_ranges(rows_of, "i", entries, counts[0]), line_ranges(b, "j", facts["n"], counts[1])
    if rows.heavy or columns.heavy:
        return None
    # Each range of columns has an entry, so that every position is in a block.
    columns = Ranges([cut for cut in columns.cuts if cut > facts["low"]], [])
    cuts = np.array(columns.cuts)

    def pack(table: pa.Table) -> dict[str, object]:
        own = table.column("own")
        j, i = _entry_columns(table.filter(pc.invert(own)), "i", "k", None)
        ends = [0, *np.searchsorted(j, cuts).tolist(), len(j)]
        wanted = [packed([j[low:high], i[low:high]]) for low, high in zip(ends, ends[1:])]
        return {"pack": packed(_entry_columns(table.filter(own), "i", "k", "p")), "wanted": wanted}

    none = F.lit(None).cast(a.schema["p"].dataType)
    both = a.withColumn("own", F.lit(True)).unionByName(known.select("i", F.col("j").alias("k"), none.alias("p"), F.lit(False).alias("own")))
    left = packs(both, rows, "i", pack, f"{PACK}, wanted array<binary>", "a")
    # Arrays of inner indices by column.
    right = packs(b, columns, "j", lambda table: {"pack": packed(_entry_columns(table, "k", "j", "p"))}, PACK, "b")
    wanted = F.element_at("a_wanted", F.col("b_r") + 1).alias("wanted")
    pairs = met(left, right).select("a_pack", wanted, "b_pack")
    kernel, schema = (grouped.met_sums, "i long, j long, v double") if payload == "v" else (grouped.met_pairs, "i long, j long, le long, re long")
    return pairs.mapInArrow(_met_at(kernel), schema), structure.where("i is null or j is null")
