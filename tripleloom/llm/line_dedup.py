"""Repeated lines found with two Bloom filters and confirmed exactly.

1. The distinct 64-bit hashes of the lines' keys (at most two per batch and key) are written and
   counted; the filters get twelve bits for each.  They are cut into slices of at most ``WIDTH`` bits by the
   hash, and each hash goes to its slice, which keeps two Bloom filters: seen once, and seen again.
2. The seen-again filters are broadcast, up to ``MOST_BITS`` in all.  Only keys that they
   suspect are shuffled, as 128-bit digests with the document's id; counts and the
   largest id are combined before the shuffle, so a line in a third of all
   documents is one row per task.  Beyond that bound nothing is broadcast: every key's digest is shuffled.
3. Keys in at least ``least`` documents are dropped everywhere but in the document with
   the largest id.  Up to ``broadcast_keys`` of them are broadcast after a count;
   beyond that the suspects are joined with them and each document gets its own list.

The result does not depend on the number of bits: a fuller filter only suspects more keys.
Digests are taken for the keys: two of 10^12 keys share one with probability 10^-15.

Defined results: a null or empty text is one empty line; each row is one
document, so rows that repeat an id count as documents and keep their lines if the
id is the largest; a null id is smaller than any other; other columns are carried
along by ``deduplicated`` alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleloom.llm.words import SPACE, mixed, slices
from tripleloom.session import written

#: Bits of one slice, bits for each hash, and bits of all filters that are broadcast (256 MB).
WIDTH = 1 << 20
PER_HASH = 12
MOST_BITS = 1 << 31
LOW = (1 << 64) - 1


def line_keys(text: bytes | None, shortest: int = 40) -> Iterator[tuple[int, int]]:
    """``(line number, 128-bit digest)`` of the lines whose key has ``shortest`` code points."""
    for n, line in enumerate((text or b"").split(b"\n")):
        key = line.strip(SPACE).lower()
        if len(key) >= shortest and (key.isascii() or len(key.decode("utf-8", "replace")) >= shortest):
            yield n, xxhash.xxh3_128_intdigest(key)


def _binary(batch: pa.RecordBatch, column: int) -> list:
    return batch.column(column).cast(pa.large_binary()).to_pylist()


def _hashes(column: int, shortest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, column):
                found = [d & LOW for text in _binary(batch, column) for d in {d for _, d in line_keys(text, shortest)}]
                values, n = np.unique(np.array(found, np.uint64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(values, np.minimum(n, 2)).view(np.int64))], ["h"])

    return run


def places(hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bit positions of each hash inside its slice's filter."""
    size = np.uint64(width)
    return ((hashes % size).astype(np.int64), (mixed(hashes) % size).astype(np.int64))


def slice_of(hashes: np.ndarray, slices: int) -> np.ndarray:
    return ((hashes >> np.uint64(24)) % np.uint64(slices)).astype(np.int64)


def _filters(width: int):
    """Rows sorted by slice; a slice's filters are handed on when its last row has come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, twice, at = np.zeros(width, bool), np.zeros(width, bool), None
        for batch in batches:
            part, hashes = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            for s in np.unique(part).tolist():
                if s != at:
                    if at is not None:
                        yield _packed(at, twice)
                    seen[:], twice[:], at = False, False, s
                mine, n = np.unique(hashes[part == s], return_counts=True)
                a, b = places(mine, width)
                repeated = (n > 1) | (seen[a] & seen[b])
                twice[a[repeated]] = twice[b[repeated]] = True
                seen[a] = seen[b] = True
        if at is not None:
            yield _packed(at, twice)

    return run


def _packed(at: int, bits: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.packbits(bits).tobytes()])], ["slice", "again"])


def repeat_filter(docs: DataFrame, text: str, shortest: int, bits: int | None = None, most: int = MOST_BITS) -> np.ndarray | None:
    """Packed seen-again filters, one row of bytes per slice; None beyond ``most`` bits.

    ``bits`` follows the counted hashes unless it is given.
    """
    rows = written(docs.select(text).mapInArrow(_hashes(0, shortest), "h long"))
    bits = bits or 1 << max(12, (PER_HASH * rows.count() - 1).bit_length())
    if bits > most:
        return None
    width = min(WIDTH, bits)
    slices = bits // width
    dealt = rows.select(F.pmod(F.shiftrightunsigned("h", 24), F.lit(slices)).cast("int").alias("slice"), "h")
    found = dealt.repartition("slice").sortWithinPartitions("slice").mapInArrow(_filters(width), "slice int, again binary")
    out = np.zeros((slices, width // 8), np.uint8)
    for row in found.toLocalIterator():
        out[row["slice"]] = np.frombuffer(row["again"], np.uint8)
    return out


def _suspects(shared, key: str, shortest: int):
    """Digests of the keys that the filters suspect; of all keys where there are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        again = shared.value if shared is not None else None
        for whole in batches:
            for batch in slices(whole, 1):
                owner, low, high = [], [], []
                for row, text in enumerate(_binary(batch, 1)):
                    for d in {d for _, d in line_keys(text, shortest)}:
                        owner.append(row)
                        low.append(d & LOW)
                        high.append(d >> 64)
                hashes = np.array(low, np.uint64)
                hit = np.ones(len(hashes), bool)
                if again is not None:
                    part = slice_of(hashes, len(again))
                    for at in places(hashes, again.shape[1] * 8):
                        hit &= (again[part, at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(np.array(owner, np.int64)[hit])),
                        pa.array(hashes[hit].view(np.int64)),
                        pa.array(np.array(high, np.uint64)[hit].view(np.int64)),
                    ],
                    [key, "low", "high"],
                )

    return run


def repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = 40, least: int = 5, bits: int | None = None, most_bits: int = MOST_BITS) -> tuple[DataFrame, DataFrame]:
    """The drop list ``(low, high, keeper)``, written once, and the suspects ``(key, low, high)`` behind it."""
    rows = docs.select(key, text)
    filters = repeat_filter(docs, text, shortest, bits, most_bits)
    shared = None if filters is None else docs.sparkSession.sparkContext.broadcast(filters)
    kind = rows.schema[key].dataType.simpleString()
    suspects = rows.mapInArrow(_suspects(shared, key, shortest), f"`{key}` {kind}, low long, high long")
    counted = suspects.groupBy("low", "high").agg(F.count("*").alias("n"), F.max(key).alias("keeper"))
    return written(counted.where(F.col("n") >= least).select("low", "high", "keeper")), suspects


def deduplicated(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = 40, least: int = 5, bits: int | None = None, broadcast_keys: int = 500_000, most_bits: int = MOST_BITS
) -> DataFrame:
    """``docs`` with the text's repeated lines taken out, and ``n_lines`` (before) and ``n_dropped``."""
    drops, suspects = repeated_lines(docs, key, text, shortest, least, bits, most_bits)
    plain = docs.drop("n_lines", "n_dropped")
    out = plain.withColumns({"n_lines": F.lit(0).cast("long"), "n_dropped": F.lit(0).cast("long")}).schema
    columns = plain.columns.index(key), plain.columns.index(text)
    if drops.count() <= broadcast_keys:
        shared = docs.sparkSession.sparkContext.broadcast(_drop_map(drops.toArrow()))
        return plain.mapInArrow(_dropper(columns, shortest, shared, None), out)
    mine = suspects.join(drops, ["low", "high"]).where(F.col("keeper").isNotNull() & (F.col(key).isNull() | (F.col(key) < F.col("keeper"))))
    # A document's list holds at most its own lines.
    lists = mine.groupBy(F.col(key).alias("_tl_key")).agg(F.collect_set(F.struct("low", "high")).alias("_tl_drop"))
    joined = plain.join(lists, F.col(key).eqNullSafe(F.col("_tl_key")), "left").drop("_tl_key")
    return joined.mapInArrow(_dropper(columns, shortest, None, len(plain.columns)), out)


def _drop_map(rows: pa.Table) -> dict[int, object]:
    low, high, keeper = (rows.column(n).to_pylist() for n in range(3))
    return {(h & LOW) << 64 | a & LOW: k for a, h, k in zip(low, high, keeper)}


def _dropper(columns: tuple[int, int], shortest: int, shared, own: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, text = columns
        known = shared.value if shared is not None else None
        for whole in batches:
            for batch in slices(whole, text):
                ids = batch.column(key).to_pylist()
                lists = batch.column(own).to_pylist() if own is not None else None
                kept, lines, dropped = [], [], []
                for n, content in enumerate(_binary(batch, text)):
                    if lists is None:
                        gone = {at for at, d in line_keys(content, shortest) if d in known and _loses(ids[n], known[d])}
                    else:
                        drop = {(x["high"] & LOW) << 64 | x["low"] & LOW for x in lists[n] or ()}
                        gone = {at for at, d in line_keys(content, shortest) if d in drop} if drop else ()
                    every = (content or b"").split(b"\n")
                    lines.append(len(every))
                    dropped.append(len(gone))
                    kept.append(b"\n".join([x for at, x in enumerate(every) if at not in gone]) if gone else content or b"")
                arrays = list(batch.columns)[: own if own is not None else None]
                arrays[text] = pa.array(kept, pa.binary()).cast(batch.column(text).type)
                names = batch.schema.names[: len(arrays)]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], [*names, "n_lines", "n_dropped"])

    return run


def _loses(own, keeper) -> bool:
    return keeper is not None and (own is None or own < keeper)
