"""Passages that repeat, found in suffix trees over words that are split by variable-length prefixes.

1. **Suffixes.** Of every window of ``window`` words the ``prefix`` words with the smallest hash are its anchor; equal
   windows have equal anchors at the same place.  Suffixes start at the windows' first words; those of one anchor stand
   side by side and travel as one row, with the words that their windows cover.
2. **Prefixes.** Anchors are counted, combined before the shuffle.  Suffixes under an anchor that is counted
   once are leaves of their own and go no further.  Others are dealt by anchor, so that a group is a subtree of
   at most ``most`` rows.  An anchor that is counted more often takes the longer prefix: its suffixes are dealt by all
   ``window`` words, and such a node needs no more than its first leaf, a minimum that is combined before the shuffle.
3. **Subtrees.** A task takes the groups in order, many small ones at once.  Ranks of 1, 2, 4, ... words give the order
   of the suffixes; neighbours that agree in ``window`` words are under one deep internal node.  All its
   leaves but the first (smallest key, then earliest word) start a repeat; repeats that follow each other
   are one maximal passage.
4. **Texts.** Each row's passages are joined to it and its words outside them are kept.

Up to ``FILTER_BITS`` the repeated anchors are broadcast as a Bloom filter with twelve bits for each counted
one, and up to ``HOT`` of the frequent ones as a list; beyond either, anchors are joined to their counts and each document
gets its own list.  A false hit of the filter makes a leaf of its own, no more.  Windows are compared word by word, those
of frequent anchors by 128 bits.

Defined results: a null or empty text has no words; a null key is smaller than any other; rows that
repeat a key are one document as far as "earlier" goes, so equal rows lose the same words; a text of fewer words than
a window is kept; other columns are carried along by ``without_repeats``, and ``n_words`` and ``n_removed`` replace
columns of these names; the result's words are joined by one space.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleloom.llm.words import Words, mixed, slices, table, weights
from tripleloom.session import written

WINDOW, PREFIX = 20, 8
#: Rows of one subtree.
MOST = 2_000
#: Words of the subtrees that a task makes at once.
BATCH = 200_000
FILTER_BITS, SLICES, HOT = 1 << 31, 64, 500_000
#: First leaves under frequent anchors that are broadcast, some 50 MB.
HEADS = 300_000
#: Documents, and passages, that are broadcast.
DOCUMENTS, PASSAGES = 500_000, 2_000_000

AS_WRITTEN = table()
AS_WRITTEN[65:91] -= 32

Owner = Callable[[int, np.ndarray], tuple[np.ndarray, np.ndarray]]


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every ``n`` words in a row, also across rows."""
    total = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for k, factor in enumerate(weights(n, seed=2000)):
        total += hashes[k : k + len(total)] * factor
    return mixed(total)


def anchors(words: Words, window: int, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(row, first window, windows, hash)`` of every anchor; windows are numbered by their first word."""
    n = len(words.hashes) - window + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    gram = grams(words.hashes, prefix)
    least, place = gram[:n].copy(), np.arange(n)
    for k in range(1, window - prefix + 1):
        smaller = gram[k : k + n] < least
        least[smaller] = gram[k : k + n][smaller]
        place[smaller] = np.flatnonzero(smaller) + k
    row = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    whole = np.flatnonzero(row[:n] == row[window - 1 :])
    if not len(whole):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    begins = np.flatnonzero(np.r_[True, (place[whole][1:] != place[whole][:-1]) | (row[whole][1:] != row[whole][:-1])])
    first = whole[begins]
    return row[first], first, np.diff(np.r_[begins, len(whole)]), gram[place[first]]


def _counted(window: int, prefix: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 0):
                found = anchors(Words(batch.column(0), AS_WRITTEN), window, prefix)[3]
                values, n = np.unique(found, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    return run


def repeated_anchors(docs: DataFrame, text: str, window: int, prefix: int) -> DataFrame:
    """``(h, n)`` of the anchors that are counted twice or more, written."""
    rows = docs.select(text).mapInArrow(_counted(window, prefix), "h long, n long")
    return written(rows.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1"))


def _bits(hashes: np.ndarray, width: int) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Slice and two places in it of each hash."""
    again = mixed(hashes)
    part = hashes >> np.uint64(64 - SLICES.bit_length() + 1)
    return part.astype(np.int64), ((hashes % np.uint64(width)).astype(np.int64), (again % np.uint64(width)).astype(np.int64))


def _slice_filters(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine: dict[int, np.ndarray] = {}
        for batch in batches:
            part, places = _bits(batch.column(1).to_numpy().view(np.uint64), width)
            for s in np.unique(part).tolist():
                bits = mine.setdefault(s, np.zeros(width, bool))
                for at in places:
                    bits[at[part == s]] = True
        for s, bits in mine.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([np.packbits(bits).tobytes()])], ["slice", "bits"])

    return run


def anchor_filter(repeated: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter of ``bits`` bits in slices, each made in one task."""
    width = bits // SLICES
    rows = repeated.select(F.shiftrightunsigned("h", 64 - SLICES.bit_length() + 1).cast("int").alias("slice"), "h").repartition("slice")
    out = np.zeros((SLICES, width // 8), np.uint8)
    for row in rows.mapInArrow(_slice_filters(width), "slice int, bits binary").toLocalIterator():
        out[row["slice"]] |= np.frombuffer(row["bits"], np.uint8)
    return out


def filtered(filters: np.ndarray, hot: np.ndarray) -> Owner:
    """Which anchors are repeated, and which of them are frequent, by filter and list."""
    width = filters.shape[1] * 8

    def judge(_: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        part, places = _bits(hashes, width)
        hit = np.ones(len(hashes), bool)
        for at in places:
            hit &= (filters[part, at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
        return hit, np.isin(hashes, hot)

    return judge


def _listed(column: pa.Array) -> Owner:
    """The same from each document's own list."""
    lists = column.to_pylist()

    def judge(row: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = lists[row] or ()
        every = np.array([x["h"] for x in own], np.int64).view(np.uint64)
        hot = np.array([x["h"] for x in own if x["hot"]], np.int64).view(np.uint64)
        return np.isin(hashes, every), np.isin(hashes, hot)

    return judge


def _judged(batch: pa.RecordBatch, found, shared) -> tuple[np.ndarray, np.ndarray]:
    row, _, _, hashes = found
    if shared is not None:
        return filtered(*shared.value)(0, hashes)
    judge = _listed(batch.column(3))
    repeated, hot = np.zeros(len(row), bool), np.zeros(len(row), bool)
    edges = np.flatnonzero(np.r_[True, row[1:] != row[:-1], True]) if len(row) else []
    for a, b in zip(edges[:-1], edges[1:]):
        repeated[a:b], hot[a:b] = judge(int(row[a]), hashes[a:b])
    return repeated, hot


def _leaves(shared, window: int, prefix: int):
    """Rows of suffixes: anchor, document, first window and the bytes that the windows cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1):
                words = Words(batch.column(1), AS_WRITTEN)
                found = anchors(words, window, prefix)
                repeated, hot = _judged(batch, found, shared)
                row, first, count, hashes = (x[repeated & ~hot] for x in found)
                raw = words.raw.tobytes()
                begin, end = words.starts[first].tolist(), words.ends[first + count + window - 2].tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(hashes.view(np.int64)), batch.column(0).take(pa.array(row)), batch.column(2).take(pa.array(row)),
                        pa.array((first - words.first[row]).astype(np.int32)), pa.array([raw[a:b] for a, b in zip(begin, end)], pa.binary()),
                    ],
                    ["h", "id", "digest", "start", "covered"],
                )

    return run


def _windows(batch: pa.RecordBatch, shared, window: int, prefix: int) -> Iterator[tuple[int, int, bytes]]:
    """``(row, first word, 128 bits)`` of every window of a frequent anchor."""
    words = Words(batch.column(1), AS_WRITTEN)
    found = anchors(words, window, prefix)
    row, first, count, _ = (x[_judged(batch, found, shared)[1]] for x in found)
    at = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    row, raw = np.repeat(row, count), words.raw.tobytes()
    begin, end, base = words.starts.tolist(), words.ends.tolist(), words.first[row]
    for r, s, place in zip(row.tolist(), at.tolist(), (at - base).tolist()):
        yield r, place, xxhash.xxh3_128_digest(b" ".join(raw[begin[k] : end[k]] for k in range(s, s + window)))


def _halves(prints: list[bytes]) -> tuple[pa.Array, pa.Array]:
    both = np.frombuffer(b"".join(prints), np.int64).reshape(-1, 2)
    return pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())


def _earlier(key, start: int, other, place: int) -> bool:
    if key is None or other is None:
        return key is None and (other is not None or start < place)
    return (key, start) < (other, place)


def _heads(shared, window: int, prefix: int):
    """The first place of each window of a frequent anchor in a batch, and how often it occurs there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1):
                ids = batch.column(0).to_pylist()
                first: dict[bytes, tuple] = {}
                count: dict[bytes, int] = {}
                for row, start, mark in _windows(batch, shared, window, prefix):
                    if mark not in first or _earlier(ids[row], start, *first[mark][:2]):
                        first[mark] = (ids[row], start, row)
                    count[mark] = count.get(mark, 0) + 1
                a, b = _halves(list(first))
                rows = pa.array([h[2] for h in first.values()], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [a, b, batch.column(0).take(rows), pa.array([h[1] for h in first.values()], pa.int32()), pa.array(list(count.values()), pa.int64())],
                    ["a", "b", "id", "start", "n"],
                )

    return run


def _later(shared, heads, window: int, prefix: int):
    """Passages of the windows that start earlier elsewhere, by a broadcast map of first places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = heads.value
        for whole in batches:
            for batch in slices(whole, 1):
                ids = batch.column(0).to_pylist()
                rows, begin, end = [], [], []
                for row, start, mark in _windows(batch, shared, window, prefix):
                    if mark in known and known[mark] != (ids[row], start):
                        if rows and rows[-1] == row and end[-1] >= start:
                            end[-1] = start + window
                        else:
                            rows.append(row)
                            begin.append(start)
                            end.append(start + window)
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(2).take(at), pa.array(begin, pa.int32()), pa.array(end, pa.int32())], ["id", "digest", "from", "to"]
                )

    return run


def _frequent(shared, window: int, prefix: int):
    """One row for each window of a frequent anchor, with 128 bits of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1):
                every = list(_windows(batch, shared, window, prefix))
                a, b = _halves([mark for _, _, mark in every])
                at = pa.array([row for row, _, _ in every], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [a, b, batch.column(0).take(at), batch.column(2).take(at), pa.array([start for _, start, _ in every], pa.int32())],
                    ["a", "b", "id", "digest", "start"],
                )

    return run


def frequent_passages(rows: DataFrame, shared, window: int, prefix: int, heads_kept: int) -> DataFrame:
    """``(id, digest, from, to)`` under frequent anchors: a node's first leaf is a minimum, combined before the shuffle.

    The first leaves of up to ``heads_kept`` nodes are broadcast; beyond that the windows are joined to them.
    """
    kind = rows.schema["id"].dataType.simpleString()
    some = rows.mapInArrow(_heads(shared, window, prefix), f"a long, b long, id {kind}, start int, n long")
    # A null key sorts first in a struct, too.
    head = F.min(F.struct("id", "start")).alias("head")
    heads = written(some.groupBy("a", "b").agg(head, F.sum("n").alias("n")).where("n > 1").select("a", "b", "head"))
    if heads.count() <= heads_kept:
        known = heads.select("a", "b", "head.id", "head.start").toArrow()
        marks = np.column_stack([known.column(c).to_numpy() for c in range(2)])
        places = zip(known.column(2).to_pylist(), known.column(3).to_pylist())
        sent = rows.sparkSession.sparkContext.broadcast({m.tobytes(): p for m, p in zip(marks, places)})
        return rows.mapInArrow(_later(shared, sent, window, prefix), f"id {kind}, digest long, `from` int, to int")
    ends = rows.mapInArrow(_frequent(shared, window, prefix), f"a long, b long, id {kind}, digest long, start int")
    later = ends.join(heads, ["a", "b"]).where(~(F.col("id").eqNullSafe(F.col("head.id")) & (F.col("start") == F.col("head.start"))))
    return later.select("id", "digest", F.col("start").alias("from"), (F.col("start") + window).alias("to"))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passages that touch or overlap become one."""
    for batch in batches:
        out = []
        for passages in batch.column(2).to_pylist():
            own: list[dict] = []
            for p in passages:
                if own and p["from"] <= own[-1]["to"]:
                    own[-1]["to"] = max(own[-1]["to"], p["to"])
                else:
                    own.append(dict(p))
            out.append(own)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, batch.column(2).type)], batch.schema.names)


def _symbols(covered: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all words, equal for equal words only, and each row's first one."""
    words = Words(covered, AS_WRITTEN)
    size = words.ends - words.starts
    inside = AS_WRITTEN[words.raw] > 0
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    flat = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(words.raw[inside])])
    return flat.dictionary_encode().indices.to_numpy().astype(np.int64), words.first


def _paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Ranks of the pairs ``(a, b)``."""
    return np.unique(a * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1].astype(np.int64)


def window_ranks(symbols: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """Ranks of the ``window`` symbols from each start, by doubling."""
    ranks, width, covered, out = symbols, 1, 0, None
    while True:
        if window & width:
            part = ranks[starts + covered]
            out = part if out is None else _paired(out, part)
            covered += width
        width *= 2
        if width > window:
            return out
        ranks = _paired(ranks[: len(ranks) - width // 2], ranks[width // 2 :])


def repeats_of(rows: pa.Table, window: int) -> pa.RecordBatch:
    """Passages of whole groups; the rows are in the order of group, key and first window."""
    covered, ids = rows.column(4).combine_chunks(), rows.column(1).combine_chunks()
    symbols, first = _symbols(covered)
    count = np.diff(first) - window + 1
    row = np.repeat(np.arange(len(count)), count)
    place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    leaf = first[row] + place
    start = rows.column(3).to_numpy()[row] + place
    code, group = ids.dictionary_encode(null_encoding="encode").indices.to_numpy(), rows.column(0).to_numpy()
    owner = np.cumsum(np.r_[0, (code[1:] != code[:-1]) | (group[1:] != group[:-1])])[row]
    node = window_ranks(symbols, leaf, window)
    # Leaves under one deep node stand together, the first one first.
    order = np.lexsort((owner << 32 | start, node))
    deep = np.r_[False, node[order][1:] == node[order][:-1]]
    heads = np.maximum.accumulate(np.where(deep, 0, np.arange(len(order))))
    head = np.empty(len(order), np.int64)
    head[order] = order[heads]
    later = (owner != owner[head]) | (start != start[head])
    at = np.flatnonzero(later)
    begins = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | (row[at][1:] != row[at][:-1])]) if len(at) else at
    last = np.r_[begins[1:], len(at)] - 1 if len(at) else at
    mine = row[at[begins]]
    return pa.RecordBatch.from_arrays(
        [
            ids.take(pa.array(mine)), rows.column(2).combine_chunks().take(pa.array(mine)),
            pa.array(start[at[begins]].astype(np.int32)), pa.array((start[at[last]] + window).astype(np.int32)),
        ],
        [rows.schema.names[1], "digest", "from", "to"],
    )


def _subtrees(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            for part in _pieces(batch):
                held.append(part)
                size += part.num_rows
                if size * window > BATCH:
                    rows = pa.Table.from_batches(held)
                    groups = rows.column(0).to_numpy()
                    # The last group may go on in the next batch.
                    cut = int(np.searchsorted(groups, groups[-1]))
                    if cut:
                        yield repeats_of(rows.slice(0, cut), window)
                        held, size = rows.slice(cut).combine_chunks().to_batches(), rows.num_rows - cut
        if size:
            yield repeats_of(pa.Table.from_batches(held), window)

    return run


def _pieces(batch: pa.RecordBatch, rows: int = 4_000) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def repeated_passages(
    docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, prefix: int = PREFIX,
    most: int = MOST, filter_bits: int = FILTER_BITS, hot_keys: int = HOT, heads_kept: int = HEADS,
) -> DataFrame:
    """``(key, digest, passages)`` of the rows that repeat earlier words: the maximal ``(from, to)`` in words, sorted.

    ``digest`` is ``xxhash64`` of the text, which tells rows of one key apart.
    """
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("digest"))
    kind = rows.schema["id"].dataType.simpleString()
    repeated = repeated_anchors(rows, "text", window, prefix)
    total = repeated.agg(F.count("*").alias("n"), F.count_if(F.col("n") > most).alias("hot")).first()
    hot = repeated.where(F.col("n") > most).select("h")
    bits = max(SLICES * 64, 1 << (12 * total["n"]).bit_length())
    shared = None
    if bits <= filter_bits and total["hot"] <= hot_keys:
        frequent = hot.toArrow().column(0).to_numpy().view(np.uint64)
        shared = docs.sparkSession.sparkContext.broadcast((anchor_filter(repeated, bits), np.sort(frequent)))
    else:
        rows = with_own_anchors(rows, repeated, most, window, prefix)
    leaves = rows.mapInArrow(_leaves(shared, window, prefix), f"h long, id {kind}, digest long, start int, covered binary")
    passage = f"id {kind}, digest long, `from` int, to int"
    found = leaves.repartition("h").sortWithinPartitions("h", F.asc_nulls_first("id"), "start").mapInArrow(_subtrees(window), passage)
    if total["hot"]:
        found = found.unionByName(frequent_passages(rows, shared, window, prefix, heads_kept))
    # A row's list holds at most its own windows.
    lists = found.groupBy("id", "digest").agg(F.sort_array(F.collect_set(F.struct("from", "to"))).alias("passages"))
    return lists.mapInArrow(_merged, lists.schema).withColumnRenamed("id", key)


def with_own_anchors(rows: DataFrame, repeated: DataFrame, most: int, window: int, prefix: int) -> DataFrame:
    """``rows`` with each one's repeated anchors in ``own``; nothing is broadcast."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1):
                row, _, _, hashes = anchors(Words(batch.column(1), AS_WRITTEN), window, prefix)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row)), batch.column(2).take(pa.array(row)), pa.array(hashes.view(np.int64))], ["id", "digest", "h"]
                )

    every = rows.mapInArrow(run, f"id {kind}, digest long, h long")
    known = every.join(repeated, "h").select("id", "digest", F.struct("h", (F.col("n") > most).alias("hot")).alias("x"))
    lists = known.groupBy("id", "digest").agg(F.collect_set("x").alias("own")).select(F.col("id").alias("_id"), F.col("digest").alias("_digest"), "own")
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest"))
    return rows.join(lists, same).select("id", "text", "digest", "own")


def _kept(at_text: int, at_list: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, at_text):
                texts = batch.column(at_text).cast(pa.large_binary()).to_pylist()
                total, removed, kept = [], [], []
                for text, passages in zip(texts, batch.column(at_list).to_pylist()):
                    # Without an argument bytes are split at the six ASCII blanks.
                    words = (text or b"").split()
                    total.append(len(words))
                    done, parts = 0, []
                    for p in passages or ():
                        if p["from"] > done:
                            parts.extend(words[done : p["from"]])
                        done = max(done, p["to"])
                    parts.extend(words[done:])
                    removed.append(len(words) - len(parts))
                    kept.append(b" ".join(parts))
                arrays = [c for n, c in enumerate(batch.columns) if n != at_list]
                names = [c for n, c in enumerate(batch.schema.names) if n != at_list]
                arrays[at_text] = pa.array(kept, pa.binary()).cast(batch.column(at_text).type)
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(total, pa.int64()), pa.array(removed, pa.int64())], [*names, "n_words", "n_removed"])

    return run


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", documents: int = DOCUMENTS, passages: int = PASSAGES, **options) -> DataFrame:
    """``docs`` with the words outside repeated passages in ``text``, and ``n_words`` (before) and ``n_removed``."""
    plain = docs.drop(*(c for c in docs.columns if c.lower() in ("n_words", "n_removed") and c not in (key, text)))
    lists = written(repeated_passages(docs, key, text, **options).select(F.col(key).alias("_tl_key"), F.col("digest").alias("_tl_digest"), F.col("passages").alias("_tl_passages")))
    size = lists.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("_tl_passages")), F.lit(0)).alias("m")).first()
    small = size["n"] <= documents and size["m"] <= passages
    same = F.col(key).eqNullSafe(F.col("_tl_key")) & (F.xxhash64(text) == F.col("_tl_digest"))
    joined = plain.join(F.broadcast(lists) if small else lists, same, "left").drop("_tl_key", "_tl_digest")
    out = plain.withColumns({"n_words": F.lit(0).cast("long"), "n_removed": F.lit(0).cast("long")}).schema
    for field in out.fields:
        field.nullable = True
    return joined.mapInArrow(_kept(plain.columns.index(text), len(plain.columns)), out)
