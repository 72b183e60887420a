"""Benchmark decontamination with spaced seeds.

Words are runs of ASCII letters and digits or other non-ASCII bytes, lower-cased.
Fixed masks keep some places of a window and ignore the others; a window's hash over the kept places
survives substitutions at the ignored ones.  The hashes of the test items are joined with those
of the documents inside the tasks that hold the texts; around each hit the overlap is verified on its
diagonal, where item and document stand word by word.

An overlap counts where

* the whole item stands on the diagonal but for the substitutions that its length allows: none below 6
  words, one below 12, else two; or
* a stretch of it does, with at least ``least`` equal words and three of them around each substituted one (the
  best run with +1 for an equal word and -3 for another).

The masks are chosen by the item's length, so that every placement of the allowed substitutions leaves a hit; a
stretch of ``least`` equal words with up to two substitutions is always hit, too.  Items of fewer than ``shortest`` words (3) name no passage and are not searched.

The items are dealt into blocks of about ``block_words`` words; only one block's index
is broadcast at a time, and every block meets all documents.  Nothing is shuffled but the items.

Defined results: a null or empty text overlaps with nothing; repeated rows are searched one by one; repeated items are
reported under each id, once for each text; empty tables give empty results; where ``key`` and ``item``
have one name, the item's column is called ``benchmark_<name>``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleloom.llm.words import LETTERS, Words, mixed, slices, weights

#: First length of the items that use them, and the places that each mask keeps.  Found by search; each
#: group leaves a hit for all placements of the substitutions that its lengths allow (a test goes through them).
MASKS = (
    (12, ("11101011", "101100111", "111111")),
    (8, ("111111", "1111011", "1101111")),
    (6, ("1111", "11011")),
)
FILTER_BITS = 22
#: Words of diagonals that are compared at once.
DIAGONALS = 1_000_000


def allowed(words: int) -> int:
    """Substitutions that a whole item may have."""
    return min(2, words // 6)


def masks_of(words: int) -> tuple[str, ...]:
    """Masks for items of this length; below 6 words all places of the whole item."""
    return next((masks for first, masks in MASKS if words >= first), ("1" * words,))


def seed_hashes(words: np.ndarray, mask: str) -> np.ndarray:
    """The hash of every window of the mask's length, over its kept places."""
    n = len(words) - len(mask) + 1
    total = np.zeros(max(n, 0), np.uint64)
    factors = weights(len(mask), seed=int(mask, 2))
    for k, kept in enumerate(mask):
        if n > 0 and kept == "1":
            total += words[k : k + n] * factors[k]
    return mixed(total)


class Index:
    """Seeds of a block of items, as sorted arrays."""

    def __init__(self, ids: list, texts: list[str], least: int, shortest: int = 3):
        found = Words(pa.array(texts, pa.large_string()), LETTERS)
        self.ids, self.least = ids, least
        self.words, self.first = found.hashes, found.first
        size = np.diff(found.first)
        lengths = [n for n in np.unique(size).tolist() if n >= shortest]
        owner = np.repeat(np.arange(len(ids)), size)
        self.masks = sorted({mask for n in lengths for mask in masks_of(n)})
        self.tables = []
        for mask in self.masks:
            mine = np.isin(size, [n for n in lengths if mask in masks_of(n)])
            hashes = seed_hashes(found.hashes, mask)
            at = np.flatnonzero(owner[: len(hashes)] == owner[len(mask) - 1 :])
            at = at[mine[owner[at]]]
            hashes = hashes[at]
            order = np.argsort(hashes, kind="stable")
            flags = np.zeros(1 << FILTER_BITS, bool)
            flags[hashes & np.uint64((1 << FILTER_BITS) - 1)] = True
            self.tables.append((hashes[order], owner[at][order], (at - found.first[owner[at]])[order], np.packbits(flags)))

    def open(self) -> list[np.ndarray]:
        return [np.unpackbits(t[3]).view(bool) for t in self.tables]

    def overlaps(self, words: np.ndarray, first: np.ndarray, flags: list[np.ndarray]) -> list[tuple]:
        """``(row, item, row start, item start, length, equal words)``, the best one of each row and item."""
        rows, items, shifts = [], [], []
        for mask, (hashes, owner, place, _), flag in zip(self.masks, self.tables, flags):
            own = seed_hashes(words, mask)
            at = np.flatnonzero(flag[own & np.uint64((1 << FILTER_BITS) - 1)])
            low, high = np.searchsorted(hashes, own[at], "left"), np.searchsorted(hashes, own[at], "right")
            n = high - low
            at, low, n = at[n > 0], low[n > 0], n[n > 0]
            hit = np.repeat(low, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            at = np.repeat(at, n)
            row = np.searchsorted(first, at, "right") - 1
            inside = at + len(mask) <= first[row + 1]
            row, at, hit = row[inside], at[inside], hit[inside]
            rows.append(row)
            items.append(owner[hit])
            shifts.append(at - first[row] - place[hit])
        seen = np.unique(np.stack([np.concatenate(x) for x in (rows, items, shifts)]), axis=1) if rows else np.zeros((3, 0), int)
        seen = seen[:, self.possible(words, first, *seen)]
        best: dict[tuple, tuple] = {}
        for row, item, shift in seen.T.tolist():
            found = self.verified(words[first[row] : first[row + 1]], item, shift)
            if found and found[3] > best.get((row, item), (0, 0, 0, 0))[3]:
                best[row, item] = found
        return [(*key, *value) for key, value in sorted(best.items())]

    def possible(self, words: np.ndarray, first: np.ndarray, row: np.ndarray, item: np.ndarray, shift: np.ndarray) -> np.ndarray:
        """Whether a diagonal has enough equal words at all, counted for all of them at once."""
        size = np.diff(self.first)[item]
        low, high = np.maximum(0, -shift), np.minimum(size, first[row + 1] - first[row] - shift)
        n = np.maximum(high - low, 0)
        out = np.zeros(len(row), bool)
        ends = np.cumsum(n)
        at = 0
        while at < len(row):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + DIAGONALS, "right")))
            part = np.repeat(np.arange(at, to), n[at:to])
            place = np.arange(len(part)) - np.repeat(np.cumsum(n[at:to]) - n[at:to], n[at:to]) + low[part]
            same = words[first[row[part]] + shift[part] + place] == self.words[self.first[item[part]] + place]
            equal = np.bincount(part[same] - at, minlength=to - at)
            tolerated = np.minimum(2, size[at:to] // 6)
            out[at:to] = equal >= np.minimum(self.least, size[at:to] - tolerated)
            at = to
        return out

    def verified(self, row: np.ndarray, item: int, shift: int) -> tuple[int, int, int, int] | None:
        words = self.words[self.first[item] : self.first[item + 1]]
        low, high = max(0, -shift), min(len(words), len(row) - shift)
        same = row[low + shift : high + shift] == words[low:high]
        if same.sum() >= len(words) - allowed(len(words)):
            start, end = int(np.argmax(same)), len(same) - int(np.argmax(same[::-1]))
        else:
            gain = np.r_[0, np.cumsum(np.where(same, 1, -3))]
            floor = np.minimum.accumulate(gain)
            end = int(np.argmax(gain - floor))
            start = int(np.argmin(gain[: end + 1]))
            if same[start:end].sum() < self.least:
                return None
        return low + start + shift, low + start, end - start, int(same[start:end].sum())


def benchmark_blocks(items: DataFrame, key: str, text: str, least: int, block_words: int) -> Iterator[Index]:
    """Indexes of blocks of items; one block at a time is on the driver."""
    rows = items.select(key, text).distinct()
    words = F.size(F.split(F.coalesce(text, F.lit("")), " "))
    total = rows.agg(F.sum(words)).first()[0] or 0
    blocks = max(1, -(-total // block_words))
    for n in range(blocks):
        # By id and text, so neither repeated nor null ids fill a block.
        block = rows.where(F.pmod(F.xxhash64(key, text), F.lit(blocks)) == n).orderBy(key, text).toArrow()
        if block.num_rows:
            yield Index(block.column(0).to_pylist(), [t or "" for t in block.column(1).to_pylist()], least)


def contaminations(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", least: int = 12, block_words: int = 1_000_000) -> DataFrame:
    """One row per document and item that overlap, with the place, length and equal words of the best overlap."""
    rows = docs.select(key, text)
    kinds = rows.schema[key].dataType.simpleString(), items.schema[item].dataType.simpleString()
    name = f"benchmark_{item}" if item.lower() == key.lower() else item
    out = f"`{key}` {kinds[0]}, `{name}` {kinds[1]}, doc_word long, item_word long, length long, equal_words long"
    found = rows.limit(0).mapInArrow(lambda batches: iter(()), out)
    for index in benchmark_blocks(items, item, item_text, least, block_words):
        shared = docs.sparkSession.sparkContext.broadcast(index)
        found = found.unionByName(rows.mapInArrow(_reporter(shared, key, name), out))
    return found


def decontaminated(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", least: int = 12, block_words: int = 1_000_000) -> DataFrame:
    """``docs`` without the rows that overlap with any item; columns and order inside partitions stay."""
    for index in benchmark_blocks(items, item, item_text, least, block_words):
        shared = docs.sparkSession.sparkContext.broadcast(index)
        docs = docs.mapInArrow(_filter(shared, docs.columns.index(text)), docs.schema)
    return docs


def _search(shared, batch: pa.RecordBatch, text: int, flags: list) -> list[tuple]:
    found = Words(batch.column(text), LETTERS)
    return shared.value.overlaps(found.hashes, found.first, flags)


def _reporter(shared, key: str, item: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        flags = index.open()
        names = [key, item, "doc_word", "item_word", "length", "equal_words"]
        ids = pa.array(index.ids)
        for whole in batches:
            for batch in slices(whole, 1):
                found = np.array(_search(shared, batch, 1, flags), np.int64).reshape(-1, 6)
                columns = [batch.column(0).take(pa.array(found[:, 0])), ids.take(pa.array(found[:, 1]))]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(found[:, k]) for k in range(2, 6)], names)

    return run


def _filter(shared, text: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = shared.value.open()
        for whole in batches:
            for batch in slices(whole, text):
                keep = np.ones(batch.num_rows, bool)
                keep[[f[0] for f in _search(shared, batch, text, flags)]] = False
                yield batch.filter(pa.array(keep))

    return run
