"""Token counts of a byte-level BPE by rank-synchronous merging.

Distinct pre-tokens of a batch are held as ragged numpy arrays.  In each round
every sequence finds its lowest-rank pair, and all its places are merged at once;
the symbols left at the end are counted.  A pre-token of more than ``LONG`` bytes, a run
without a space, keeps its places by rank instead, so that a round looks at those it merges and their
neighbours alone.  No shuffle: each text is counted where
it lies, and a task keeps a bounded cache of pre-token lengths.

Defined results: a null or empty text has no tokens; the special tokens of the
vocabulary file count as one token wherever their strings stand in a text;
repeated rows are counted one by one; other columns are not read.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tripleloom.llm.words import slices

#: Fixed value: the pattern of the byte-level pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KNOWN = 400_000
#: Longer pre-tokens are not kept in the cache.
LONGEST = 64
#: Bytes from which a pre-token's places are kept by rank.
LONG = 1_000


class Merges:
    """Pair → (rank, merged symbol) as sorted arrays; symbols are vocabulary ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        vocab = content["model"]["vocab"]
        pairs = [p if isinstance(p, list) else p.split(" ") for p in content["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.width = max(vocab.values()) + 1
        keys = left * self.width + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.bytes = np.array([vocab[c] for c in byte_letters()], np.int64)
        self.special = sorted((t["content"] for t in content.get("added_tokens", ())), key=len, reverse=True)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; the number of merges where there is none."""
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], len(self.keys))


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 for itself, the rest from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


@cache
def merges(path: str) -> Merges:
    return Merges(path)


def long_length(piece: bytes, m: Merges) -> int:
    """How many symbols are left of one long piece: the places of the lowest rank are merged, then their new pairs placed."""
    n, none = len(piece), len(m.keys)
    symbol = m.bytes[np.frombuffer(piece, np.uint8)]
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    alive = np.ones(n, bool)
    waiting: dict[int, list[np.ndarray]] = {}
    ranks: list[int] = []

    def place(at: np.ndarray) -> None:
        at = at[after[at] < n]
        rank = m.rank(symbol[at], symbol[after[at]])
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        edges = np.flatnonzero(np.r_[True, rank[1:] != rank[:-1], True]) if len(rank) else []
        for a, b in zip(edges[:-1], edges[1:]):
            r = int(rank[a])
            if r == none:
                break
            if r not in waiting:
                waiting[r] = []
                heapq.heappush(ranks, r)
            waiting[r].append(at[a:b])

    place(np.arange(n - 1))
    while ranks:
        r = heapq.heappop(ranks)
        at = np.unique(np.concatenate(waiting.pop(r)))
        at = at[alive[at]]
        at = at[after[at] < n]
        at = at[m.rank(symbol[at], symbol[after[at]]) == r]
        if not len(at):
            continue
        # Hits that overlap (a run of one symbol) merge from the left: every other one.
        fresh = np.r_[True, after[at[:-1]] != at[1:]]
        run = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - run) % 2 == 0]
        right = after[at]
        symbol[at] = m.merged[r]
        alive[right] = False
        beyond = after[right]
        after[at] = beyond
        inside = beyond < n
        before[beyond[inside]] = at[inside]
        left = before[at]
        place(np.unique(np.concatenate([left[left >= 0], at])))
    return int(alive.sum())


def merged_lengths(pieces: list[bytes], m: Merges) -> np.ndarray:
    """How many symbols are left of each piece."""
    if any(len(p) > LONG for p in pieces):
        short = [n for n, p in enumerate(pieces) if len(p) <= LONG]
        out = np.array([long_length(p, m) if len(p) > LONG else 0 for p in pieces], np.int64)
        out[short] = merged_lengths([pieces[n] for n in short], m)
        return out
    size = np.array([len(p) for p in pieces], np.int64)
    row = np.repeat(np.arange(len(pieces)), size)
    symbol = m.bytes[np.frombuffer(b"".join(pieces), np.uint8)]
    left = np.zeros(len(pieces), np.int64)
    while len(row):
        paired = row[:-1] == row[1:]
        rank = np.where(paired, m.rank(symbol[:-1], symbol[1:]), len(m.keys))
        lowest = np.full(len(pieces), len(m.keys), np.int64)
        np.minimum.at(lowest, row[:-1], rank)
        # Rows without a pair are done and leave the arrays.
        done = lowest[row] == len(m.keys)
        left += np.bincount(row[done], minlength=len(pieces))
        hit = (rank == lowest[row[:-1]]) & ~done[:-1]
        # Hits that overlap (a run of one symbol) merge from the left: every other one.
        at = np.flatnonzero(hit)
        if len(at):
            fresh = np.r_[True, np.diff(at) > 1]
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
        symbol = symbol.copy()
        symbol[at] = m.merged[rank[at]]
        keep = ~done
        keep[at + 1] = False
        row, symbol = row[keep], symbol[keep]
    return left


@cache
def known(path: str) -> dict[str, int]:
    """Lengths of pre-tokens that this worker has merged."""
    return {}


def count_tokens(texts: list[str], path: str) -> list[int]:
    m, lengths = merges(path), known(path)
    special = regex.compile("|".join(map(regex.escape, m.special))) if m.special else None
    find = _pattern().findall
    parts, extra = [], []
    for text in texts:
        if special and any(s in text for s in m.special):
            between = special.split(text)
            extra.append(len(between) - 1)
            parts.append([p for piece in between for p in find(piece)])
        else:
            extra.append(0)
            parts.append(find(text))
    fresh = {p for found in parts for p in found if p not in lengths}
    if len(lengths) + len(fresh) > KNOWN:
        lengths.clear()
        fresh = {p for found in parts for p in found}
    new = sorted(fresh, key=len)
    lengths.update(zip(new, merged_lengths([p.encode() for p in new], m).tolist()))
    out = [sum(map(lengths.__getitem__, found)) + n for found, n in zip(parts, extra)]
    for p in reversed(new):
        if len(p) <= LONGEST:
            break
        del lengths[p]
    return out


@cache
def _pattern() -> regex.Pattern:
    return regex.compile(PATTERN)


def token_counts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = 1024) -> DataFrame:
    """``(key, n_bytes, n_tokens, over_limit)`` for every row; the vocabulary file lies at ``path`` on each executor."""
    rows = docs.select(key, text)
    schema = rows.schema[key]
    out = f"`{key}` {schema.dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean"
    return rows.mapInArrow(_counter(path, key, limit), out)


def _counter(path: str, key: str, limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1):
                texts = [t or "" for t in batch.column(1).to_pylist()]
                n = np.array(count_tokens(texts, path), np.int64)
                size = np.array([len(t.encode()) for t in texts], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(size), pa.array(n), pa.array(n > limit)], [key, "n_bytes", "n_tokens", "over_limit"]
                )

    return run
