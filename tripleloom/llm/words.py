"""Words of Arrow text columns as numpy arrays: where they lie and a 64-bit hash of each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = b" \t\n\x0b\x0c\r"
#: Bytes hashed at once, so that the eight-byte temporaries stay small.
SPAN = 2_000_000


def table(word: bytes | None = None) -> np.ndarray:
    """For each byte the lower-case byte of a word, or 0 between words.

    Without ``word`` a word is what lies between ASCII white space; with it, ASCII
    bytes outside ``word`` end words too.  Bytes of other characters belong to words.
    """
    out = np.arange(256, dtype=np.uint16)
    out[65:91] += 32
    out[0] = 256
    out[list(SPACE)] = 0
    if word is not None:
        out[[b for b in range(128) if b not in word]] = 0
    return out


SPACED = table()
LETTERS = table(bytes([*range(48, 58), *range(65, 91), *range(97, 123)]))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def weights(n: int, seed: int = 0) -> np.ndarray:
    return mixed(np.arange(1 + seed, n + 1 + seed, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def slices(batch: pa.RecordBatch, text: int, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of text, one row at least."""
    ends = np.cumsum(lengths(batch.column(text)))
    at = 0
    while at < batch.num_rows:
        done = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def lengths(texts: pa.Array) -> np.ndarray:
    return raw_text(texts)[1]


def raw_text(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets, lengths and bytes of a text column; null counts as empty."""
    flat = texts.cast(pa.large_string()) if texts.type != pa.large_string() else texts
    if flat.null_count:
        flat = flat.fill_null("")
    offsets = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1] if len(flat) else np.zeros(1, np.int64)
    data = flat.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    raw = raw[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    return offsets, np.diff(offsets), raw


class Words:
    """``hashes``, byte ``starts`` and ``ends`` of all words, and ``first``: each row's first word."""

    def __init__(self, texts: pa.Array, letters: np.ndarray = SPACED):
        offsets, _, raw = raw_text(texts)
        low = letters[raw]
        inside = low > 0
        before = np.empty(len(raw) + 1, bool)
        before[0] = before[-1] = False
        before[1:] = inside
        begins = offsets[:-1][offsets[:-1] < len(raw)]
        edge = np.zeros(len(raw) + 1, bool)
        edge[begins] = True
        edge[len(raw)] = True
        self.starts = np.flatnonzero(inside & (~before[:-1] | edge[:-1]))
        after = np.empty(len(raw), bool)
        if len(raw):
            after[:-1] = inside[1:]
            after[-1] = False
        self.ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.raw, self.offsets = raw, offsets
        self.hashes = self._hashed(low)

    def _hashed(self, low: np.ndarray) -> np.ndarray:
        size = self.ends - self.starts
        out = np.zeros(len(size), np.uint64)
        factors = weights(int(size.max()) if len(size) else 0)
        at = 0
        while at < len(size):
            to = max(at + 1, int(np.searchsorted(self.ends, self.starts[at] + SPAN, "right")))
            starts, n = self.starts[at:to], size[at:to]
            fence = np.cumsum(n) - n
            place = np.arange(int(n.sum())) - np.repeat(fence, n)
            part = low[np.repeat(starts, n) + place].astype(np.uint64) * factors[place]
            out[at:to] = mixed(np.add.reduceat(part, fence) + n.astype(np.uint64))
            at = to
        return out


def shingles(hashes: np.ndarray, first: np.ndarray, n: int) -> list[np.ndarray]:
    """Each row's sorted distinct hashes of ``n`` words in a row; of the whole row where it has fewer."""
    factors = weights(n, seed=1000)
    out = []
    whole = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for k in range(n if len(whole) else 0):
        whole += hashes[k : k + len(whole)] * factors[k]
    whole = mixed(whole)
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= n:
            out.append(np.unique(whole[a : b - n + 1]))
        elif b > a:
            out.append(mixed((hashes[a:b] * factors[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
