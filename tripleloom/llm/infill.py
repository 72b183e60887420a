"""Fill-in-the-middle texts by displacement: cuts at line ends, one shift per byte, scatter out and gather back.

A text is cut at two line ends into prefix, middle and suffix, and its parts change
places between the marks ``<P>``, ``<S>`` and ``<M>``:

* ``psm``: ``<P>`` prefix ``<S>`` suffix ``<M>`` middle;
* ``spm``: ``<S>`` suffix ``<P>`` prefix ``<M>`` middle;
* ``plain``: the text as it is.

All texts of a batch are one run of bytes.  A scan finds the line ends and the cuts; each
part's displacement enters a difference array at the part's first byte, and the running sum
is every byte's shift to its place in the output, where one numpy assignment scatters it.
``restored`` finds the marks in the output alone, sums the opposite displacements and
gathers.  Long texts are moved in blocks, so memory is a small multiple of the text.

The cuts come from the SHA-256 of ``<seed>:<key>``, so a row is cut the same way wherever it runs.
Nothing is shuffled.

Defined results: a null text is empty; an empty text and one that holds a mark are plain, and
so is one beyond ``rate`` percent; a null key hashes as an empty one; repeated rows are cut
alike; input columns named like new ones are replaced.  ``restored`` returns a text
as it is when its form is null, plain or unknown, or when the form's marks are not in it once each in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleloom.llm.words import raw_text, slices

MARKS = (b"<P>", b"<S>", b"<M>")
WIDTH = 3
#: Bytes moved at once.
SPAN = 4_000_000
NEW = ("n", "form", "prefix_chars", "middle_chars", "fim_text")


def draws(keys: list, seed: int) -> np.ndarray:
    """Four 32-bit numbers for each key."""
    digests = b"".join(hashlib.sha256(f"{seed}:{'' if k is None else k}".encode()).digest()[:16] for k in keys)
    return np.frombuffer(digests, ">u4").reshape(-1, 4).astype(np.int64)


def mark_places(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place, row and mark number of every mark that lies inside one row."""
    if len(raw) < WIDTH:
        return (np.zeros(0, np.int64),) * 3
    kind = np.zeros(256, np.int8)
    kind[[m[1] for m in MARKS]] = np.arange(1, len(MARKS) + 1)
    at = np.flatnonzero((raw[:-2] == MARKS[0][0]) & (raw[2:] == MARKS[0][2]) & (kind[raw[1:-1]] > 0))
    row = np.searchsorted(offsets, at, "right") - 1
    inside = at + WIDTH <= offsets[row + 1]
    at, row = at[inside], row[inside]
    return at, row, kind[raw[at + 1]].astype(np.int64) - 1


def line_units(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the lines of all rows, and each row's first one; a last line needs no newline."""
    ends = np.flatnonzero(raw == 10) + 1
    closing = offsets[1:][np.diff(offsets) > 0]
    ends = np.union1d(ends, closing)
    return ends, np.searchsorted(ends, offsets, "right")


def displaced(starts: np.ndarray, shifts: np.ndarray, size: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """``(from, to, place of each byte)`` in blocks; the part at ``starts[k]`` moves by ``shifts[k]``.

    Parts are in order and cover ``size`` bytes; empty parts may share a start, the last one counts.
    """
    used = np.r_[starts[1:] > starts[:-1], True] & (starts < size) if len(starts) else np.zeros(0, bool)
    starts, steps = starts[used], np.diff(shifts[used], prepend=0)
    carried = 0
    for at in range(0, size, SPAN):
        to = min(size, at + SPAN)
        first, last = np.searchsorted(starts, [at, to])
        shift = np.zeros(to - at, np.int64)
        shift[starts[first:last] - at] = steps[first:last]
        shift[0] += carried
        np.cumsum(shift, out=shift)
        carried = int(shift[-1])
        yield at, to, shift + np.arange(at, to)


def _parts(cuts: np.ndarray, order: np.ndarray, width: int) -> np.ndarray:
    """Places of the parts inside their output, where part ``order[:, k]`` is the k-th and a mark stands before each."""
    size = np.diff(cuts, axis=1)
    moved = np.take_along_axis(size, order, 1)
    begins = np.cumsum(moved, axis=1) - moved + width * np.arange(1, cuts.shape[1])
    out = np.empty_like(begins)
    np.put_along_axis(out, order, begins, 1)
    return out


#: Order of the parts (prefix 0, middle 1, suffix 2) in each form, and of the marks before them.
ORDER = {"psm": ((0, 2, 1), (0, 1, 2)), "spm": ((2, 0, 1), (1, 0, 2))}


def _strings(raw: np.ndarray, offsets: np.ndarray) -> pa.Array:
    kind = pa.large_string() if offsets[-1] >= 2**31 else pa.string()
    width = np.int64 if offsets[-1] >= 2**31 else np.int32
    return pa.Array.from_buffers(kind, len(offsets) - 1, [None, pa.py_buffer(offsets.astype(width)), pa.py_buffer(raw)])


def _letters(raw: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Code points between neighbouring cuts."""
    heads = np.flatnonzero((raw & 0xC0) != 0x80)
    return np.diff(np.searchsorted(heads, cuts), axis=1)


def cut_batch(texts: pa.Array, keys: list, seed: int, rate: int, spm_rate: int) -> list[pa.Array]:
    """``n, form, prefix_chars, middle_chars, fim_text`` of one batch."""
    offsets, size, raw = raw_text(texts)
    ends, first = line_units(raw, offsets)
    n = np.diff(first)
    h = draws(keys, seed)
    plain = (size == 0) | (h[:, 2] % 100 >= rate)
    plain[mark_places(raw, offsets)[1]] = True
    spm = ~plain & (h[:, 3] % 100 < spm_rate)
    units = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
    units[plain] = n[plain, None]
    # The end of the row before is the cut in front of the first unit.
    before = np.r_[0, ends]
    places = np.where(units > 0, before[np.minimum(first[:-1, None] + units, len(ends))], offsets[:-1, None])
    cuts = np.column_stack([offsets[:-1], places, offsets[1:]])
    order = np.where(spm[:, None], ORDER["spm"][0], ORDER["psm"][0])
    out_offsets = np.concatenate([[0], np.cumsum(size + np.where(plain, 0, WIDTH * len(MARKS)))])
    target = _parts(cuts, order, WIDTH)
    target[plain] = 0
    shifts = out_offsets[:-1, None] + target - cuts[:, :-1]
    out = np.empty(int(out_offsets[-1]), np.uint8)
    for at, to, place in displaced(cuts[:, :-1].ravel(), shifts.ravel(), len(raw)):
        out[place] = raw[at:to]
    for form, chosen in (("psm", ~plain & ~spm), ("spm", spm)):
        for part, mark in zip(*ORDER[form]):
            place = out_offsets[:-1][chosen] + target[chosen, part] - WIDTH
            out[place[:, None] + np.arange(WIDTH)] = np.frombuffer(MARKS[mark], np.uint8)
    chars = _letters(raw, cuts)
    form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
    return [
        pa.array(n.astype(np.int64)),
        pa.array(form.tolist(), pa.string()),
        pa.array(chars[:, 0].astype(np.int64), mask=plain),
        pa.array(chars[:, 1].astype(np.int64), mask=plain),
        _strings(out, out_offsets),
    ]


def restore_batch(texts: pa.Array, forms: list) -> pa.Array:
    """The texts before ``cut_batch``, from outputs and forms alone."""
    offsets, size, raw = raw_text(texts)
    at, row, mark = mark_places(raw, offsets)
    seen = np.bincount(row, minlength=len(size))
    begin = np.concatenate([[0], np.cumsum(seen)])[:-1]
    # One part as long as the row, and two empty ones, where nothing moves.
    sources = np.repeat(offsets[:-1, None], 3, 1)
    sizes = np.column_stack([size, np.zeros_like(size), np.zeros_like(size)])
    for form, (parts, marks) in ORDER.items():
        rows = np.flatnonzero((np.array([f == form for f in forms], bool)) & (seen == len(MARKS)))
        three = begin[rows, None] + np.arange(len(MARKS))
        good = (mark[three] == marks).all(1) & (at[three[:, 0]] == offsets[rows]) if len(rows) else np.zeros(0, bool)
        rows, three = rows[good], three[good]
        starts = at[three] + WIDTH
        stops = np.column_stack([at[three][:, 1:], offsets[rows + 1]])
        for k, part in enumerate(parts):
            sources[rows, part] = starts[:, k]
            sizes[rows, part] = stops[:, k] - starts[:, k]
    out_offsets = np.concatenate([[0], np.cumsum(sizes.sum(1))])
    begins = out_offsets[:-1, None] + np.cumsum(sizes, axis=1) - sizes
    out = np.empty(int(out_offsets[-1]), np.uint8)
    for a, b, place in displaced(begins.ravel(), (sources - begins).ravel(), len(out)):
        out[a:b] = raw[place]
    return _strings(out, out_offsets)


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 7, rate: int = 100, spm_rate: int = 50) -> DataFrame:
    """``docs`` with ``n`` (lines), ``form``, ``prefix_chars``, ``middle_chars`` (null if plain) and ``fim_text``."""
    plain = docs.drop(*(c for c in docs.columns if c.lower() in NEW and c not in (key, text)))
    clash = [c for c in (key, text) if c.lower() in NEW]
    if clash:
        raise ValueError(f"rename the input columns {clash}: the output has columns of these names")
    at_key, at_text = plain.columns.index(key), plain.columns.index(text)
    out = plain.select(
        "*", F.lit(0).cast("long").alias("n"), F.lit("").alias("form"),
        F.lit(0).cast("long").alias("prefix_chars"), F.lit(0).cast("long").alias("middle_chars"), F.lit("").alias("fim_text"),
    ).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, at_text):
                new = cut_batch(batch.column(at_text), batch.column(at_key).to_pylist(), seed, rate, spm_rate)
                yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *NEW])

    return plain.mapInArrow(run, _nullable(out))


def restored(df: DataFrame, text: str = "fim_text", form: str = "form", name: str = "restored_text") -> DataFrame:
    """``df`` with the text before the transformation, from ``text`` and ``form`` alone."""
    plain = df.drop(*(c for c in df.columns if c.lower() == name.lower()))
    at_text, at_form = plain.columns.index(text), plain.columns.index(form)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, at_text):
                new = restore_batch(batch.column(at_text), batch.column(at_form).to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns, new], [*batch.schema.names, name])

    return plain.mapInArrow(run, _nullable(plain.withColumn(name, F.lit("")).schema))


def _nullable(schema):
    for field in schema.fields:
        field.nullable = True
    return schema
