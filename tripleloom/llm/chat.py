"""Chat formatting by columnar byte assembly.

Turns are range-partitioned by conversation and place, so a conversation of any
length spreads over tasks.  A task assembles its turns into one preallocated Arrow
buffer per batch: segment lengths, cumulative offsets and gather indices are numpy
arrays, and headers and contents are copied through them.

The result has rows ``(conv, part)``: a run of whole turns of one conversation as formatted
text, with the loss mask as code point spans of the assistant contents.  The parts of
a conversation, put together by ``part``, are its formatted text.

Template: ``<s>role\\ntext</s>\\n`` for each turn.  Control strings inside texts and
roles get a backslash after their first character (existing ones shift by one), which
``unescaped`` takes away again; line feeds and backslashes in roles are escaped too.

Defined results: turns are ordered by turn, then role, then a hash of the text, nulls first; a
null text or role is empty; repeated rows are turns of their own; a null
conversation id is one conversation; an empty table gives an empty table; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleloom.llm.words import raw_text, slices

OPEN, CLOSE = "<s>", "</s>\n"
#: Control strings that a content must not show; each is a first character and the rest.
CONTROLS = (("<", r"/?s>"), (r"\[", r"/?INST\]"))
#: Segments longer than this are copied as one slice.
LONG = 4096


def escaped(texts: pa.Array) -> pa.Array:
    for first, rest in CONTROLS:
        texts = pc.replace_substring_regex(texts, rf"({first})(\\*)({rest})", r"\1\\\2\3")
    return texts


def unescaped(text: str) -> str:
    for first, rest in CONTROLS:
        text = re.sub(rf"({first})\\(\\*{rest})", r"\1\2", text)
    return text


def escaped_roles(roles: pa.Array) -> pa.Array:
    return escaped(pc.replace_substring(pc.replace_substring(roles, "\\", "\\\\"), "\n", "\\n"))


def unescaped_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(role))


def assemble(columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the columns woven row by row into one buffer, and the end of every segment.

    Segment ``r * len(columns) + c`` is row ``r`` of column ``c``.
    """
    parts = [raw_text(c) for c in columns]
    bases = np.cumsum([0] + [len(p[2]) for p in parts[:-1]])
    source = np.concatenate([p[2] for p in parts])
    size = np.stack([p[1] for p in parts], axis=1).ravel()
    origin = np.stack([p[0][:-1] + b for p, b in zip(parts, bases)], axis=1).ravel()
    ends = np.cumsum(size)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    start = ends - size
    for k in np.flatnonzero(size > LONG):
        out[start[k] : ends[k]] = source[origin[k] : origin[k] + size[k]]
    short = size <= LONG
    n, at, to = size[short], origin[short], start[short]
    place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    out[np.repeat(to, n) + place] = source[np.repeat(at, n) + place]
    return out, ends


def format_chat(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained: str = "assistant", partitions: int | None = None) -> DataFrame:
    """``(conv, part, n_turns, formatted, mask)``; ``mask`` holds ``(start, end)`` of what is trained on.

    ``part`` grows along the conversation; it need not be gapless.
    """
    rows = turns.select(conv, turn, role, text)
    tie = F.coalesce(F.length(text), F.lit(0))
    order = [F.col(conv).asc_nulls_first(), F.col(turn).asc_nulls_first(), F.col(role).asc_nulls_first()]
    # Texts stay out of the sampled range keys; equal rows are spread by their place in the input.
    keys = [*order, F.xxhash64(text), F.monotonically_increasing_id()]
    spread = rows.repartitionByRange(partitions, *keys) if partitions else rows.repartitionByRange(*keys)
    sorted_rows = spread.sortWithinPartitions(*order, F.xxhash64(text), tie, F.col(text).asc_nulls_first())
    numbered = sorted_rows.withColumn("_tl_p", F.spark_partition_id().cast("long") * (1 << 40))
    kind = rows.schema[conv].dataType.simpleString()
    out = f"`{conv}` {kind}, part long, n_turns long, formatted string, mask array<struct<start:long,end:long>>"
    return numbered.mapInArrow(_formatter(conv, trained), out)


def _formatter(conv: str, trained: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        for whole in batches:
            for batch in slices(whole, 3, 1_000_000):
                yield _formatted(batch, conv, trained, done)
                done += batch.num_rows

    return run


def _formatted(batch: pa.RecordBatch, conv: str, trained: str, done: int) -> pa.RecordBatch:
    ids = batch.column(0)
    roles, texts = (batch.column(n).cast(pa.large_string()).fill_null("") for n in (2, 3))
    n = batch.num_rows
    fixed = lambda s: pa.array([s] * n, pa.large_string())
    raw, ends = assemble([fixed(OPEN), escaped_roles(roles), fixed("\n"), escaped(texts), fixed(CLOSE)])
    ends = ends.reshape(n, 5)
    codes = ids.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    starts = np.r_[0, ends[:, 4]][first]
    # Code points up to each byte, so that the mask counts characters.
    points = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]
    loss = np.flatnonzero(np.asarray(pc.equal(roles, trained)))
    conversation = np.searchsorted(first, loss, "right") - 1
    base = points[starts[conversation]]
    spans = pa.StructArray.from_arrays([pa.array(points[ends[loss, k]] - base) for k in (2, 3)], ["start", "end"])
    formatted = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(np.r_[starts, len(raw)].astype(np.int64)), pa.py_buffer(raw))
    mask = pa.ListArray.from_arrays(np.searchsorted(loss, np.r_[first, n]).astype(np.int32), spans)
    part = batch.column(4).take(pa.array(first)).to_numpy() + done + first
    return pa.RecordBatch.from_arrays(
        [ids.take(pa.array(first)), pa.array(part), pa.array(np.diff(np.r_[first, n])), formatted.cast(pa.string()), mask],
        [conv, "part", "n_turns", "formatted", "mask"],
    )


def read_back(formatted: str) -> list[tuple[str, str]]:
    """``(role, text)`` of every turn."""
    found = []
    for piece in formatted.split(CLOSE)[:-1]:
        head, _, text = piece.removeprefix(OPEN).partition("\n")
        found.append((unescaped_role(head), unescaped(text)))
    return found


def masked(formatted: str, mask: list[dict]) -> list[str]:
    return [unescaped(formatted[m["start"] : m["end"]]) for m in mask]


def chat_digests(parts: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Per conversation what is read back from its parts: turns, loss text and length, as counts and digests.

    A digest runs along its conversation, so one task reads the parts in order and
    keeps nothing but the state of the hashes.
    """
    kind = parts.schema[conv].dataType.simpleString()
    out = f"`{conv}` {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    ordered = parts.select(conv, "part", "formatted", "mask").repartition(conv).sortWithinPartitions(F.col(conv).asc_nulls_first(), "part")
    return ordered.mapInArrow(_digester(conv), out)


class _Digest:
    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = 0

    def add(self, formatted: str, mask: list[dict]) -> None:
        for role, text in read_back(formatted):
            self.turns.update(f"{role}\n{text}\n".encode())
            self.n_turns += 1
        for text in masked(formatted, mask):
            self.loss.update(text.encode())
            self.loss_chars += len(text)
        self.formatted_chars += len(formatted)

    def row(self) -> tuple:
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars


def _digester(conv: str):
    names = [conv, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_id, digest, kind = None, None, None
        for whole in batches:
            kind = whole.schema.field(0).type
            for batch in slices(whole, 2, 1_000_000):
                done = []
                for key, formatted, mask in zip(*(batch.column(n).to_pylist() for n in (0, 2, 3))):
                    if digest is None or key != open_id:
                        if digest is not None:
                            done.append((open_id, *digest.row()))
                        open_id, digest = key, _Digest()
                    digest.add(formatted, mask)
                if done:
                    yield _rows(done, names, kind)
        if digest is not None:
            yield _rows([(open_id, *digest.row())], names, kind)

    return run


def _rows(rows: list[tuple], names: list[str], kind: pa.DataType) -> pa.RecordBatch:
    types = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
