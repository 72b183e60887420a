"""SentencePiece encoding and decoding by a shared-prefix forward pass.

The distinct marked words of a batch are sorted, which is the depth-first order
of their trie; each word starts from the forward state of the prefix it shares
with the word before, so a common prefix is scored once.

The state of a prefix depends on the kind of model:

* ``unigram``: the best sum of piece scores and the last piece of that path (Viterbi).
* ``bpe``: the last piece of the prefix's own encoding.  Adding up scores cannot give
  the pieces of a merge model, so a step is allowed when its two pieces stay
  apart if their joined text is encoded alone.  Merges never cross the border of
  two such pieces, so exactly one path through allowed steps exists, and it is the
  encoding that the library gives.

A marked word is a run of marks (U+2581 for spaces) with what follows it; no piece
has a mark after another character, which is checked when the model is loaded.  If no
piece joins a letter with a character of another kind, words also end between them.
Texts are taken unchanged, as models with an identity normalizer do.

Defined results: a null or empty text has no pieces and decodes to an empty text;
repeated rows are encoded one by one; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from tripleloom.llm.words import slices

MARK = "▁"
LETTER = r"[^\W\d_{}]"
ONE = (1,)
#: Words, and allowed or forbidden pairs, that a worker remembers.
KNOWN = 600_000
LONGEST = 64


class Pieces:
    """A vocabulary: ``ids`` and ``scores`` by piece, byte pieces for what it lacks."""

    def __init__(self, scores: dict[str, float], ids: dict[str, int], by_bytes: list[int], unknown: int, kind: str):
        self.scores, self.ids, self.by_bytes, self.unknown, self.kind = scores, ids, by_bytes, unknown, kind
        self.longest = max(map(len, scores), default=1)
        if any(MARK in p.lstrip(MARK) for p in scores):
            raise ValueError("a piece has a mark after another character")
        self.text = {i: p for p, i in ids.items()}
        pairs = {pair for p in scores for pair in zip(p.lstrip(MARK), p.lstrip(MARK)[1:])}
        # Numerals that the letter class takes in, but no word: they stand with punctuation in pieces.
        numerals = "".join(sorted({c for pair in pairs for c in pair if c.isalnum() and not c.isalpha() and not c.isdecimal()}))
        letter = LETTER.format(re.escape(numerals))
        is_letter = re.compile(letter).fullmatch
        joins = any(bool(is_letter(a)) != bool(is_letter(b)) for a, b in pairs)
        #: Where no piece joins a letter with another character, a word ends between them.
        self.split = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+" if joins else f"{MARK}*{letter}+|{MARK}*(?:(?!{letter})[^{MARK}])+|{MARK}+").findall
        #: Pieces that merging ever makes, and their lengths by their last two characters, longest first.
        self.usable = {p for p in scores if len(p) > 1 and (kind != "bpe" or self.merged(p) == [p])}
        ends: dict[str, set[int]] = {}
        for piece in self.usable:
            ends.setdefault(piece[-2:], {1}).add(len(piece))
        self.ends = {k: tuple(sorted(v, reverse=True)) for k, v in ends.items()}
        self.byte_of = {i: b for b, i in enumerate(by_bytes)}
        self.words: dict[str, tuple[int, ...]] = {}
        #: By left piece, whether a right piece stays apart from it.
        self.apart: dict[str, dict[str, bool]] = {}
        self.pairs = 0

    @staticmethod
    def load(path: str, kind: str = "bpe") -> Pieces:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [
            i
            for i in range(model.vocab_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
        ]
        ids = {model.id_to_piece(i): i for i in plain}
        by_bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        by_bytes = by_bytes if all(map(model.is_byte, by_bytes)) else []
        return Pieces({p: model.get_score(i) for p, i in ids.items()}, ids, by_bytes, model.unk_id(), kind)

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text: join the best-scored pair, leftmost first, while there is one."""
        parts = list(text)
        while len(parts) > 1:
            joined = [self.scores.get(a + b) for a, b in zip(parts, parts[1:])]
            best = max((s for s in joined if s is not None), default=None)
            if best is None:
                break
            at = joined.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stays_apart(self, left: str, right: str) -> bool:
        if self.pairs >= KNOWN:
            self.pairs = 0
            for found in self.apart.values():
                found.clear()
        self.pairs += 1
        apart = self.merged(left + right) == [left, right]
        self.apart[left][right] = apart
        return apart

    def extend_bpe(self, word: str, state: list, tables: list) -> None:
        """Append to ``state`` the last piece of each longer prefix of ``word``, and to ``tables`` what stays apart from it."""
        usable, ends, apart = self.usable, self.ends, self.apart
        del tables[len(state) :]
        for end in range(len(state), len(word) + 1):
            for length in ends.get(word[end - 2 : end], ONE) if end > 1 else ONE:
                start = end - length
                if start < 0:
                    continue
                piece = word[start:end]
                if length > 1 and piece not in usable:
                    continue
                if start == 0:
                    break
                free = tables[start].get(piece)
                if free is None:
                    free = self.stays_apart(state[start], piece)
                if free:
                    break
            else:
                raise ValueError(f"no encoding of {word[:end]!r}")
            state.append(piece)
            table = apart.get(piece)
            if table is None:
                table = apart[piece] = {}
            tables.append(table)

    def extend_unigram(self, word: str, state: list, best: list) -> None:
        """The same by the best sum of scores; an unknown character costs more than any piece."""
        worst = min(self.scores.values(), default=0.0) - 10.0
        del best[len(state) :]
        for end in range(len(state), len(word) + 1):
            score, start = max(
                (best[start] + self.scores.get(word[start:end], worst), start)
                for start in range(max(0, end - self.longest), end)
                if end - start == 1 or word[start:end] in self.scores
            )
            best.append(score)
            state.append(word[start:end])

    def encode_words(self, words: list[str]) -> dict[str, tuple[int, ...]]:
        """Ids of distinct words, in trie order with shared forward states."""
        out, state, tables, best, last = {}, [""], [{}], [0.0], ""
        for word in sorted(words):
            shared, most = 0, min(len(word), len(last))
            while shared < most and word[shared] == last[shared]:
                shared += 1
            del state[shared + 1 :]
            if self.kind == "bpe":
                self.extend_bpe(word, state, tables)
            else:
                self.extend_unigram(word, state, best)
            out[word] = self._path(word, state)
            last = word
        return out

    def _path(self, word: str, state: list) -> tuple[int, ...]:
        ids, end = [], len(word)
        while end:
            piece = state[end]
            if piece in self.ids:
                ids.append(self.ids[piece])
            elif self.by_bytes:
                ids.extend(self.by_bytes[b] for b in reversed(piece.encode()))
            else:
                ids.append(self.unknown)
            end -= len(piece)
        return tuple(reversed(ids))

    def encode(self, texts: list[str]) -> list[list[int]]:
        split = [self.split((MARK + t).replace(" ", MARK)) if t else [] for t in texts]
        words, every = self.words, set(chain.from_iterable(split))
        fresh = every.difference(words) if len(every) < len(words) else {w for w in every if w not in words}
        if len(words) + len(fresh) > KNOWN:
            words.clear()
            fresh = every
        words.update(self.encode_words(list(fresh)))
        out = [list(chain.from_iterable(map(words.__getitem__, found))) for found in split]
        for w in fresh:
            if len(w) > LONGEST:
                del words[w]
        return out

    def decode(self, ids: list[list[int]]) -> list[str]:
        return [self._decoded(row) for row in ids]

    def _decoded(self, row: list[int]) -> str:
        text, byte_of = self.text, self.byte_of
        try:
            whole = "".join(map(text.__getitem__, row))
        except KeyError:
            spelled = bytearray()
            for i in row:
                if i in byte_of:
                    spelled.append(byte_of[i])
                else:
                    spelled += text.get(i, " ⁇ ").encode()
            whole = spelled.decode("utf-8", "replace")
        return whole.replace(MARK, " ").removeprefix(" ")


@cache
def vocabulary(path: str, kind: str = "bpe") -> Pieces:
    return Pieces.load(path, kind)


def encoded(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", kind: str = "bpe") -> DataFrame:
    """``(key, n_pieces, pieces, round_trip)``: ids of every text, and whether decoding them gives the text back.

    The text comes back unless it holds the mark itself, which reads as a space.
    """
    rows = docs.select(key, text)
    out = f"`{key}` {rows.schema[key].dataType.simpleString()}, n_pieces long, pieces array<int>, round_trip boolean"
    return rows.mapInArrow(_encoder(path, kind, key), out)


def decoded(rows: DataFrame, path: str, key: str = "doc_id", pieces: str = "pieces", kind: str = "bpe") -> DataFrame:
    """``(key, text)`` from rows of ids; null ids give an empty text."""
    rows = rows.select(key, pieces)
    return rows.mapInArrow(_decoder(path, kind, key), f"`{key}` {rows.schema[key].dataType.simpleString()}, text string")


def _encoder(path: str, kind: str, key: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = vocabulary(path, kind)
        for whole in batches:
            for batch in slices(whole, 1):
                texts = [t or "" for t in batch.column(1).to_pylist()]
                ids = model.encode(texts)
                same = [a == b for a, b in zip(model.decode(ids), texts)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([len(i) for i in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(same, pa.bool_())],
                    [key, "n_pieces", "pieces", "round_trip"],
                )

    return run


def _decoder(path: str, kind: str, key: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = vocabulary(path, kind)
        for batch in batches:
            texts = model.decode([i or [] for i in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [key, "text"])

    return run
