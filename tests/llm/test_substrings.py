"""Repeated passages against brute force over all windows."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.conftest import LONG, rows_of
from tripleloom.llm import substrings
from tripleloom.llm.queries import op11_substring_dedup
from tripleloom.llm.words import Words


def plain_repeats(rows, window):
    """``{row number: (words, kept words)}``; rows of one key are one document, a null key is the smallest."""
    order = lambda key, at: (key is not None, key or 0, at)
    first, split = {}, [(key, (text or "").encode().split()) for key, text in rows]
    for key, words in split:
        for at in range(len(words) - window + 1):
            gram = tuple(words[at : at + window])
            first[gram] = min(first.get(gram, order(key, at)), order(key, at))
    out = {}
    for n, (key, words) in enumerate(split):
        gone = np.zeros(len(words), bool)
        for at in range(len(words) - window + 1):
            if first[tuple(words[at : at + window])] != order(key, at):
                gone[at : at + window] = True
        out[n] = (len(words), b" ".join(w for w, g in zip(words, gone) if not g).decode())
    return out


def corpus(seed, n=60, letters="abc", sizes=(0, 80)):
    """Texts of few words, with copied passages inside and between them."""
    draw = random.Random(seed)
    texts = []
    for _ in range(n):
        words = [draw.choice(letters) + draw.choice(letters) for _ in range(draw.randint(*sizes))]
        if texts and draw.random() < 0.7:
            other = draw.choice(texts).split()
            at = draw.randrange(len(other) + 1)
            where = draw.randrange(len(words) + 1)
            words[where:where] = other[at : at + draw.randrange(40)]
        texts.append(draw.choice([" ", "\n", " \t"]).join(words))
    return texts


@pytest.mark.parametrize(
    "seed, letters, window, prefix, options",
    [
        (1, "abcdefgh", 20, 8, {}),
        (2, "ab", 6, 3, {}),
        (3, "abcd", 7, 4, {"most": 3}),
        (4, "abcd", 7, 7, {"filter_bits": 0}),
        (5, "abc", 5, 2, {"filter_bits": 0, "most": 2, "documents": 0}),
        (6, "a", 20, 8, {"most": 5}),
        (6, "ab", 20, 8, {"most": 2, "heads_kept": 0}),
        (8, "abcd", 7, 4, {"most": 1, "heads_kept": 10**6}),
        (7, "abcdefgh", 20, 8, {"hot_keys": 0, "most": 1, "passages": 0}),
    ],
)
def test_equals_all_windows(docs, seed, letters, window, prefix, options):
    rows = list(enumerate(corpus(seed, letters=letters)))
    found = rows_of(substrings.without_repeats(docs(rows), window=window, prefix=prefix, **options))
    for n, (total, kept) in plain_repeats(rows, window).items():
        assert (found[n]["n_words"], found[n]["text"]) == (total, kept), n
        assert found[n]["n_removed"] == total - len(kept.split())


def test_many_groups_pass_through_one_task(docs, monkeypatch):
    monkeypatch.setattr(substrings, "BATCH", 50)
    rows = list(enumerate(corpus(8, letters="abcd")))
    found = rows_of(substrings.without_repeats(docs(rows), window=6, prefix=3))
    assert {n: found[n]["text"] for n, _ in rows} == {n: kept for n, (_, kept) in plain_repeats(rows, 6).items()}


@pytest.mark.parametrize("options", [{}, {"filter_bits": 0, "documents": 0}, {"most": 1}, {"most": 1, "heads_kept": 0}])
def test_repeated_and_null_keys(docs, options):
    copied = " ".join(f"w{k}" for k in range(30))
    rows = [(5, copied), (5, copied), (5, "x " + copied), (None, "y y " + copied), (None, None), (7, copied + " end"), (None, copied), (6, "")]
    wanted = sorted(v + (rows[n][0] or -1,) for n, v in plain_repeats(rows, 20).items())
    found = substrings.without_repeats(docs(rows), **options).collect()
    assert sorted((r["n_words"], r["text"], r["doc_id"] or -1) for r in found) == wanted


def test_awkward_rows(awkward, nothing):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    wanted = sorted(plain_repeats([(k, t) for k, t in rows], 20).values())
    result = substrings.without_repeats(awkward)
    found = result.collect()
    assert len(result.columns) == len(set(result.columns)) and all(r["shard"] == "x" for r in found)
    assert sorted((r["n_words"], r["text"]) for r in found) == wanted
    assert substrings.without_repeats(nothing).count() == 0


def test_extra_columns_of_the_same_names(docs):
    from pyspark.sql import functions as F

    wide = docs([(1, LONG[:200]), (2, None)]).withColumns({"digest": F.lit("x"), "passages": F.lit("y"), "N_words": F.lit("z"), "id": F.lit("i")})
    found = rows_of(substrings.without_repeats(wide))
    assert found[2]["digest"] == "x" and found[2]["passages"] == "y" and found[2]["n_words"] == 0


def test_ranks_are_equal_for_equal_windows_only():
    draw = np.random.default_rng(3)
    for window in (1, 2, 3, 5, 8, 13, 20):
        symbols = draw.integers(0, 2, 200).astype(np.int64)
        starts = np.arange(len(symbols) - window + 1)
        ranks = substrings.window_ranks(symbols, starts, window)
        seen = {}
        for s, rank in zip(starts.tolist(), ranks.tolist()):
            assert seen.setdefault(tuple(symbols[s : s + window]), rank) == rank
        assert len(set(ranks.tolist())) == len(seen)


def test_every_window_has_one_anchor():
    texts = pa.array(corpus(9, letters="abcdef") + ["one two", None, ""])
    words = Words(texts, substrings.AS_WRITTEN)
    row, first, count, hashes = substrings.anchors(words, 20, 8)
    covered = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
    size = np.diff(words.first)
    assert sorted(covered.tolist()) == [a + k for a, n in zip(words.first[:-1].tolist(), size.tolist()) for k in range(n - 19)]


def test_query_equals_all_windows(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(d["doc_id"], d["text"]) for d in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    found = rows_of(op11_substring_dedup(spark, folder))
    for n, (total, kept) in plain_repeats(rows, 20).items():
        r = found[rows[n][0]]
        assert (r["n_words"], r["n_removed"]) == (total, total - len(kept.split()))
        assert r["kept_sha256"] == hashlib.sha256(kept.encode()).hexdigest()
