"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from tests.llm.conftest import rows_of
from tripleloom.llm import variants
from tripleloom.llm.queries import op12_spelling_variants


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_words(rows, shortest=6, least=5, every=199):
    counts = Counter()
    for key, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % every == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= shortest and n >= least}


def plain_variants(words, ratio=5):
    near = {w: [u for u in words if u != w and abs(len(u) - len(w)) < 2 and one_edit(w, u)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda u: (-words[u], u), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None
    out = {}
    for w in words:
        end = w
        while form[end] is not None:
            end = form[end]
        out[w] = (words[w], len(near[w]), form[w], words.get(form[w]), end)
    return out


def found_of(df):
    return {w: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for w, r in rows_of(df, "word").items()}


def vocabulary(seed, n, letters="abcé", sizes=(6, 9)):
    draw = random.Random(seed)
    return {"".join(draw.choice(letters) for _ in range(draw.randint(*sizes))): 5 * 7 ** draw.randrange(5) + draw.randrange(3) for _ in range(n)}


@pytest.mark.parametrize("seed, letters, sizes", [(1, "abcé", (6, 9)), (2, "ab", (6, 12)), (3, "abcdefgh", (6, 7)), (4, "a", (6, 40))])
def test_scan_equals_all_pairs(seed, letters, sizes):
    words = sorted(vocabulary(seed, 300, letters, sizes))
    queries, found = variants.near_pairs(words)
    assert sorted(zip(queries.tolist(), found.tolist())) == [(q, w) for q in range(len(words)) for w in range(len(words)) if one_edit(words[q], words[w])]


@pytest.mark.parametrize("most", [20_000, 3])
def test_variants_equal_all_pairs(spark, most):
    words = vocabulary(11, 600) | vocabulary(12, 200, "ab", (6, 14))
    table = spark.createDataFrame(list(words.items()), "word string, n long").repartition(5)
    assert found_of(variants.spelling_variants(table, most=most)) == plain_variants(words)


def test_long_chain_of_forms(spark):
    words = {"a" * k: 5 * 6**k for k in range(6, 20)}
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    assert {r[4] for r in found_of(variants.spelling_variants(table)).values()} == {"a" * 19}


def test_words_of_awkward_rows(spark, awkward, nothing):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    found = {r["word"]: r["n"] for r in variants.vocabulary(variants.runs(awkward, shortest=4, every=3), 4, 1).collect()}
    assert found == plain_words(rows, 4, 1, 3)
    assert variants.spelling_variants(variants.vocabulary(variants.runs(nothing))).count() == 0


def test_runs_lose_the_code_point_their_hash_names(docs):
    draw = random.Random(5)
    rows = [(k if k else None, " ".join(draw.choice(["Straßes", "élèveÉ", "ABCdefg", "x÷y×zabc", "plain-words"]) for _ in range(50))) for k in range(40)]
    found = {r["word"]: r["n"] for r in variants.vocabulary(variants.runs(docs(rows), every=2)).collect()}
    assert found == plain_words(rows, every=2)


def test_query_equals_all_pairs(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(d["doc_id"], d["text"]) for d in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert found_of(op12_spelling_variants(spark, folder)) == plain_variants(plain_words(rows))
