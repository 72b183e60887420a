"""Fill-in-the-middle against plain Python, round trips, and awkward rows."""

import hashlib
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import LONG, rows_of
from tripleloom.llm import infill
from tripleloom.llm.queries import op13_fill_in_middle

PIECES = ["a", "bc ", "\n", "\n\n", "é", "😀", "<", "P>", "<P", "S", ">", "\x00", "word word\n", "\r\n"]


def plain_form(key, text, seed=7, rate=100, spm_rate=50):
    """``(n, form, prefix, middle, output)`` straight from the definition."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    low, high = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    if h[3] % 100 < spm_rate:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def texts(seed, n=400):
    draw = random.Random(seed)
    return ["".join(draw.choice(PIECES) for _ in range(draw.randrange(30))) for _ in range(n)] + ["<P>", "a<M>b\n", "<S", ">", LONG]


@pytest.mark.parametrize("rate, spm_rate", [(100, 50), (60, 20), (0, 50), (100, 100)])
def test_equals_the_definition(docs, rate, spm_rate):
    rows = list(enumerate(texts(rate + spm_rate)))
    cut = infill.fill_in_middle(docs(rows), seed=5, rate=rate, spm_rate=spm_rate)
    found = rows_of(infill.restored(cut))
    for key, text in rows:
        r = found[key]
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["fim_text"]) == plain_form(key, text, 5, rate, spm_rate)
        assert r["restored_text"] == text


def test_blocks_move_like_one(docs, monkeypatch):
    rows = list(enumerate(texts(9)))
    monkeypatch.setattr(infill, "SPAN", 7)
    for key, text in rows[:150]:
        out = infill.cut_batch(pa.array([text, None, text]), [key, 0, key], 7, 100, 50)
        assert out[4].to_pylist() == [plain_form(key, text)[4], "", plain_form(key, text)[4]]
        assert infill.restore_batch(out[4], out[1].to_pylist()).to_pylist() == [text, "", text]


def test_awkward_rows(awkward, nothing):
    wide = awkward.withColumns({c: F.lit("x") for c in ("n", "Form", "fim_text", "restored_text")})
    back = infill.restored(infill.fill_in_middle(wide))
    rows = back.collect()
    assert sorted(back.columns) == sorted(set(back.columns)) and len(rows) == 8
    for r in rows:
        assert r["fim_text"] == plain_form(r["doc_id"], r["text"])[4] and r["restored_text"] == (r["text"] or "")
        assert r["shard"] == "x"
    assert infill.restored(infill.fill_in_middle(nothing)).count() == 0


def test_restoring_leaves_what_is_not_a_form(spark):
    rows = [("<P>a<S>b<M>c", "psm"), ("<P>a<S>b<M>c", "spm"), ("<P>a<S>b", "psm"), ("x<P>a<S>b<M>c", "psm"), ("<S>b<P>a<M>c", "spm"), (None, "psm"), ("q", None)]
    df = spark.createDataFrame(rows, "fim_text string, form string")
    assert [r["restored_text"] for r in infill.restored(df).collect()] == ["acb", "<P>a<S>b<M>c", "<P>a<S>b", "x<P>a<S>b<M>c", "acb", "", "q"]


def test_query_equals_the_definition(spark):
    folder = "/root/testdata/sf0.001"
    found = rows_of(op13_fill_in_middle(spark, folder))
    for d in spark.read.parquet(f"{folder}/documents.parquet").collect():
        n, form, prefix, middle, output = plain_form(d["doc_id"], d["text"])
        r = found[d["doc_id"]]
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"]) == (n, form, prefix, middle)
        assert r["output_sha256"] == hashlib.sha256(output.encode()).hexdigest()
        assert r["restored_sha256"] == hashlib.sha256((d["text"] or "").encode()).hexdigest()
