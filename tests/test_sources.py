import json
import struct
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import cells, dense
from tripleloom.sources import binary_csr, cache, index_pages, matrix_market, results, run_logs
from tripleloom.streaming import log_follow

SAMPLE = """%%MatrixMarket matrix coordinate real symmetric
% a comment
5 5 7
1 1 10
3 1 1
2 2 20
3 3 30
5 3 2
4 4 40
5 5 50
"""


def saved(tmp_path, text, name="m.mtx"):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


@pytest.mark.parametrize("dialect", matrix_market.DIALECTS)
def test_sample_file(spark, tmp_path, symmetric5, dialect):
    m = matrix_market.read_matrix_market(spark, saved(tmp_path, SAMPLE), dialect)
    assert (m.rows, m.cols) == (5, 5)
    assert cells(m) == cells(symmetric5)


def lines(field, symmetry, body, size="3 3 1"):
    return f"%%MatrixMarket matrix coordinate {field} {symmetry}\n{size}\n{body}\n"


@pytest.mark.parametrize(
    ("field", "symmetry", "body", "dialect", "want"),
    [
        ("pattern", "general", "2 1", "standard", {(1, 0): 1}),
        ("complex", "general", "2 1 4 9", "standard", {(1, 0): 4}),
        ("complex", "general", "2 1 4 9", "strict", {(1, 0): 4}),
        ("real", "skew-symmetric", "2 1 4", "standard", {(1, 0): 4, (0, 1): -4}),
        ("real", "skew-symmetric", "2 1 4", "core", {(1, 0): 4, (0, 1): 4}),
        ("complex", "hermitian", "2 1 4 9", "standard", {(1, 0): 4, (0, 1): 4}),
        ("complex", "hermitian", "2 1 4 9", "core", {(1, 0): 4}),
        ("complex", "Hermitian", "2 1 4 9", "strict", {(1, 0): 4, (0, 1): 4}),
        ("real", "unsymmetric", "2 1 4", "core", {(1, 0): 4, (0, 1): 4}),
        ("pattern", "general", "2 1", "lenient", {(1, 0): 1}),
        ("real", "other", "2 1 4", "lenient", {(1, 0): 4, (0, 1): 4}),
        ("integer", "symmetric", "  2\t1   4  ", "standard", {(1, 0): 4, (0, 1): 4}),
    ],
)
def test_dialects(spark, tmp_path, field, symmetry, body, dialect, want):
    path = saved(tmp_path, lines(field, symmetry, body))
    assert cells(matrix_market.read_matrix_market(spark, path, dialect)) == want


@pytest.mark.parametrize(
    ("text", "dialect"),
    [
        ("%%MatrixMarket matrix array real general\n2 2\n1\n", "standard"),
        (lines("real", "hermitian", "1 1 1"), "strict"),
        (lines("quaternion", "general", "1 1 1"), "strict"),
        ("no banner\n1 1 1\n", "strict"),
        ("%%MatrixMarket matrix coordinate real general\nx y z\n", "standard"),
        ("%%MatrixMarket matrix coordinate real general\n", "standard"),
    ],
)
def test_refused_files(spark, tmp_path, text, dialect):
    with pytest.raises(matrix_market.FormatError):
        matrix_market.read_matrix_market(spark, saved(tmp_path, text), dialect)


@pytest.mark.parametrize("body", ["4 1 1", "1 9 1", "0 1 1", "1 1", "a b c", "1 1 x"])
def test_bad_lines_are_named(spark, tmp_path, body):
    m = matrix_market.read_matrix_market(spark, saved(tmp_path, lines("real", "general", body)))
    with pytest.raises(Exception, match=f"bad Matrix Market line: {body}"):
        m.entries.collect()


def test_size_line_equal_to_a_data_line(spark, tmp_path):
    path = saved(tmp_path, lines("real", "general", "3 3 1"))
    assert cells(matrix_market.read_matrix_market(spark, path)) == {(2, 2): 1}


def test_duplicates(spark, tmp_path):
    path = saved(tmp_path, lines("real", "general", "1 1 2\n1 1 3", "2 2 2"))
    assert matrix_market.read_matrix_market(spark, path).nnz() == 2
    assert cells(matrix_market.read_matrix_market(spark, path, combine=True)) == {(0, 0): 5}


def test_written_text_reads_back(spark, tmp_path, matrix):
    a = np.random.default_rng(1).normal(size=(17, 9)) * (np.random.default_rng(2).random((17, 9)) < 0.4)
    m = matrix(a)
    path = str(tmp_path / "out")
    matrix_market.write_matrix_market(m, path)
    np.testing.assert_array_equal(dense(matrix_market.read_matrix_market(spark, path)), a)
    parts = sorted((tmp_path / "out").glob("part-*"))
    text = "".join(p.read_text() for p in parts).splitlines()
    assert text[:2] == ["%%MatrixMarket matrix coordinate real general", f"17 9 {np.count_nonzero(a)}"]
    spots = [tuple(map(int, line.split()[:2])) for line in text[2:]]
    assert spots == sorted(spots)


def test_parse_once(spark, tmp_path, symmetric5, monkeypatch):
    text, kept = saved(tmp_path, SAMPLE), str(tmp_path / "kept")
    assert cells(cache.parse_once(spark, text, kept)) == cells(symmetric5)
    with monkeypatch.context() as m:
        m.setattr(cache, "read_matrix_market", None)
        again = cache.parse_once(spark, text, kept)
        assert (again.rows, again.cols) == (5, 5) and cells(again) == cells(symmetric5)
    skew = saved(tmp_path, "%%MatrixMarket matrix coordinate real skew-symmetric\n2 2 1\n2 1 3\n")
    assert cells(cache.parse_once(spark, skew, kept)) == {(1, 0): 3, (0, 1): -3}
    assert cells(cache.parse_once(spark, skew, kept, "core")) == {(1, 0): 3, (0, 1): 3}


def test_parse_once_after_a_broken_attempt(spark, tmp_path, symmetric5, monkeypatch):
    text, kept = saved(tmp_path, SAMPLE), str(tmp_path / "kept")
    with monkeypatch.context() as m:
        m.setattr(cache, "SHAPE_SCHEMA", "no schema")
        with pytest.raises(Exception):
            cache.parse_once(spark, text, kept)
    assert cells(cache.parse_once(spark, text, kept)) == cells(symmetric5)


def test_short_and_crooked_files_are_refused(spark, tmp_path):
    head = "%%MatrixMarket matrix coordinate real general\n3 3 {}\n"
    with pytest.raises(matrix_market.FormatError):
        matrix_market.read_matrix_market(spark, saved(tmp_path, head.format(5) + "1 1 1\n2 2 2\n"))
    outside = matrix_market.read_matrix_market(spark, saved(tmp_path, head.format(1) + "9 9 1\n"))
    with pytest.raises(Exception, match="bad Matrix Market line"):
        outside.entries.groupBy("j").count().collect()


@pytest.mark.parametrize("value_bytes", [8, 4])
def test_binary_file(spark, tmp_path, matrix, monkeypatch, value_bytes):
    monkeypatch.setattr(binary_csr, "SLICE_ENTRIES", 16)
    a = np.random.default_rng(3).integers(0, 3, (23, 11)).astype(float)
    a[5] = a[0] = a[22] = 0
    path = str(tmp_path / "m.hicsr")
    binary_csr.write_binary_csr(matrix(a), path, value_bytes)
    raw = open(path, "rb").read()
    nnz = np.count_nonzero(a)
    assert raw[:9] == b"Hi\x01Compsd" and struct.unpack_from("<3Q", raw, 16 + 40) == (23, 11, nnz)
    start = 80 + (16 if value_bytes == 8 else 8)
    values = np.frombuffer(raw, f"<f{value_bytes}", nnz, start)
    np.testing.assert_array_equal(values, a[a != 0])
    ptr = np.frombuffer(raw, "<u4", 24, start + nnz * (value_bytes + 4))
    assert ptr.tolist() == [0, *np.cumsum(np.count_nonzero(a, axis=1))]
    np.testing.assert_array_equal(dense(binary_csr.read_binary_csr(spark, path, value_bytes)), a)
    with pytest.raises(binary_csr.FormatError):
        binary_csr.read_binary_csr(spark, path, 12 - value_bytes)


def test_binary_refusals(spark, tmp_path):
    path = tmp_path / "x"
    for content in (b"short", b"x" * 200):
        path.write_bytes(content)
        with pytest.raises(binary_csr.FormatError):
            binary_csr.read_binary_csr(spark, str(path))


LOG = """[dbg    0.000 ms] [cu] start
[dbg   10.000 ms] [cu] h2d
[dbg    1.000 ms] [cu] start
[dbg    3.500 ms] [cu] h2d
[dbg    9.000 ms] [cu] compute
[dbg    9.500 ms] [cu] d2h
[dbg    9.600 ms] [hash-prof] accumulate         9.000 ms
[dbg    9.700 ms] [hash-prof] TOTAL(GPU)         9.900 ms
[dbg    9.600 ms] [hash-prof] accumulate         2.000 ms
[dbg    9.600 ms] [hash-prof] h2d                0.500 ms
[dbg    9.700 ms] [hash-prof] TOTAL(GPU)         3.000 ms
Input A: 1138 x 1138, nnz = 4,054, sparsity = 99.7%
Result C: 1138 x 1138, nnz = 11142, sparsity = 99.1%
Time: 0.135 ms
[adapt] n=1138 maxrow=18 skew=5.1 → merge3 (score=1.0)
"""


def test_logs(spark, tmp_path):
    from tripleloom.analytics import benchmarking as be

    folder = tmp_path / "logs"
    folder.mkdir()
    (folder / "one.log").write_text(LOG)
    (folder / "two.log").write_text(LOG.replace("merge3 (score", "hash (score") + "[adapt] hash overflow → fallback merge3\n")
    lines_ = run_logs.read_logs(spark, str(folder))
    got = {r["run"]: r for r in run_logs.run_summary(lines_).collect()}
    assert tuple(got["one"])[1:] == (1138, 4054, 0.135, 11142, "merge3")
    assert got["two"]["choice"] == run_logs.FALLBACK_CHOICE
    last = run_logs.last_per_phase(run_logs.marks(lines_)).where("run = 'one'")
    took = {r["phase"]: r["ms"] for r in be.phase_durations(last).where("tag = 'cu'").collect()}
    assert took == {"h2d": 2.5, "compute": 5.5, "d2h": 0.5}
    assert be.compute_only(be.phase_durations(last)).where("tag = 'cu'").first()["ms"] == 5.5
    prof = run_logs.profile(lines_).where("run = 'one'")
    assert be.profile_compute_only(run_logs.last_per_phase(prof)).first()["ms"] == 2.5
    blocks = {(r["block"], r["phase"]): r["ms"] for r in be.profile_blocks(prof).collect()}
    assert blocks[0, "accumulate"] == 9 and blocks[1, "accumulate"] == 2 and blocks[1, "TOTAL(GPU)"] == 3
    assert be.block_medians(be.profile_blocks(prof)).first()["median"] == 5.5


def test_logs_are_followed_once(spark, tmp_path):
    folder, table = tmp_path / "in", str(tmp_path / "table")
    folder.mkdir()
    name = f"follow-{uuid.uuid4().hex}"
    (folder / "a.log").write_text(LOG)
    log_follow.follow_logs(spark, str(folder), table, name).awaitTermination()
    (folder / "b.log").write_text(LOG)
    log_follow.follow_logs(spark, str(folder), table, name).awaitTermination()
    log_follow.follow_logs(spark, str(folder), table, name + "-again").awaitTermination()
    rows = log_follow.stored_results(spark, table).orderBy("run").collect()
    assert [r["run"] for r in rows] == ["a", "b"] and rows[0]["c_nnz"] == 11142


def test_result_tables(spark, tmp_path):
    path = str(tmp_path / "table")
    columns = results.COMPARISON_COLUMNS
    row = lambda name, cu: (name, "5", "Y", "1.0", cu, "0.5", "hash", "", "DNF", "1", "timeout", "fail", "9")
    first = spark.createDataFrame([row("m1", "2.0"), row("m2", "")], results.comparison_schema())
    results.append_rows(first, path)
    results.append_rows(spark.createDataFrame([row("m3", "4")], results.comparison_schema()), path)
    table = results.read_table(spark, path, results.comparison_schema())
    assert table.count() == 3 and results.stored_columns(spark, path) == list(columns)
    with pytest.raises(results.StaleSchema):
        results.append_rows(table.drop("cublas"), path)
    wanted = spark.createDataFrame([("m1",), ("m9",)], "matrix string")
    assert [r["matrix"] for r in results.pending(wanted, table).collect()] == ["m9"]
    fresh = spark.createDataFrame([("m2", "7.5")], "matrix string, cu string")
    new = {r["matrix"]: r["cu"] for r in results.timed(results.refreshed(table, "cu", fresh), ["cu", "dense"]).collect()}
    assert new == {"m1": 2.0, "m2": 7.5, "m3": 4.0}
    assert results.timed(table, ["opSparse", "dense", "cublas", "Ocean"]).where(
        "opSparse IS NOT NULL OR dense IS NOT NULL OR cublas IS NOT NULL OR Ocean IS NOT NULL"
    ).isEmpty()
    with pytest.raises(ValueError):
        results.refreshed(table, "none", fresh)


def test_run_documents(spark, tmp_path):
    doc = {
        "C": {"rows": 5, "cols": 5, "nnz": 11}, "gflops": 0.5, "total_time": 9.0,
        "timing": {
            "analysis": {"mem_cpy": 1.0, "product_calc": 2.0, "reduce": 4.0},
            "estimation": {"binning": 1000.0, "hll_construct": 8.0},
            "numeric": {"hash": 16.0, "usparse_outlier": 32.0}, "prologue": 64.0,
        },
    }
    (tmp_path / "stats.json").write_text(json.dumps(doc, indent=2))
    runs = results.read_runs(spark, str(tmp_path / "stats.json"))
    row = runs.select("C.nnz", results.compute_ms().alias("ms")).first()
    assert tuple(row) == (11, 127.0)


def test_index_pages(spark):
    page = """<html><table><tr><th>ID</th><th>Name</th></tr>
    <TR><td>1</td><td><a class='x' href="/HB/one">one &lt;a&gt;</a></td><td>HB</td><td>1,138</td>
    <td>1,138</td><td>4,054</td><td> power <b>network</b></td><td>1985</td></TR>
    <tr><td>n/a</td><td>x</td><td>x</td><td>1</td><td>1</td><td>1</td><td>x</td><td>x</td></tr>
    <tr><td>2</td><td>short</td></tr></table></html>"""
    rows = index_pages.parse_index(spark.createDataFrame([(page,), ("<p>none</p>",)], "html string")).collect()
    assert len(rows) == 1
    assert tuple(rows[0]) == (1, "one <a>", "HB", 1138, 1138, 4054, "power network", "1985", "/HB/one")


def test_command_line(spark, tmp_path, capsys):
    from tripleloom.__main__ import main

    path = saved(tmp_path, SAMPLE)
    assert main(["product", path, "--out", str(tmp_path / "c")]) == 0
    assert main(["product", path, "att", "--method", "MERGE", "--out", str(tmp_path / "u")]) == 0
    assert main(["multiply", path, path, "--method", "outer", "--out", str(tmp_path / "d")]) == 0
    out = capsys.readouterr().out
    assert "Input A: 5 x 5, nnz = 9" in out and "Result C: 5 x 5, nnz = 11" in out and "nnz = 8" in out and "Time: " in out
    assert main(["compare", str(tmp_path / "c"), str(tmp_path / "d")]) == 0
    assert main(["compare", str(tmp_path / "c"), str(tmp_path / "u")]) == 1
    assert main(["features", path]) == 0
    assert "choice=merge3" in capsys.readouterr().out
