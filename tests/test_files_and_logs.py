"""Binary parts, dense pieces, log spans, other tools' lines, stored layouts and split tiles."""

import numpy as np
import pyarrow as pa
import pytest

from tests.conftest import cells, dense
from tripleloom import spgemm
from tripleloom.operators import reshape, stored, tiles
from tripleloom.session import clear_written
from tripleloom.sources import binary_csr, run_logs


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.mark.parametrize("value_bytes, entries, rows", [(8, 20, 7), (4, 10**6, 5), (8, 10**6, 10**6)])
def test_binary_parts(spark, tmp_path, matrix, value_bytes, entries, rows):
    a = np.random.default_rng(4).integers(0, 3, (23, 11)).astype(float)
    a[5] = a[0] = a[22] = 0
    path = str(tmp_path / "parts")
    binary_csr.write_csr_parts(matrix(a), path, value_bytes, entries, rows)
    back = binary_csr.read_binary_csr(spark, path, value_bytes)
    assert (back.rows, back.cols) == (23, 11)
    np.testing.assert_array_equal(dense(back), a)
    files = sorted((tmp_path / "parts").rglob("part-*.txt"))
    assert len(files) > 1 or entries > 100 and rows > 100
    alone = binary_csr.read_binary_csr(spark, str(files[0]), value_bytes)
    np.testing.assert_array_equal(dense(alone), a[: alone.rows])
    with pytest.raises(binary_csr.FormatError):
        binary_csr.read_binary_csr(spark, path, 12 - value_bytes)
    (tmp_path / "short").write_bytes(files[-1].read_bytes()[:100])
    with pytest.raises(binary_csr.FormatError):
        binary_csr.read_binary_csr(spark, str(tmp_path / "short"), value_bytes)


def test_large_single_file_is_read_in_slices(spark, tmp_path, matrix, monkeypatch):
    a = np.random.default_rng(6).integers(0, 2, (9, 8)).astype(float)
    binary_csr.write_binary_csr(matrix(a), str(tmp_path / "m"))
    monkeypatch.setattr(binary_csr, "LARGEST_PART", 10)
    np.testing.assert_array_equal(dense(binary_csr.read_binary_csr(spark, str(tmp_path / "m"))), a)


def test_parts_without_entries(spark, tmp_path, matrix):
    binary_csr.write_csr_parts(matrix(np.zeros((3, 4))), str(tmp_path / "none"))
    back = binary_csr.read_binary_csr(spark, str(tmp_path / "none"))
    assert (back.rows, back.cols, back.nnz()) == (3, 4, 0)


@pytest.mark.parametrize("piece", [1, 5, 12, 1000])
def test_dense_pieces(matrix, piece):
    a = np.random.default_rng(8).integers(0, 3, (7, 12)).astype(float)
    a[3] = 0
    out = np.full(a.shape, np.nan)
    for r in reshape.dense_pieces(matrix(a), piece).collect():
        out[r["i"], r["first"] : r["first"] + len(r["vals"])] = r["vals"]
    np.testing.assert_array_equal(out, a)
    assert reshape.densified(matrix(np.zeros((2, 0)))).count() == 0
    plan = plan_of(reshape.dense_pieces(matrix(a)))
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


LINES = [
    "[dbg 1.0 ms] tool: compute begin", "[dbg 2.0 ms] tool: copy begin", "[dbg 3.0 ms] tool: compute done buf2=7", "[dbg 4.0 ms] tool: compute done",
    "[dbg 5.0 ms] T1 writing", "[dbg 6.0 ms] tool: compute begin", "[dbg 7.0 ms] T1 write done", "[dbg 8.0 ms] tool: compute begin", "noise done", "[dbg 9.0 ms] tool: compute done",
]


@pytest.mark.parametrize("width", [1, 2, 3, 100])
def test_spans_across_blocks(spark, width):
    rows = [("r", {"block": n // width, "line": n}, line) for n, line in enumerate(LINES)] + [("q", {"block": 0, "line": 0}, LINES[0])]
    lines = spark.createDataFrame(rows, "run string, at struct<block: long, line: long>, value string").repartition(4)
    found = run_logs.spans(run_logs.span_marks(lines)).collect()
    wanted = [
        ("r", "tool: compute", "closed", 1, 3, "buf2=7"), ("r", "tool: compute", "stray", 0, 4, ""), ("r", "tool: compute", "open", 6, 0, None),
        ("r", "tool: compute", "closed", 8, 9, ""), ("r", "tool: copy", "open", 2, 0, None), ("r", "T1 write", "closed", 5, 7, ""),
        ("q", "tool: compute", "open", 1, 0, None),
    ]
    rows = [(r["run"], r["event"], r["state"], int(r["begin_ms"] or 0), int(r["done_ms"] or 0), r["detail"]) for r in found]
    assert sorted(rows, key=str) == sorted(wanted, key=str)
    assert {r["ms"] for r in found if r["state"] == "closed"} == {2, 1}


def test_lines_of_other_tools(spark):
    text = ["  total 12.5ms", "  total 99ms", "x C.nnz=31 y", "Kernel time:  3.25 ms", "total 7ms"]
    rows = [("a", n, line) for n, line in enumerate(text)] + [("b", 0, "Kernel time: 1 ms"), ("c", 0, "nothing")]
    found = {r["run"]: tuple(r)[1:] for r in run_logs.other_tools(spark.createDataFrame(rows, "run string, at int, value string")).collect()}
    assert found == {"a": (12.5, 31, 3.25), "b": (None, None, 1.0)}


@pytest.mark.parametrize("task_products", [1 << 22, 4])
def test_stored_factors_are_not_shuffled(spark, matrix, task_products):
    rng = np.random.default_rng(9)
    a, b = rng.integers(-2, 3, (12, 9)), rng.integers(-2, 3, (9, 15))
    a[:, 4] = b[4] = 1
    kept = stored.store_factors(matrix(a), matrix(b), task_products)
    assert (kept.keys == ("k", "ls", "rs")) == (task_products == 4)
    for _ in range(2):
        c = stored.stored_product(spark, kept, buckets=4)
        rows = c.collect()
        assert {(r["i"], r["j"]): r["v"] for r in rows} == cells(spgemm(matrix(a), matrix(b)))
        assert all(r["b"] == ((r["j"] + 1) * 4 - 1) // 15 for r in rows)
        plan = plan_of(c)
        assert "SortMergeJoin" in plan and "Exchange" not in plan[plan.index("SortMergeJoin") :]
        assert "rangepartitioning(i" in plan and plan.count("Exchange") == 1
    upper = stored.stored_product(spark, kept, upper=True)
    assert all(r["j"] >= r["i"] for r in upper.collect())
    clear_written(spark)
    assert not spark.catalog.tableExists(kept.left)


def test_a_hot_inner_tile_is_split(matrix):
    rng = np.random.default_rng(10)
    a, b = rng.integers(-3, 4, (40, 3)), rng.integers(-3, 4, (3, 50))
    for side in (1, 2, 100):
        c = tiles.tiled_product(matrix(a), matrix(b), edge=8, side=side)
        assert cells(c) == cells(spgemm(matrix(a), matrix(b)))
    grid = tiles.block_grid(matrix(a), matrix(b), 8, 2).collect()
    assert [(r["bk"], r["lparts"], r["rparts"]) for r in grid] == [(0, 3, 4)]
    full = {k: v for k, v in cells(spgemm(matrix(a[:, :3]), matrix(a.T[:3]))).items() if k[1] >= k[0]}
    assert cells(tiles.tiled_product(matrix(a), matrix(a.T), edge=8, side=2, upper=True)) == full


@pytest.mark.parametrize("held", [1, 3, 10_000])
def test_strips_are_added_up(held):
    edge = 8
    part = tiles._strips([0, 0, 1], [2, 2, 2], [0, 0, 0], [np.array([1, 5]), np.array([5, 9]), np.array([0])], [np.array([1.0, 2]), np.array([3.0, 4]), np.array([5.0])])
    out = pa.Table.from_batches(list(tiles._added(edge, held)(iter([part, part.slice(1, 2)])))).to_pylist()
    total = {}
    for r in out:
        for c, v in zip(r["cell"], r["v"]):
            total[r["bi"], c] = total.get((r["bi"], c), 0) + v
    assert total == {(0, 1): 1, (0, 5): 8, (0, 9): 8, (1, 0): 10}
    if held > 2:
        assert len(out) == 2
