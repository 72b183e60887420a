"""Structure before values: bitmaps, sorted intersections, stored plans, sized exchanges."""

import numpy as np
import pyarrow as pa
import pytest

from tests.conftest import cells, dense
from tripleloom import Matrix, spgemm
from tripleloom.operators import bitmaps, masked
from tripleloom.operators import multiply as mul
from tripleloom.operators import rowstats, sketches
from tripleloom.session import written


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def wide(spark):
    """Both sides over more columns than one bitmap has, with long and hot rows, repeated and empty ones."""
    rng = np.random.default_rng(5)
    left = [(int(i), int(k), 1.0) for i in range(30) for k in rng.choice(40, 12, replace=False)] + [(3, 7, 1.0)] * 3
    right = [(int(k), int(j), 1.0) for k in range(0, 40, 2) for j in rng.choice(100_000, 200)] + [(7, 32_767, 1.0), (7, 32_768, 2.0)]
    schema = "i long, j long, v double"
    a, b = (Matrix(spark.createDataFrame(rows, schema).repartition(3), n, m) for rows, n, m in ((left, 31, 41), (right, 41, 100_000)))
    wanted = {}
    columns = {}
    for k, j, _ in right:
        columns.setdefault(k, set()).add(j)
    for i, k, _ in left:
        wanted.setdefault(i, set()).update(columns.get(k, ()))
    return a, b, {i: js for i, js in wanted.items() if js}


@pytest.mark.parametrize("broadcast", [bitmaps.BROADCAST_BITMAPS, 0])
def test_bitmaps_hold_the_structure(wide, monkeypatch, broadcast):
    monkeypatch.setattr(bitmaps, "BROADCAST_BITMAPS", broadcast)
    a, b, wanted = wide
    found = {r["i"]: r["c_nnz"] for r in bitmaps.bitmap_lengths(a, b).collect()}
    assert found == {i: len(js) for i, js in wanted.items()}
    positions = bitmaps.bitmap_positions(a, b).collect()
    assert sorted((r["i"], r["j"]) for r in positions) == sorted((i, j) for i, js in wanted.items() for j in js)
    parts = {(r["i"], r["b"]): r["n"] for r in bitmaps.bitmap_lengths(a, b, bitmaps.bucket_group(7, b.cols), name="n").collect()}
    edge = lambda j: ((j + 1) * 7 - 1) // b.cols
    assert parts == {(i, c): n for i, js in wanted.items() for c in range(7) if (n := sum(edge(j) == c for j in js))}


def test_both_ways_of_the_symbolic_phase_agree(wide, monkeypatch):
    a, b, wanted = wide
    sizes = []
    for bound in (1, 10**9):
        monkeypatch.setattr(bitmaps, "by_bitmaps", lambda work, least=0, bound=bound: bound == 1)
        sizes.append({(r["i"], r["j"]) for r in mul.symbolic(a, b).collect()})
        assert {r["i"]: r["c_nnz"] for r in mul.output_row_lengths(a, b).collect()} == {i: len(js) for i, js in wanted.items()}
        assert sum(r["nnz"] for r in rowstats.bucket_lengths(a, b, 3).collect()) == sum(map(len, wanted.values()))
    assert sizes[0] == sizes[1]


def test_counted_work_chooses(wide, symmetric5):
    a, b, _ = wide
    work = bitmaps.bitmap_work(a, b, {})
    assert work["products"] > 16 * work["merges"] and bitmaps.by_bitmaps(work)
    assert not bitmaps.by_bitmaps(bitmaps.bitmap_work(symmetric5, symmetric5, {}))
    plan = plan_of(mul.output_row_lengths(a, b))
    assert "bitmap_or_agg" in plan and "partial_count" not in plan


@pytest.mark.parametrize("most", [masked.MOST, 2])
def test_only_wanted_positions_have_values(spark, matrix, monkeypatch, most):
    monkeypatch.setattr(masked, "MOST", most)
    monkeypatch.setattr(masked, "NARROWEST", min(most, masked.NARROWEST))
    rng = np.random.default_rng(7)
    a, b = rng.integers(-2, 3, (9, 30)), rng.integers(-2, 3, (30, 11))
    wanted = [(int(i), int(j)) for i in range(9) for j in range(11) if rng.random() < 0.4]
    structure = spark.createDataFrame(wanted, "i long, j long")
    full = a @ b
    ma, mb = matrix(a), matrix(b)
    assert cells(mul.numeric(structure, ma, mb)) == {p: full[p] for p in wanted}
    plan = masked.product_plan(structure, ma, mb)
    for left, right in ((a, b), (a * 3 + (a != 0), -b)):
        values = masked.planned_product(plan, masked.entry_values(matrix(left)), masked.entry_values(matrix(right)), 9, 11)
        shown = (np.where(a != 0, left, 0)) @ (np.where(b != 0, right, 0))
        assert cells(values) == {p: shown[p] for p in wanted}


def test_a_stored_plan_needs_no_join_on_the_inner_index(spark, symmetric5):
    structure = mul.symbolic(symmetric5, symmetric5)
    rows = written(masked.product_plan(structure, symmetric5, symmetric5))
    values = masked.entry_values(symmetric5)
    again = masked.planned_product(rows, values, values, 5, 5)
    assert cells(again) == cells(spgemm(symmetric5, symmetric5))
    assert "MapInArrow" not in plan_of(again.entries)


def test_positions_where_nothing_meets_are_zero(spark, matrix):
    m = matrix([[1, 0], [0, 2]])
    structure = spark.createDataFrame([(0, 0), (0, 1)], "i long, j long")
    assert cells(mul.numeric(structure, m, m)) == {(0, 0): 1, (0, 1): 0}
    none = structure.limit(0)
    assert mul.numeric(none, m, m).nnz() == 0 and masked.product_plan(none, m, m).count() == 0


def test_repeated_elements_pair_up_in_full():
    row, left, right = masked.common(pa.array([[1, 2, 2], [], [5]]), pa.array([[2, 2, 3], [1], [5]]))
    assert list(zip(row.tolist(), left.tolist(), right.tolist())) == [(0, 1, 0), (0, 1, 1), (0, 2, 0), (0, 2, 1), (2, 3, 4)]


def test_inner_order_makes_no_product_of_the_key(matrix):
    a = np.ones((6, 40))
    c = spgemm(matrix(a), matrix(a.T), method="inner")
    np.testing.assert_array_equal(dense(c), a @ a.T)
    plan = plan_of(c.entries)
    assert "MapInArrow" in plan and "bitmap_or_agg" in plan


def test_the_result_sizes_the_exchange(spark, matrix):
    rng = np.random.default_rng(3)
    a = (rng.random((60, 50)) < 0.3).astype(int)
    m = matrix(a)
    entries = np.count_nonzero(a @ a.T)
    assert abs(sketches.estimated_entries(m, m.T) - entries) <= 0.15 * entries
    c = spgemm(m, m.T, broadcast_rows=0, result_rows=100)
    wanted = -(-min(sketches.estimated_entries(m, m.T), 10**9) // 100)
    assert f", {wanted}), REPARTITION_BY_NUM" in plan_of(c.entries)
    np.testing.assert_array_equal(dense(c), a @ a.T)
    assert "REPARTITION_BY_NUM" not in plan_of(spgemm(m, m.T, broadcast_rows=0).entries)
