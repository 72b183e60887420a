import numpy as np
import pytest

from tests.conftest import cells, dense
from tripleloom import Matrix, inner_gram, outer_gram, spgemm, spmv
from tripleloom.matrix import ShapeError
from tripleloom.operators import multiply as mul
from tripleloom.operators import diff
from tripleloom.operators.spmv import spmv_transposed, vector_diff
from tripleloom.operators.tiles import tiled_product
from tripleloom.plans import workload

GOLDEN = {
    (0, 0): 101, (0, 2): 40, (0, 4): 2, (1, 1): 400, (2, 0): 40, (2, 2): 905,
    (2, 4): 160, (3, 3): 1600, (4, 0): 2, (4, 2): 160, (4, 4): 2504,
}


@pytest.mark.parametrize("method", mul.METHODS)
def test_golden_product(symmetric5, method):
    assert cells(spgemm(symmetric5, symmetric5, method=method)) == GOLDEN


@pytest.mark.parametrize("method", mul.METHODS)
def test_golden_upper(symmetric5, method):
    upper = {k: v for k, v in GOLDEN.items() if k[1] >= k[0]}
    assert cells(outer_gram(symmetric5, method=method)) == upper
    assert len(upper) == 8


def test_cancelled_entries_stay(matrix):
    m = matrix([[1, 1], [1, -1]])
    assert cells(spgemm(m, m)) == {(0, 0): 2, (0, 1): 0, (1, 0): 0, (1, 1): 2}
    assert cells(tiled_product(m, m)) == cells(mul.spgemm(m, m)) and len(cells(mul.spgemm(m, m, method="tiled"))) == 4
    assert cells(tiled_product(m, m, eps=1e-30)) == {(0, 0): 2, (1, 1): 2}


def test_shapes(matrix):
    rect = matrix([[1, 0, 2], [0, 0, 3]])
    with pytest.raises(ShapeError):
        mul.square_product(rect)
    with pytest.raises(ShapeError):
        spgemm(rect, rect)
    with pytest.raises(ValueError):
        spgemm(rect, rect.T, method="none")
    assert (outer_gram(rect).rows, inner_gram(rect).rows) == (2, 3)
    a = dense(rect)
    np.testing.assert_array_equal(dense(mul.self_product(rect)), a @ a.T)
    np.testing.assert_array_equal(dense(mul.gram_by_symmetry(rect)), a @ a.T)


def test_empty_product(spark):
    none = Matrix(spark.createDataFrame([], "i long, j long, v double"), 4, 4)
    for method in mul.METHODS:
        assert spgemm(none, none, method=method).nnz() == 0


def test_repeated_positions_add_up(spark, symmetric5):
    twice = Matrix(symmetric5.entries.unionByName(symmetric5.entries), 5, 5)
    assert twice.nnz() == 18
    assert cells(spgemm(twice, symmetric5)) == {k: 2 * v for k, v in GOLDEN.items()}
    assert cells(twice.combined()) == {k: 2 * v for k, v in cells(symmetric5).items()}


def skewed(rng, n, hot):
    """A third of all entries in one column, the rest spread."""
    a = np.zeros((n, n))
    a[:, hot] = rng.integers(1, 9, n)
    spots = rng.integers(0, n, (2 * n, 2))
    a[spots[:, 0], spots[:, 1]] = rng.integers(1, 9, 2 * n)
    return a


def test_hot_inner_key_is_cut(matrix):
    rng = np.random.default_rng(7)
    a, b = skewed(rng, 60, 5), skewed(rng, 60, 9).T.copy()
    b[5, :] = rng.integers(1, 9, 60)
    ma, mb = matrix(a), matrix(b)
    left, right = mul.left_side(ma), mul.right_side(mb)
    work = workload.measure(left, right, 100)
    per_key = np.count_nonzero(a, axis=0) * np.count_nonzero(b, axis=1)
    assert work.products == per_key.sum()
    assert work.hot_keys == (per_key > 100).sum() >= 1
    assert work.largest_key == per_key.max() >= 3600
    for options in ({"method": "outer"}, {"method": "auto", "broadcast_rows": 0}):
        np.testing.assert_array_equal(dense(spgemm(ma, mb, task_products=100, **options)), a @ b)
    cut_left, cut_right = workload.split_hot_keys(left, right, work, 100)
    blocks = cut_left.groupBy("k", "ls", "rs").count().withColumnRenamed("count", "a").join(
        cut_right.groupBy("k", "ls", "rs").count().withColumnRenamed("count", "b"), ["k", "ls", "rs"]
    )
    sizes = [r["a"] * r["b"] for r in blocks.collect()]
    assert sum(sizes) == work.products
    assert max(sizes) < 800


@pytest.mark.parametrize("flip", [False, True])
def test_long_row_leaves_the_row_plan(matrix, flip):
    """A row over the budget is shuffled by (row, key); results are whole either way."""
    rng = np.random.default_rng(3)
    a = skewed(rng, 40, 2).T.copy()
    b = np.zeros((40, 40))
    b[:, :8] = rng.integers(0, 3, (40, 8))
    ma, mb = (matrix(a), matrix(b)) if not flip else (matrix(b.T), matrix(a.T))
    work = workload.measure(mul.left_side(ma), mul.right_side(mb))
    parts = mul.planned_parts(mul.left_side(ma), mul.right_side(mb), work, False, 64, 2_000_000)
    assert len(parts) == 2
    np.testing.assert_array_equal(dense(spgemm(ma, mb, task_products=64)), dense(ma) @ dense(mb))


def test_row_plan_adds_up_without_second_shuffle(symmetric5):
    plan = spgemm(symmetric5, symmetric5).entries._jdf.queryExecution().executedPlan().toString()
    first, join = plan.index("HashAggregate"), plan.index("BroadcastHashJoin")
    assert "Exchange hashpartitioning(i" not in plan[first:join]


def test_large_sides_join_by_shuffle(spark, symmetric5):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        c = spgemm(symmetric5, symmetric5, broadcast_rows=0)
        plan = c.entries._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
        assert cells(c) == GOLDEN
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_structure_then_values(matrix):
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 2, (12, 12)) for _ in range(2))
    ma, mb = matrix(a), matrix(b)
    structure = mul.symbolic(ma, mb)
    np.testing.assert_array_equal(dense(mul.numeric(structure, ma, mb)), a @ b)
    lengths = {r["i"]: r["c_nnz"] for r in mul.output_row_lengths(ma, mb).collect()}
    assert lengths == {i: n for i, n in enumerate(np.count_nonzero(a @ b, axis=1)) if n}


def test_tiles_against_numpy(matrix):
    rng = np.random.default_rng(2)
    a, b = rng.integers(-3, 4, (20, 33)), rng.integers(-3, 4, (33, 17))
    np.testing.assert_array_equal(dense(tiled_product(matrix(a), matrix(b), edge=8)), a @ b)


def test_random_products_agree(matrix):
    rng = np.random.default_rng(11)
    for shape in ((1, 1, 1), (7, 3, 9), (25, 40, 5)):
        a = rng.integers(-2, 3, shape[:2])
        b = rng.integers(-2, 3, shape[1:])
        ma, mb = matrix(a), matrix(b)
        for method in ("auto", "outer", "bucketed"):
            np.testing.assert_array_equal(dense(spgemm(ma, mb, method=method)), a @ b)
        total = sum(v for v in cells(spgemm(ma, mb)).values())
        assert total == (a.sum(axis=0) * b.sum(axis=1)).sum()


def test_spmv(spark, matrix):
    a = np.array([[1, 0, 2, 0], [0, 0, 0, 0], [0, 0, 3, 4], [5, 0, 0, 0.0]])
    m = matrix(a)
    x = spark.createDataFrame([(j, float(j + 1)) for j in range(4)], "j long, x double")
    y = {r["i"]: r["y"] for r in spmv(m, x).collect()}
    assert [y[i] for i in range(4)] == (a @ [1, 2, 3, 4]).tolist()
    y = {r["i"]: r["y"] for r in spmv_transposed(m, x).collect()}
    assert [y[i] for i in range(4)] == (a.T @ [1, 2, 3, 4]).tolist()
    assert spmv(m, x, all_rows=False).count() == 3
    assert vector_diff(spmv(m, x), spmv(m, x)).isEmpty()


def test_diff(matrix):
    one, other = matrix([[1, 2], [0, 4]]), matrix([[1, 2.5], [3, 0]])
    row = diff.difference(one, other).first()
    assert (row["common"], row["only_expected"], row["only_actual"]) == (2, 1, 1)
    assert row["max_abs_err"] == 0.5 and row["scale"] == 4 and not row["passed"]
    assert diff.difference(one, one).first()["passed"]
    assert diff.equal(one, one) and not diff.equal(one, other) and not diff.same_structure(one, other)
    assert diff.mismatches(one, other).count() == 3
    sides = {(r["i"], r["j"]): r["side"] for r in diff.key_sets(one, other).collect()}
    assert sides == {(0, 0): "both", (0, 1): "both", (1, 0): "actual", (1, 1): "expected"}
