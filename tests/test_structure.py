import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import cells, dense
from tripleloom import Matrix
from tripleloom.functions import hashing, scalar
from tripleloom.operators import reshape, rowstats, scans, sketches
from tripleloom.plans import dispatch


def test_row_form_and_back(matrix):
    rng = np.random.default_rng(5)
    a = rng.integers(0, 3, (9, 30))
    m = matrix(a)
    rows = reshape.row_form(m, segment=7)
    assert all(len(r["cols"]) <= 7 and r["cols"] == sorted(r["cols"]) for r in rows.collect())
    assert reshape.unsorted_rows(rows).isEmpty()
    np.testing.assert_array_equal(dense(reshape.from_row_form(rows, 9, 30)), a)
    np.testing.assert_array_equal(dense(m.T.T), a)
    np.testing.assert_array_equal(dense(m.T), a.T)


def test_unsorted_rows_are_found(spark):
    rows = spark.createDataFrame([(0, 0, [1, 2]), (1, 0, [2, 1]), (2, 0, [3, 3])], "i long, seg long, cols array<long>")
    assert sorted(r["i"] for r in reshape.unsorted_rows(rows).collect()) == [1, 2]


def test_offsets_and_positions(matrix):
    rng = np.random.default_rng(6)
    a = rng.integers(0, 2, (11, 8))
    a[4] = 0
    m = matrix(a)
    ptr = {r["i"]: r["row_ptr"] for r in reshape.row_offsets(m).collect()}
    assert [ptr[i] for i in range(12)] == [0, *np.cumsum(np.count_nonzero(a, axis=1))]
    order = [(r["i"], r["j"]) for r in reshape.csr_positions(m).orderBy("at").collect()]
    assert order == list(zip(*np.nonzero(a)))


@pytest.mark.parametrize("window", [1_000_000, 3])
def test_prefix_sums_with_a_hot_group(spark, monkeypatch, window):
    """A third of the rows in one group; the block plan and the window agree with numpy."""
    monkeypatch.setattr(scans, "WINDOW_ROWS", window)
    rng = np.random.default_rng(8)
    rows = [(0, int(k), int(rng.integers(9))) for k in rng.permutation(200)[:100]]
    rows += [(g, int(k), int(rng.integers(9))) for g in range(1, 41) for k in rng.permutation(200)[:5]]
    df = spark.createDataFrame(rows, "g long, k long, v long")
    got = {(r["g"], r["k"]): r["before"] for r in scans.prefix_sum(df, "k", F.col("v"), 200, ("g",)).collect()}
    want = {(g, k): sum(v for g2, k2, v in rows if g2 == g and k2 < k) for g, k, _ in rows}
    assert got == want
    whole = scans.prefix_sum(df.where("g = 0"), "k", F.col("v"), 200).collect()
    assert {(r["g"], r["k"]): r["before"] for r in whole} == {k: v for k, v in want.items() if k[0] == 0}


@pytest.mark.parametrize("window", [1_000_000, 2])
def test_order_statistics(spark, monkeypatch, window):
    monkeypatch.setattr(scans, "WINDOW_ROWS", window)
    rng = np.random.default_rng(9)
    groups = {
        0: np.concatenate([np.full(60, 7.0), rng.normal(0, 1e3, 40)]),
        1: rng.normal(0, 1, 31), 2: np.array([-4.0]), 3: np.array([0.0, -0.5, 1e-9, 1e9]),
    }
    df = spark.createDataFrame([(g, float(x)) for g, xs in groups.items() for x in xs], "g int, x double")
    got = {r["g"]: r["median"] for r in scans.medians(df, "x", ("g",)).collect()}
    assert got == {g: pytest.approx(float(np.median(xs))) for g, xs in groups.items()}
    at = [0.0, 0.1, 0.5, 0.77, 1.0]
    got = {(r["g"], r["q"]): r["x"] for r in scans.quantiles(df, "x", at, ("g",)).collect()}
    for g, xs in groups.items():
        for q in at:
            assert got[g, q] == pytest.approx(float(np.quantile(xs, q)))


def test_equal_values_are_ordered_by_id(spark, monkeypatch):
    monkeypatch.setattr(scans, "WINDOW_ROWS", 2)
    df = spark.createDataFrame([("a", n, 5) for n in range(50)], "g string, id int, x int")
    targets = spark.createDataFrame([("a", 0, 17), ("a", 1, 49)], "g string, pick int, rank long")
    levels = [*scans.value_levels("x"), *scans.id_levels("id", 50)]
    got = {r["pick"]: r["id"] for r in scans.at_ranks(df, targets, levels, ("g",), ["id"]).collect()}
    assert got == {0: 17, 1: 49}


def test_magnitude_blocks_never_fall(spark):
    xs = sorted({0.0, *np.random.default_rng(1).normal(0, 1e3, 500), 1e-300, -1e-300, 1e300, -1e300, 2.0, 4.0, 8.0})
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    for per_octave in (1 << 10, 1 << 20):
        blocks = [r[0] for r in df.orderBy("x").select(scans.magnitude_block(F.col("x"), per_octave)).collect()]
        assert blocks == sorted(blocks)


def test_column_buckets(spark):
    for n, k in ((24, 5), (7, 3), (79, 8), (5, 5)):
        got = [r[0] for r in spark.range(n).select(scalar.column_bucket(F.col("id"), k, n)).collect()]
        assert got == [next(b for b in range(k) if b * n // k <= j < (b + 1) * n // k) for j in range(n)]


def test_sizes_and_bins(spark):
    es = [1, 16, 17, 32, 33, 64, 65, 5000, 16384, 99999]
    df = spark.createDataFrame([(e,) for e in es], "e long")
    rows = df.select("e", scalar.table_size(F.col("e")).alias("t"), scalar.size_bin(F.col("e")).alias("b")).collect()
    for r in rows:
        size, bin_ = 32, 0
        while size < r["e"] and size < 16384:
            size, bin_ = size * 2, bin_ + 1
        assert (r["t"], r["b"]) == ((r["e"], 10) if r["e"] <= 16 else (size, min(bin_, 9)))


def test_classes(spark):
    df = spark.createDataFrame([(x,) for x in (100.0, 10.0, 9.99, 1.0, 0.1, 0.0999, None, float("nan"))], "d double")
    got = [r[0] for r in df.select(scalar.density_class(F.col("d"))).collect()]
    assert got == ["Dense", "Dense", "Mildly sparse", "Mildly sparse", "Highly sparse", "Extremely sparse", "?", "?"]


def python_murmur(key: int) -> int:
    m = 0xFFFFFFFF
    rot = lambda x, r: ((x << r) | (x >> (32 - r))) & m
    k = rot(key * 0xCC9E2D51 & m, 15) * 0x1B873593 & m
    h = (rot(1234 ^ k, 13) * 5 + 0xE6546B64) & m
    h ^= 4
    h = (h ^ h >> 16) * 0x85EBCA6B & m
    h = (h ^ h >> 13) * 0xC2B2AE35 & m
    return h ^ h >> 16


def test_murmur(spark):
    rows = hashing.with_murmur3(spark.range(2000).withColumn("j", F.col("id") * 2147483 % (1 << 32)), "j").collect()
    assert all(r["h"] == python_murmur(r["j"]) for r in rows)


def test_packed_keys(spark):
    df = spark.createDataFrame([(3, 5), (2**30, 2**31 + 7)], "i long, j long")
    key = hashing.pack_key(F.col("i"), F.col("j"))
    rows = df.select("i", "j", hashing.unpack_row(key).alias("r"), hashing.unpack_col(key).alias("c")).collect()
    assert all((r["i"], r["j"]) == (r["r"], r["c"]) for r in rows)
    assert df.limit(1).select(hashing.pack_row_in_column(F.col("i"), F.col("j"))).first()[0] == (3 << 27) + 5


def test_sketches_against_truth(matrix):
    rng = np.random.default_rng(4)
    a = (rng.random((30, 900)) < 0.05).astype(float)
    b = (rng.random((900, 900)) < 0.05).astype(float)
    ma, mb = matrix(a), matrix(b)
    exact = np.count_nonzero(a @ b, axis=1)
    for estimate in (sketches.hll_estimate(ma, mb), sketches.minhash_estimate(ma, mb, bounded=True)):
        ratio = [r["distinct_est"] / exact[r["i"]] for r in estimate.collect()]
        assert len(ratio) == 30 and 0.5 < min(ratio) and max(ratio) < 2
    for native in (sketches.native_hll_estimate(ma, mb), sketches.native_theta_estimate(ma, mb)):
        ratio = [r["est"] / exact[r["i"]] for r in native.collect()]
        assert 0.85 < min(ratio) and max(ratio) < 1.15


def test_sketch_merge_is_the_sketch_of_the_union(matrix):
    rng = np.random.default_rng(14)
    a, b = ((rng.random((12, 12)) < 0.3).astype(float) for _ in range(2))
    ma, mb = matrix(a), matrix(b)
    merged = {(r["i"], r["p"]): r["reg"] for r in sketches.merged_hll(ma, mb).collect()}
    union = {}
    for i, j in zip(*np.nonzero(a @ b)):
        h = python_murmur(int(j))
        spot = (int(i), h & 127)
        union[spot] = max(union.get(spot, 0), min(33 - h.bit_length(), 26))
    assert merged == union


def test_row_statistics(matrix):
    rng = np.random.default_rng(15)
    a, b = (rng.integers(0, 2, (20, 20)) for _ in range(2))
    a[3] = 0
    ma, mb = matrix(a), matrix(b)
    lengths = np.count_nonzero(a, axis=1)
    row = rowstats.length_statistics(ma).first()
    assert row["mean_nnz"] == pytest.approx(lengths.mean()) and row["std_nnz"] == pytest.approx(lengths.std(ddof=1))
    assert (row["min_nnz"], row["max_nnz"]) == (0, lengths.max())
    flop = {r["i"]: r["products"] for r in rowstats.product_counts(ma, mb).collect()}
    want = (a != 0) @ np.count_nonzero(b, axis=1)
    assert flop == {i: n for i, n in enumerate(want) if n}
    assert rowstats.product_totals(ma, mb).first()["operations"] == 2 * want.sum()
    assert sum(r["products"] for r in rowstats.bucket_products(ma, mb, 3).collect()) == want.sum()
    assert sum(r["nnz"] for r in rowstats.bucket_lengths(ma, mb, 3).collect()) == np.count_nonzero(a @ b)


def test_work_curve(spark):
    work = np.array([9, 1, 1, 1, 5, 5, 0, 30, 2, 2])
    df = spark.createDataFrame([(n, int(w)) for n, w in enumerate(work)], "i long, products long")
    curve = rowstats.work_curve(df, "products", 30)
    ends = {r["rows_upto"]: r["work_upto"] for r in curve.collect()}
    total = np.cumsum(np.sort(work)[::-1])
    assert ends == {n: total[n - 1] for n in ends} and max(ends) == 10
    share = rowstats.top_share(curve, 10, int(work.sum())).first()
    assert (share["rows_taken"], share["share_pct"]) == (2, pytest.approx(100 * 39 / 56))


def test_bins_are_laid_out_in_order(spark):
    est = [5, 40, 200, 16, 33, 9000, 2, 50]
    df = spark.createDataFrame([(n, e) for n, e in enumerate(est)], "i long, e long")
    bins = rowstats.binned(df, F.col("e"))
    slots = sorted((r["slot"], r["bin"], r["i"]) for r in rowstats.bin_positions(bins, len(est)).collect())
    assert [s for s, _, _ in slots] == list(range(8))
    assert [(b, i) for _, b, i in slots] == sorted((b, i) for _, b, i in slots)


def test_dispatch(matrix, symmetric5):
    row = dispatch.features(symmetric5).first()
    assert (row["n"], row["nnz"], row["maxrow"]) == (5, 9, 3)
    assert row["skew"] == pytest.approx(3 / 1.8) and row["flop"] == pytest.approx(81 / 5)
    assert dispatch.choose(symmetric5) == "merge3"
    assert dispatch.choose(symmetric5, "hash") == "hash" and dispatch.method_for(symmetric5, "H") == "auto"
    assert dispatch.choose(symmetric5, "x") == "merge3"


def test_mirror_and_prune(matrix):
    m = matrix([[1, 2], [0, 3]])
    assert cells(reshape.mirrored(m)) == {(0, 0): 1, (0, 1): 2, (1, 0): 2, (1, 1): 3}
    assert cells(reshape.mirrored(m, -1.0))[(1, 0)] == -2
    assert cells(reshape.pruned(m, 1.5)) == {(0, 1): 2, (1, 1): 3}
    assert reshape.densified(m).count() == 4


def test_estimate_by_named_method(matrix):
    rng = np.random.default_rng(16)
    m = matrix(rng.integers(0, 2, (15, 15)))
    bound = {r["i"]: r["products"] for r in rowstats.product_counts(m, m).collect()}
    small = {r["i"]: r["est"] for r in sketches.row_estimate(m, m, "bound").collect()}
    assert small == bound
    for method, direct in (("hll", sketches.hll_estimate), ("minhash", sketches.minhash_estimate)):
        large = {r["i"]: r["slots"] for r in sketches.row_estimate(m, m, method).collect()}
        assert large == {r["i"]: r["slots"] for r in direct(m, m).collect()}


def test_accumulator_choice(matrix):
    a = np.zeros((4, 600))
    a[0, 0] = 1
    a[1, :3] = 1
    a[2, 3:5] = 1
    b = np.zeros((600, 600))
    b[0, :500] = 1
    b[3, [0, 599]] = 1
    b[4, [5, 300]] = 1
    b[1, 0] = b[2, 0] = 1
    got = {r["i"]: (r["kind"], r["size_class"]) for r in rowstats.accumulator_choice(matrix(a), matrix(b), 1024).collect()}
    assert got == {0: ("direct", 2), 1: ("dense", 2), 2: ("hash", 5)}


@pytest.mark.parametrize("side_by_side", [32, 2])
def test_bucket_products_of_any_columns(spark, monkeypatch, side_by_side):
    monkeypatch.setattr(rowstats, "SIDE_BY_SIDE", side_by_side)
    left = [(0, 0), (0, 1), (0, 1), (1, 2), (None, 1), (2, None), (3, 7)]
    right = [(0, 0), (0, 9), (1, 3), (1, 3), (1, None), (1, 10), (1, -1), (2, -8), (2, 25), (None, 4), (0, -3)]
    a = Matrix(spark.createDataFrame([(i, j, 1.0) for i, j in left], "i long, j long, v double"), 4, 3)
    b = Matrix(spark.createDataFrame([(i, j, 1.0) for i, j in right], "i long, j long, v double"), 3, 10)
    bucket = lambda j: None if j is None else int(((j + 1) * 4 - 1) / 10)
    want = Counter((i, bucket(j)) for i, k in left for o, j in right if k is not None and k == o)
    got = rowstats.bucket_products(a, b, 4).collect()
    assert {(r["i"], r["b"]): r["products"] for r in got} == want and len(got) == len(want)


def test_bucket_products_keep_one_group_per_row(matrix, monkeypatch):
    monkeypatch.setattr(rowstats, "BROADCAST_ROWS", 0)
    m = matrix(np.arange(400).reshape(20, 20) % 3)
    plan = rowstats.bucket_products(m, m, 5)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"keys=\[[ik]#\d+L?, b#", plan)
