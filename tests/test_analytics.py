import numpy as np
import pytest
from pyspark.sql import functions as F

from tripleloom.analytics import benchmarking as be
from tripleloom.analytics import corpus as co
from tripleloom.analytics import regression as rg
from tripleloom.functions.scalar import geomean
from tripleloom.plans import dispatch


@pytest.fixture(scope="module")
def runs(spark):
    rows = [
        ("a", "Dense", 1.0, 2.0, None), ("b", "Dense", 2.0, 2.0, 1.0),
        ("c", "Mildly sparse", 4.0, 3.9, 8.0), ("d", "Mildly sparse", 5.0, 2.0, None), ("e", "Dense", None, 1.0, 1.0),
    ]
    return spark.createDataFrame(rows, "matrix string, class string, auto double, cu double, dense double")


@pytest.mark.parametrize(
    ("rule", "cu", "dense"),
    [
        ("at_most", (2, 0, 2), (1, 0, 1)),
        ("strict", (1, 0, 3), (1, 0, 1)),
        ("unfinished_wins", (2, 0, 2), (3, 0, 1)),
        ("tie_band", (1, 2, 1), (1, 0, 1)),
        ("near", (1, 2, 1), (1, 0, 1)),
    ],
)
def test_tallies(runs, rule, cu, dense):
    got = {r["baseline"]: (r["wins"], r["ties"], r["losses"]) for r in be.win_loss(runs, "auto", ["cu", "dense"], rule).collect()}
    assert got == {"cu": cu, "dense": dense}
    with pytest.raises(ValueError):
        be.win_loss(runs, "auto", ["cu"], "none")


def test_speedups_and_means(runs):
    got = {(r["baseline"], r["class"]): r for r in be.speedups(runs, "auto", ["cu", "dense"]).collect()}
    ratios = np.array([2.0, 1.0, 3.9 / 4, 0.4])
    assert got["cu", "ALL"]["speedup"] == pytest.approx(np.exp(np.log(ratios).mean()))
    assert (got["cu", "ALL"]["wins"], got["cu", "ALL"]["total"]) == (1, 4)
    assert got["dense", "Dense"]["total"] == 1 and ("dense", "ALL") in got
    means = {r["class"]: r for r in be.class_geomeans(runs, ["auto", "cu"]).collect()}
    assert means["Dense"]["auto"] == pytest.approx(2**0.5) and means["ALL"]["matrices"] == 5
    assert runs.select(geomean(F.col("cu") * 0)).first()[0] is None


def test_rankings(runs):
    assert [r["matrix"] for r in be.worst_losses(runs, "auto", "cu", 5).collect()] == ["d", "c"]
    assert [r["matrix"] for r in be.tightest(runs, "auto", "dense", 2.5, 5).collect()] == ["b", "c"]


def test_phase_groups(spark):
    rows = [("r", "gust", "count", 1.0), ("r", "gust", "scan", 2.0), ("s", "gust", "count", 5.0), ("s", "gust", "d2h", 4.0)]
    df = spark.createDataFrame(rows, "run string, tag string, phase string, ms double")
    got = {r["group"]: r["ms"] for r in be.phase_group_means(df).collect()}
    assert got == {"symbolic": 4.0, "d2h": 2.0}
    only = {r["run"]: r["ms"] for r in be.compute_only(df.unionByName(spark.createDataFrame([("t", "gust", "h2d", 1.0)], df.schema))).collect()}
    assert only == {"r": 3.0, "s": 5.0, "t": None}


def trend(x, ratio, bins):
    lx = np.log10(x)
    edges = np.quantile(lx, np.linspace(0, 1, bins + 1))[1:-1]
    place = np.searchsorted(edges, lx, side="right")
    return [(float(np.median(x[place == k])), float(10 ** np.log10(ratio[place == k]).mean())) for k in range(bins) if (place == k).sum() > 1]


def test_binned_trend(spark):
    rng = np.random.default_rng(0)
    x, ratio = 10 ** rng.uniform(1, 5, 101), 10 ** rng.normal(0, 0.3, 101)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, ratio)], "x double, r double")
    got = [(r["x"], r["ratio"]) for r in be.binned_trend(df, "x", "r").orderBy("bin").collect()]
    np.testing.assert_allclose(got, trend(x, ratio, 6))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(21)
    rows = []
    for n in range(300):
        size = int(10 ** rng.uniform(1, 4))
        nnz = max(1, int(size * size * 10 ** rng.uniform(-4, -0.3)))
        rows.append((n, f"m{n}", "g", size, size if n % 7 else size + 1, nnz, "k", f"v. {1990 + n % 30}"))
    index = spark.createDataFrame(rows, "id int, name string, `group` string, rows long, cols long, nnz long, kind string, date string")
    return co.classified(co.enriched(index, "https://example.org")).cache()


def half_even(x):
    return int(np.round(x))


def expected_picks(rows, by, at):
    order = sorted(rows, key=lambda r: (r[by], r["id"]))
    return {order[min(len(order) - 1, max(0, half_even(q * (len(order) - 1))))]["id"] for q in at}


def test_representatives(corpus):
    got = {}
    for r in co.representatives(corpus, 300, co.CUSTOMARY).collect():
        got.setdefault(r["class"], set()).add(r["id"])
    by_class = {}
    for r in corpus.collect():
        by_class.setdefault(r["class"], []).append(r)
    for name, rows in by_class.items():
        within = lambda r, limit: r["n"] <= limit[0] and r["nnz"] <= limit[1]
        tight = [r for r in rows if within(r, co.CUSTOMARY.tight)]
        pool = tight if len(tight) >= 5 else [r for r in rows if within(r, co.CUSTOMARY.loose)]
        want = expected_picks(pool, "nnz", co.SIZE_POSITIONS) | expected_picks(pool, "density_pct", co.DENSITY_POSITIONS)
        assert got[name] == want
    assert set(got) == set(by_class)


def test_more_representatives(corpus):
    chosen = co.representatives(corpus, 300, co.CUSTOMARY)
    more = co.more_representatives(corpus, chosen, 8, 300, co.CUSTOMARY).collect()
    taken = {r["id"] for r in chosen.collect()}
    assert not taken & {r["id"] for r in more}
    for name in {r["class"] for r in more}:
        have = sum(1 for r in chosen.collect() if r["class"] == name)
        free = [r for r in corpus.where(F.col("class") == name).collect() if r["id"] not in taken]
        tight = [r for r in free if r["n"] <= co.CUSTOMARY.tight[0] and r["nnz"] <= co.CUSTOMARY.tight[1]]
        pool = free if len(tight) < 8 - have else tight
        want = expected_picks(pool, "density_pct", np.linspace(0.05, 0.95, 8 - have))
        assert {r["id"] for r in more if r["class"] == name} == want


def test_enriched(corpus):
    r = corpus.where("id = 1").first()
    assert r["year"] == 1991 and r["url_mm"] == "https://example.org/MM/g/m1.tar.gz" and r["is_square"]
    assert r["density"] == r["nnz"] / r["rows"] ** 2 and corpus.where("rows <> cols").isEmpty()


def test_summaries(corpus):
    n = np.array([r["n"] for r in corpus.collect()])
    row = co.summary(corpus, ("n", "nnz")).where("column = 'n'").first()
    assert tuple(row)[1:] == (n.min(), np.median(n), pytest.approx(n.mean()), n.max())
    assert [r["n"] for r in co.largest(corpus, "n", 3).collect()] == sorted(n, reverse=True)[:3]
    logs = np.log10([r["density"] for r in corpus.collect()])
    counts, edges = np.histogram(logs, bins=60)
    got = {r["bin"]: r["n"] for r in co.log_histogram(corpus, "density").collect()}
    assert sum(got.values()) == len(logs)
    assert sum(abs(got.get(b, 0) - c) for b, c in enumerate(counts)) <= 2


def test_fits(spark):
    rng = np.random.default_rng(5)
    n = 10 ** rng.uniform(2, 5, 400)
    nnz = n * 10 ** rng.uniform(0.3, 1.5, 400)
    maxrow = np.ceil(nnz / n * 10 ** rng.uniform(0, 1, 400))
    flop = nnz * nnz / n
    hash_ms = 0.1 + flop * 2e-7 * np.exp(rng.normal(0, 0.1, 400))
    merge_ms = 0.05 + flop * 9e-7 * np.exp(rng.normal(0, 0.1, 400))
    rows = zip(*(c.tolist() for c in (n.astype(int), nnz.astype(int), maxrow, maxrow / (nnz / n), flop, hash_ms, merge_ms)))
    df = spark.createDataFrame(list(rows), "n long, nnz long, maxrow double, skew double, flop double, hash_ms double, merge3_ms double")
    design = np.column_stack([np.log(flop), np.log(n.astype(int)), np.ones(400)])
    want = np.linalg.lstsq(design, np.log(hash_ms), rcond=None)[0]
    row = rg.plane_fit(df, F.ln("hash_ms"), F.ln("flop"), F.ln(F.col("n").cast("double"))).first()
    np.testing.assert_allclose([row["b1"], row["b2"], row["b0"]], want, rtol=1e-6)
    beta, r2 = rg.least_squares(df, F.ln("hash_ms"), [F.ln("flop"), F.ln(F.col("n").cast("double")), F.lit(1.0)])
    np.testing.assert_allclose(beta, want, rtol=1e-6)
    assert r2 == pytest.approx(row["r2"])
    unequal = df.withColumn("y", 3 * F.col("flop") + 2e8 * F.col("nnz") * 1e-12 + 1)
    beta, r2 = rg.least_squares(unequal, F.col("y"), [F.col("flop"), F.col("nnz") * 1e-12, F.lit(1.0)])
    np.testing.assert_allclose(beta, [3, 2e8, 1], rtol=1e-4)
    fitted = rg.fit_dispatcher(df)
    accuracy = dispatch.evaluation(df, fitted).first()
    assert accuracy["accuracy"] > 0.9
    assert accuracy["oracle_ms"] <= accuracy["cost_ms"] <= accuracy["always_merge_ms"]
