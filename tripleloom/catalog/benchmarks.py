"""Line items read as a table of method timings, events as run logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripleloom.analytics import benchmarking as be
from tripleloom.analytics import regression as rg
from tripleloom.catalog import Query
from tripleloom.catalog.statistics import TIMINGS, score_sql, timings
from tripleloom.functions.scalar import class_rank, density_class
from tripleloom.operators import scans as sc
from tripleloom.plans import dispatch
from tripleloom.session import written
from tripleloom.sources.results import timed

BASELINES = ["cu", "ocean", "dense"]


def raw_runs(t):
    """One row per part with times as text; a dense run of many lines timed out."""
    lines = t.read("lineitem").groupBy("l_partkey").agg(
        F.count(F.lit(1)).alias("nnz"),
        F.sum(F.round(F.col("l_discount") * 100).cast("long")).alias("auto"),
        F.sum(F.round(F.col("l_tax") * 100).cast("long")).alias("cu"),
        F.sum("l_linenumber").alias("ocean"),
        F.sum("l_quantity").cast("long").alias("dense"),
    )
    density = F.col("nnz") * 100.0 / (F.col("p_size") * F.col("p_size") * 100.0)
    text = lambda c: F.col(c).cast("string").alias(c)
    return lines.join(t.read("part"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_partkey").alias("matrix"), F.col("p_size").cast("long").alias("n"),
        density_class(density).alias("class"),
        text("auto"), text("cu"), text("ocean"),
        F.when(F.col("nnz") > 35, F.lit("timeout")).otherwise(F.col("dense").cast("string")).alias("dense"),
        F.when(F.col("auto") % 3 == 0, F.lit("hash"))
        .when(F.col("auto") % 3 == 1, F.lit("merge3"))
        .otherwise(F.lit("merge3 (fallback)")).alias("choice"),
        F.col("nnz").alias("cnnz"), (F.col("nnz") + F.col("auto") % 2).alias("cnnz_other"),
    )


def runs(t):
    return timed(raw_runs(t), ["auto", *BASELINES])


RAW_RUNS = """SELECT p_partkey AS matrix, CAST(p_size AS BIGINT) AS n,
  CASE WHEN d >= 10 THEN 'Dense' WHEN d >= 1 THEN 'Mildly sparse' WHEN d >= 0.1 THEN 'Highly sparse'
    ELSE 'Extremely sparse' END AS class,
  CAST(a AS VARCHAR) AS auto, CAST(c AS VARCHAR) AS cu, CAST(o AS VARCHAR) AS ocean,
  CASE WHEN nnz > 35 THEN 'timeout' ELSE CAST(q AS VARCHAR) END AS dense,
  CASE a % 3 WHEN 0 THEN 'hash' WHEN 1 THEN 'merge3' ELSE 'merge3 (fallback)' END AS choice,
  nnz AS cnnz, nnz + a % 2 AS cnnz_other
FROM (SELECT *, nnz * 100.0::DOUBLE / (p_size * p_size * 100.0::DOUBLE) AS d FROM part JOIN (
  SELECT l_partkey, count(*) AS nnz, CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) AS a,
    CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS BIGINT) AS c, CAST(sum(l_linenumber) AS BIGINT) AS o,
    CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY 1) ON p_partkey = l_partkey)"""
RUNS = f"""SELECT matrix, n, class, TRY_CAST(auto AS DOUBLE) AS auto, TRY_CAST(cu AS DOUBLE) AS cu,
  TRY_CAST(ocean AS DOUBLE) AS ocean, TRY_CAST(dense AS DOUBLE) AS dense, choice, cnnz, cnnz_other FROM ({RAW_RUNS})"""
LONG = f"""SELECT matrix, n, class, auto AS s, 'cu' AS baseline, cu AS b FROM ({RUNS})
UNION ALL SELECT matrix, n, class, auto, 'ocean', ocean FROM ({RUNS})
UNION ALL SELECT matrix, n, class, auto, 'dense', dense FROM ({RUNS})"""


def _tally(win: str, tie: str = "false", unfinished: bool = False) -> str:
    won = f"CASE WHEN b > 0 THEN {win} ELSE b IS NULL END" if unfinished else win
    counted = "(b > 0 OR b IS NULL)" if unfinished else "b > 0"
    return f"""SELECT baseline, count(*) FILTER (WHERE {won}) AS wins, count(*) FILTER (WHERE b > 0 AND ({tie})) AS ties,
  count(*) FILTER (WHERE b > 0 AND NOT ({win}) AND NOT ({tie})) AS losses,
  count(*) FILTER (WHERE b IS NULL) AS unfinished,
  round(exp(avg(CASE WHEN b > 0 THEN ln(s / b) END)), 9) AS ratio
FROM ({LONG}) WHERE s > 0 AND {counted} GROUP BY 1"""


def _win_loss(rule: str, *terms, **options) -> Query:
    return Query(
        lambda t: be.win_loss(runs(t), "auto", BASELINES, rule).withColumn("ratio", F.round("ratio", 9)),
        _tally(*terms, **options),
    )


def _round(df, *columns, digits=9):
    return df.select(*[F.round(c, digits).alias(c) if c in columns else F.col(c) for c in df.columns])


def _changes(t):
    """Discount against tax per part and status, as before and after."""
    sums = lambda c: t.read("lineitem").groupBy("l_partkey", "l_linestatus").agg(
        F.sum(F.round(F.col(c) * 100)).alias("ms")
    )
    return _round(be.paired_change(sums("l_discount"), sums("l_tax"), ["l_partkey", "l_linestatus"], "ms"), "change_pct")


def _status_stats(t):
    long = written(t.read("lineitem").select("l_returnflag", F.col("l_extendedprice").alias("ms")))
    return _round(be.method_statistics(long, "ms", "l_returnflag"), "mean", "median", digits=4)


def _trend(t):
    points = written(timings(t).select("flop", (F.col("merge3_ms") / F.col("hash_ms")).alias("ratio")))
    return _round(be.binned_trend(points, "flop", "ratio"), "x", "ratio", digits=6)


TREND = f"""WITH p AS (SELECT flop AS x, log10(flop) AS lx, log10(merge3_ms / hash_ms) AS lr
  FROM ({TIMINGS}) WHERE flop > 0 AND hash_ms > 0),
e AS (SELECT quantile_cont(lx, [{", ".join(f"{q}::DOUBLE / 6" for q in range(1, 6))}]) AS e FROM p),
b AS (SELECT p.*, {" + ".join(f"CAST(lx >= e[{n}] AS BIGINT)" for n in range(1, 6))} AS bin FROM p, e)
SELECT bin, count(*) AS n, round(median(x), 6) AS x, round(10.0::DOUBLE ** avg(lr), 6) AS ratio
FROM b GROUP BY 1 HAVING count(*) >= 2"""


def _line(t):
    p = timings(t).where("hash_ms IS NOT NULL")
    fit = rg.line_fit(p, F.ln(F.col("hash_ms") / F.col("merge3_ms")), F.ln("flop"))
    return _round(fit.withColumn("crossover", rg.crossover(F.col("slope"), F.col("intercept")) > 0), "slope", "intercept", "r2")


def _plane(t):
    p = timings(t).where("hash_ms IS NOT NULL")
    return _round(rg.plane_fit(p, F.ln("hash_ms"), F.ln("flop"), F.ln(F.col("n").cast("double"))), "b1", "b2", "b0", "r2", digits=6)


def _class_lines(t):
    fit = rg.line_fit(runs(t).where("auto > 0 AND cu > 0"), F.ln("auto"), F.ln("cu"), ("class",))
    return _round(fit, "slope", "intercept", "r2", digits=6)


def _fit_quality(t):
    """The logistic fit by what it decides: cases, and whether it beats either fixed choice."""
    data = written(timings(t))
    row = dispatch.evaluation(data, rg.fit_dispatcher(data))
    return row.select(
        F.col("matrices").cast("long").alias("cases"),
        (F.col("cost_ms") <= F.least("always_merge_ms", "always_hash_ms") * 1.001).alias("no_worse_than_fixed"),
        (F.col("cost_ms") >= F.col("oracle_ms") * 0.999999).alias("no_better_than_best"),
    )


def _fit_gradient(t):
    """The fit by its slopes, which are zero at the best one, and by its accuracy beside always taking the more frequent winner."""
    data = written(timings(t))
    fit = rg.fit_dispatcher(data)
    slopes = F.greatest(*[F.abs(c) for c in [*rg.FEATURES, "constant"]])
    return rg.fit_gradient(data, fit).select("cases", (slopes < 1e-3).alias("stationary"))


def _forced(t):
    force = F.element_at(F.array(F.lit(None), F.lit(""), F.lit("Hash"), F.lit("merge")), (F.col("matrix") % 4 + 1).cast("int"))
    return dispatch.executed(timings(t), force).select("matrix", "choice", "ran", "paid_ms")


def _least_squares(t):
    """Price by quantity and tax, the tax brought to a scale of 1e-8."""
    lines = t.read("lineitem")
    (b1, b2, b0), r2 = rg.least_squares(lines, F.col("l_extendedprice"), [F.col("l_quantity"), F.col("l_tax") * 1e-8, F.lit(1.0)])
    row = [(round(b1, 4), round(b2 * 1e-8, 4), round(b0, 3), round(r2, 8))]
    return t.spark.createDataFrame(row, "b1 double, b2_scaled double, b0 double, r2 double")


def _ab_summary(t):
    lines = t.read("lineitem")
    sides = [lines.select("l_linestatus", "l_returnflag", F.round(F.col(c) * 100).alias("ms")) for c in ("l_discount", "l_tax")]
    return _round(
        be.ab_summary(*map(written, sides), ["l_linestatus", "l_returnflag"]),
        "before_mean", "after_mean", "mean_change_pct", "median_change_pct", digits=6,
    )


AB_SIDE = """SELECT l_linestatus, l_returnflag, count(*) AS {0}_runs, avg(round({1} * 100)) AS {0}_mean,
  median(round({1} * 100)) AS {0}_median FROM lineitem GROUP BY 1, 2"""


def _quantity_medians(t):
    return sc.medians(t.read("lineitem"), "l_quantity", ("l_returnflag",))


QUERIES = {
    "geomean_by_class_rollup": Query(
        lambda t: _round(be.class_geomeans(runs(t), ["auto", *BASELINES]), "auto", *BASELINES),
        f"""SELECT coalesce(class, 'ALL') AS class, count(*) AS matrices,
  {", ".join(f"round(exp(avg(CASE WHEN {m} > 0 THEN ln({m}) END)), 9) AS {m}" for m in ["auto", *BASELINES])}
FROM ({RUNS}) GROUP BY ROLLUP (class)""",
    ),
    "speedup_by_class": Query(
        lambda t: _round(be.speedups(runs(t), "auto", BASELINES), "speedup", "baseline_ms"),
        f"""SELECT baseline, coalesce(class, 'ALL') AS class, round(exp(avg(ln(b / s))), 9) AS speedup,
  count(*) FILTER (WHERE s < b) AS wins, count(*) AS total, round(exp(avg(ln(b))), 9) AS baseline_ms
FROM ({LONG}) WHERE s > 0 AND b > 0 GROUP BY GROUPING SETS ((baseline, class), (baseline))""",
    ),
    "win_loss": _win_loss("at_most", "s / b <= 1"),
    "win_loss_unfinished": _win_loss("unfinished_wins", "s / b <= 1", unfinished=True),
    "win_loss_strict": _win_loss("strict", "s / b < 1"),
    "win_loss_tie_band": _win_loss("tie_band", "s / b < 1", "s / b >= 1 AND s / b <= 1.05::DOUBLE"),
    "win_loss_near": _win_loss(
        "near", "s / b <= 1 - 0.03::DOUBLE", "abs(s / b - 1) < 0.03::DOUBLE"
    ),
    "worst_losers": Query(
        lambda t: _round(be.worst_losses(runs(t), "auto", "cu", 15), "ratio"),
        f"""SELECT matrix, auto AS subject_ms, cu AS baseline_ms, round(auto / cu, 9) AS ratio FROM ({RUNS})
WHERE auto > 0 AND cu > 0 AND auto > cu ORDER BY auto / cu DESC, matrix LIMIT 15""",
    ),
    "tightest_margins": Query(
        lambda t: _round(be.tightest(runs(t), "auto", "dense", 5.0, 8), "ratio"),
        f"""SELECT matrix, round(dense / auto, 9) AS ratio, dense - auto AS margin_ms FROM ({RUNS})
WHERE auto > 0 AND dense > 0 AND dense / auto < 5.0::DOUBLE ORDER BY dense / auto, matrix LIMIT 8""",
    ),
    "choice_counts": Query(
        lambda t: be.choice_counts(runs(t), "choice"),
        f"SELECT regexp_extract(choice, '^(\\w+)', 1) AS choice, count(*) AS runs FROM ({RUNS}) GROUP BY 1",
    ),
    "nnz_mismatches": Query(
        lambda t: be.nnz_gaps(runs(t), "cnnz", ["cnnz_other"]),
        f"""SELECT matrix, cnnz, abs(cnnz_other - cnnz) AS cnnz_other_gap FROM ({RUNS}) WHERE cnnz_other <> cnnz""",
    ),
    "report_order": Query(
        lambda t: runs(t).select("matrix", "class", "n", class_rank(F.col("class")).cast("long").alias("rank")).orderBy(
            "rank", "n", "matrix"
        ),
        f"""SELECT matrix, class, n, CAST(CASE class WHEN 'Dense' THEN 0 WHEN 'Mildly sparse' THEN 1
  WHEN 'Highly sparse' THEN 2 ELSE 3 END AS BIGINT) AS rank FROM ({RUNS})""",
    ),
    "method_statistics": Query(
        _status_stats,
        """SELECT l_returnflag, count(*) AS runs, round(avg(l_extendedprice), 4) AS mean, min(l_extendedprice) AS least,
  max(l_extendedprice) AS greatest, round(median(l_extendedprice), 4) AS median FROM lineitem GROUP BY 1""",
    ),
    "paired_change": Query(
        _changes,
        """SELECT l_partkey, l_linestatus, before, after, round((after - before) / nullif(before, 0) * 100, 9) AS change_pct
FROM (SELECT l_partkey, l_linestatus, sum(round(l_discount * 100)) AS before, sum(round(l_tax * 100)) AS after
      FROM lineitem GROUP BY 1, 2)""",
    ),
    "binned_trend": Query(_trend, TREND),
    "simple_regression": Query(
        _line,
        f"""SELECT round(regr_slope(y, x), 9) AS slope, round(regr_intercept(y, x), 9) AS intercept,
  round(regr_r2(y, x), 9) AS r2, count(*) AS points, true AS crossover
FROM (SELECT ln(hash_ms / merge3_ms) AS y, ln(flop) AS x FROM ({TIMINGS}) WHERE hash_ms IS NOT NULL)""",
    ),
    "regression_by_class": Query(
        _class_lines,
        f"""SELECT class, round(regr_slope(ln(auto), ln(cu)), 6) AS slope, round(regr_intercept(ln(auto), ln(cu)), 6) AS intercept,
  round(regr_r2(ln(auto), ln(cu)), 6) AS r2, count(*) AS points FROM ({RUNS}) WHERE auto > 0 AND cu > 0 GROUP BY 1""",
    ),
    "multi_regression": Query(
        _plane,
        f"""WITH p AS (SELECT ln(hash_ms) AS y, ln(flop) AS a, ln(n) AS b FROM ({TIMINGS}) WHERE hash_ms IS NOT NULL),
m AS (SELECT avg(y) AS my, avg(a) AS ma, avg(b) AS mb, covar_pop(a, a) AS aa, covar_pop(b, b) AS bb, covar_pop(a, b) AS ab,
  covar_pop(a, y) AS ay, covar_pop(b, y) AS yb, covar_pop(y, y) AS yy FROM p),
f AS (SELECT *, (ay * bb - yb * ab) / (aa * bb - ab * ab) AS b1, (yb * aa - ay * ab) / (aa * bb - ab * ab) AS b2 FROM m)
SELECT round(b1, 6) AS b1, round(b2, 6) AS b2, round(my - b1 * ma - b2 * mb, 6) AS b0,
  round((b1 * ay + b2 * yb) / yy, 6) AS r2 FROM f""",
    ),
    "least_squares_unequal_scales": Query(
        _least_squares,
        """WITH m AS (SELECT avg(l_extendedprice) AS my, avg(l_quantity) AS ma, avg(l_tax) AS mb, var_pop(l_quantity) AS aa,
  var_pop(l_tax) AS bb, covar_pop(l_quantity, l_tax) AS ab, covar_pop(l_quantity, l_extendedprice) AS ay,
  covar_pop(l_tax, l_extendedprice) AS yb, var_pop(l_extendedprice) AS yy FROM lineitem),
f AS (SELECT *, (ay * bb - yb * ab) / (aa * bb - ab * ab) AS b1, (yb * aa - ay * ab) / (aa * bb - ab * ab) AS b2 FROM m)
SELECT round(b1, 4) AS b1, round(b2, 4) AS b2_scaled, round(my - b1 * ma - b2 * mb, 3) AS b0,
  round((b1 * ay + b2 * yb) / yy, 8) AS r2 FROM f""",
    ),
    "ab_summary": Query(
        _ab_summary,
        f"""SELECT a.l_linestatus AS l_linestatus, a.l_returnflag AS l_returnflag, before_runs, round(before_mean, 6) AS before_mean,
  before_median, after_runs, round(after_mean, 6) AS after_mean, after_median,
  round((after_mean - before_mean) * 100 / before_mean, 6) AS mean_change_pct,
  round((after_median - before_median) * 100 / before_median, 6) AS median_change_pct
FROM ({AB_SIDE.format("before", "l_discount")}) a JOIN ({AB_SIDE.format("after", "l_tax")}) b
ON a.l_linestatus = b.l_linestatus AND a.l_returnflag = b.l_returnflag""",
    ),
    "medians_of_few_values": Query(
        _quantity_medians, "SELECT l_returnflag, median(l_quantity) AS median FROM lineitem GROUP BY 1"
    ),
    "dispatcher_gradient": Query(
        _fit_gradient, f"SELECT count(*) AS cases, true AS stationary FROM ({TIMINGS}) WHERE hash_ms IS NOT NULL AND merge3_ms IS NOT NULL"
    ),
    "dispatch_forced": Query(
        _forced,
        f"""SELECT matrix, choice, CASE WHEN choice = 'hash' AND hash_ms IS NULL THEN 'merge3 (fallback)' ELSE choice END AS ran,
  CASE WHEN choice = 'hash' THEN coalesce(hash_ms, merge3_ms) ELSE merge3_ms END AS paid_ms
FROM (SELECT *, CASE matrix % 4 WHEN 2 THEN 'hash' WHEN 3 THEN 'merge3'
    ELSE CASE WHEN {score_sql(dispatch.CURRENT)} < 0 THEN 'hash' ELSE 'merge3' END END AS choice FROM ({TIMINGS}))""",
    ),
    "dispatcher_fit": Query(
        _fit_quality,
        f"""SELECT count(*) AS cases, true AS no_worse_than_fixed, true AS no_better_than_best
FROM ({TIMINGS}) WHERE hash_ms IS NOT NULL AND merge3_ms IS NOT NULL""",
    ),
}
