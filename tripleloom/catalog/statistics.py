"""Work estimates, bins, features and the method choice."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripleloom.catalog import Query
from tripleloom.catalog import tables as sql
from tripleloom.functions.scalar import doubling_bin
from tripleloom.operators import rowstats as st
from tripleloom.operators.reshape import row_lengths
from tripleloom.plans import dispatch
from tripleloom.session import written

COUNTED = f"""c AS (SELECT i AS k, count(*) AS n, min(j) AS lo, max(j) AS hi FROM ({sql.PART_SQUARE}) GROUP BY 1),
a AS (SELECT i, j AS k FROM ({sql.PART_SQUARE})),
f AS (SELECT a.i, CAST(sum(n) AS BIGINT) AS products, max(n) AS largest, count(*) AS nnz,
        min(lo) AS first_col, max(hi) AS last_col
      FROM a JOIN c USING (k) GROUP BY 1)"""
# Slots and bin of an estimate e.
SLOTS = "CASE WHEN {e} <= 16 THEN {e} ELSE greatest(32, least(16384, CAST(2 ** ceil(log2({e})) AS BIGINT))) END"
BIN = "CASE WHEN {s} <= 16 THEN 10 ELSE CAST(log2({s}) AS BIGINT) - 5 END"
BINS = f"""WITH {COUNTED}, s AS (SELECT i, products AS est, {SLOTS.format(e="products")} AS slots FROM f),
b AS (SELECT i, est, slots, {BIN.format(s="slots")} AS bin FROM s)"""


def _bins(t):
    # Read by three jobs, so it is written once.
    return written(st.binned(st.product_counts(t.part_square, t.part_square), F.col("products")))


def _curve(t):
    work = written(st.product_counts(t.part_square, t.part_square).select("i", "products"))
    top = int(work.agg(F.max("products")).first()[0] or 0)
    return work, st.work_curve(work, "products", top)


def _top_share(t):
    work, curve = _curve(t)
    rows, total = work.agg(F.count(F.lit(1)), F.sum("products")).first()
    return st.top_share(curve, rows, int(total or 0)).select("rows_taken", F.round("share_pct", 9).alias("share_pct"))


def _rounded(df, columns, digits=9):
    return df.select(*[F.round(c, digits).alias(c) if c in columns else F.col(c) for c in df.columns])


def timings(t):
    """A table of timings per part: ``n, nnz, maxrow, skew, flop, hash_ms, merge3_ms``."""
    lines = t.read("lineitem").groupBy(F.col("l_partkey").alias("matrix")).agg(
        (F.sum("l_quantity") * 10).alias("nnz"),
        (F.max("l_quantity") * 10).alias("maxrow"),
        (F.sum(F.round(F.col("l_discount") * 100)) / 10).alias("hash_ms"),
        (F.sum(F.round(F.col("l_tax") * 100)) / 8).alias("merge3_ms"),
    )
    sizes = t.read("part").select(F.col("p_partkey").alias("matrix"), F.col("p_size").cast("long").alias("n"))
    return lines.join(sizes, "matrix").select(
        "matrix", "n", "nnz", "maxrow",
        (F.col("maxrow") / (F.col("nnz") / F.col("n"))).alias("skew"),
        (F.col("nnz") * F.col("nnz") / F.col("n")).alias("flop"),
        F.when(F.col("hash_ms") > 0, F.col("hash_ms")).alias("hash_ms"),
        F.greatest("merge3_ms", F.lit(0.125)).alias("merge3_ms"),
    )


TIMINGS = """SELECT matrix, n, nnz, maxrow, maxrow / (nnz / n) AS skew, nnz * nnz / n AS flop,
  CASE WHEN hash_ms > 0 THEN hash_ms END AS hash_ms, greatest(merge3_ms, 0.125::DOUBLE) AS merge3_ms
FROM (SELECT l_partkey AS matrix, sum(l_quantity) * 10 AS nnz, max(l_quantity) * 10 AS maxrow,
        sum(round(l_discount * 100)) / 10 AS hash_ms, sum(round(l_tax * 100)) / 8 AS merge3_ms
      FROM lineitem GROUP BY 1)
JOIN (SELECT p_partkey AS matrix, CAST(p_size AS BIGINT) AS n FROM part) USING (matrix)"""


def score_sql(f: dispatch.Formula) -> str:
    lg = "log10(greatest({0}, 1.0::DOUBLE))"
    return (
        f"({f.products}::DOUBLE * {lg.format('flop')} + {f.rows}::DOUBLE * log10(CAST(n AS DOUBLE)) "
        f"+ {f.longest}::DOUBLE * {lg.format('maxrow')} + {f.skew}::DOUBLE * {lg.format('skew')} + {f.constant}::DOUBLE)"
    )


def evaluated_sql(f: dispatch.Formula) -> str:
    return f"""SELECT *, CASE WHEN choice = 'hash' THEN coalesce(hash_ms, merge3_ms) ELSE merge3_ms END AS paid_ms,
  least(coalesce(hash_ms, merge3_ms), merge3_ms) AS best_ms,
  coalesce(abs(hash_ms - merge3_ms) / nullif(least(coalesce(hash_ms, merge3_ms), merge3_ms), 0) > 0.1, true) AS decisive
FROM (SELECT *, CASE WHEN {score_sql(f)} < 0 THEN 'hash' ELSE 'merge3' END AS choice,
        CASE WHEN hash_ms < merge3_ms THEN 'hash' ELSE 'merge3' END AS winner FROM ({TIMINGS}))"""


def evaluation_sql(f: dispatch.Formula) -> str:
    return f"""SELECT count(*) AS matrices, count(*) FILTER (WHERE choice = 'hash') AS picked_hash,
  count(*) FILTER (WHERE winner = 'hash') AS hash_wins, count(*) FILTER (WHERE decisive) AS decisive,
  round(avg(CASE WHEN choice = winner THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS accuracy,
  round(avg(CASE WHEN choice = winner THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FILTER (WHERE decisive), 9) AS decisive_accuracy,
  round(sum(paid_ms), 6) AS cost_ms, round(sum(best_ms), 6) AS oracle_ms,
  round(sum(coalesce(hash_ms, merge3_ms)), 6) AS always_hash_ms, round(sum(merge3_ms), 6) AS always_merge_ms
FROM ({evaluated_sql(f)})"""


def _evaluation(formula):
    def run(t):
        rates = _rounded(dispatch.evaluation(timings(t), formula), {"accuracy", "decisive_accuracy"})
        return _rounded(rates, {"cost_ms", "oracle_ms", "always_hash_ms", "always_merge_ms"}, 6)

    return Query(run, evaluation_sql(formula))


def _product_features(t):
    return _rounded(dispatch.features(t.part_square), {"skew", "flop"}, 6)


FEATURES = f"""SELECT n, nnz, maxrow, maxrow / (CAST(nnz AS DOUBLE) / n) AS skew,
  CAST(nnz AS DOUBLE) * nnz / n AS flop
FROM (SELECT (SELECT count(*) FROM part) AS n, CAST(sum(c) AS BIGINT) AS nnz, max(c) AS maxrow
      FROM (SELECT i, count(*) AS c FROM ({sql.PART_SQUARE}) GROUP BY 1))"""

SORTED_WORK = f"""WITH {COUNTED}, v AS (SELECT products AS value, count(*) AS n FROM f GROUP BY 1),
w AS (SELECT value, n,
  CAST(sum(n) OVER (ORDER BY value DESC) AS BIGINT) AS rows_upto,
  CAST(sum(n * value) OVER (ORDER BY value DESC) AS BIGINT) AS work_upto FROM v)"""

QUERIES = {
    "flop_per_row": Query(
        lambda t: st.product_counts(t.part_square, t.part_square),
        f"WITH {COUNTED} SELECT i, products, largest FROM f",
    ),
    "flop_total_x2": Query(
        lambda t: st.product_totals(t.part_square, t.part_square),
        f"""WITH {COUNTED} SELECT CAST(sum(products) AS BIGINT) AS products, CAST(2 * sum(products) AS BIGINT) AS operations,
  max(products) AS largest_row_products, (SELECT max(n) FROM c) AS longest_row FROM f""",
    ),
    "products_outer_axis": Query(
        lambda t: st.products_by_inner_key(t.part_square, t.part_square),
        f"""WITH {COUNTED}, l AS (SELECT k, count(*) AS col_nnz FROM a GROUP BY 1)
SELECT k, col_nnz, n AS row_nnz, col_nnz * n AS products FROM l JOIN c USING (k)""",
    ),
    "products_by_column": Query(
        lambda t: st.products_by_column(t.part_square, t.part_square),
        f"""WITH l AS (SELECT j AS k, count(*) AS n FROM ({sql.PART_SQUARE}) GROUP BY 1)
SELECT b.j AS j, CAST(sum(n) AS BIGINT) AS products FROM ({sql.PART_SQUARE}) b JOIN l ON b.i = l.k GROUP BY 1""",
    ),
    "row_output_col_range": Query(
        lambda t: st.output_column_range(t.part_square, t.part_square),
        f"""WITH {COUNTED} SELECT i, first_col, last_col,
  CASE WHEN last_col = first_col THEN 0 ELSE CAST(floor(log2(last_col - first_col)) AS BIGINT) + 1 END AS width_class FROM f""",
    ),
    "bucket_flop": Query(
        lambda t: st.bucket_products(t.once("part_square"), t.once("part_square"), 5),
        f"""WITH b AS (SELECT i AS k, CAST(((j + 1) * 5 - 1) // (SELECT count(*) FROM part) AS BIGINT) AS b, count(*) AS n
  FROM ({sql.PART_SQUARE}) GROUP BY 1, 2)
SELECT a.i AS i, b.b AS b, CAST(sum(n) AS BIGINT) AS products FROM ({sql.PART_SQUARE}) a JOIN b ON a.j = b.k GROUP BY 1, 2""",
    ),
    "bucket_distinct_long_rows": Query(
        lambda t: st.bucket_lengths(t.once("supplier_part").T, t.once("supplier_part"), 5),
        f"""SELECT a.i AS i, CAST(((b.j + 1) * 5 - 1) // (SELECT count(*) FROM part) AS BIGINT) AS b, count(DISTINCT b.j) AS nnz
FROM ({sql.transposed(sql.SUPPLIER_PART)}) a JOIN ({sql.SUPPLIER_PART}) b ON a.j = b.i GROUP BY 1, 2""",
    ),
    "bucket_distinct": Query(
        lambda t: st.bucket_lengths(t.once("part_square"), t.once("part_square"), 5),
        f"""SELECT i, CAST(((j + 1) * 5 - 1) // (SELECT count(*) FROM part) AS BIGINT) AS b, count(*) AS nnz
FROM ({sql.product(sql.PART_SQUARE, sql.PART_SQUARE)}) GROUP BY 1, 2""",
    ),
    "row_stats": Query(
        lambda t: _rounded(st.length_statistics(t.document_label), {"mean_nnz", "std_nnz"}),
        f"""WITH n AS (SELECT d.i, count(m.i) AS n FROM (SELECT unnest(range(0, (SELECT count(*) FROM documents))) AS i) d
  LEFT JOIN ({sql.DOCUMENT_LABEL}) m ON m.i = d.i GROUP BY 1)
SELECT round(avg(n), 9) AS mean_nnz, round(stddev_samp(n), 9) AS std_nnz, max(n) AS max_nnz, min(n) AS min_nnz FROM n""",
    ),
    "row_lengths_every_row": Query(
        lambda t: row_lengths(t.document_label, every_row=True),
        f"""SELECT d.i AS i, count(m.i) AS nnz FROM (SELECT unnest(range(0, (SELECT count(*) FROM documents))) AS i) d
LEFT JOIN ({sql.DOCUMENT_LABEL}) m ON m.i = d.i GROUP BY 1""",
    ),
    "longest_row": Query(
        lambda t: row_lengths(t.order_part).orderBy(F.desc("nnz"), "i").limit(1),
        f"SELECT i, count(*) AS nnz FROM ({sql.ORDER_PART}) GROUP BY 1 ORDER BY nnz DESC, i LIMIT 1",
    ),
    "sparsity": Query(
        lambda t: _rounded(st.sparsity(t.order_part), {"sparsity_pct"}),
        f"""SELECT rows, cols, nnz, round((1.0::DOUBLE - CAST(nnz AS DOUBLE) / (CAST(rows AS DOUBLE) * cols)) * 100, 9) AS sparsity_pct
FROM (SELECT (SELECT count(*) FROM orders) AS rows, (SELECT count(*) FROM part) AS cols, count(*) AS nnz FROM ({sql.ORDER_PART}))""",
    ),
    "row_bins_hist": Query(
        lambda t: st.bin_histogram(_bins(t)),
        f"{BINS} SELECT CAST(bin AS BIGINT) AS bin, count(*) AS rows FROM b GROUP BY 1",
    ),
    "row_bins_positions": Query(
        lambda t: st.bin_positions(_bins(t), t.part_square.rows),
        f"""{BINS} SELECT i, CAST(bin AS BIGINT) AS bin, row_number() OVER (PARTITION BY bin ORDER BY i) - 1 AS pos,
  row_number() OVER (ORDER BY bin, i) - 1 AS slot FROM b""",
    ),
    "row_length_bins": Query(
        lambda t: row_lengths(t.supplier_part)
        .groupBy(doubling_bin(F.col("nnz"), 32, 16, 7).alias("bin"))
        .agg(F.count(F.lit(1)).alias("rows")),
        f"""SELECT CAST(CASE WHEN n <= 16 THEN 0 WHEN n <= 32 THEN 1 WHEN n <= 64 THEN 2 WHEN n <= 128 THEN 3
  WHEN n <= 256 THEN 4 WHEN n <= 512 THEN 5 ELSE 6 END AS BIGINT) AS bin, count(*) AS rows
FROM (SELECT i, count(*) AS n FROM ({sql.SUPPLIER_PART}) GROUP BY 1) GROUP BY 1""",
    ),
    "accumulator_choice": Query(
        lambda t: st.accumulator_choice(t.once("part_square"), t.once("part_square"), largest_table=1024, density_pct=45),
        f"""WITH {COUNTED}, g AS (SELECT i, nnz, products, least(products, p) AS bound,
    least(p - first_col, CASE WHEN last_col = first_col THEN 1
      ELSE CAST(2 ** (floor(log2(last_col - first_col)) + 1) AS BIGINT) END) AS reach
  FROM f, (SELECT count(*) AS p FROM part))
SELECT i, nnz, products, CASE WHEN nnz = 1 THEN 'direct' WHEN bound >= 1024 OR bound * 100 > reach * 45 THEN 'dense'
  ELSE 'hash' END AS kind,
  CAST(CASE WHEN bound < 64 THEN 5 WHEN bound < 128 THEN 4 WHEN bound < 256 THEN 3 WHEN bound < 512 THEN 2
    WHEN bound < 1024 THEN 1 ELSE 0 END AS BIGINT) AS size_class FROM g""",
    ),
    "lorenz_curve": Query(
        lambda t: _curve(t)[1].select("value", "n", "rows_upto", "work_upto"),
        f"{SORTED_WORK} SELECT value, n, rows_upto, work_upto FROM w",
    ),
    "lorenz_share": Query(
        _top_share,
        f"""WITH {COUNTED}, r AS (SELECT products, row_number() OVER (ORDER BY products DESC) AS place,
    count(*) OVER () AS m FROM f),
k AS (SELECT greatest(1, CAST(round_even(0.2 * max(m), 0) AS BIGINT)) AS k FROM r)
SELECT k AS rows_taken, round(sum(products) FILTER (WHERE place <= k) * 100.0::DOUBLE / sum(products), 9) AS share_pct
FROM r, k GROUP BY 1""",
    ),
    "matrix_features": Query(
        _product_features,
        f"SELECT n, nnz, maxrow, round(skew, 6) AS skew, round(flop, 6) AS flop FROM ({FEATURES})",
    ),
    "dispatch_score": Query(
        lambda t: dispatch.features(t.part_square).select(
            F.round(dispatch.score(), 9).alias("score"), dispatch.choice().alias("choice"),
            dispatch.threshold_choice().alias("by_threshold"),
        ),
        f"""SELECT round({score_sql(dispatch.CURRENT)}, 9) AS score,
  CASE WHEN {score_sql(dispatch.CURRENT)} < 0 THEN 'hash' ELSE 'merge3' END AS choice,
  CASE WHEN flop > 144000 THEN 'hash' ELSE 'merge3' END AS by_threshold FROM ({FEATURES})""",
    ),
    "dispatch_accuracy_cost": _evaluation(dispatch.CURRENT),
    "dispatch_accuracy_cost_earlier": _evaluation(dispatch.EARLIER),
    "dispatch_misclassified": Query(
        lambda t: dispatch.misclassified(timings(t)).select(
            "matrix", "choice", "winner", F.round("lost_ms", 6).alias("lost_ms")
        ),
        f"""SELECT matrix, choice, winner, round(paid_ms - best_ms, 6) AS lost_ms
FROM ({evaluated_sql(dispatch.CURRENT)}) WHERE choice <> winner""",
    ),
}
