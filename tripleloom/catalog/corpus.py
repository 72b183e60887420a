"""The part table read as an index of matrices: classes, picks, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripleloom.analytics import corpus as co
from tripleloom.catalog import Query
from tripleloom.session import written

BASE_URL = "https://example.org"


def index(t):
    """``id, name, group, rows, cols, nnz, kind, date`` with one matrix per part."""
    lines = t.read("lineitem").groupBy("l_partkey").agg(
        F.count(F.lit(1)).alias("nnz"), F.min("l_shipdate").alias("first")
    )
    rows = F.col("p_size").cast("long") * 10
    return t.read("part").join(lines, F.col("p_partkey") == F.col("l_partkey")).select(
        F.col("p_partkey").alias("id"),
        F.concat("p_name", F.lit("-"), F.col("p_partkey").cast("string")).alias("name"),
        F.col("p_brand").alias("group"),
        rows.alias("rows"),
        F.when(F.col("p_type") == "PROMO", rows * 2).otherwise(rows).alias("cols"),
        "nnz",
        F.col("p_type").alias("kind"),
        F.date_format("first", "'since' yyyy-MM-dd").alias("date"),
    )


def enriched(t):
    return co.enriched(index(t), BASE_URL)


def classified(t):
    return co.classified(enriched(t))


INDEX = """SELECT p_partkey AS id, p_name || '-' || CAST(p_partkey AS VARCHAR) AS name, p_brand AS "group",
  CAST(p_size AS BIGINT) * 10 AS rows,
  CASE WHEN p_type = 'PROMO' THEN CAST(p_size AS BIGINT) * 20 ELSE CAST(p_size AS BIGINT) * 10 END AS cols,
  nnz, p_type AS kind, 'since ' || strftime(first, '%Y-%m-%d') AS date
FROM part JOIN (SELECT l_partkey, count(*) AS nnz, min(l_shipdate) AS first FROM lineitem GROUP BY 1) ON p_partkey = l_partkey"""
ENRICHED = f"""SELECT *, rows * cols AS num_entries, CAST(nnz AS DOUBLE) / (rows * cols) AS density,
  (1.0::DOUBLE - CAST(nnz AS DOUBLE) / (rows * cols)) * 100.0 AS sparsity_pct, CAST(nnz AS DOUBLE) / rows AS nnz_per_row,
  rows = cols AS is_square, CAST(substr(date, 7, 4) AS INTEGER) AS year,
  '{BASE_URL}/MM/' || "group" || '/' || name || '.tar.gz' AS url_mm FROM ({INDEX})"""
CLASSIFIED = f"""SELECT *, CASE WHEN density_pct >= 10 THEN 'Dense' WHEN density_pct >= 1 THEN 'Mildly sparse'
  WHEN density_pct >= 0.1 THEN 'Highly sparse' ELSE 'Extremely sparse' END AS class
FROM (SELECT *, density * 100.0 AS density_pct, rows AS n FROM ({ENRICHED}) WHERE is_square)"""
PICKS = f"""c AS ({CLASSIFIED}),
r AS (SELECT id, class, count(*) OVER (PARTITION BY class) AS m,
  row_number() OVER (PARTITION BY class ORDER BY nnz, id) - 1 AS by_size,
  row_number() OVER (PARTITION BY class ORDER BY density_pct, id) - 1 AS by_density FROM c),
p AS (SELECT DISTINCT class, id FROM r WHERE by_size IN (
    CAST(round_even(0.10::DOUBLE * (m - 1), 0) AS BIGINT), CAST(round_even(0.50::DOUBLE * (m - 1), 0) AS BIGINT),
    CAST(round_even(0.90::DOUBLE * (m - 1), 0) AS BIGINT))
  OR by_density IN (CAST(round_even(0.05::DOUBLE * (m - 1), 0) AS BIGINT), CAST(round_even(0.95::DOUBLE * (m - 1), 0) AS BIGINT)))"""
TARGET = 8


def _representatives(t):
    # Several counting passes read the corpus, so it is written once.
    corpus = written(classified(t))
    return co.representatives(corpus, t.rows("part"))


def _more(t):
    corpus = written(classified(t))
    chosen = written(co.representatives(corpus, t.rows("part")))
    return co.more_representatives(corpus, chosen, TARGET, t.rows("part"))


#: Limits that bind on the part index.
LIMITS = co.Limits((300, 40), (400, 60), fewest=5)


def _limited(t):
    return co.representatives(written(classified(t)), t.rows("part"), LIMITS)


def _united(t):
    corpus = written(classified(t))
    old = written(co.representatives(corpus, t.rows("part")))
    more = co.more_representatives(corpus, old, TARGET, t.rows("part"))
    local = t.read("part").where("p_size > 25").select(F.col("p_partkey").alias("id"))
    return co.all_representatives(old, more, local)


MORE = f"""WITH {PICKS},
h AS (SELECT class, count(*) AS have FROM p GROUP BY 1),
f AS (SELECT c.class, c.id, c.density_pct, {TARGET} - coalesce(have, 0) AS need,
  count(*) OVER (PARTITION BY c.class) AS m,
  row_number() OVER (PARTITION BY c.class ORDER BY density_pct, c.id) - 1 AS at
  FROM c LEFT JOIN h ON c.class = h.class WHERE (c.class, c.id) NOT IN (SELECT class, id FROM p)),
s AS (SELECT DISTINCT class, m, need, unnest(range(0, CAST(need AS BIGINT))) AS pick FROM f WHERE need > 0),
q AS (SELECT class, least(m - 1, greatest(0, CAST(round_even(
    (0.05::DOUBLE + coalesce((0.95::DOUBLE - 0.05::DOUBLE) / nullif(need - 1, 0), 0) * pick) * (m - 1), 0) AS BIGINT))) AS at FROM s)
SELECT DISTINCT f.class AS class, f.id AS id FROM f JOIN q ON f.class = q.class AND f.at = q.at"""

LIMITED = f"""x AS ({CLASSIFIED}),
t AS (SELECT class, count(*) FILTER (n <= {LIMITS.tight[0]} AND nnz <= {LIMITS.tight[1]}) AS tight FROM x GROUP BY 1),
c AS (SELECT x.* FROM x JOIN t ON x.class = t.class WHERE CASE WHEN tight >= {LIMITS.fewest}
  THEN n <= {LIMITS.tight[0]} AND nnz <= {LIMITS.tight[1]} ELSE n <= {LIMITS.loose[0]} AND nnz <= {LIMITS.loose[1]} END)"""

SUMMARY_COLUMNS = ("n", "nnz", "nnz_per_row", "sparsity_pct")


def _summary(t):
    return co.summary(written(classified(t)), SUMMARY_COLUMNS).select(
        "column", *[F.round(c, 6).alias(c) for c in ("least", "middle", "average", "greatest")]
    )


SUMMARY = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", round(CAST(min({c}) AS DOUBLE), 6) AS least, round(CAST(median({c}) AS DOUBLE), 6) AS middle,
  round(avg({c}), 6) AS average, round(CAST(max({c}) AS DOUBLE), 6) AS greatest FROM x"""
    for c in SUMMARY_COLUMNS
)
META = ("id", "name", "group", "rows", "cols", "nnz", "kind", "date", "nnz_per_row", "is_square", "url_mm")

QUERIES = {
    "corpus_enrich": Query(
        lambda t: enriched(t).select(
            *META, F.col("num_entries").cast("long").alias("num_entries"), F.round("density", 12).alias("density"),
            F.round("sparsity_pct", 9).alias("sparsity_pct"), F.col("year").cast("long").alias("year"),
        ),
        f"""SELECT {", ".join(f'"{c}"' for c in META)}, num_entries, round(density, 12) AS density,
  round(sparsity_pct, 9) AS sparsity_pct, CAST(year AS BIGINT) AS year FROM ({ENRICHED})""",
    ),
    "density_class": Query(
        lambda t: classified(t).select("id", "class"), f"SELECT id, class FROM ({CLASSIFIED})"
    ),
    "class_summary": Query(
        lambda t: co.class_summary(classified(t)).select(
            "class", "matrices", *[F.round(c, 9).alias(c) for c in ("lowest_pct", "highest_pct", "share_pct")]
        ),
        f"""SELECT class, count(*) AS matrices, round(min(density_pct), 9) AS lowest_pct,
  round(max(density_pct), 9) AS highest_pct, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 9) AS share_pct
FROM ({CLASSIFIED}) GROUP BY 1""",
    ),
    "stratified_picks": Query(
        lambda t: _representatives(t).select("class", "id", "nnz", F.round("density_pct", 9).alias("density_pct")),
        f"""WITH {PICKS} SELECT c.class AS class, c.id AS id, c.nnz AS nnz, round(c.density_pct, 9) AS density_pct
FROM c JOIN p ON c.class = p.class AND c.id = p.id""",
    ),
    "more_picks": Query(lambda t: _more(t).select("class", "id"), MORE),
    "limited_picks": Query(
        lambda t: _limited(t).select("class", "id"),
        f"""WITH {PICKS.replace(f"c AS ({CLASSIFIED})", LIMITED)} SELECT class, id FROM p""",
    ),
    "all_picks": Query(
        lambda t: _united(t).select("class", "id", "in_local_data"),
        f"""SELECT x.class AS class, x.id AS id, p_size > 25 AS in_local_data
FROM (WITH {PICKS} SELECT class, id FROM p UNION ({MORE})) x JOIN part ON p_partkey = x.id""",
    ),
    "top_k": Query(
        lambda t: co.largest(classified(t), "nnz").select("id", "name", "nnz"),
        f"SELECT id, name, nnz FROM ({CLASSIFIED}) ORDER BY nnz DESC, id LIMIT 5",
    ),
    "corpus_summary": Query(_summary, f"WITH x AS ({CLASSIFIED}) {SUMMARY}"),
    "density_geomean": Query(
        lambda t: co.typical_density(classified(t)).select(F.round("density_geomean", 9).alias("density_geomean")),
        f"SELECT round(exp(avg(ln(density))), 9) AS density_geomean FROM ({CLASSIFIED})",
    ),
    "log_histogram": Query(
        lambda t: co.log_histogram(index(t), "nnz").select(
            "bin", "n", F.round("bin_lo", 9).alias("bin_lo"), F.round("bin_hi", 9).alias("bin_hi")
        ),
        f"""WITH x AS (SELECT log10(nnz) AS x FROM ({INDEX}) WHERE nnz > 0),
e AS (SELECT min(x) AS lo, (max(x) - min(x)) / 60 AS w FROM x)
SELECT least(59, CAST(floor((x - lo) / w) AS BIGINT)) AS bin, count(*) AS n,
  round(lo + w * least(59, CAST(floor((x - lo) / w) AS BIGINT)), 9) AS bin_lo,
  round(lo + w * (least(59, CAST(floor((x - lo) / w) AS BIGINT)) + 1), 9) AS bin_hi
FROM x, e GROUP BY 1, 3, 4""",
    ),
}
