"""Text sources, fed with lines that Spark makes from the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tripleloom.analytics import benchmarking as be
from tripleloom.catalog import Query
from tripleloom.catalog import tables as sql
from tripleloom.catalog.corpus import INDEX, index
from tripleloom.functions.scalar import looked_up
from tripleloom.matrix import Matrix
from tripleloom.session import shared_folder
from tripleloom.sources import index_pages, results, run_logs
from tripleloom.sources.binary_csr import read_binary_csr, write_csr_parts
from tripleloom.sources.cache import parse_once
from tripleloom.sources.matrix_market import Layout, formatted_lines, parse_entries, read_matrix_market, write_matrix_market

# Fixed values of these queries: event types as phases and as profile lines.
PHASE_OF = {"click": "count", "view": "expand", "purchase": "sort", "signup": "reduce", "error": "pack"}
PROFILE_OF = {"click": "accumulate", "view": "binning", "purchase": "compact+sort", "signup": "h2d", "error": "TOTAL(GPU)"}


def _named(names: dict[str, str]):
    return looked_up(F.col("event_type"), names)


def _named_sql(names: dict[str, str]) -> str:
    return "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + " END"


def _events(t):
    """Events with their run (user), place in the log and milliseconds since the first day."""
    millis = F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts)")
    return t.read("events").select(
        F.col("user_id").cast("string").alias("run"),
        F.struct(F.floor(F.col("event_id") / 1000).alias("block"), F.col("event_id").alias("line")).alias("at"),
        "event_id", "event_type", "value", millis.alias("ms"),
    )


def mark_lines(t):
    tag = F.when(F.col("event_id") % 2 == 0, "gust").otherwise("mrg3")
    text = F.concat(
        F.lit("[dbg "), F.lpad(F.col("ms").cast("string"), 14, " "), F.lit(" ms] ["), tag, F.lit("] "), _named(PHASE_OF)
    )
    return _events(t).select("run", "at", text.alias("value"))


def profile_lines(t):
    text = F.concat(
        F.lit("[dbg 1.000 ms] [hash-prof] "), F.rpad(_named(PROFILE_OF), 18, " "), F.col("value").cast("string"), F.lit(" ms")
    )
    return _events(t).select("run", "at", text.alias("value"))


def fact_lines(t):
    kind = F.col("event_type")
    number = F.col("event_id")
    grouped = F.format_number(number * 1000 + 7, 0)
    text = (
        F.when(kind == "click", F.concat(F.lit("Time:  "), F.col("value").cast("string"), F.lit(" ms")))
        .when(kind == "view", F.concat(F.lit("Input A: "), number.cast("string"), F.lit(" x "), number.cast("string"), F.lit(", nnz = "), grouped, F.lit(", sparsity = 1%")))
        .when(kind == "purchase", F.concat(F.lit("Result C: 5 x 5, nnz = "), grouped, F.lit(", sparsity = 1%")))
        .when(kind == "signup", F.concat(F.lit("[adapt] n="), number.cast("string"), F.lit(" maxrow=1 skew=1.0 → "), F.when(number % 3 == 0, "hash").otherwise("merge3"), F.lit(" (score=0.1)")))
        .otherwise(F.lit("[adapt] hash overflow → fallback merge3"))
    )
    return _events(t).select("run", "at", text.alias("value"))


def _durations(t):
    return be.phase_durations(run_logs.last_per_phase(run_logs.marks(mark_lines(t))))


MILLIS = "CAST(epoch_us(ts) // 1000 - 1704067200000 AS DOUBLE)"
MARKS = f"""SELECT CAST(user_id AS VARCHAR) AS run, event_id, CASE WHEN event_id % 2 = 0 THEN 'gust' ELSE 'mrg3' END AS tag,
  {_named_sql(PHASE_OF)} AS phase, {MILLIS} AS ms FROM events"""
LAST = f"SELECT run, tag, phase, arg_max(ms, event_id) AS ms FROM ({MARKS}) GROUP BY 1, 2, 3"
DURATIONS = f"""SELECT run, tag, phase, ms - before AS ms FROM (
  SELECT *, lag(ms) OVER (PARTITION BY run, tag ORDER BY ms, phase) AS before FROM ({LAST})) WHERE before IS NOT NULL"""
PROFILE = f"""SELECT CAST(user_id AS VARCHAR) AS run, event_id, {_named_sql(PROFILE_OF)} AS phase, value AS ms FROM events"""
GROUP_SQL = "CASE phase " + " ".join(f"WHEN '{p}' THEN '{g}'" for p, g in be.PHASE_GROUPS.items()) + " END"


def _index_pages(t):
    """The corpus index as HTML pages, one table per matrix, and its rows parsed back."""
    cells = [
        F.col("id").cast("string"),
        F.concat(F.lit('<a href="/m/'), F.col("id").cast("string"), F.lit('">'), F.col("name"), F.lit(" &amp; co</a>")),
        F.col("group"),
        *[F.format_number(c, 0) for c in ("rows", "cols", "nnz")],
        F.col("kind"), F.col("date"),
    ]
    row = F.concat(F.lit("<tr>"), *[x for c in cells for x in (F.lit("<td> "), c, F.lit("</td>\n"))], F.lit("</tr>"))
    heading = F.lit("<table><tr><th>ID</th><th>Name</th></tr><tr><td>none</td></tr>")
    pages = index(t).select(F.concat(heading, row, F.lit("</table>")).alias("html"))
    return index_pages.parse_index(pages)


def _run_documents(t):
    """Run documents made of line items, read back through the declared schema."""
    timing = F.struct(
        F.struct(F.col("l_quantity").alias("product_calc"), F.lit(1.5).alias("reduce")).alias("analysis"),
        F.struct(F.col("l_linenumber").cast("double").alias("hll_merge"), F.lit(9.0).alias("binning")).alias("estimation"),
        F.struct((F.col("l_quantity") * 2).alias("hash"), F.lit(3.0).alias("unlisted")).alias("numeric"),
        F.lit(0.25).alias("prologue"),
    )
    lines = t.read("lineitem").select("l_orderkey", F.to_json(F.struct(timing.alias("timing"))).alias("doc"))
    parsed = lines.select("l_orderkey", F.from_json("doc", results.run_schema()).alias("run"))
    return parsed.groupBy("l_orderkey").agg(F.sum(results.compute_ms("run.timing")).alias("ms"))


def _mm_lines(t, pattern: bool):
    m = t.order_part
    lines = formatted_lines(m).select("value")
    if pattern:
        lines = lines.select(F.regexp_replace("value", r"\s+\S+$", "").alias("value"))
    comments = lines.select(F.concat(F.lit("% "), "value").alias("value"))
    return parse_entries(lines.unionByName(comments), m.rows, m.cols, Layout(pattern, 0)).entries


def _labels(t):
    return t.read("labels").select("doc_id", F.col("quality").cast("long").alias("quality"))


def _refreshed(t):
    fresh = t.read("labels").where("toxic = 1").select("doc_id", F.lit(9).cast("long").alias("quality"))
    return results.refreshed(_labels(t), "quality", fresh, "doc_id")


def _repeated(t, where: str, prefix: str):
    """Index rows, each twice under two names of which the smaller one counts."""
    names = F.explode(F.array(F.concat(F.lit(f"{prefix}-"), "name"), F.concat(F.lit(f"{prefix}~"), "name"))).alias("name")
    return index(t).where(where).select("id", names)


def _folder(t, name: str) -> str:
    return f"{shared_folder(t.spark)}/files-{uuid.uuid4().hex}/{name}"


def _matrix_file(t):
    path = _folder(t, "matrix")
    write_matrix_market(t.order_part, path)
    return path


def _symmetric_file(t):
    path, m = _folder(t, "symmetric"), t.customer_square
    write_matrix_market(Matrix(m.entries.where("j <= i"), m.rows, m.cols), path, "symmetric")
    return read_matrix_market(t.spark, path).entries


def _cached_file(t):
    path = _matrix_file(t)
    cache = _folder(t, "cache")
    for _ in range(2):
        found = parse_once(t.spark, path, cache)
    return found.entries


def _log_files(t):
    """Marks of log files in four folders, by tag and phase."""
    path = _folder(t, "logs")
    mark_lines(t).select("value", (F.col("run").cast("long") % 4).alias("folder")).write.partitionBy("folder").text(path)
    found = run_logs.marks(run_logs.read_logs(t.spark, path))
    return found.groupBy("tag", "phase").agg(F.count(F.lit(1)).alias("n"), F.sum("ms").alias("ms"))


def over_allocation_lines(t):
    """A line per order and return flag: the lines' number as the result size, their quantity as the estimate."""
    rows = t.read("lineitem").where("l_returnflag <> 'N'").groupBy("l_orderkey", "l_returnflag").agg(
        F.count(F.lit(1)).alias("c"), F.sum("l_quantity").cast("long").alias("e"), F.sum("l_linenumber").alias("ms")
    )
    text = F.format_string("[dbg 1.0 ms] [hash] C_nnz=%d (est=%d, %.2fx over-alloc)", "c", "e", F.col("e") / F.col("c"))
    return rows.select(F.col("l_orderkey").alias("run"), "l_returnflag", F.col("ms").cast("double").alias("ms"), F.lit(0).alias("at"), text.alias("value"))


def _sketch_comparison(t):
    lines = over_allocation_lines(t)
    found = [
        run_logs.over_allocations(part).join(part.select("run", "ms"), "run").select("run", "ms", F.round(F.col("est") / F.col("c_nnz"), 6).alias("factor"))
        for part in (lines.where("l_returnflag = 'A'"), lines.where("l_returnflag = 'R'"))
    ]
    return run_logs.sketch_comparison(*found).withColumn("ratio", F.round("ratio", 9))


def span_lines(t):
    """Marks of five events per run: every third one is a done mark, and the purchases' begin is a ``writing``."""
    closing = F.col("event_id") % 3 == 0
    word = F.when(closing, F.lit("done")).when(F.col("event_type") == "purchase", F.lit("writing")).when(F.col("event_id") % 3 == 1, F.lit("begin")).otherwise(F.lit("start"))
    event = F.when(F.col("event_type") == "purchase", F.when(closing, F.lit("T1 write")).otherwise(F.lit("T1"))).otherwise(F.concat(F.lit("step: "), "event_type"))
    text = F.concat(F.lit("[dbg "), F.col("ms").cast("string"), F.lit(" ms] "), event, F.lit(" "), word, F.when(closing, F.concat(F.lit(" buf="), F.col("event_id").cast("string"))).otherwise(F.lit("")))
    return _events(t).select("run", "at", text.alias("value"))


def other_tool_lines(t):
    kind, number = F.col("event_type"), F.col("event_id")
    text = (
        F.when(kind == "click", F.concat(F.lit("   total   "), F.col("value").cast("string"), F.lit("ms")))
        .when(kind == "view", F.concat(F.lit("C.nnz="), number.cast("string")))
        .when(kind == "purchase", F.concat(F.lit("Kernel time:  "), F.col("value").cast("string"), F.lit(" ms")))
        .otherwise(F.lit("no total 5ms here"))
    )
    return _events(t).select("run", "at", text.alias("value"))


def _spans(t):
    return run_logs.spans(run_logs.span_marks(span_lines(t))).select("run", "event", "begin_ms", "done_ms", "ms", "state", "detail")


def _dialect_file(t, heading: str, lines):
    """A file with this banner over lines ``(i, j, value)`` of the square customer matrix."""
    m, path = t.customer_square, _folder(t, "dialect")
    rows = lines(formatted_lines(Matrix(m.entries.where("j <= i"), m.rows, m.cols)))
    n = rows.count()
    first = t.spark.createDataFrame([(-1, 0, heading), (-1, 1, f"{m.rows} {m.cols} {n}")], "i long, j long, value string")
    rows.select("i", "j", "value").unionByName(first).orderBy("i", "j").select("value").write.text(path)
    return path


def _core(t):
    return read_matrix_market(t.spark, _dialect_file(t, "%%MatrixMarket matrix coordinate real skew-symmetric", lambda x: x), "core").entries


def _lenient(t):
    bare = F.when(F.col("i") % 2 == 0, F.concat_ws(" ", F.col("i") + 1, F.col("j") + 1)).otherwise(F.col("value"))
    path = _dialect_file(t, "%%MatrixMarket matrix whatever", lambda x: x.withColumn("value", bare))
    return read_matrix_market(t.spark, path, "lenient").entries


def _strict(t):
    return read_matrix_market(t.spark, _dialect_file(t, "%%MatrixMarket matrix coordinate complex Hermitian", lambda x: x.withColumn("value", F.concat("value", F.lit(" 0.5")))), "strict").entries


def _binary_file(t):
    path = _folder(t, "binary")
    write_csr_parts(t.once("customer_square"), path, part_entries=2_000)
    return read_binary_csr(t.spark, path).entries


TRIANGLE = f"SELECT i, j, {{}} AS v FROM ({sql.CUSTOMER_SQUARE}) WHERE j <= i"
MIRRORED = "WITH m AS ({}) SELECT * FROM m UNION ALL SELECT j AS i, i AS j, v FROM m WHERE j < i"
SPANS = f"""WITH m AS (SELECT CAST(user_id AS VARCHAR) AS run, event_id, event_id % 3 <> 0 AS opens, {MILLIS} AS ms,
  CASE event_type WHEN 'purchase' THEN 'T1 write' ELSE 'step: ' || event_type END AS event FROM events),
n AS (SELECT *, lead(opens) OVER w AS next_opens, lag(opens) OVER w AS last_opens, lead(ms) OVER w AS next_ms, lead(event_id) OVER w AS next_id
  FROM m WINDOW w AS (PARTITION BY run, event ORDER BY event_id)),
s AS (SELECT *, CASE WHEN opens AND NOT coalesce(next_opens, TRUE) THEN 'closed' WHEN NOT opens THEN 'stray' ELSE 'open' END AS state
  FROM n WHERE opens OR NOT coalesce(last_opens, FALSE))
SELECT run, event, CASE WHEN opens THEN ms END AS begin_ms, CASE state WHEN 'closed' THEN next_ms WHEN 'stray' THEN ms END AS done_ms,
  CASE state WHEN 'closed' THEN next_ms - ms END AS ms, state, CASE state WHEN 'closed' THEN 'buf=' || next_id WHEN 'stray' THEN 'buf=' || event_id END AS detail
FROM s"""

SKETCH_SIDE = """SELECT l_orderkey AS run, CAST(sum(l_linenumber) AS DOUBLE) AS ms,
  round(CAST(sum(l_quantity) AS BIGINT) / count(*)::DOUBLE, 6) AS factor FROM lineitem WHERE l_returnflag = '{}' GROUP BY 1"""

QUERIES = {
    "matrix_market_lines": Query(lambda t: _mm_lines(t, False), sql.ORDER_PART),
    "matrix_market_pattern": Query(
        lambda t: _mm_lines(t, True), f"SELECT i, j, 1.0::DOUBLE AS v FROM ({sql.ORDER_PART})"
    ),
    "log_marks": Query(
        lambda t: run_logs.marks(mark_lines(t)).select("run", F.col("at.line").alias("event_id"), "tag", "phase", "ms"),
        MARKS,
    ),
    "log_last_per_phase": Query(lambda t: run_logs.last_per_phase(run_logs.marks(mark_lines(t))), LAST),
    "phase_durations": Query(_durations, DURATIONS),
    "phase_compute_only": Query(
        lambda t: be.compute_only(_durations(t)), f"SELECT run, tag, sum(ms) AS ms FROM ({DURATIONS}) GROUP BY 1, 2"
    ),
    "phase_table": Query(
        lambda t: be.phase_table(_durations(t), tuple(PHASE_OF.values())),
        "SELECT run, tag, "
        + ", ".join(f"max(ms) FILTER (WHERE phase = '{p}') AS {p}" for p in PHASE_OF.values())
        + f" FROM ({DURATIONS}) GROUP BY 1, 2",
    ),
    "phase_group_means": Query(
        lambda t: be.phase_group_means(_durations(t)).withColumn("ms", F.round("ms", 4)),
        f"""SELECT tag, g AS "group", round(sum(ms) / any_value(m), 4) AS ms
FROM (SELECT tag, {GROUP_SQL} AS g, ms FROM ({DURATIONS}))
JOIN (SELECT tag, count(DISTINCT run) AS m FROM ({DURATIONS}) GROUP BY 1) USING (tag) GROUP BY 1, 2""",
    ),
    "profile_compute_only": Query(
        lambda t: be.profile_compute_only(run_logs.last_per_phase(run_logs.profile(profile_lines(t)))).withColumn(
            "ms", F.round("ms", 6)
        ),
        f"""WITH l AS (SELECT run, phase, arg_max(ms, event_id) AS ms FROM ({PROFILE}) GROUP BY 1, 2)
SELECT run, 'hash-prof' AS tag, round(coalesce(max(ms) FILTER (WHERE phase = 'TOTAL(GPU)') - coalesce(sum(ms) FILTER (WHERE phase = 'h2d'), 0),
  sum(ms) FILTER (WHERE phase NOT IN ('h2d', 'TOTAL(GPU)'))), 6) AS ms FROM l GROUP BY 1""",
    ),
    "profile_block_medians": Query(
        lambda t: be.block_medians(be.profile_blocks(run_logs.profile(profile_lines(t)))).withColumn(
            "median", F.round("median", 6)
        ),
        f"""WITH b AS (SELECT run, phase, ms, coalesce(sum(CASE WHEN phase = 'TOTAL(GPU)' THEN 1 ELSE 0 END) OVER (
    PARTITION BY run ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS block FROM ({PROFILE})),
s AS (SELECT run, block, phase, sum(ms) AS ms FROM b WHERE phase NOT IN ('h2d', 'd2h', 'TOTAL(GPU)') GROUP BY 1, 2, 3)
SELECT run, phase, round(median(ms), 6) AS median FROM s GROUP BY 1, 2""",
    ),
    "log_run_summary": Query(
        lambda t: run_logs.run_summary(fact_lines(t)),
        """SELECT CAST(user_id AS VARCHAR) AS run, arg_max(event_id, event_id) FILTER (WHERE event_type = 'view') AS n,
  max(event_id * 1000 + 7) FILTER (WHERE event_type = 'view') AS a_nnz,
  arg_max(value, event_id) FILTER (WHERE event_type = 'click') AS time_ms,
  max(event_id * 1000 + 7) FILTER (WHERE event_type = 'purchase') AS c_nnz,
  arg_max(CASE WHEN event_type = 'error' THEN 'merge3 (fallback)' WHEN event_id % 3 = 0 THEN 'hash' ELSE 'merge3' END,
    event_id) FILTER (WHERE event_type IN ('signup', 'error')) AS choice FROM events GROUP BY 1""",
    ),
    "index_pages": Query(
        _index_pages,
        f"""SELECT CAST(id AS INTEGER) AS id, name || ' & co' AS name, "group", rows, cols, nnz, kind, date,
  '/m/' || CAST(id AS VARCHAR) AS detail_url FROM ({INDEX})""",
    ),
    "run_documents": Query(
        _run_documents,
        """SELECT l_orderkey, sum(l_quantity + 1.5::DOUBLE + l_linenumber + l_quantity * 2 + 3.0::DOUBLE + 0.25::DOUBLE) AS ms
FROM lineitem GROUP BY 1""",
    ),
    "resume_antijoin": Query(
        lambda t: results.pending(t.read("documents").select("doc_id", "lang"), t.read("labels"), "doc_id"),
        "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    ),
    "left_join_baseline": Query(
        lambda t: results.with_baseline(t.read("documents").select("doc_id", "n_chars"), _labels(t), "quality", "doc_id"),
        """SELECT d.doc_id AS doc_id, n_chars, CAST(quality AS BIGINT) AS quality
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    ),
    "refresh_column": Query(
        _refreshed,
        "SELECT doc_id, CASE WHEN toxic = 1 THEN 9 ELSE CAST(quality AS BIGINT) END AS quality FROM labels",
    ),
    "index_page_union": Query(
        lambda t: index_pages.merged_pages(
            _repeated(t, "kind <> 'PROMO'", "first"), _repeated(t, "true", "later")
        ),
        f"""SELECT id, CASE WHEN kind <> 'PROMO' THEN 'first-' ELSE 'later-' END || name AS name FROM ({INDEX})""",
    ),
    "matrix_market_file": Query(lambda t: read_matrix_market(t.spark, _matrix_file(t)).entries, sql.ORDER_PART),
    "matrix_market_symmetric": Query(
        _symmetric_file,
        f"""WITH m AS ({sql.CUSTOMER_SQUARE}) SELECT i, j, v FROM m WHERE j <= i
UNION ALL SELECT j AS i, i AS j, v FROM m WHERE j < i""",
    ),
    "matrix_market_core": Query(_core, MIRRORED.format(TRIANGLE.format("v"))),
    "matrix_market_lenient": Query(_lenient, MIRRORED.format(TRIANGLE.format("CASE WHEN i % 2 = 0 THEN 1.0::DOUBLE ELSE v END"))),
    "matrix_market_strict": Query(_strict, MIRRORED.format(TRIANGLE.format("v"))),
    "binary_csr_file": Query(_binary_file, sql.CUSTOMER_SQUARE),
    "log_spans": Query(_spans, SPANS),
    "other_tool_results": Query(
        lambda t: run_logs.other_tools(other_tool_lines(t)),
        """SELECT CAST(user_id AS VARCHAR) AS run, arg_min(value, event_id) FILTER (event_type = 'click') AS total_ms,
  min(event_id) FILTER (event_type = 'view') AS c_nnz, arg_min(value, event_id) FILTER (event_type = 'purchase') AS kernel_ms
FROM events WHERE event_type IN ('click', 'view', 'purchase') GROUP BY 1""",
    ),
    "matrix_cache": Query(_cached_file, sql.ORDER_PART),
    "log_files": Query(
        _log_files,
        f"""SELECT CASE WHEN event_id % 2 = 0 THEN 'gust' ELSE 'mrg3' END AS tag, {_named_sql(PHASE_OF)} AS phase, count(*) AS n,
  CAST(sum(date_diff('millisecond', TIMESTAMP '2024-01-01 00:00:00', ts)) AS DOUBLE) AS ms FROM events GROUP BY 1, 2""",
    ),
    "log_methods": Query(
        lambda t: run_logs.method_results(fact_lines(t)),
        """WITH f AS (SELECT CAST(user_id AS VARCHAR) AS run, event_type AS kind, event_id, value,
  row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1 AS place FROM events WHERE event_type IN ('click', 'purchase'))
SELECT run, place, max(value) FILTER (kind = 'click') AS time_ms,
  max(event_id * 1000 + 7) FILTER (kind = 'purchase') AS c_nnz FROM f GROUP BY 1, 2""",
    ),
    "sketch_comparison": Query(
        _sketch_comparison,
        f"""SELECT a.run AS run, a.ms AS ms, a.factor AS factor, r.ms AS other_ms, r.factor AS other_factor,
  round(r.ms / a.ms, 9) AS ratio, CASE WHEN r.ms / a.ms > 1.03 THEN 'first' WHEN r.ms / a.ms < 0.97 THEN 'other' ELSE 'near' END AS faster
FROM ({SKETCH_SIDE.format("A")}) a JOIN ({SKETCH_SIDE.format("R")}) r ON a.run = r.run""",
    ),
}
