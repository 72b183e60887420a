"""Structural transforms and comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripleloom.catalog import Query
from tripleloom.catalog import tables as sql
from tripleloom.functions.hashing import pack_key, unpack_col, unpack_row
from tripleloom.matrix import Matrix
from tripleloom.operators import diff
from tripleloom.operators import reshape as shape

SEGMENT = 256


def _text(c: str):
    return F.array_join(F.transform(c, lambda x: x.cast("long").cast("string")), ",")


def _row_view(t):
    return shape.row_form(t.order_part, SEGMENT).select(
        "i", "seg", _text("cols").alias("cols"), _text("vals").alias("vals")
    )


def _column_view(t):
    return shape.column_form(t.order_part, 4096).select(
        "j", "seg", _text("rows").alias("rows"), _text("vals").alias("vals")
    )


def _row_view_round_trip(t):
    m = t.order_part
    return shape.from_row_form(shape.row_form(m, SEGMENT), m.rows, m.cols).entries


def _sorted_check(t):
    rows = shape.row_form(t.order_part, SEGMENT)
    bad = shape.unsorted_rows(rows).withColumn("bad", F.lit(1))
    return rows.select("i", "seg").join(bad, ["i", "seg"], "left").agg(
        F.count(F.lit(1)).alias("segments"), F.count("bad").alias("unsorted")
    )


def _turned_check(t):
    """The columns of every seventh row the wrong way round, and a column twice in every eleventh."""
    rows = shape.row_form(t.order_part, SEGMENT)
    cols = F.when(F.col("i") % 7 == 0, F.reverse("cols")).when(F.col("i") % 11 == 0, F.concat("cols", F.slice("cols", -1, 1))).otherwise(F.col("cols"))
    rows = rows.withColumn("cols", cols)
    bad = shape.unsorted_rows(rows).withColumn("bad", F.lit(1))
    return rows.select("i", "seg").join(bad, ["i", "seg"], "left").agg(
        F.count(F.lit(1)).alias("segments"), F.count("bad").alias("unsorted")
    )


def _packed(t):
    key = pack_key(F.col("i"), F.col("j"))
    return t.order_part.entries.select(key.alias("key")).select(
        "key", unpack_row(F.col("key")).alias("i"), unpack_col(F.col("key")).alias("j")
    )


def _kept(t) -> Matrix:
    """Supplier by part without returned lines."""
    kept = t.read("lineitem").where("l_returnflag <> 'R'")
    m = t.supplier_part
    return Matrix.of(kept, m.rows, m.cols, "l_suppkey", "l_partkey", "l_quantity", combine=True)


KEPT = """SELECT l_suppkey AS i, l_partkey AS j, sum(l_quantity) AS v FROM lineitem
WHERE l_returnflag <> 'R' GROUP BY 1, 2"""
BOTH = f"""SELECT coalesce(x.i, y.i) AS i, coalesce(x.j, y.j) AS j, x.v AS e, y.v AS a
FROM ({sql.SUPPLIER_PART}) x FULL OUTER JOIN ({KEPT}) y ON x.i = y.i AND x.j = y.j"""
ROWS_LIST = """SELECT unnest(range(0, (SELECT count(*) FROM documents) + 1)) AS i"""

QUERIES = {
    "transpose": Query(lambda t: t.order_part.T.entries, sql.transposed(sql.ORDER_PART)),
    "symmetric_expand": Query(
        lambda t: shape.mirrored(shape.upper_triangle(t.customer_square)).entries,
        f"""WITH u AS (SELECT * FROM ({sql.CUSTOMER_SQUARE}) WHERE j >= i)
SELECT i, j, v FROM u UNION ALL SELECT j, i, v FROM u WHERE i <> j""",
    ),
    "skew_symmetric_expand": Query(
        lambda t: shape.mirrored(shape.upper_triangle(t.customer_square), -1.0).entries,
        f"""WITH u AS (SELECT * FROM ({sql.CUSTOMER_SQUARE}) WHERE j >= i)
SELECT i, j, v FROM u UNION ALL SELECT j, i, -v FROM u WHERE i <> j""",
    ),
    "csr_view": Query(
        _row_view,
        f"""SELECT i, j // {SEGMENT} AS seg, string_agg(CAST(j AS VARCHAR), ',' ORDER BY j) AS cols,
  string_agg(CAST(CAST(v AS BIGINT) AS VARCHAR), ',' ORDER BY j) AS vals
FROM ({sql.ORDER_PART}) GROUP BY 1, 2""",
    ),
    "csc_view": Query(
        _column_view,
        f"""SELECT j, i // 4096 AS seg, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) AS rows,
  string_agg(CAST(CAST(v AS BIGINT) AS VARCHAR), ',' ORDER BY i) AS vals
FROM ({sql.ORDER_PART}) GROUP BY 1, 2""",
    ),
    "csr_round_trip": Query(_row_view_round_trip, sql.ORDER_PART),
    "csr_row_ptr": Query(
        lambda t: shape.row_offsets(t.document_label),
        f"""WITH r AS ({ROWS_LIST}), c AS (SELECT i, count(*) AS n FROM ({sql.DOCUMENT_LABEL}) GROUP BY 1)
SELECT r.i AS i, coalesce(n, 0) AS nnz,
  CAST(coalesce(sum(coalesce(n, 0)) OVER (ORDER BY r.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS row_ptr
FROM r LEFT JOIN c ON r.i = c.i""",
    ),
    "csr_positions": Query(
        lambda t: shape.csr_positions(t.once("order_part")),
        f"""SELECT i, j, v, row_number() OVER (ORDER BY i, j) - 1 AS at FROM ({sql.ORDER_PART})""",
    ),
    "per_row_rank": Query(
        lambda t: shape.positions_in_row(t.once("supplier_part")).select("i", "j", "pos"),
        f"""SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY j) - 1 AS pos FROM ({sql.SUPPLIER_PART})""",
    ),
    "segment_lengths": Query(
        lambda t: shape.segment_lengths(t.supplier_part, SEGMENT),
        f"""SELECT i, j // {SEGMENT} AS seg, (j // {SEGMENT}) * {SEGMENT} AS first_col, count(*) AS nnz
FROM ({sql.SUPPLIER_PART}) GROUP BY 1, 2, 3""",
    ),
    "column_buckets": Query(
        lambda t: shape.bucketed_columns(t.supplier_part, 5).groupBy("b").agg(
            F.count(F.lit(1)).alias("n"), F.min("j").alias("lo"), F.max("j").alias("hi")
        ),
        f"""SELECT CAST(((j + 1) * 5 - 1) // (SELECT count(*) FROM part) AS BIGINT) AS b, count(*) AS n,
  min(j) AS lo, max(j) AS hi FROM ({sql.SUPPLIER_PART}) GROUP BY 1""",
    ),
    "densify": Query(
        lambda t: shape.densified(t.document_label),
        f"""SELECT d.i AS i, l.j AS j, coalesce(m.v, 0.0::DOUBLE) AS v
FROM (SELECT unnest(range(0, (SELECT count(*) FROM documents))) AS i) d
CROSS JOIN (SELECT unnest(range(0, 2)) AS j) l
LEFT JOIN ({sql.DOCUMENT_LABEL}) m ON m.i = d.i AND m.j = l.j""",
    ),
    "prune_eps": Query(
        lambda t: shape.pruned(t.supplier_part_net, 1e-12).entries,
        f"SELECT * FROM ({sql.SUPPLIER_PART_NET}) WHERE abs(v) > 1e-12",
    ),
    "packed_keys": Query(
        _packed, f"SELECT i * 4294967296 + j AS key, i, j FROM ({sql.ORDER_PART})"
    ),
    "single_precision": Query(
        lambda t: shape.as_single(Matrix(
            t.read("lineitem").groupBy(F.col("l_orderkey").alias("i"), F.col("l_partkey").alias("j")).agg(F.max("l_extendedprice").alias("v")),
            t.rows("orders"), t.rows("part"),
        )).entries,
        """SELECT l_orderkey AS i, l_partkey AS j, CAST(CAST(max(l_extendedprice) AS FLOAT) AS DOUBLE) AS v
FROM lineitem GROUP BY 1, 2""",
    ),
    "duplicates_summed": Query(
        lambda t: t.order_part_lines.combined().entries,
        sql.ORDER_PART,
    ),
    "sortedness_check": Query(
        _sorted_check,
        f"""SELECT count(*) AS segments, CAST(0 AS BIGINT) AS unsorted
FROM (SELECT DISTINCT i, j // {SEGMENT} AS seg FROM ({sql.ORDER_PART}))""",
    ),
    "sortedness_of_turned_rows": Query(
        _turned_check,
        f"""SELECT count(*) AS segments, count(*) FILTER (i % 7 = 0 AND n > 1 OR i % 7 <> 0 AND i % 11 = 0) AS unsorted
FROM (SELECT i, j // {SEGMENT} AS seg, count(*) AS n FROM ({sql.ORDER_PART}) GROUP BY 1, 2)""",
    ),
    "matrix_diff": Query(
        lambda t: diff.difference(t.supplier_part, _kept(t)),
        f"""SELECT count(*) FILTER (WHERE e IS NOT NULL AND a IS NOT NULL) AS common,
  count(*) FILTER (WHERE a IS NULL) AS only_expected, count(*) FILTER (WHERE e IS NULL) AS only_actual,
  max(abs(e - a)) AS max_abs_err, greatest(1.0::DOUBLE, max(greatest(abs(e), abs(coalesce(a, e))))) AS scale,
  max(abs(e - a)) / greatest(1.0::DOUBLE, max(greatest(abs(e), abs(coalesce(a, e))))) AS max_rel_err,
  false AS passed FROM ({BOTH})""",
    ),
    "matrix_equal": Query(
        lambda t: diff.difference(t.supplier_part, t.supplier_part_lines.T.T.combined()),
        f"""SELECT count(*) AS common, CAST(0 AS BIGINT) AS only_expected, CAST(0 AS BIGINT) AS only_actual,
  0.0::DOUBLE AS max_abs_err, greatest(1.0::DOUBLE, max(abs(v))) AS scale, 0.0::DOUBLE AS max_rel_err, true AS passed
FROM ({sql.SUPPLIER_PART})""",
    ),
    "matrix_mismatches": Query(
        lambda t: diff.mismatches(t.supplier_part, _kept(t)),
        f"""SELECT i, j, e, a FROM ({BOTH})
WHERE e IS NULL OR a IS NULL OR abs(e - a) > greatest(abs(e), abs(a)) * 1e-9""",
    ),
    "key_sets": Query(
        lambda t: diff.key_sets(t.supplier_part, _kept(t)).groupBy("side").agg(F.count(F.lit(1)).alias("n")),
        f"""SELECT CASE WHEN a IS NULL THEN 'expected' WHEN e IS NULL THEN 'actual' ELSE 'both' END AS side,
  count(*) AS n FROM ({BOTH}) GROUP BY 1""",
    ),
}
