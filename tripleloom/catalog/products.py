"""Products of matrices and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripleloom.catalog import Query
from tripleloom.catalog import tables as sql
from tripleloom.operators import masked
from tripleloom.operators import multiply as mul
from tripleloom.operators.spmv import spmv, spmv_transposed, vector_diff
from tripleloom.operators.stored import store_factors, stored_product
from tripleloom.operators.tiles import tiled_product
from tripleloom.plans.dispatch import method_for
from tripleloom.session import written

SQUARE = sql.product(sql.CUSTOMER_SQUARE, sql.CUSTOMER_SQUARE)
CUSTOMER_PART = sql.product(sql.CUSTOMER_ORDER, sql.ORDER_PART)
UPPER = "b.j >= a.i"


def _split_budget(m) -> int:
    """A budget that every event type exceeds several times."""
    return max(1, m.rows * m.rows // 8)


def _square(method: str) -> Query:
    return Query(lambda t: mul.square_product(t.once("customer_square"), method=method).entries, SQUARE)


def _size_vector(t):
    return t.read("part").select(F.col("p_partkey").alias("j"), F.col("p_size").cast("double").alias("x"))


def _price_vector(t):
    return t.read("orders").select(F.col("o_orderkey").alias("j"), F.floor("o_totalprice").cast("double").alias("x"))


def _label_weights(t):
    return t.spark.range(2).select(F.col("id").alias("j"), (F.col("id") + 3).cast("double").alias("x"))


def _labelled_documents(t):
    return spmv(t.document_label, _label_weights(t))


def _row_totals(t):
    c = mul.square_product(t.once("part_square")).entries
    return c.groupBy("i").agg(F.count(F.lit(1)).alias("c_nnz"), F.sum("v").alias("c_sum"), F.max("v").alias("c_max"))


def _bucketed(t):
    return mul.bucketed_product(t.once("customer_square"), t.once("customer_square"), 5)


def _stored(t):
    m = t.once("customer_square")
    return stored_product(t.spark, store_factors(m, m), 5)


def _reuse(t):
    a, b = t.customer_order, t.once("order_part")
    return mul.numeric(mul.symbolic(a, b), a, b).entries


def _third(m):
    """A third of the positions of a structure."""
    return m.where("(i + j) % 3 = 0")


def _masked(t):
    a, b = t.customer_order, t.once("order_part")
    return mul.numeric(_third(mul.symbolic(a, b)), a, b).entries


def _by_plan(t):
    """A stored plan, with values that it was not made from."""
    a, b = t.once("customer_order"), t.once("order_part")
    an, bn = masked.numbered(a), masked.numbered(b)
    plan = written(masked.product_plan(mul.symbolic(a, b), a, b, (an, bn)))
    left = masked.entry_values(a, an).select("at", (F.col("v") + F.col("at") % 5).alias("v"))
    right = masked.entry_values(b, bn).select("at", (F.col("v") * 2 + F.col("at") % 3).alias("v"))
    return masked.planned_product(plan, left, right, a.rows, b.cols).entries


def _formula(t):
    m = t.once("customer_square")
    return mul.square_product(m, method=method_for(m)).entries


def _twice(t):
    """``A·(A·x)``, which the SQL computes as ``(A·A)·x``."""
    a = t.once("customer_square")
    x = t.spark.range(a.cols).select(F.col("id").alias("j"), (F.col("id") % 7 + 1).cast("double").alias("x"))
    once = spmv(a, x).select(F.col("i").alias("j"), F.col("y").alias("x"))
    return spmv(a, once)


def _vector_check(t):
    """Rows where ``A·(A·x)`` and ``(A·A)·x`` differ, and the rows compared."""
    a = t.once("customer_square")
    x = t.spark.range(a.cols).select(F.col("id").alias("j"), (F.col("id") % 7 + 1).cast("double").alias("x"))
    direct = spmv(mul.square_product(a), x)
    bad = vector_diff(_twice(t), direct).select("i", F.lit(1).alias("bad"))
    return direct.join(bad, "i", "left").agg(F.count(F.lit(1)).alias("compared"), F.count("bad").alias("differences"))


ORDER_SIZE = f"""SELECT a.i AS i, sum(a.v * p_size) AS y FROM ({sql.ORDER_PART}) a
JOIN part ON a.j = p_partkey GROUP BY 1"""

NUMBERED = "SELECT i, j, v, row_number() OVER (ORDER BY i, j) - 1 AS n FROM ({})"

QUERIES = {
    "spgemm_aa": _square("auto"),
    "spgemm_rowwise_order": _square("rowwise"),
    "spgemm_colwise_order": _square("columnwise"),
    "spgemm_outer_order": _square("outer"),
    "spgemm_inner_order": _square("inner"),
    "spgemm_merge_join": _square("merge"),
    "spgemm_broadcast": _square("broadcast"),
    "spgemm_by_formula": Query(_formula, SQUARE),
    "spgemm_bucketed_k5": Query(
        _bucketed,
        f"""SELECT i, j, CAST(((j + 1) * 5 - 1) // (SELECT count(*) FROM customer) AS BIGINT) AS b, v
FROM ({SQUARE})""",
    ),
    "spgemm_range_merge": Query(
        _stored,
        f"""SELECT i, j, CAST(((j + 1) * 5 - 1) // (SELECT count(*) FROM customer) AS BIGINT) AS b, v
FROM ({SQUARE})""",
    ),
    "dense_product_hot_index": Query(
        lambda t: tiled_product(t.once("user_event"), t.once("user_event").T, edge=16, side=3).entries,
        sql.product(sql.USER_EVENT, sql.transposed(sql.USER_EVENT)),
    ),
    "spgemm_sorted_output": Query(lambda t: mul.square_product(t.once("customer_square")).sorted(), SQUARE),
    "spgemm_row_totals": Query(
        _row_totals,
        f"""SELECT i, count(*) AS c_nnz, sum(v) AS c_sum, max(v) AS c_max
FROM ({sql.product(sql.PART_SQUARE, sql.PART_SQUARE)}) GROUP BY 1""",
    ),
    "spgemm_ab_rect": Query(lambda t: mul.spgemm(t.customer_order, t.once("order_part")).entries, CUSTOMER_PART),
    "spgemm_hot_keys_split": Query(
        lambda t: mul.outer_gram(
            t.once("user_event"), upper=False, method="outer", task_products=_split_budget(t.once("user_event"))
        ).entries,
        sql.product(sql.USER_EVENT, sql.transposed(sql.USER_EVENT)),
    ),
    "self_product_rect": Query(
        lambda t: mul.self_product(t.once("user_event")).entries,
        sql.product(sql.USER_EVENT, sql.transposed(sql.USER_EVENT)),
    ),
    "symbolic_row_lengths": Query(
        lambda t: mul.output_row_lengths(t.once("part_square"), t.once("part_square")),
        f"""SELECT i, count(*) AS c_nnz
FROM ({sql.product(sql.PART_SQUARE, sql.PART_SQUARE)}) GROUP BY 1""",
    ),
    "symbolic_long_rows": Query(
        lambda t: mul.output_row_lengths(t.once("supplier_part").T, t.once("supplier_part")),
        f"""SELECT a.i AS i, count(DISTINCT b.j) AS c_nnz
FROM ({sql.transposed(sql.SUPPLIER_PART)}) a JOIN ({sql.SUPPLIER_PART}) b ON a.j = b.i GROUP BY 1""",
    ),
    "numeric_on_known_structure": Query(_reuse, CUSTOMER_PART),
    "numeric_masked": Query(_masked, f"SELECT * FROM ({CUSTOMER_PART}) WHERE (i + j) % 3 = 0"),
    "numeric_by_plan": Query(
        _by_plan,
        sql.product(
            f"SELECT i, j, v + n % 5 AS v FROM ({NUMBERED.format(sql.CUSTOMER_ORDER)})",
            f"SELECT i, j, v * 2 + n % 3 AS v FROM ({NUMBERED.format(sql.ORDER_PART)})",
        ),
    ),
    "cancellation_kept": Query(
        lambda t: mul.spgemm(t.once("supplier_part_net"), t.part_brand).entries,
        sql.product(sql.SUPPLIER_PART_NET, sql.PART_BRAND),
    ),
    "aat_upper": Query(
        lambda t: mul.outer_gram(t.once("supplier_part")).entries,
        sql.product(sql.SUPPLIER_PART, sql.transposed(sql.SUPPLIER_PART), UPPER),
    ),
    "aat_full": Query(
        lambda t: mul.outer_gram(t.once("supplier_part"), upper=False).entries,
        sql.product(sql.SUPPLIER_PART, sql.transposed(sql.SUPPLIER_PART)),
    ),
    "aat_by_symmetry": Query(
        lambda t: mul.gram_by_symmetry(t.once("supplier_part")).entries,
        sql.product(sql.SUPPLIER_PART, sql.transposed(sql.SUPPLIER_PART)),
    ),
    "ata_upper": Query(
        lambda t: mul.inner_gram(t.once("order_part")).entries,
        sql.product(sql.transposed(sql.ORDER_PART), sql.ORDER_PART, UPPER),
    ),
    "ata_embeddings": Query(
        lambda t: mul.inner_gram(t.once("embedded")).entries,
        sql.product(sql.transposed(sql.EMBEDDED), sql.EMBEDDED, UPPER),
    ),
    "dense_product_tiles": Query(
        lambda t: tiled_product(t.once("embedded").T, t.once("embedded"), edge=64).entries,
        f"""SELECT * FROM ({sql.product(sql.transposed(sql.EMBEDDED), sql.EMBEDDED)}) WHERE abs(v) > 1e-30""",
    ),
    "dense_product_small": Query(
        lambda t: tiled_product(t.once("nation_flow"), t.once("nation_flow"), edge=8).entries,
        sql.product(sql.NATION_FLOW, sql.NATION_FLOW),
    ),
    "spmv": Query(lambda t: spmv(t.order_part_lines, _size_vector(t), all_rows=False), ORDER_SIZE),
    "spmv_every_row": Query(
        _labelled_documents,
        f"""SELECT d.i AS i, coalesce(y, 0.0::DOUBLE) AS y
FROM (SELECT unnest(range(0, (SELECT count(*) FROM documents))) AS i) d
LEFT JOIN (SELECT i, sum(v * (j + 3)) AS y FROM ({sql.DOCUMENT_LABEL}) GROUP BY 1) s ON d.i = s.i""",
    ),
    "spmv_transpose": Query(
        lambda t: spmv_transposed(t.order_part_lines, _price_vector(t), all_rows=False),
        f"""SELECT a.j AS i, sum(a.v * floor(o_totalprice)) AS y FROM ({sql.ORDER_PART}) a
JOIN orders ON a.i = o_orderkey GROUP BY 1""",
    ),
    "spmv_twice": Query(
        _twice,
        f"""SELECT d.i AS i, coalesce(y, 0.0::DOUBLE) AS y
FROM (SELECT unnest(range(0, (SELECT count(*) FROM customer))) AS i) d
LEFT JOIN (SELECT i, sum(v * (j % 7 + 1)) AS y FROM ({SQUARE}) GROUP BY 1) s ON d.i = s.i""",
    ),
    "vector_diff": Query(
        _vector_check, "SELECT count(*) AS compared, CAST(0 AS BIGINT) AS differences FROM customer"
    ),
}
