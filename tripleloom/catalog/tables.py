"""The driver tables as matrices, in Spark and in SQL side by side."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleloom.functions.scalar import looked_up
from tripleloom.matrix import Matrix

EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


class Tables:
    """Readers for one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._written: dict[str, Matrix] = {}

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def once(self, name: str) -> Matrix:
        """A derived matrix as a written table, for operators that scan it several times."""
        if name not in self._written:
            self._written[name] = getattr(self, name).materialized()
        return self._written[name]

    def rows(self, name: str) -> int:
        """Row count, answered from the file footers."""
        return self.read(name).count()

    # Square: customers by order numbers folded onto the customers.
    @cached_property
    def customer_square(self) -> Matrix:
        n = self.rows("customer")
        return Matrix.of(
            self.read("orders"), n, n, "o_custkey", F.col("o_orderkey") % n, F.floor("o_totalprice"), combine=True
        )

    # Square: parts by order numbers folded onto the parts, valued by quantity.
    @cached_property
    def part_square(self) -> Matrix:
        n = self.rows("part")
        return Matrix.of(
            self.read("lineitem"), n, n, "l_partkey", F.col("l_orderkey") % n, "l_quantity", combine=True
        )

    @cached_property
    def order_part(self) -> Matrix:
        return Matrix.of(
            self.read("lineitem"), self.rows("orders"), self.rows("part"),
            "l_orderkey", "l_partkey", "l_quantity", combine=True,
        )

    # The same without adding up repeated positions; sums over it come out equal.
    @cached_property
    def order_part_lines(self) -> Matrix:
        return Matrix.of(
            self.read("lineitem"), self.rows("orders"), self.rows("part"), "l_orderkey", "l_partkey", "l_quantity"
        )

    @cached_property
    def supplier_part(self) -> Matrix:
        return Matrix.of(
            self.read("lineitem"), self.rows("supplier"), self.rows("part"),
            "l_suppkey", "l_partkey", "l_quantity", combine=True,
        )

    @cached_property
    def supplier_part_lines(self) -> Matrix:
        return Matrix.of(
            self.read("lineitem"), self.rows("supplier"), self.rows("part"), "l_suppkey", "l_partkey", "l_quantity"
        )

    # Returns count against sales, so sums cancel.
    @cached_property
    def supplier_part_net(self) -> Matrix:
        sign = F.when(F.col("l_returnflag") == "R", -1.0).otherwise(1.0)
        return Matrix.of(
            self.read("lineitem"), self.rows("supplier"), self.rows("part"), "l_suppkey", "l_partkey", sign, combine=True
        )

    @cached_property
    def part_brand(self) -> Matrix:
        brand = F.regexp_extract("p_brand", r"(\d+)", 1).cast("long")
        brands = int(self.read("part").agg(F.max(brand)).first()[0] or 0) + 1
        return Matrix.of(self.read("part"), self.rows("part"), brands, "p_partkey", brand, F.lit(1.0))

    @cached_property
    def customer_order(self) -> Matrix:
        return Matrix.of(
            self.read("orders"), self.rows("customer"), self.rows("orders"), "o_custkey", "o_orderkey", F.lit(1.0)
        )

    # Customer nation by supplier nation, valued by line items; dense.
    @cached_property
    def nation_flow(self) -> Matrix:
        lines = self.read("lineitem").select("l_orderkey", "l_suppkey")
        flow = (
            lines.join(self.read("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
            .join(self.read("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
            .join(self.read("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        )
        n = self.rows("nation")
        return Matrix.of(flow, n, n, "c_nationkey", "s_nationkey", F.lit(1.0), combine=True)

    # Users by event type: five columns, each with a fifth of the events, and one for other types.
    @cached_property
    def user_event(self) -> Matrix:
        events = self.read("events")
        users = int(events.agg(F.max("user_id")).first()[0] or 0) + 1
        return Matrix.of(events, users, len(EVENT_TYPES) + 1, "user_id", event_code(), F.lit(1.0), combine=True)

    # Embedding components in whole thousandths, so sums are exact.
    @cached_property
    def embedded(self) -> Matrix:
        cells = self.read("embeddings").select("vec_id", F.posexplode("embedding").alias("p", "x"))
        width = int(self.read("embeddings").agg(F.max(F.size("embedding"))).first()[0] or 0)
        return Matrix.of(
            cells, self.rows("embeddings"), width, "vec_id", "p", F.floor(F.col("x").cast("double") * 1000.0)
        )

    # Documents by label; documents without labels are empty rows.
    @cached_property
    def document_label(self) -> Matrix:
        marks = self.read("labels").select(
            "doc_id", F.posexplode(F.array("quality", "toxic")).alias("label", "mark")
        )
        return Matrix.of(
            marks.where("mark <> 0"), self.rows("documents"), 2, "doc_id", "label", "mark"
        )


def event_code() -> Column:
    """The place of the type in the list; types beyond it share the next place."""
    known = looked_up(F.col("event_type"), {name: n for n, name in enumerate(EVENT_TYPES)})
    return F.coalesce(known, F.lit(len(EVENT_TYPES))).cast("long")


EVENT_CODE_SQL = "CASE event_type " + " ".join(f"WHEN '{t}' THEN {n}" for n, t in enumerate(EVENT_TYPES)) + f" ELSE {len(EVENT_TYPES)} END"

CUSTOMER_SQUARE = """
  SELECT o_custkey AS i, o_orderkey % (SELECT count(*) FROM customer) AS j, sum(floor(o_totalprice)) AS v
  FROM orders GROUP BY 1, 2"""
PART_SQUARE = """
  SELECT l_partkey AS i, l_orderkey % (SELECT count(*) FROM part) AS j, sum(l_quantity) AS v
  FROM lineitem GROUP BY 1, 2"""
ORDER_PART = "SELECT l_orderkey AS i, l_partkey AS j, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2"
SUPPLIER_PART = "SELECT l_suppkey AS i, l_partkey AS j, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2"
SUPPLIER_PART_NET = """
  SELECT l_suppkey AS i, l_partkey AS j, sum(CASE WHEN l_returnflag = 'R' THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END) AS v
  FROM lineitem GROUP BY 1, 2"""
PART_BRAND = """
  SELECT p_partkey AS i, CAST(regexp_extract(p_brand, '(\\d+)', 1) AS BIGINT) AS j, 1.0::DOUBLE AS v FROM part"""
CUSTOMER_ORDER = "SELECT o_custkey AS i, o_orderkey AS j, 1.0::DOUBLE AS v FROM orders"
NATION_FLOW = """
  SELECT CAST(c_nationkey AS BIGINT) AS i, CAST(s_nationkey AS BIGINT) AS j, CAST(count(*) AS DOUBLE) AS v
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2"""
USER_EVENT = f"""
  SELECT user_id AS i, CAST({EVENT_CODE_SQL} AS BIGINT) AS j, CAST(count(*) AS DOUBLE) AS v
  FROM events GROUP BY 1, 2"""
EMBEDDED = """
  SELECT vec_id AS i, CAST(p - 1 AS BIGINT) AS j, floor(CAST(embedding[p] AS DOUBLE) * 1000.0::DOUBLE) AS v
  FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS p FROM embeddings)"""
DOCUMENT_LABEL = """
  SELECT doc_id AS i, CAST(0 AS BIGINT) AS j, CAST(quality AS DOUBLE) AS v FROM labels WHERE quality <> 0
  UNION ALL SELECT doc_id, CAST(1 AS BIGINT), CAST(toxic AS DOUBLE) FROM labels WHERE toxic <> 0"""


def transposed(sql: str) -> str:
    return f"SELECT j AS i, i AS j, v FROM ({sql})"


def product(a: str, b: str, where: str = "TRUE") -> str:
    return f"""SELECT a.i AS i, b.j AS j, sum(a.v * b.v) AS v
FROM ({a}) a JOIN ({b}) b ON a.j = b.i WHERE {where} GROUP BY 1, 2"""
