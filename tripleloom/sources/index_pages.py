"""The corpus index: HTML tables of matrices to metadata rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Columns of the index table and entities that occur in it.
INDEX_CELLS = ("id", "name", "group", "rows", "cols", "nnz", "kind", "date")
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def _text(cell: Column) -> Column:
    """Text of a cell: tags removed, entities decoded, blanks collapsed."""
    plain = F.regexp_replace(cell, r"(?s)<[^>]*>", " ")
    for entity, character in ENTITIES:
        plain = F.replace(plain, F.lit(entity), F.lit(character))
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def parse_index(pages: DataFrame, html: str = "html") -> DataFrame:
    """Data rows of the index tables in ``pages``.

    Rows with fewer than eight cells or an id that is no number are headings
    or filler and drop out.  Thousands separators are removed.
    """
    rows = pages.select(F.explode(F.split(F.col(html), r"(?i)</tr\s*>")).alias("row"))
    cells = rows.select(F.regexp_extract_all("row", F.lit(r"(?is)<td[^>]*>(.*?)</td\s*>"), F.lit(1)).alias("cell"))
    wide = cells.where(F.size("cell") >= len(INDEX_CELLS))
    text = wide.select(
        *[_text(F.col("cell")[n]).alias(name) for n, name in enumerate(INDEX_CELLS)],
        F.regexp_extract(F.col("cell")[1], r"""(?i)<a[^>]*href\s*=\s*["']([^"']*)""", 1).alias("detail_url"),
    ).where(F.col("id").rlike(r"^\d+$"))
    count = lambda name: F.regexp_replace(name, ",", "").cast("long").alias(name)
    return text.select(
        F.col("id").cast("int").alias("id"), "name", "group", count("rows"), count("cols"), count("nnz"),
        "kind", "date", "detail_url",
    )


def merged_pages(first: DataFrame, later: DataFrame) -> DataFrame:
    """One row per id: of the first page set where it has the id, else of the later ones.

    Among repeats the smallest row counts, column by column.
    """
    columns = [c for c in first.columns if c != "id"]
    ranked = first.withColumn("__set", F.lit(0)).unionByName(later.withColumn("__set", F.lit(1)))
    best = F.min(F.struct("__set", *columns)).alias("__best")
    return ranked.groupBy("id").agg(best).select(*[F.col("id") if c == "id" else F.col(f"__best.{c}").alias(c) for c in first.columns])
