"""Named queries over the driver tables, each with the SQL that gives the same rows.

Every query reads whole tables.  ``sql`` is None where the result has no
reasonable SQL form (foreign sketches, iterative fits).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from tripleloom.catalog.tables import Tables


@dataclass(frozen=True)
class Query:
    run: Callable[[Tables], DataFrame]
    sql: str | None = None


def all_queries() -> dict[str, Query]:
    from tripleloom.catalog import benchmarks, corpus, estimates, products, sources, statistics, structure

    found: dict[str, Query] = {}
    for part in (products, structure, statistics, estimates, corpus, benchmarks, sources):
        found.update(part.QUERIES)
    return found
