"""Run a query in Spark and its SQL in DuckDB and compare whole results.

``python -m tests.oracle FOLDER [NAME …]`` prints one line per query.
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def kinds(df: pd.DataFrame) -> dict[str, str]:
    names = {"i": "whole", "u": "whole", "f": "real", "b": "bool", "O": "text", "M": "time"}
    return {c: names.get(df[c].dtype.kind, "text") for c in df.columns}


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns), kind="stable", na_position="last").reset_index(drop=True)


def problem(spark_rows: pd.DataFrame, sql_rows: pd.DataFrame) -> str | None:
    """What differs first, or None."""
    if sorted(spark_rows.columns) != sorted(sql_rows.columns):
        return f"columns {sorted(spark_rows.columns)} / {sorted(sql_rows.columns)}"
    if len(spark_rows) != len(sql_rows):
        return f"rows {len(spark_rows)} / {len(sql_rows)}"
    a, b = normal(spark_rows), normal(sql_rows)
    for c in a.columns:
        x, y = a[c], b[c]
        missing = x.isna().to_numpy()
        if (missing != y.isna().to_numpy()).any():
            return f"{c}: NULLs differ"
        same = missing | (x.to_numpy() == y.to_numpy())
        if not same.all():
            at = int(np.flatnonzero(~same)[0])
            return f"{c}: {int((~same).sum())} differ, first {a.loc[at].to_dict()} / {b.loc[at].to_dict()}"
    left, right = kinds(a), kinds(b)
    odd = {c: (left[c], right[c]) for c in left if left[c] != right[c] and not a[c].isna().any()}
    return f"types {odd}" if odd else None


def main() -> None:
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    import __spark_entry__ as entry
    from tripleloom.session import local_session

    folder, names = sys.argv[1], sys.argv[2:]
    spark, con = local_session(8), connect(sys.argv[1])
    oracles, bad = entry.oracle_sql(), 0
    for name, run in entry.queries().items():
        if names and name not in names:
            continue
        start = time.perf_counter()
        try:
            rows = run(spark, folder).toPandas()
            took = time.perf_counter() - start
            if name not in oracles:
                print(f"rows {name} {len(rows)} {took:.1f}s", flush=True)
                continue
            start = time.perf_counter()
            wanted = con.execute(oracles[name]).df()
            issue = problem(rows, wanted)
            print(f"{'BAD ' if issue else 'ok  '} {name} {len(rows)} {took:.1f}s sql {time.perf_counter() - start:.1f}s {issue or ''}", flush=True)
            bad += bool(issue)
        except Exception as error:  # noqa: BLE001
            bad += 1
            print(f"FAIL {name} {type(error).__name__} {str(error)[:600]}", flush=True)
    print(f"{bad} bad", flush=True)


if __name__ == "__main__":
    main()
