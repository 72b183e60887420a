"""Size checks that stand before every broadcast hint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows of a few fixed-width columns; about 64 MB at 32 bytes a row.
BROADCAST_ROWS = 2_000_000
# Rows one task may sort for a window.
WINDOW_ROWS = 1_000_000


def has_at_most(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has no more than ``rows`` rows.

    A full count moves no rows; a limit would send its rows to one task.
    """
    return df.count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint where its counted size allows, else unchanged.

    Without the hint the join shuffles both sides, and adaptive execution
    splits its skewed partitions.
    """
    return F.broadcast(df) if has_at_most(df, rows) else df
