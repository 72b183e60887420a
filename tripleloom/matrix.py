"""The matrix type: an entries DataFrame with a shape."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripleloom.session import written

ENTRY_SCHEMA = T.StructType(
    [
        T.StructField("i", T.LongType()),
        T.StructField("j", T.LongType()),
        T.StructField("v", T.DoubleType()),
    ]
)
VECTOR_SCHEMA = T.StructType([T.StructField("j", T.LongType()), T.StructField("x", T.DoubleType())])


class ShapeError(ValueError):
    """The shapes of the operands do not fit."""


@dataclass(frozen=True)
class Matrix:
    """``entries(i BIGINT, j BIGINT, v DOUBLE)``, zero-based, with ``rows`` and ``cols``.

    An absent entry is zero; a stored 0.0 is a stored entry.  The shape is not
    derivable from the entries, since rows and columns may be empty.
    """

    entries: DataFrame
    rows: int
    cols: int

    @staticmethod
    def of(df: DataFrame, rows: int, cols: int, i="i", j="j", v="v", combine: bool = False) -> "Matrix":
        """A matrix over columns (or column expressions) of ``df``; ``combine`` adds up repeated positions."""
        entries = df.select(
            _column(i).cast("long").alias("i"),
            _column(j).cast("long").alias("j"),
            _column(v).cast("double").alias("v"),
        )
        matrix = Matrix(entries, rows, cols)
        return matrix.combined() if combine else matrix

    @property
    def is_square(self) -> bool:
        return self.rows == self.cols

    @property
    def T(self) -> "Matrix":
        """The transpose: a swap of two columns, no shuffle."""
        return Matrix(
            self.entries.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"), self.cols, self.rows
        )

    def combined(self) -> "Matrix":
        """One entry per position; repeated positions are added."""
        return Matrix(self.entries.groupBy("i", "j").agg(F.sum("v").alias("v")), self.rows, self.cols)

    def sorted(self) -> DataFrame:
        """Entries in row-major order, as a range-partitioned global sort."""
        return self.entries.orderBy("i", "j")

    def materialized(self) -> "Matrix":
        """The same matrix over a written table, for inputs that several jobs scan."""
        return Matrix(written(self.entries), self.rows, self.cols)

    def nnz(self) -> int:
        return self.entries.count()

    def require_square(self) -> None:
        if not self.is_square:
            raise ShapeError(f"a square matrix is needed, got {self.rows} x {self.cols}")

    def require_inner(self, other: "Matrix") -> None:
        if self.cols != other.rows:
            raise ShapeError(
                f"inner sizes differ: {self.rows} x {self.cols} times {other.rows} x {other.cols}"
            )


def _column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c
