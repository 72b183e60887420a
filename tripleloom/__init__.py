"""Sparse-matrix analytics as DataFrame plans.

A matrix is a relation of ``(i, j, v)`` entries plus its shape.  Products are
joins with grouped sums, sketches are mergeable aggregates, offsets are
two-level scans; Spark partitions, shuffles and spills all of it.
"""

from tripleloom.matrix import Matrix
from tripleloom.operators.multiply import spgemm, outer_gram, inner_gram
from tripleloom.operators.spmv import spmv

__all__ = ["Matrix", "spgemm", "outer_gram", "inner_gram", "spmv"]
