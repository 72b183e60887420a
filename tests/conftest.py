import numpy as np
import pytest

from tripleloom import Matrix
from tripleloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, memory="8g")
    yield session
    session.stop()


@pytest.fixture
def matrix(spark):
    """A matrix from a dense array; zeros are absent."""

    def build(array) -> Matrix:
        a = np.asarray(array, dtype=float)
        rows = [(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a))]
        return Matrix(spark.createDataFrame(rows, "i long, j long, v double"), *a.shape)

    return build


@pytest.fixture
def symmetric5(matrix):
    """The 5 x 5 sample: seven stored entries, nine when expanded."""
    a = np.diag([10.0, 20, 30, 40, 50])
    a[2, 0] = a[0, 2] = 1
    a[4, 2] = a[2, 4] = 2
    return matrix(a)


def cells(m) -> dict:
    found = {(r["i"], r["j"]): r["v"] for r in m.entries.collect()}
    assert len(found) == m.nnz()
    return found


def dense(m) -> np.ndarray:
    out = np.zeros((m.rows, m.cols))
    for (i, j), v in cells(m).items():
        out[i, j] = v
    return out
