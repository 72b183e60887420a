import pytest

from tripleloom import session


class _Unset:
    """A session whose configuration names no folder."""

    def __init__(self, master):
        self.conf = {"spark.master": master}


def test_shared_folder_comes_from_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert session.shared_folder(spark) == named.rstrip("/")
    assert session.shared_folder(_Unset("local[4]")) == session.shared_folder(_Unset("local"))


def test_a_cluster_needs_a_shared_folder():
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session.shared_folder(_Unset(master))


def test_written_tables_can_be_deleted(spark):
    path = session.written(spark.range(3)).inputFiles()[0]
    assert session.clear_written(spark) >= 1
    with pytest.raises(Exception):
        spark.read.parquet(path)


def test_written_tables_keep_rows_and_schema(spark):
    df = spark.range(10).selectExpr("id", "cast(null as double) AS x")
    kept = session.written(df)
    assert kept.dtypes == df.dtypes and kept.count() == 10
