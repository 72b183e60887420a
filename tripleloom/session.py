"""Session set-up and the shared folder for written intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "20g") -> SparkSession:
    """A session for tests and single-machine benchmarks."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tripleloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where it is unset, a temporary one for local sessions.

    On a cluster an unset folder is an error: the driver's own folders are not seen by executors.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not is_local(spark):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (path or _temporary_folder()).rstrip("/")


def is_local(spark: SparkSession) -> bool:
    return bool(re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")))


@cache
def _temporary_folder() -> str:
    return tempfile.mkdtemp(prefix="tripleloom-")


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage by writing ``df`` as Parquet in the shared folder.

    The table survives the loss of executors, and every later reader sees the
    same rows, so use it for inputs that several jobs scan.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tripleloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _tables.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Tables that ``written`` has made in this process, and the names of those that a catalogue knows.
_tables: list[str] = []
_names: list[str] = []


def keep_until_cleared(path: str, name: str | None = None) -> None:
    """Let ``clear_written`` delete a folder, and the table of that name, that were made elsewhere."""
    _tables.append(path)
    if name:
        _names.append(name)


def clear_written(spark: SparkSession) -> int:
    """Delete the tables that ``written`` made; call it when no result that reads them is needed any more."""
    jvm = spark.sparkContext._jvm
    settings = spark.sparkContext._jsc.hadoopConfiguration()
    n = len(_tables)
    while _names:
        spark.sql(f"DROP TABLE IF EXISTS {_names.pop()}")
    while _tables:
        path = jvm.org.apache.hadoop.fs.Path(_tables.pop())
        path.getFileSystem(settings).delete(path, True)
    return n
