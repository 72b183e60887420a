"""Parse a text matrix once, read Parquet afterwards."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tripleloom.matrix import ENTRY_SCHEMA, Matrix
from tripleloom.sources.matrix_market import read_matrix_market

SHAPE_SCHEMA = "rows long, cols long"
FINISHED_SCHEMA = "state string, folder string"


def write_parquet(m: Matrix, path: str, partitions: int | None = None) -> None:
    """Entries clustered by row range, for row-group pruning on ``i``; the shape is written last."""
    spark = m.entries.sparkSession
    arranged = m.entries.repartitionByRange(partitions, "i") if partitions else m.entries.repartitionByRange("i")
    arranged.sortWithinPartitions("i", "j").write.parquet(f"{path}/entries")
    spark.createDataFrame([(m.rows, m.cols)], SHAPE_SCHEMA).coalesce(1).write.parquet(f"{path}/shape")


def read_parquet(spark: SparkSession, path: str) -> Matrix:
    rows, cols = spark.read.schema(SHAPE_SCHEMA).parquet(f"{path}/shape").first()
    return Matrix(spark.read.schema(ENTRY_SCHEMA).parquet(f"{path}/entries"), rows, cols)


def parse_once(spark: SparkSession, text_path: str, cache_path: str, dialect: str = "standard") -> Matrix:
    """The cached matrix; made from the text where the cache has none of this dialect and file version.

    Every attempt writes to a folder of its own and adds one line to the list of
    finished ones last, so an attempt that breaks off leaves nothing in the way.
    """
    version = spark.read.text(text_path).select(
        F.max("_metadata.file_modification_time").cast("string"), F.sum("_metadata.file_size").cast("string")
    )
    state = "/".join([dialect, *(str(x) for x in version.first())])
    finished = f"{cache_path}/finished"
    try:
        found = spark.read.schema(FINISHED_SCHEMA).parquet(finished).where(F.col("state") == state).orderBy("folder").first()
    except AnalysisException:
        found = None
    if found is None:
        folder = f"{cache_path}/{uuid.uuid4().hex}"
        write_parquet(read_matrix_market(spark, text_path, dialect), folder)
        spark.createDataFrame([(state, folder)], FINISHED_SCHEMA).coalesce(1).write.mode("append").parquet(finished)
        return read_parquet(spark, folder)
    return read_parquet(spark, found["folder"])
