"""Follow a folder of run logs: finished files into a result table, or growing files into the last mark of every phase.

The engine keeps in its checkpoint which files were read, or how far; every folder has a checkpoint of its own.  A run is
named by its file's place below the folder.  A key that already has a result is left alone, so restarts and repeated
batches add nothing twice.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tripleloom.session import shared_folder
from tripleloom.sources.results import pending
from tripleloom.sources.run_logs import marks, run_of, run_summary

SUMMARY_SCHEMA = "run string, n long, a_nnz long, time_ms double, c_nnz long, choice string"


def checkpoint_of(spark: SparkSession, folder: str, name: str) -> str:
    """A checkpoint for this purpose and folder."""
    return f"{shared_folder(spark)}/{name}-{hashlib.sha256(folder.rstrip('/').encode()).hexdigest()[:16]}"


def follow_logs(spark: SparkSession, folder: str, results: str, name: str = "logs") -> StreamingQuery:
    """Start a query that adds one row per finished log below ``folder`` to the Parquet table ``results``.

    It handles what is there and stops; call it again for later files.  Every
    file must be complete when it appears.
    """
    meta = F.col("_metadata")
    lines = spark.readStream.option("recursiveFileLookup", "true").text(folder).select(
        run_of(folder).alias("run"), meta["file_block_start"].alias("block"), "value"
    )

    def add(batch: DataFrame, batch_id: int) -> None:
        at = F.struct("block", F.monotonically_increasing_id().alias("line"))
        found = run_summary(batch.select("run", at.alias("at"), "value"))
        done = stored_results(batch.sparkSession, results)
        pending(found, done, "run").write.mode("append").parquet(results)

    return (
        lines.writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint_of(spark, folder, name))
        .trigger(availableNow=True)
        .start()
    )


def stored_results(spark: SparkSession, results: str) -> DataFrame:
    """The result table, empty where nothing has been written yet."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(SUMMARY_SCHEMA).parquet(results)
    except AnalysisException:
        return spark.createDataFrame([], SUMMARY_SCHEMA)


# --- growing files ----------------------------------------------------------------

GROWING = "growing_logs"
LINE_SCHEMA = "run string, start long, value string"
PHASE_SCHEMA = "run string, tag string, phase string, ms double, start long"
#: Bytes of a file that one task reads.
SLICE_BYTES = 64 << 20


class _Part(InputPartition):
    def __init__(self, run: str, path: str, begin: int, end: int):
        self.run, self.path, self.begin, self.end = run, path, begin, end


class GrowingLogs(DataSource):
    """Lines of files that are appended to, as a stream ``(run, start, value)``; ``start`` is the line's first byte.

    The offset is the length of every file; each batch reads what was added since, in slices, by the tasks.  The folder must be on
    storage that the driver and all executors see under the same path.
    """

    @classmethod
    def name(cls) -> str:
        return GROWING

    def schema(self) -> str:
        return LINE_SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _GrowingReader(self.options["path"])


class _GrowingReader(DataSourceStreamReader):
    def __init__(self, folder: str):
        self.folder = folder

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """Length of each file, in whole lines."""
        found = {}
        for place, _, names in os.walk(self.folder):
            for name in names:
                if not name.startswith((".", "_")):
                    path = os.path.join(place, name)
                    found[os.path.relpath(path, self.folder)] = whole_lines(path)
        return found

    def partitions(self, start: dict, end: dict) -> list[_Part]:
        parts = []
        for name, length in sorted(end.items()):
            for at in range(start.get(name, 0), length, SLICE_BYTES):
                parts.append(_Part(os.path.splitext(name)[0], os.path.join(self.folder, name), at, min(length, at + SLICE_BYTES)))
        return parts

    def read(self, part: _Part) -> Iterator[tuple]:
        """The lines that begin in this slice."""
        with open(part.path, "rb") as f:
            at = part.begin
            if at:
                f.seek(at - 1)
                at = part.begin if f.read(1) == b"\n" else part.begin + len(f.readline())
            while at < part.end:
                line = f.readline()
                if not line:
                    break
                yield part.run, at, line.rstrip(b"\r\n").decode("utf-8", "replace")
                at += len(line)

    def commit(self, end: dict) -> None:
        pass


def whole_lines(path: str, step: int = 1 << 16) -> int:
    """Bytes up to the last line end."""
    with open(path, "rb") as f:
        end = f.seek(0, os.SEEK_END)
        while end > 0:
            begin = max(0, end - step)
            f.seek(begin)
            at = f.read(end - begin).rfind(b"\n")
            if at >= 0:
                return begin + at + 1
            end = begin
    return 0


def _latest(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The mark of a phase that stands last in its file, whatever order its lines come in."""
    start, ms = state.get if state.exists else (-1, 0.0)
    for frame in frames:
        at = frame["start"].idxmax()
        if frame.at[at, "start"] > start:
            start, ms = int(frame.at[at, "start"]), float(frame.at[at, "ms"])
    state.update((start, ms))
    yield pd.DataFrame({"run": [key[0]], "tag": [key[1]], "phase": [key[2]], "ms": [ms], "start": [start]})


def follow_marks(spark: SparkSession, folder: str, results: str, name: str = "marks") -> StreamingQuery:
    """Start a query that adds the last mark of every phase that changed to the Parquet table ``results``.

    State is one mark per run, tag and phase, so a file of any length may grow for any time.  The query handles
    what is there and stops; ``current_marks`` reads the table.
    """
    spark.dataSource.register(GrowingLogs)
    lines = spark.readStream.format(GROWING).load(folder)
    timed = marks(lines.withColumn("at", F.col("start"))).select("run", "tag", "phase", F.col("at").alias("start"), "ms")
    last = timed.groupBy("run", "tag", "phase").applyInPandasWithState(
        _latest, PHASE_SCHEMA, "start long, ms double", "update", GroupStateTimeout.NoTimeout
    )

    def add(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("append").parquet(results)

    return (
        last.writeStream.outputMode("update")
        .foreachBatch(add)
        .option("checkpointLocation", checkpoint_of(spark, folder, name))
        .trigger(availableNow=True)
        .start()
    )


def current_marks(spark: SparkSession, results: str) -> DataFrame:
    """``(run, tag, phase, ms)``: the last mark of each phase so far."""
    rows = spark.read.schema(f"{PHASE_SCHEMA}, batch long").parquet(results)
    return rows.groupBy("run", "tag", "phase").agg(F.max_by("ms", "start").alias("ms"))
