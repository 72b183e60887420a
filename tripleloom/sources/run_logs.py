"""Run logs: text lines to time marks, profile phases and facts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Line patterns.
MARK = r"^\[dbg\s+([\d.]+)\s+ms\]\s*\[([^\]]+)\]\s*(\w+)"
PROFILE = r"\[([\w-]+-prof)\]\s+(\S+)\s+([0-9.]+)\s+ms"
TIME = r"Time:\s+([\d.]+)\s+ms"
INPUT = r"Input A:\s*(\d+)\s*x\s*(\d+),\s*nnz\s*=\s*([\d,]+)"
RESULT = r"Result C:.*?nnz\s*=\s*([\d,]+)"
CHOICE = r"\[adapt\].*→\s*(hash|merge3)"
OVER_ALLOCATION = r"C_nnz=(\d+)\s*\(est=(\d+),\s*([\d.]+)x over-alloc\)"
SPAN = r"^\[dbg\s+([\d.]+)\s+ms\]\s+(.*?)[\s:]*\b(begin|start|done|writing)\b(.*)$"
TOTAL = r"^\s+total\s+([0-9.]+)ms"
ENTRIES = r"C\.nnz=(\d+)"
KERNEL = r"Kernel time:\s*([0-9.]+)\s*ms"
FALLBACK_CHOICE = "merge3 (fallback)"


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """``(run, at, value)``: the lines of every log, ``at`` rising within a file.

    A run is named by its file's place below ``path``, so equal names in two folders stay apart.
    """
    at = F.struct(
        F.col("_metadata")["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("line")
    )
    return spark.read.text(path).select(run_of(path).alias("run"), at.alias("at"), "value")


def run_of(path: str) -> Column:
    """A file's place below ``path``, without its ending."""
    meta = F.col("_metadata")
    folder = re.sub(r"^[a-z]+:/*", "/", path).rstrip("/") + "/"
    below = F.when(F.contains(meta["file_path"], F.lit(folder)), F.substring_index(meta["file_path"], folder, -1))
    return F.regexp_replace(F.coalesce(below, meta["file_name"]), r"\.[^./]*$", "")


def _number(group: Column) -> Column:
    return F.regexp_replace(group, ",", "")


def marks(lines: DataFrame) -> DataFrame:
    """``(run, at, tag, phase, ms)`` from ``[dbg … ms] [tag] phase`` lines."""
    part = lambda n: F.regexp_extract("value", MARK, n)
    return lines.where(F.col("value").rlike(MARK)).select(
        "run", "at", part(2).alias("tag"), part(3).alias("phase"), part(1).cast("double").alias("ms")
    )


def profile(lines: DataFrame) -> DataFrame:
    """``(run, at, tag, phase, ms)`` from ``[tag-prof] phase … ms`` lines."""
    part = lambda n: F.regexp_extract("value", PROFILE, n)
    return lines.where(F.col("value").rlike(PROFILE)).select(
        "run", "at", part(1).alias("tag"), part(2).alias("phase"), part(3).cast("double").alias("ms")
    )


def facts(lines: DataFrame) -> DataFrame:
    """``(run, at, kind, number, text)``: total times, input and result sizes, the chosen method."""
    value = F.col("value")
    kind = (
        F.when(value.rlike(TIME), "time")
        .when(value.rlike(INPUT), "input")
        .when(value.rlike(RESULT), "result")
        .when(value.contains("[adapt]") & value.contains("overflow"), "choice")
        .when(value.rlike(CHOICE), "choice")
    )
    number = (
        F.when(F.col("kind") == "time", F.regexp_extract("value", TIME, 1))
        .when(F.col("kind") == "input", _number(F.regexp_extract("value", INPUT, 3)))
        .when(F.col("kind") == "result", _number(F.regexp_extract("value", RESULT, 1)))
        .try_cast("double")
    )
    text = F.when(
        F.col("kind") == "choice",
        F.when(value.contains("overflow"), F.lit(FALLBACK_CHOICE)).otherwise(F.regexp_extract("value", CHOICE, 1)),
    ).when(F.col("kind") == "input", F.regexp_extract("value", INPUT, 1))
    return (
        lines.select("run", "at", "value", kind.alias("kind"))
        .where(F.col("kind").isNotNull())
        .select("run", "at", "kind", number.alias("number"), text.alias("text"))
    )


def last_per_phase(timed: DataFrame) -> DataFrame:
    """``(run, tag, phase, ms)``: the last line of a phase counts, earlier ones are warm-up."""
    return timed.groupBy("run", "tag", "phase").agg(F.max_by("ms", "at").alias("ms"))


def run_summary(lines: DataFrame) -> DataFrame:
    """One row per run: rows, stored entries, last time, last result size, last choice."""

    def last(kind: str, column: str) -> Column:
        return F.max_by(F.when(F.col("kind") == kind, F.col(column)), F.when(F.col("kind") == kind, F.col("at")))

    return facts(lines).groupBy("run").agg(
        last("input", "text").try_cast("long").alias("n"),
        last("input", "number").cast("long").alias("a_nnz"),
        last("time", "number").alias("time_ms"),
        last("result", "number").cast("long").alias("c_nnz"),
        last("choice", "text").alias("choice"),
    )


def method_results(lines: DataFrame) -> DataFrame:
    """``(run, place, time_ms, c_nnz)``: a run's times and result sizes in the order in which its methods print them.

    A run prints one line of either kind per method, which bounds the window.
    """
    found = facts(lines).where(F.col("kind").isin("time", "result"))
    order = Window.partitionBy("run", "kind").orderBy("at")
    placed = found.withColumn("place", F.row_number().over(order) - 1)
    of = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("number")))
    return placed.groupBy("run", "place").agg(of("time").alias("time_ms"), of("result").cast("long").alias("c_nnz"))


def span_marks(lines: DataFrame) -> DataFrame:
    """``(run, at, event, opens, ms, detail)`` from ``[dbg … ms] event begin`` and ``… done`` lines.

    ``start`` opens like ``begin``; ``writing`` opens the event that ``write done`` closes.
    """
    part = lambda n: F.regexp_extract("value", SPAN, n)
    event = F.when(part(3) == "writing", F.concat_ws(" ", F.nullif(part(2), F.lit("")), F.lit("write"))).otherwise(part(2))
    return lines.where(F.col("value").rlike(SPAN)).select(
        "run", "at", event.alias("event"), (part(3) != "done").alias("opens"), part(1).cast("double").alias("ms"), F.trim(part(4)).alias("detail")
    )


def spans(marked: DataFrame) -> DataFrame:
    """``(run, event, at, begin_ms, done_ms, ms, state, detail)``: each opening mark with the next mark of its event.

    ``closed`` where that is a done mark, else ``open``; a done mark that closes nothing is ``stray``.  Marks are
    paired inside each block of a file; only a block's first and last mark of an event are looked at across blocks, so
    no task sorts a whole log.
    """
    placed = marked.withColumn("block", F.col("at.block"))
    inside = Window.partitionBy("run", "event", "block").orderBy("at")
    near = placed.select(
        "*", F.lead("opens").over(inside).alias("next_opens"), F.lead("ms").over(inside).alias("next_ms"),
        F.lead("detail").over(inside).alias("next_detail"), F.lag("opens").over(inside).alias("last_opens"),
    )
    ends = placed.groupBy("run", "event", "block").agg(
        F.min_by(F.struct("opens", "ms", "detail"), "at").alias("first"), F.max_by("opens", "at").alias("last")
    )
    across = Window.partitionBy("run", "event").orderBy("block")
    edges = ends.select("run", "event", "block", F.lead("first").over(across).alias("after"), F.lag("last").over(across).alias("before"))
    both = near.join(edges, ["run", "event", "block"])
    ended = F.col("next_opens").isNull()
    next_opens = F.when(ended, F.col("after.opens")).otherwise(F.col("next_opens"))
    known = both.select(
        "run", "event", "at", "opens", "ms", "detail", next_opens.alias("next_opens"),
        F.when(ended, F.col("after.ms")).otherwise(F.col("next_ms")).alias("next_ms"),
        F.when(ended, F.col("after.detail")).otherwise(F.col("next_detail")).alias("next_detail"),
        F.coalesce("last_opens", "before").alias("last_opens"),
    )
    closed = F.col("opens") & ~F.coalesce("next_opens", F.lit(True))
    stray = ~F.col("opens") & ~F.coalesce("last_opens", F.lit(False))
    done = F.when(closed, F.col("next_ms")).when(stray, F.col("ms"))
    begin = F.when(F.col("opens"), F.col("ms"))
    return known.where(F.col("opens") | stray).select(
        "run", "event", "at", begin.alias("begin_ms"), done.alias("done_ms"), (done - begin).alias("ms"),
        F.when(closed, "closed").when(stray, "stray").otherwise("open").alias("state"),
        F.when(closed, F.col("next_detail")).when(stray, F.col("detail")).alias("detail"),
    )


def other_tools(lines: DataFrame) -> DataFrame:
    """``(run, total_ms, c_nnz, kernel_ms)``: the first total, result size and kernel time that other tools print."""
    number = lambda rule: F.when(F.col("value").rlike(rule), F.regexp_extract("value", rule, 1).try_cast("double"))
    found = lines.select("run", "at", number(TOTAL).alias("total_ms"), number(ENTRIES).alias("c_nnz"), number(KERNEL).alias("kernel_ms"))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("at")))
    summed = found.where("coalesce(total_ms, c_nnz, kernel_ms) IS NOT NULL").groupBy("run")
    return summed.agg(first("total_ms").alias("total_ms"), first("c_nnz").cast("long").alias("c_nnz"), first("kernel_ms").alias("kernel_ms"))


def over_allocations(lines: DataFrame) -> DataFrame:
    """``(run, at, c_nnz, est, factor)`` from the lines that compare an estimate with the result size."""
    part = lambda n: F.regexp_extract("value", OVER_ALLOCATION, n)
    return lines.where(F.col("value").rlike(OVER_ALLOCATION)).select(
        "run", "at", part(1).cast("long").alias("c_nnz"), part(2).cast("long").alias("est"), part(3).cast("double").alias("factor")
    )


def sketch_comparison(one: DataFrame, other: DataFrame, band: float = 0.03) -> DataFrame:
    """Runs of two sketches ``(run, ms, factor)`` side by side: time ratio, its side of the band, both over-allocations."""
    right = other.select("run", F.col("ms").alias("other_ms"), F.col("factor").alias("other_factor"))
    ratio = F.try_divide(F.col("other_ms"), F.col("ms"))
    side = F.when(F.col("ratio") > 1 + band, "first").when(F.col("ratio") < 1 - band, "other").otherwise("near")
    return one.join(right, "run").withColumn("ratio", ratio).withColumn("faster", F.when(F.col("ratio").isNotNull(), side))
