"""Method comparison: geometric means, tallies, rankings, phase times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripleloom.functions.scalar import geomean, looked_up
from tripleloom.operators.scans import medians, quantiles

# Bands of the tallies.
TIE_UPTO = 1.05
NEAR_SHARE = 0.03
TRANSFERS = ("h2d", "d2h", "h2dmalloc")
TOTAL_PHASE = "TOTAL(GPU)"
# Phases in report order and the group of each.
PHASES = (
    "h2d", "csc", "count", "scan", "expand", "merge", "compact", "workest",
    "compute", "copy", "sort", "reduce", "final", "numeric", "pack", "d2h",
)
PHASE_GROUPS = {
    "h2d": "h2d", "d2h": "d2h",
    "csc": "symbolic", "count": "symbolic", "scan": "symbolic",
    "expand": "compute", "workest": "compute", "compute": "compute", "copy": "compute",
    "sort": "sort", "merge": "sort", "reduce": "reduce",
    "final": "finish", "compact": "finish", "numeric": "numeric", "pack": "pack",
}

ALL_CLASSES = "ALL"


def against_baselines(runs: DataFrame, subject: str, baselines: list[str], keep: list[str]) -> DataFrame:
    """Long form ``(keep, baseline, subject_ms, baseline_ms)``, one row per baseline."""
    pairs = F.stack(F.lit(len(baselines)), *[x for b in baselines for x in (F.lit(b), F.col(b))])
    return runs.select(*keep, F.col(subject).alias("subject_ms"), pairs.alias("baseline", "baseline_ms"))


def _measured() -> Column:
    return (F.col("subject_ms") > 0) & (F.col("baseline_ms") > 0)


def speedups(runs: DataFrame, subject: str, baselines: list[str], by: str = "class") -> DataFrame:
    """Geometric-mean speed-up per class and over all, per baseline.

    Columns: class (``ALL`` for the whole), baseline, speedup, wins (strictly
    faster), total, baseline_ms.
    """
    long = against_baselines(runs, subject, baselines, [by]).where(_measured())
    return (
        long.rollup("baseline", by)
        .agg(
            geomean(F.col("baseline_ms") / F.col("subject_ms")).alias("speedup"),
            F.count_if(F.col("subject_ms") < F.col("baseline_ms")).alias("wins"),
            F.count(F.lit(1)).alias("total"),
            geomean(F.col("baseline_ms")).alias("baseline_ms"),
        )
        .where("baseline IS NOT NULL")
        .withColumn(by, F.coalesce(by, F.lit(ALL_CLASSES)))
    )


def class_geomeans(runs: DataFrame, methods: list[str], by: str = "class") -> DataFrame:
    """Geometric-mean time of every method per class and over all."""
    return (
        runs.rollup(by)
        .agg(F.count(F.lit(1)).alias("matrices"), *[geomean(F.col(m)).alias(m) for m in methods])
        .withColumn(by, F.coalesce(by, F.lit(ALL_CLASSES)))
    )


def win_loss(runs: DataFrame, subject: str, baselines: list[str], rule: str = "at_most") -> DataFrame:
    """Wins, ties, losses and the mean ratio per baseline.

    ``at_most``: equal counts as a win.  ``unfinished_wins``: like it, and a
    baseline without a time is a win.  ``strict``: only faster counts.
    ``tie_band``: up to 5 % slower is a tie.  ``near``: within 3 % is a tie.
    """
    ratio = F.col("subject_ms") / F.col("baseline_ms")
    none = F.lit(False)
    rules = {
        "at_most": (ratio <= 1, none),
        "unfinished_wins": (ratio <= 1, none),
        "strict": (ratio < 1, none),
        "tie_band": (ratio < 1, (ratio >= 1) & (ratio <= TIE_UPTO)),
        "near": (ratio <= 1 - NEAR_SHARE, F.abs(ratio - 1) < NEAR_SHARE),
    }
    if rule not in rules:
        raise ValueError(f"unknown rule {rule!r}, choose one of {', '.join(rules)}")
    win, tie = rules[rule]
    long = against_baselines(runs, subject, baselines, []).where("subject_ms > 0")
    measured = F.col("baseline_ms") > 0
    unfinished = F.col("baseline_ms").isNull()
    counted = measured | unfinished if rule == "unfinished_wins" else measured
    won = F.when(measured, win).otherwise(unfinished) if rule == "unfinished_wins" else win
    return (
        long.where(counted)
        .groupBy("baseline")
        .agg(
            F.count_if(won).alias("wins"),
            F.count_if(measured & tie).alias("ties"),
            F.count_if(measured & ~win & ~tie).alias("losses"),
            F.count_if(unfinished).alias("unfinished"),
            geomean(F.when(measured, ratio)).alias("ratio"),
        )
    )


def worst_losses(runs: DataFrame, subject: str, baseline: str, k: int, key: str = "matrix") -> DataFrame:
    """The ``k`` rows where the subject is slowest against the baseline."""
    ratio = F.col(subject) / F.col(baseline)
    return (
        runs.where((F.col(subject) > 0) & (F.col(baseline) > 0) & (F.col(subject) > F.col(baseline)))
        .select(key, F.col(subject).alias("subject_ms"), F.col(baseline).alias("baseline_ms"), ratio.alias("ratio"))
        .orderBy(F.desc("ratio"), key)
        .limit(k)
    )


def tightest(runs: DataFrame, subject: str, baseline: str, below: float, k: int, key: str = "matrix") -> DataFrame:
    """The ``k`` rows with the smallest baseline/subject ratio below a bound."""
    ratio = F.col(baseline) / F.col(subject)
    return (
        runs.where((F.col(subject) > 0) & (F.col(baseline) > 0))
        .select(key, ratio.alias("ratio"), (F.col(baseline) - F.col(subject)).alias("margin_ms"))
        .where(F.col("ratio") < below)
        .orderBy("ratio", key)
        .limit(k)
    )


def choice_counts(runs: DataFrame, choice: str) -> DataFrame:
    """Runs per chosen method; a fallback counts for the method it fell back to."""
    name = F.regexp_extract(choice, r"^(\w+)", 1)
    return runs.where(F.col(choice) != "").groupBy(name.alias("choice")).agg(F.count(F.lit(1)).alias("runs"))


def nnz_gaps(runs: DataFrame, expected: str, others: list[str], key: str = "matrix") -> DataFrame:
    """Rows where a method's result size differs from the expected one."""
    wrong = F.lit(False)
    for c in others:
        wrong = wrong | F.coalesce(F.col(c) != F.col(expected), F.lit(False))
    gap = [F.abs(F.col(c) - F.col(expected)).alias(f"{c}_gap") for c in others]
    return runs.where(wrong).select(key, expected, *gap)


# --- phases ------------------------------------------------------------------------


def phase_durations(timed: DataFrame, phases: tuple[str, ...] | None = None) -> DataFrame:
    """``(run, tag, phase, ms)``: time since the mark before, in order of time.

    ``timed`` holds one mark per run, tag and phase, so the program's phases bound the window of
    a run.  Every mark counts unless ``phases`` names some.  The first mark has no duration and drops out.
    """
    marks = timed.where(F.col("phase").isin(*phases)) if phases else timed
    before = F.lag("ms").over(Window.partitionBy("run", "tag").orderBy("ms", "phase"))
    return (
        marks.withColumn("before", before)
        .where(F.col("before").isNotNull())
        .select("run", "tag", "phase", (F.col("ms") - F.col("before")).alias("ms"))
    )


def phase_table(durations: DataFrame, phases: tuple[str, ...] = PHASES) -> DataFrame:
    """Wide form: one row per run and tag, one column per phase, NULL where absent."""
    return durations.groupBy("run", "tag").pivot("phase", list(phases)).agg(F.first("ms"))


def compute_only(durations: DataFrame) -> DataFrame:
    """``(run, tag, ms)``: the phases without transfers, NULL where a run has none."""
    kept = F.when(~F.col("phase").isin(*TRANSFERS), F.col("ms"))
    return durations.groupBy("run", "tag").agg(F.sum(kept).alias("ms"))


def profile_compute_only(timed: DataFrame) -> DataFrame:
    """``(run, tag, ms)``: the reported total without transfers, or the sum of the phases without a total."""
    of = lambda c: F.sum(F.when(c, F.col("ms")))
    transfer = F.col("phase").isin(*TRANSFERS)
    total = F.max(F.when(F.col("phase") == TOTAL_PHASE, F.col("ms")))
    rest = of(~transfer & (F.col("phase") != TOTAL_PHASE))
    moved = F.coalesce(of(transfer), F.lit(0.0))
    return timed.groupBy("run", "tag").agg(F.coalesce(total - moved, rest).alias("ms"))


def phase_group_means(durations: DataFrame) -> DataFrame:
    """``(tag, group, ms)``: mean over runs of the time per phase group; a run without the group counts as 0.

    A phase without a group is a group of its own name.
    """
    group = F.coalesce(looked_up(F.col("phase"), PHASE_GROUPS), F.col("phase"))
    runs = durations.groupBy("tag").agg(F.count_distinct("run").alias("runs"))
    sums = (
        durations.withColumn("group", group)
        .where(F.col("group").isNotNull())
        .groupBy("tag", "group")
        .agg(F.sum("ms").alias("total"))
    )
    return sums.join(runs, "tag").select("tag", "group", (F.col("total") / F.col("runs")).alias("ms"))


def profile_blocks(timed: DataFrame) -> DataFrame:
    """Profile lines numbered by call: a total line closes its block.

    ``at`` is a struct of file split and line, as log scans give it.  Closed
    blocks are counted inside each split and over the splits of a log, so a
    long log is not one window.
    """
    closing = F.when(F.col("phase") == TOTAL_PHASE, 1).otherwise(0)
    lines = timed.withColumn("__split", F.col("at.block")).withColumn("__closing", closing)
    totals = lines.groupBy("run", "__split").agg(F.sum("__closing").alias("__n"))
    across = Window.partitionBy("run").orderBy("__split").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("run", "__split", F.coalesce(F.sum("__n").over(across), F.lit(0)).alias("__start"))
    within = Window.partitionBy("run", "__split").orderBy("at.line").rowsBetween(Window.unboundedPreceding, -1)
    local = F.coalesce(F.sum("__closing").over(within), F.lit(0))
    return (
        lines.withColumn("__local", local)
        .join(starts, ["run", "__split"])
        .withColumn("block", F.col("__start") + F.col("__local"))
        .drop("__split", "__closing", "__start", "__local")
    )


def block_medians(blocks: DataFrame) -> DataFrame:
    """``(run, phase, median)``: median over calls of each phase's time, transfers and totals left out."""
    inner = blocks.where(~F.col("phase").isin(*TRANSFERS, TOTAL_PHASE))
    sums = inner.groupBy("run", "block", "phase").agg(F.sum("ms").alias("ms"))
    return medians(sums, "ms", ("run", "phase"))


def method_statistics(long: DataFrame, value: str, by: str) -> DataFrame:
    """Count, mean, exact median, least and greatest time per method."""
    present = long.where(F.col(value).isNotNull())
    numbers = present.groupBy(by).agg(
        F.count(F.lit(1)).alias("runs"), F.avg(value).alias("mean"),
        F.min(value).alias("least"), F.max(value).alias("greatest"),
    )
    return numbers.join(medians(present, value, (by,)), by)


def paired_change(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Both values and the relative change in percent of rows that occur in both tables."""
    b = before.select(*keys, F.col(value).alias("before"))
    a = after.select(*keys, F.col(value).alias("after"))
    change = F.try_divide(F.col("after") - F.col("before"), F.col("before")) * 100.0
    return b.join(a, keys).withColumn("change_pct", change)


# --- trends ------------------------------------------------------------------------


def binned_trend(points: DataFrame, x: str, ratio: str, bins: int = 6) -> DataFrame:
    """``(bin, n, x, ratio)``: median ``x`` and geometric-mean ratio in quantile bins of ``log10 x``.

    Bins with fewer than two points are left out.
    """
    logs = points.where((F.col(x) > 0) & (F.col(ratio) > 0)).select(
        F.lit(0).alias("one"), F.col(x).alias("x"), F.log10(x).alias("lx"), F.log10(ratio).alias("lr")
    )
    inner = [q / bins for q in range(1, bins)]
    # ``bins - 1`` numbers come to the driver and go into the plan as constants.
    edges = [row["x"] for row in quantiles(logs, "lx", inner, ("one",)).collect()]
    place = F.lit(0).cast("long")
    for edge in edges:
        place = place + F.when(F.col("lx") >= edge, 1).otherwise(0)
    placed = logs.withColumn("bin", place)
    sums = placed.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.pow(F.lit(10.0), F.avg("lr")).alias("ratio"))
    return sums.where("n >= 2").join(medians(placed, "x", ("bin",)), "bin").select(
        "bin", "n", F.col("median").alias("x"), "ratio"
    )


def ab_summary(before: DataFrame, after: DataFrame, by: list[str], value: str = "ms") -> DataFrame:
    """Mean and median per group of two sets of runs side by side, and the change of both in per cent."""

    def side(rows: DataFrame, name: str) -> DataFrame:
        present = rows.where(F.col(value).isNotNull())
        means = present.groupBy(*by).agg(F.count(F.lit(1)).alias(f"{name}_runs"), F.avg(value).alias(f"{name}_mean"))
        return means.join(medians(present, value, tuple(by)).withColumnRenamed("median", f"{name}_median"), by)

    def change(kind: str) -> Column:
        return F.try_divide((F.col(f"after_{kind}") - F.col(f"before_{kind}")) * 100.0, F.col(f"before_{kind}")).alias(f"{kind}_change_pct")

    both = side(before, "before").join(side(after, "after"), by, "full")
    return both.select("*", change("mean"), change("median"))
