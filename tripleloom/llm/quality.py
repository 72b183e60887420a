"""Quality rules with thresholds learned per language and source.

Native: DataFrame functions only.  The sketch is a log-linear histogram (32
sub-buckets per power of two, relative error at most 1/16) kept as rows
``(lang, source, metric, bucket, count)``.  Two sketches merge by adding counts,
so the result does not depend on partitions or on the order of merging.

Defined results: a null text has no words; nulls of ``lang`` or ``source`` form
groups of their own; repeated rows are judged one by one; an empty table gives an
empty table; input columns named like an output column are replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripleloom.plans.sizing import broadcast_if_small
from tripleloom.session import written

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 8
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Rule:
    """Reject where ``1000 * part / whole`` lies beyond the group's fence.

    The upper fence is ``q75 + max(3 * (q75 - q25), slack)``, the lower one
    mirrors it.  ``slack`` is the least spread that the rule can tell apart.
    """

    name: str
    part: str
    whole: str
    slack: int
    low: bool = False


RULES = (
    Rule("symbols", "n_symbols", "word_chars", 60),
    Rule("capitals", "n_capitals", "word_chars", 250),
    Rule("repeats", "n_repeat_words", "n_words", 280),
    Rule("same_lines", "n_dup_lines", "n_lines", 500),
    Rule("word_length", "word_chars", "n_words", 4000, low=True),
)
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside windows of ``window`` words that the text has twice or more."""

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, at: F.struct(h.alias("h"), at.alias("at"))))

        def repeats(s: Column) -> Column:
            def met(x: Column, k: Column) -> Column:
                other = lambda n: F.coalesce(F.get(s, n)["h"] == x["h"], F.lit(False))
                return other(k - 1) | other(k + 1)

            return F.sort_array(F.transform(F.filter(s, met), lambda x: x["at"]))

        def length(p: Column) -> Column:
            steps = F.transform(p, lambda x, k: F.coalesce(F.least(F.lit(window), F.get(p, k + 1) - x), F.lit(window)))
            return F.aggregate(steps, F.lit(0), lambda total, x: total + x)

        return bound(bound(pairs, repeats), length)

    def of(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(w) - (window - 1))
        return bound(
            F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, window))),
            lambda v: F.when(F.size(F.array_distinct(v)) == F.size(v), 0).otherwise(covered(v)),
        )

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) <= window, 0).otherwise(bound(hashed, of)).cast("long")


def removed(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def quality_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """The counts behind the rules, added to ``docs``."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n", -1), lambda line: F.translate(line, " \t\n\x0b\x0c\r", "") != "")
    counted = docs.withColumn("_tl_words", F.array_remove(F.split(whole, SPACE, -1), "")).withColumn("_tl_lines", lines)
    n_lines = F.size("_tl_lines").cast("long")
    return counted.withColumns(
        {
            "n_words": F.size("_tl_words").cast("long"),
            "word_chars": F.length(F.translate(whole, " \t\n\x0b\x0c\r", "")).cast("long"),
            "n_symbols": removed(whole, SYMBOLS).cast("long"),
            "n_capitals": removed(whole, CAPITALS).cast("long"),
            "n_lines": n_lines,
            "n_dup_lines": n_lines - F.size(F.array_distinct("_tl_lines")),
            "n_repeat_words": repeated_words(F.col("_tl_words")),
        }
    ).drop("_tl_words", "_tl_lines")


def base_failed() -> Column:
    n = F.col("n_words")
    return (n < 20) | (100 * F.col("n_repeat_words") > 30 * n)


def measure(rule: Rule) -> Column:
    return F.floor(1000 * F.col(rule.part) / F.greatest(F.col(rule.whole), F.lit(1))).cast("long")


def bucket_of(x: Column) -> Column:
    level = F.greatest(F.length(F.bin(x)) - 5, F.lit(0))
    return level.cast("long") * 32 + F.call_function("shiftright", x, level)


def lower_edge(bucket: Column) -> Column:
    return F.call_function("shiftleft", bucket % 32, F.floor(bucket / 32).cast("int"))


def quality_sketch(features: DataFrame, by: tuple[str, ...] = ("lang", "source"), rules=RULES) -> DataFrame:
    """``(*by, metric, bucket, count)`` over the documents that pass the base rules."""
    values = F.explode(F.array(*[F.struct(F.lit(r.name).alias("metric"), bucket_of(measure(r)).alias("bucket")) for r in rules]))
    rows = features.where(~base_failed()).select(*by, values.alias("_tl_m")).select(*by, "_tl_m.*")
    return rows.groupBy(*by, "metric", "bucket").agg(F.count("*").alias("count"))


def merged_sketches(*sketches: DataFrame) -> DataFrame:
    whole = sketches[0]
    for other in sketches[1:]:
        whole = whole.unionByName(other)
    keys = [c for c in whole.columns if c != "count"]
    return whole.groupBy(*keys).agg(F.sum("count").alias("count"))


def quality_fences(sketch: DataFrame, by: tuple[str, ...] = ("lang", "source"), rules=RULES) -> DataFrame:
    """One row per group with ``<rule>_high`` and, where asked for, ``<rule>_low``.

    A window holds the buckets of one group and metric: at most 32 for each power of two.
    """
    group = Window.partitionBy(*by, "metric")
    upto = group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    ranked = sketch.withColumns({"_tl_upto": F.sum("count").over(upto), "_tl_all": F.sum("count").over(group)})
    quartile = lambda n: F.min(F.when(4 * F.col("_tl_upto") >= n * F.col("_tl_all"), lower_edge(F.col("bucket"))))
    quartiles = ranked.groupBy(*by, "metric").agg(quartile(1).alias("q1"), quartile(3).alias("q3"))
    columns = []
    for r in rules:
        of = lambda c: F.max(F.when(F.col("metric") == r.name, c))  # noqa: B023, E731
        spread = F.greatest(3 * (F.col("q3") - F.col("q1")), F.lit(r.slack))
        columns.append(of(F.col("q3") + spread).alias(f"{r.name}_high"))
        if r.low:
            columns.append(of(F.col("q1") - spread).alias(f"{r.name}_low"))
    return quartiles.groupBy(*by).agg(*columns)


def judged(features: DataFrame, fences: DataFrame, by: tuple[str, ...] = ("lang", "source"), rules=RULES) -> DataFrame:
    """``base_failed`` and ``kept`` added; the fences, one row per group, are joined on null-safe equality."""
    # Sent to all tasks where few by their count, else joined by a shuffle.
    side = broadcast_if_small(written(fences.select(*[F.col(c).alias(f"_tl_{c}") for c in fences.columns])))
    on = [F.col(c).eqNullSafe(F.col(f"_tl_{c}")) for c in by]
    inside = F.lit(True)
    for r in rules:
        inside &= F.coalesce(measure(r) <= F.col(f"_tl_{r.name}_high"), F.lit(True))
        if r.low:
            inside &= F.coalesce(measure(r) >= F.col(f"_tl_{r.name}_low"), F.lit(True))
    out = features.join(side, on, "left")
    return out.withColumns({"base_failed": base_failed(), "kept": ~base_failed() & inside}).drop(*side.columns)


def quality_rules(docs: DataFrame, text: str = "text", by: tuple[str, ...] = ("lang", "source"), keep_text: bool = True) -> DataFrame:
    """``docs`` with the counts, ``base_failed`` and ``kept``.

    The counts are made once and written, beside the texts where these are kept; the sketch
    reads the columns of counts alone.
    """
    counted = quality_features(docs, text)
    features = written(counted if keep_text else counted.drop(text))
    return judged(features, quality_fences(quality_sketch(features, by), by), by)
