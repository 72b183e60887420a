"""Spelling variants: words one edit apart, by dynamic programming over sorted lists.

1. **Vocabulary.** Runs of letters are counted with map-side combining; words of at least
   ``shortest`` code points and ``least`` occurrences stay.
2. **Lists.** One edit leaves the first or the last half of a word alone.  With ``L`` the length of
   the shorter word of a pair, both words have the same first ``L // 2`` code points or the same last
   ``L - L // 2``.  A word is put in both lists for each ``L`` it can have (its length, and one less);
   a list holds the rest of each word, in reading order from the shared half.
3. **Scan.** A list is sorted and scanned once, for all its words as queries at the same time.  At each
   depth a banded row of the edit matrix (three cells per query) is kept; the next rest goes on from
   the row at its common prefix with the one before.  A query whose row exceeds one edit is left
   out below that prefix, so it skips all rests that share it.
4. **Long lists** (more than ``most`` words) are split before they are scanned: a pair that differs in one code
   point also shares what is left without it, and one with an extra code point shares the shorter rest, so such
   lists hold at most the alphabet times the length.
5. **Forms.** A word's form is the near word of largest count; counts grow at least fivefold along forms, so
   pointer doubling ends after five rounds whatever the size.

Defined results: null and empty texts have no words; a null key counts as an empty one in the
hash that edits runs; repeated rows count again; other columns are not read; words are
compared by code point; ties of forms go to the smallest word; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleloom.plans.sizing import broadcast_if_small
from tripleloom.session import written

LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of one list that a task scans.
MOST = 20_000
FAR = 2
KEYS = ["L", "side", "half", "cut"]


def runs(docs: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = 6, every: int = 199) -> DataFrame:
    """``(word)`` per run of at least ``shortest`` letters; where ``every`` divides the run's hash it has lost a code point."""
    found = F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(f"[{LETTERS}]{{{shortest},}}"), F.lit(0))
    rows = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id"), F.explode(found).alias("run"))
    h = rows.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    gone = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.col("run").substr(F.lit(1), gone), F.col("run").substr(gone + 2, F.length("run")))
    return h.select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, shortest: int = 6, least: int = 5) -> DataFrame:
    """``(word, n)`` of the words that are long and frequent enough."""
    return words.where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def listed(words: DataFrame) -> DataFrame:
    """``(L, side, half, cut, rest, word, n)``: each word in its lists; ``cut`` is empty."""
    size = F.length("word")
    rows = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("L")).withColumn("m", F.floor(F.col("L") / 2).cast("int"))
    tail = F.col("L") - F.col("m")
    front = F.struct(F.lit("front").alias("side"), F.col("word").substr(F.lit(1), F.col("m")).alias("half"), F.col("word").substr(F.col("m") + 1, size).alias("rest"))
    back = F.struct(
        F.lit("back").alias("side"),
        F.col("word").substr(size - tail + 1, tail).alias("half"),
        F.reverse(F.col("word").substr(F.lit(1), size - tail)).alias("rest"),
    )
    each = rows.select("L", "word", "n", F.explode(F.array(front, back)).alias("x"))
    return each.select("L", "x.side", "x.half", F.lit("").alias("cut"), "x.rest", "word", "n")


def split_lists(lists: DataFrame, most: int) -> DataFrame:
    """``lists`` with those of more than ``most`` words dealt by what an edit inside the rest leaves alone."""
    counts = lists.groupBy("L", "side", "half").agg(F.count("*").alias("size"))
    long = written(counts.where(F.col("size") > most).drop("size"))
    if long.isEmpty():
        return lists
    sent = broadcast_if_small(long)
    short = lists.join(sent, ["L", "side", "half"], "left_anti")
    without = "transform(sequence(1, length(rest)), p -> concat({}, concat(substring(rest, 1, p - 1), substring(rest, p + 1))))"
    same = F.expr("if(length(rest) = 0, array(), " + without.format("concat('=', p, ':')") + ")")
    longer = F.expr("if(length(rest) = 0, array(), array_distinct(" + without.format("'+:'") + "))")
    # A word of length L is the shorter one of a pair or differs in place; one of L + 1 only the longer one.
    cuts = F.when(F.length("word") == F.col("L"), F.concat(same, F.array(F.concat(F.lit("+:"), F.col("rest"))))).otherwise(longer)
    dealt = lists.join(sent, ["L", "side", "half"], "left_semi").withColumn("cut", F.explode(cuts))
    return short.unionByName(dealt)


class _List:
    """Sorted rests as code points, with each one's common prefix with the one before."""

    def __init__(self, rests: list[str]):
        self.size = np.array([len(r) for r in rests])
        width = int(self.size.max()) + 2
        self.points = np.zeros((len(rests), width), np.uint32)
        flat = np.frombuffer("".join(rests).encode("utf-32-le"), np.uint32)
        row = np.repeat(np.arange(len(rests)), self.size)
        self.points[row, np.arange(len(flat)) - np.repeat(np.cumsum(self.size) - self.size, self.size)] = flat
        same = self.points[1:] == self.points[:-1]
        differs = np.concatenate([~same, np.ones((len(same), 1), bool)], axis=1)
        self.common = np.minimum(differs.argmax(axis=1), np.minimum(self.size[1:], self.size[:-1]))


def near_pairs(rests: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``(query, word)`` positions of the sorted ``rests`` that are exactly one edit apart.

    Cell ``k`` of the row at depth ``d`` is the distance of the first ``d`` code points to the query's first ``d - 1 + k``.
    """
    own = _List(rests)
    count, size = len(rests), own.size
    points = np.ascontiguousarray(own.points.T)
    root = (np.arange(count), np.full(count, FAR, np.int8), np.zeros(count, np.int8), np.ones(count, np.int8))
    rows = [root]
    found_q, found_w = [], []
    for w in range(count):
        depth = min(len(rows) - 1, int(own.common[w - 1])) if w else 0
        del rows[depth + 1 :]
        for d in range(depth + 1, int(size[w]) + 1):
            queries, low, mid, high = rows[-1]
            if len(queries) < 2:
                break
            c = points[d - 1, w]
            before = points[d - 2].take(queries) != c if d > 1 else True
            new_low = np.minimum(low + before, mid + 1)
            new_mid = np.minimum(np.minimum(mid + (points[d - 1].take(queries) != c), high + 1), new_low + 1)
            new_high = np.minimum(high + (points[d].take(queries) != c), new_mid + 1)
            stay = np.flatnonzero(np.minimum(np.minimum(new_low, new_mid), new_high) < FAR)
            rows.append((queries.take(stay), new_low.take(stay), new_mid.take(stay), new_high.take(stay)))
        if len(rows) - 1 < size[w]:
            continue
        queries, low, mid, high = rows[int(size[w])]
        more = size[queries] - size[w]
        distance = np.where(more == 0, mid, np.where(more == 1, high, np.where(more == -1, low, FAR)))
        hit = queries[distance == 1]
        found_q.append(hit)
        found_w.append(np.full(len(hit), w))
    if not found_q:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_q), np.concatenate(found_w)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by list and rest; each list is scanned when its last row has come."""
    held: list[tuple] = []
    key, found = None, ([], [], [])

    def close() -> None:
        if len(held) < 2:
            return
        shorter = held[0][0]
        queries, words = near_pairs([h[1] for h in held])
        for q, w in zip(queries.tolist(), words.tolist()):
            (_, _, a, _), (_, _, b, n) = held[q], held[w]
            if min(len(a), len(b)) == shorter:
                found[0].append(a)
                found[1].append(b)
                found[2].append(n)

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(found[0], pa.string()), pa.array(found[1], pa.string()), pa.array(found[2], pa.int64())], ["word", "near", "near_n"])
        for part in found:
            part.clear()
        return out

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in range(7)]
        for L, side, half, cut, rest, word, n in zip(*columns):
            if key != (L, side, half, cut):
                close()
                held.clear()
                key = (L, side, half, cut)
            held.append((L, rest, word, n))
        if found[0]:
            yield flush()
    close()
    yield flush()


def near_words(words: DataFrame, most: int = MOST) -> DataFrame:
    """``(word, near, near_n)``: every ordered pair of words one edit apart, once."""
    lists = split_lists(listed(words), most)
    sorted_lists = lists.repartition(*KEYS).sortWithinPartitions(*KEYS, "rest", "word")
    pairs = sorted_lists.mapInArrow(_scan, "word string, near string, near_n long")
    return pairs.groupBy("word", "near").agg(F.first("near_n").alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` of the words that have a form, following forms to the last by doubling."""
    known = written(forms.select("word", F.col("form").alias("root")))
    while True:
        step = known.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
        joined = known.join(step, F.col("root") == F.col("_at"), "left")
        known = written(joined.select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")))
        if known.where("moved").isEmpty():
            return known.select("word", "root")


def spelling_variants(words: DataFrame, ratio: int = 5, most: int = MOST) -> DataFrame:
    """``(word, n, n_near, form, form_n, root)`` for a vocabulary ``(word, n)``.

    The vocabulary is scanned several times; pass a written table.
    """
    own = words.select("word", "n")
    best = F.min(F.struct((-F.col("near_n")).alias("rank"), "near")).alias("best")
    counted = near_words(own, most).groupBy("word").agg(F.count("*").alias("n_near"), best)
    joined = own.join(counted, "word", "left")
    holds = -F.col("best.rank") >= ratio * F.col("n")
    judged = written(
        joined.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(holds, F.col("best.near")).alias("form"), F.when(holds, -F.col("best.rank")).alias("form_n"),
        )
    )
    ends = roots(judged.where("form IS NOT NULL"))
    return judged.join(ends, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
