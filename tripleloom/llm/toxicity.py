"""Toxicity by compression distance to two zstandard dictionaries.

A window is one word (a run of letters and digits, lower-cased) between spaces.
Two dictionaries are made from labelled documents: of the words that toxic documents
use more than their share, and of the words of ordinary ones, the
commonest last.  A window is compressed with either; the cell (length of the
window, compressed length with the toxic, with the ordinary dictionary) is looked
up in a table of calibrated evidence, the log ratio of how often toxic and ordinary
documents have such a window.  A document is scored by a
logistic function of its strongest evidence, of the number of windows beyond the
calibrated threshold, and of its length.  Evidence and weights come from each half of
the sample under the dictionaries of the other half.

The sample has at most ``sample`` labelled rows, those with the smallest hashes of
their id.  Word counts and cells are added up by Spark; only the dictionaries, the
table of cells and one small row per sampled document reach the driver.

Defined results: a null or empty text has no windows and gets the score of a
document without evidence; repeated rows are scored one by one; without labels of
both kinds every score is the share of toxic labels (0.0 with none); other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleloom.llm.words import slices
from tripleloom.session import written

SAMPLE = 20_000
TOXIC_BYTES, ORDINARY_BYTES = 1 << 15, 1 << 17
#: The toxic dictionary is searched for the longest match; the ordinary one is larger than the window of that level.
TOXIC_LEVEL, ORDINARY_LEVEL = 7, 3
#: Least log likelihood ratio (doubled) of a word of the toxic dictionary.
GAIN = 20.0
#: Room after the window, since matches are not looked for in the last bytes of a block.
PAD = b" " * 12
KNOWN = 400_000
#: Longer words are cut into windows of this many letters.
WIDEST = 48
_word = re.compile(r"[^\W_]{1,%d}" % WIDEST)


@dataclass
class ToxicModel:
    toxic: bytes = b""
    ordinary: bytes = b""
    evidence: dict[tuple[int, int, int], float] = field(default_factory=dict)
    unseen: float = 0.0
    threshold: float = math.inf
    weights: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        out = []
        for content, level in ((self.toxic, TOXIC_LEVEL), (self.ordinary, ORDINARY_LEVEL)):
            d = zstandard.ZstdCompressionDict(content or b" " * 16, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            out.append(zstandard.ZstdCompressor(level=level, write_content_size=False, write_dict_id=False, dict_data=d))
        return out


def windows(text: str | None) -> list[str]:
    return _word.findall((text or "").lower())


class Gauge:
    """Cells of windows, remembered in a bounded table."""

    def __init__(self, model: ToxicModel):
        self.compressors = model.compressors()
        self.model = model
        self.known: dict[str, float] = {}

    def cell(self, word: str) -> tuple[int, int, int]:
        window = b" " + word.encode() + b" " + PAD
        toxic, ordinary = (len(c.compress(window)) for c in self.compressors)
        return len(window), toxic, ordinary

    def evidence(self, words: list[str]) -> list[float]:
        known = self.known
        fresh = {w for w in words if w not in known}
        if len(known) + len(fresh) > KNOWN:
            known.clear()
            fresh = set(words)
        table, unseen = self.model.evidence, self.model.unseen
        for w in fresh:
            known[w] = table.get(self.cell(w), unseen)
        return [known[w] for w in words]

    def features(self, text: str | None) -> tuple[float, float, float]:
        found = self.evidence(windows(text))
        hits = sum(e >= self.model.threshold for e in found)
        return max(found, default=0.0), math.log1p(hits), math.log1p(len(found))


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str, label: str, sample: int) -> DataFrame:
    """At most ``sample`` labelled documents, ``(key, text, y, half)``; the ids are the broadcast side."""
    rows = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull())
    chosen = rows.groupBy(key).agg(F.max(F.col(label).cast("int")).alias("y")).orderBy(F.xxhash64(key), key).limit(sample)
    half = F.pmod(F.xxhash64(F.lit(7), F.col(key)), F.lit(2)).cast("int")
    return docs.join(F.broadcast(chosen), key).withColumn("half", half)


def train_toxicity(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE
) -> ToxicModel:
    """Dictionaries from the whole sample; evidence and weights from each half by the other half's dictionaries."""
    chosen = labelled_sample(docs.select(key, text), labels.select(key, label), key, label, sample)
    taken = written(chosen.select(F.col(text).alias("text"), "y", "half"))
    size = {(r["half"], r["y"]): r["n"] for r in taken.groupBy("half", "y").agg(F.count("*").alias("n")).collect()}
    if not all(size.get((half, y)) for half in (0, 1) for y in (0, 1)):
        positive, rows = sum(v for (_, y), v in size.items() if y), sum(size.values())
        share = min(max(positive / rows, 1e-6), 1 - 1e-6) if rows else 1e-6
        return ToxicModel(weights=(math.log(share / (1 - share)), 0.0, 0.0, 0.0))
    found = taken.select("text", "y", "half").mapInArrow(_distinct_words, "word string, y int, half int")
    of = lambda y, half: F.sum(((F.col("y") == y) & (F.col("half") == half)).cast("long")).alias(f"n{y}{half}")
    counts = written(found.groupBy("word").agg(*[of(y, half) for y in (0, 1) for half in (0, 1)]))
    crossed = {half: _dictionaries(counts, [1 - half], size) for half in (0, 1)}
    model = _dictionaries(counts, [0, 1], size)
    context = docs.sparkSession.sparkContext
    halves = {half: taken.where(F.col("half") == half).select("text", "y") for half in (0, 1)}
    cells = [halves[h].mapInArrow(_cells(context.broadcast(crossed[h])), "size int, t int, o int, y int") for h in (0, 1)]
    _calibrate(model, cells[0].unionByName(cells[1]), [sum(size[h, y] for h in (0, 1)) for y in (0, 1)])
    rows = []
    for half, other in crossed.items():
        other.evidence, other.threshold = model.evidence, model.threshold
        rows.append(halves[half].mapInArrow(_featured(context.broadcast(other)), "a double, b double, c double, y int").toArrow())
    whole = np.concatenate([np.stack([r.column(k).to_numpy() for k in range(4)], axis=1) for r in rows])
    whole = whole[np.lexsort(whole.T)]
    model.weights = tuple(_logistic(whole[:, :3], whole[:, 3]).tolist())
    return model


def _dictionaries(counts: DataFrame, halves: list[int], size: dict) -> ToxicModel:
    """The two contents by the word counts of some halves of the sample."""
    n = [sum(size[h, y] for h in halves) for y in (0, 1)]
    total = lambda y: sum((F.col(f"n{y}{h}") for h in halves), F.lit(0))
    scored = counts.select("word", total(0).alias("ordinary"), total(1).alias("toxic"))
    share, base = F.greatest(F.col("toxic"), F.lit(0.5)) / F.greatest(F.col("toxic") + F.col("ordinary"), F.lit(0.75)), n[1] / sum(n)
    ratio = F.log((F.col("toxic") + 0.5) / (n[1] + 1)) - F.log((F.col("ordinary") + 0.5) / (n[0] + 1))
    # Twice the log likelihood ratio against an even spread: so few words exceed it by chance that they do not blur the cells.
    spread = F.when(F.col("ordinary") > 0, F.col("ordinary") * F.log(F.greatest(1 - share, F.lit(1e-9)) / (1 - base))).otherwise(0.0)
    scored = scored.withColumns({"ratio": ratio, "gain": 2 * (F.col("toxic") * F.log(share / base) + spread)})
    toxic = scored.where((F.col("gain") >= GAIN) & (F.col("ratio") > 2.0)).orderBy(F.desc("gain"), "word")
    ordinary = scored.where("ratio <= 0.5 and ordinary > 0").orderBy(F.desc("ordinary"), "word")
    return ToxicModel(_content(toxic, TOXIC_BYTES), _content(ordinary, ORDINARY_BYTES))


def _content(words: DataFrame, most: int) -> bytes:
    """The first words that fit into ``most`` bytes, the first of them last."""
    found, size = [], 1
    for row in words.select("word").limit(most // 2).toLocalIterator():
        size += len(row[0].encode()) + 1
        if size > most:
            break
        found.append(row[0])
    return (" " + " ".join(reversed(found)) + " ").encode()


def _calibrate(model: ToxicModel, cells: DataFrame, n: list[int]) -> None:
    """Evidence per cell, by documents that have it; cells beyond the threshold hold at most 1 % of the ordinary documents."""
    rows = cells.groupBy("size", "t", "o").agg(F.sum(1 - F.col("y")).alias("ordinary"), F.sum("y").alias("toxic")).collect()
    for r in rows:
        model.evidence[r["size"], r["t"], r["o"]] = math.log((r["toxic"] + 0.1) / (n[1] + 1)) - math.log((r["ordinary"] + 0.1) / (n[0] + 1))
    model.threshold, clean = math.inf, 0
    by_evidence = sorted(rows, key=lambda r: -model.evidence[r["size"], r["t"], r["o"]])
    for r in by_evidence:
        clean += r["ordinary"]
        if clean > 0.01 * n[0] or model.evidence[r["size"], r["t"], r["o"]] <= 0.5:
            break
        model.threshold = model.evidence[r["size"], r["t"], r["o"]]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton steps of a ridge-penalised fit with an intercept first."""
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        penalty = ridge * np.r_[0.0, np.ones(len(w) - 1)]
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), x.T @ (y - p) - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, 0):
            own = [set(windows(text)) for text in batch.column(0).to_pylist()]
            row = pa.array(np.repeat(np.arange(len(own)), [len(o) for o in own]))
            words = pa.array([w for o in own for w in o], pa.string())
            yield pa.RecordBatch.from_arrays([words, batch.column(1).take(row), batch.column(2).take(row)], ["word", "y", "half"])


def _cells(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gauge = Gauge(shared.value)
        for whole in batches:
            for batch in slices(whole, 0):
                pairs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                rows = [(*c, y) for text, y in pairs for c in {gauge.cell(w) for w in set(windows(text))}]
                table = np.array(rows, np.int32).reshape(-1, 4)
                yield pa.RecordBatch.from_arrays([pa.array(table[:, k]) for k in range(4)], ["size", "t", "o", "y"])

    return run


def _featured(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gauge = Gauge(shared.value)
        for whole in batches:
            for batch in slices(whole, 0):
                x = np.array([gauge.features(t) for t in batch.column(0).to_pylist()], float).reshape(-1, 3)
                yield pa.RecordBatch.from_arrays([*(pa.array(x[:, k]) for k in range(3)), batch.column(1)], ["a", "b", "c", "y"])

    return run


def toxicity_scores(docs: DataFrame, model: ToxicModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, score)``: 0 to 1, higher where the label is likelier to be 1."""
    rows = docs.select(key, text)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(_scorer(shared, key), f"`{key}` {rows.schema[key].dataType.simpleString()}, score double")


def _scorer(shared, key: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gauge = Gauge(shared.value)
        bias, *w = shared.value.weights
        for whole in batches:
            for batch in slices(whole, 1):
                x = np.array([gauge.features(t) for t in batch.column(1).to_pylist()], float).reshape(-1, 3)
                score = 1 / (1 + np.exp(-np.clip(bias + x @ np.array(w), -30, 30)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], [key, "score"])

    return run
