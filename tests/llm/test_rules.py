"""Quality rules, sharding, licences, toxicity and the pipeline."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import rows_of
from tests.oracle import problem
from tripleloom.llm import licences, pieces, quality, queries, sharding, toxicity
from tripleloom.llm.sql import SQL

FOLDER = "/root/testdata/sf0.001"


def brute_repeats(words, window=8):
    places = defaultdict(list)
    for i in range(len(words) - window + 1):
        places[tuple(words[i : i + window])].append(i)
    return len({i + k for at in places.values() if len(at) > 1 for i in at for k in range(window)})


def test_repeated_words_equal_brute_force(docs):
    draw = random.Random(1)
    rows = [(i, " ".join(draw.choice("abc") for _ in range(draw.randrange(60)))) for i in range(200)]
    rows += [(200 + i, ("one two three four five six seven eight nine " * n)) for i, n in enumerate(range(5))]
    found = rows_of(quality.quality_features(docs(rows)))
    for i, text in rows:
        assert found[i]["n_repeat_words"] == brute_repeats(text.split()), text


def test_quality_equals_sql(spark, docs):
    """Nulls, empty texts and odd white space through the SQL too."""
    draw = random.Random(2)
    names = ["x" * n for n in range(1, 9)] + ["##", "$a", "Aé", "日本"]
    texts = ["".join(draw.choice(names) + draw.choice([" ", " ", "\n", "\t", "\x0b", "\n\n"]) for _ in range(draw.randrange(80))) for _ in range(300)]
    texts += [None, "", " \n ", "same line here\n" * 30]
    df = docs(list(enumerate(texts))).withColumn("source", F.when(F.col("doc_id") % 3 == 0, None).otherwise("s"))
    df = df.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en"))
    documents = df.toArrow()  # noqa: F841  read by name below
    con = duckdb.connect()
    con.register("documents", documents)
    columns = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept".split()
    found = quality.quality_rules(df, keep_text=False).select(columns).toPandas()
    assert problem(found, con.execute(SQL["op9_quality_rules"]).df()) is None


def test_sketches_merge(docs):
    rows = quality.quality_features(docs([(i, "word " * (20 + i)) for i in range(50)]))
    parts = [quality.quality_sketch(rows.where(F.col("doc_id") % 2 == n)) for n in (0, 1)]
    whole = {tuple(r) for r in quality.quality_sketch(rows).collect()}
    assert {tuple(r) for r in quality.merged_sketches(*parts).collect()} == whole


def test_buckets_are_ordered_and_close(spark):
    rows = spark.range(0, 200_000, 37).select("id", quality.bucket_of(F.col("id")).alias("b"))
    found = rows.select("id", "b", quality.lower_edge(F.col("b")).alias("edge")).orderBy("id").toPandas()
    assert (np.diff(found.b) >= 0).all() and (found.edge <= found.id).all()
    assert (found.id - found.edge <= found.id / 16).all()


def test_quality_awkward(awkward, nothing):
    found = quality.quality_rules(awkward).collect()
    assert len(found) == 8 and {r["doc_id"]: r["n_words"] for r in found}[4] == 120_000
    assert all(not r["kept"] for r in found if r["doc_id"] in (1, 2, 3))
    assert quality.quality_rules(nothing).count() == 0


# -- sharding ---------------------------------------------------------------------------------


def test_curve_visits_neighbours():
    for dims in (2, 3):
        place = sharding.curve(dims)
        assert sorted(place) == list(range(len(place)))
        cells = np.argsort(place)
        axes = np.stack([cells >> (sharding.BITS * d) & 15 for d in range(dims)])
        assert (np.abs(np.diff(axes, axis=1)).sum(axis=0) == 1).all()


@pytest.mark.parametrize("per_block", [50_000, 7])
def test_shards_hold_the_law(spark, per_block):
    rows = spark.range(1003).select("id", (F.col("id") % 3).alias("a"), F.lit(1.0).alias("b"), F.lit("x").alias("shard"))
    dims = {"a": F.col("a").cast("double"), "b": F.col("b")}
    found = sharding.hilbert_shards(rows, dims, "id", 40, per_block=per_block).collect()
    slots = defaultdict(list)
    for r in found:
        slots[r["shard"]].append((r["slot"], r["curve"]))
    assert sorted(slots) == list(range(40))
    assert {len(s) for s in slots.values()} == {25, 26}
    assert all(sorted(n for n, _ in s) == list(range(len(s))) for s in slots.values())
    order = [c for s in sorted(slots) for _, c in sorted(slots[s])]
    assert order == sorted(order)


def test_shards_few_and_none(spark):
    rows = spark.createDataFrame([(1, None), (2, "b"), (2, "b"), (None, None)], "id long, s string")
    dims = {"s": F.col("s")}
    found = sharding.hilbert_shards(rows, dims, "id", 40).collect()
    assert len({r["shard"] for r in found}) == 4 and {r["slot"] for r in found} == {0}
    assert sharding.hilbert_shards(rows.limit(0), dims, "id", 40).count() == 0


def test_whole_values_are_ranked(spark):
    names = [None, "", *[f"common-crawl-src{n}" for n in range(20)], "src1", "src10", "src2", "é"]
    rows = spark.createDataFrame([(s,) for s in names for _ in range(3)] + [("src1",)] * 900, "s string").repartition(5)
    found = {r["s"]: r["code"] for r in sharding.value_codes(rows, "s", 10).collect()}
    order = [found[s] for s in [None, *sorted(names[1:], key=lambda s: s.encode())]]
    assert order == sorted(order) and len(set(order)) == len(names)
    before, total = 0, rows.count()
    for s in [None, *sorted(names[1:], key=lambda s: s.encode())]:
        n = 903 if s == "src1" else 3
        assert found[s] == (2 * before + n) * 1024 // (2 * total)
        before += n


def test_shards_equal_plain_python(spark):
    draw = random.Random(4)
    rows = [(k, draw.choice([None, "de", "en", "fr"]), draw.choice("abcdefg") * 9, draw.choice([None, 1, 5, 7, draw.randrange(1000)])) for k in range(700)]
    df = spark.createDataFrame(rows, "id long, lang string, source string, size long").withColumn("Curve", F.lit("c")).withColumn("slot", F.lit("s")).repartition(6)
    out = sharding.hilbert_shards(df, {c: F.col(c) for c in ("lang", "source", "size")}, "id", 13)
    assert sorted(out.columns) == ["curve", "id", "lang", "shard", "size", "slot", "source"]
    found = rows_of(out, "id")

    def ranks(values, key):
        order = sorted(set(values), key=key)
        before, code = 0, {}
        for v in order:
            code[v] = (2 * before + values.count(v)) * 16 // (2 * len(values))
            before += values.count(v)
        return code

    text = lambda v: (v is not None, (v or "").encode())
    lang, source = ranks([r[1] for r in rows], text), ranks([r[2] for r in rows], text)
    sizes = sorted(float("-inf") if r[3] is None else r[3] for r in rows)
    cuts = [sizes[math.ceil(len(sizes) * n / 16) - 1] for n in range(1, 16)]
    place = sharding.curve(3)
    for k, la, so, si in rows:
        size = sum((float("-inf") if si is None else si) > c for c in cuts)
        assert found[k]["curve"] == place[lang[la] | source[so] << 4 | size << 8]
    order = sorted(found.values(), key=lambda r: (r["shard"], r["slot"]))
    assert [r["curve"] for r in order] == sorted(r["curve"] for r in order)
    assert [(r["shard"], r["slot"]) for r in order] == [(s, n) for s in range(13) for n in range(sum(k * 13 // 700 == s for k in range(700)))]


def test_boxes_prune(spark):
    found = queries.op10_sharding(spark, "/root/testdata/sf0.01").select("doc_id", "shard")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    per = found.join(docs, "doc_id").groupBy("shard").agg(F.count_distinct("lang").alias("langs"), F.count_distinct("source").alias("sources")).collect()
    assert sum(r["langs"] == 4 for r in per) < len(per) / 2
    assert sum(r["sources"] for r in per) < 0.7 * 20 * len(per)


def test_shard_query(spark):
    found = queries.op10_sharding(spark, FOLDER).toPandas()
    texts = spark.read.parquet(f"{FOLDER}/documents.parquet").toPandas().set_index("doc_id").text
    assert Counter(found.groupby("shard").size()) == {5: 40}
    for r in found.itertuples():
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))


# -- licences ---------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def licence_model(spark):
    return licences.train_licences(spark.read.parquet(f"{FOLDER}/documents.parquet"), sample=100)


def test_licences_of_the_table(spark, licence_model):
    """The notices of the table against patterns."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    patterns = {"apache": "Apache License", "mit": "MIT License", "gpl": "General Public", "cc-by-nc": "CC BY-NC", "reserved": "All rights reserved"}
    wanted = {(r.doc_id, n, f) for r in rows.collect() for n, line in enumerate(r.text.split("\n")) for f, p in patterns.items() if p in line}
    found = licences.licence_scan(rows, licence_model).where("confirmed").collect()
    assert {(r["doc_id"], r["paragraph"], r["family"]) for r in found} == wanted


def test_licences_among_near_misses(docs, licence_model):
    lines = {
        0: "// LICENSED UNDER THE APACHE LICENSE, VERSION 2.0!", 1: "The software of the work is free for you to use.",
        2: "He was licensed to drive.", 3: "See: this project is licensed under the MIT license (2020).", 4: "Public version 3 of the report",
        5: "", 6: "This library is licensed under the GNU Lesser General Public License, version 3.",
    }
    found = licences.licence_scan(docs([(1, "\n".join(lines.values()))]), licence_model).where("confirmed").collect()
    assert {r["paragraph"]: r["family"] for r in found} == {0: "apache", 3: "mit", 6: "lgpl"}


WRAPPED = {
    "apache": "Licensed under the Apache\nLicense, Version 2.0 (the \"License\"); you may not use this file except\nin compliance with the License.",
    "gpl": "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction",
    "bsd": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:",
}


@pytest.mark.parametrize("family", WRAPPED)
def test_wrapped_notices_are_confirmed(docs, licence_model, family):
    """At the line where they begin; a blank line ends a notice."""
    text = WRAPPED[family]
    rows = [(1, text), (2, "Some other words\nbefore it.\n" + text + "\nand after"), (3, text.replace("\n", "\n\n"))]
    found = licences.licence_scan(docs(rows), licence_model).where("confirmed").collect()
    assert sorted((r["doc_id"], r["paragraph"], r["family"]) for r in found) == [(1, 0, family), (2, 2, family)]


def test_licences_awkward(awkward, nothing, licence_model):
    assert licences.licence_scan(awkward, licence_model).count() == 0
    assert licences.licence_scan(nothing, licence_model).count() == 0
    assert licences.train_licences(nothing).families == licence_model.families


def brute_licences(text, model, confirm=0.7):
    """Single lines by plain Python from the model's numbers."""
    out = set()
    for n, line in enumerate((text or "").split("\n")):
        words = [w[:-1] if w.endswith(".") else w for w in re.sub(licences.BREAK, " ", line.lower() + " ").split(" ")]
        words = [w for w in words if w]
        runs = lambda w, k: [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)]
        have = {g for g in runs(words, 2) + runs(words, 3) if g in model.grams}
        if not have:
            continue
        score = [b + sum(model.weights[model.grams.index(g)][k] for g in have) for k, b in enumerate(model.intercepts)]
        power = [math.exp(v - max(score)) for v in score]
        best = max(power) / sum(power)
        family = model.families[power.index(max(power))]
        if family == licences.UNKNOWN or best <= model.threshold:
            continue
        shapes = [re.sub(licences.BREAK, " ", t.lower() + " ").replace(". ", " ").split() for f, t in licences.TEMPLATES if f == family]
        shapes = [set(runs(w, 3)) if len(w) > 2 else set(w) for w in shapes]
        own = set(runs(words, 3)) if len(words) > 2 else set(words)
        share = max(len(s & own) / len(s) for s in shapes)
        out.add((n, family, round(best, 6), round(share, 6), share >= confirm))
    return out


def test_licence_scan_equals_plain_python(docs, licence_model):
    """Whole notices, cut ones and words of several notices mixed, in lines apart from each other."""
    draw = random.Random(5)
    texts = [t for _, t in licences.TEMPLATES]
    pool = [w for t in texts for w in t.split()] + "some other words of a report".split()
    lines = []
    for _ in range(200):
        words = draw.choice(texts).split()
        words = words[draw.randrange(3) : len(words) - draw.randrange(4)]
        lines.append(" ".join(words + [draw.choice(pool) for _ in range(draw.randrange(6))]))
        lines.append(" ".join(draw.choice(pool) for _ in range(draw.randrange(1, 12))))
    rows = [(i, "\n\n".join(lines[i * 10 : i * 10 + 10])) for i in range(40)]
    found = defaultdict(set)
    for r in licences.licence_scan(docs(rows), licence_model).collect():
        found[r["doc_id"]].add((r["paragraph"], r["family"], round(r["probability"], 6), round(r["similarity"], 6), r["confirmed"]))
    wanted = {i: brute_licences(t, licence_model) for i, t in rows}
    assert {i: w for i, w in wanted.items() if w} == dict(found) and sum(map(len, found.values())) > 100


def test_licence_threshold_follows_the_table(docs):
    """It moves with paragraphs that resemble notices; copies of one line change nothing; no text of the fit takes part."""
    plain = [(i, f"report {i} of the water of lake {i * 7}") for i in range(60)]
    near = [(100 + i, f"the general public {i} met at redistribution and lake {i}") for i in range(200)]
    fit = lambda rows: licences.train_licences(docs(rows), sample=40).threshold
    low, high = fit(plain), fit(plain + near)
    assert low == 0.0 and 0.0 < high < 0.9
    assert fit(plain + near + [(1000 + i, near[0][1]) for i in range(500)]) == high


def test_licences_repeated_and_long(docs, licence_model):
    """A notice is reported for each row and each line that has it, also at the end of a very long line."""
    notice = "Released under the MIT License."
    rows = [(1, notice), (1, notice), (2, notice + "\n\n" + notice), (3, "lake water report " * 60_000 + notice)]
    found = licences.licence_scan(docs(rows), licence_model).where("confirmed").collect()
    assert sorted((r["doc_id"], r["paragraph"], r["family"]) for r in found) == [(1, 0, "mit"), (1, 0, "mit"), (2, 0, "mit"), (2, 2, "mit"), (3, 0, "mit")]


# -- toxicity ---------------------------------------------------------------------------------


def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet").toPandas().set_index("doc_id").toxic
    found = queries.op5_toxicity(spark, folder).toPandas()
    assert found.score.between(0, 1).all() and (found.predicted == (found.score >= 0.5)).all()
    assert (found.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in found.doc_id]).all()
    held = found[found.held_out & found.doc_id.isin(labels.index)]
    truth = labels[held.doc_id].to_numpy()
    assert held.predicted[truth == 1].mean() > 0.85
    assert held.predicted[truth == 0].mean() < 0.02


def test_toxicity_awkward(spark, awkward, nothing):
    labels = spark.createDataFrame([(4, 1), (1, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train_toxicity(awkward, labels)
    found = toxicity.toxicity_scores(awkward, model).collect()
    assert len(found) == 8 and all(0 <= r["score"] <= 1 for r in found)
    assert toxicity.toxicity_scores(nothing, model).count() == 0
    unlabelled = toxicity.train_toxicity(awkward, labels.limit(0))
    assert all(r["score"] < 0.01 for r in toxicity.toxicity_scores(awkward, unlabelled).collect())


# -- pipeline ---------------------------------------------------------------------------------


def test_pipeline_equals_brute_force(spark):
    """Each stage by plain Python on its own input."""
    from tests.llm.test_matching import brute_components, brute_lines

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    bench = [r.text.lower() for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    table = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    stages = dict(corpus_pipeline.STAGES)
    folder = corpus_pipeline.shared_folder(spark)
    seen, rows = [table(docs)], docs
    for name in list(stages)[:-1]:
        out = stages[name](spark, rows, FOLDER)
        assert out.columns == list(corpus_pipeline.COLUMNS)
        path = f"{folder}/stage-{name}"
        out.write.mode("overwrite").parquet(path)
        rows = spark.read.parquet(path)
        seen.append(table(rows))
    start, kept, lines, single, clean = seen
    judged = duckdb.connect().execute(SQL["op9_quality_rules"].replace("FROM documents", f"FROM '{FOLDER}/documents.parquet'")).df()
    assert set(kept) == set(judged.doc_id[judged.kept]) and len(kept) > 0.7 * len(start)
    assert lines == {i: t for i, (_, _, t) in brute_lines(list(kept.items())).items()}
    assert set(single) == {root for i, (_, root) in brute_components(list(lines.items()), 5, 80, 100).items()}
    plain = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    leaked = {i for i, t in single.items() if any(plain(b) in plain(t) for b in bench)}
    assert leaked and set(clean) == set(single) - leaked
    last = {r["doc_id"]: r for r in corpus_pipeline.run(spark, FOLDER).collect()}
    model = pieces.vocabulary(queries.PIECE_BPE)
    assert set(last) == set(clean)
    assert all(last[i]["pieces"] == model.encode([t])[0] and last[i]["round_trip"] for i, t in clean.items())
