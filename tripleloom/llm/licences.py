"""Licence scans by a trained paragraph classifier.

Native: DataFrame functions and pyspark.ml only.  A paragraph is a line, or words
around a line end: a notice may be wrapped over lines up to the next blank one.  Its
sparse features are the word bigrams and trigrams that occur in the templates; a
multinomial logistic regression with an L1 penalty gives the family, with
``unknown`` as one class.  The unknown class is calibrated: a prediction counts
when its probability exceeds a threshold counted over all paragraphs of the table without
licence wording whose texts the fit has not seen.  A template comparison then confirms the family: the share of a
template's word trigrams that the paragraph holds.

A paragraph without any word of a feature has only the intercepts, which say unknown,
so it needs no scoring.  The scan is a projection of the documents; nothing is shuffled.

Training rows: the templates with their parts, and distinct paragraphs of at most
``sample`` distinct texts (those with the smallest hashes) as unknown.

Defined results: a null or empty text has no paragraphs; repeated rows are scanned
one by one; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleloom.llm.quality import bound
from tripleloom.session import written

UNKNOWN = "unknown"
#: Punctuation and white space that end a word, all but points, plus signs and line feeds.
BREAK = r"[\x09\x0B-\x0D!-*,\-/:-@\[-`{-~]+"
#: Words that say nothing about a licence when no other word is beside them.
COMMON = "a an and any are as at be by for from in is it may of on or that the this to v. with you".split()

#: Notices by which works state their licence.
TEMPLATES = (
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("mit", "Released under the MIT License."),
    ("mit", "This project is licensed under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("agpl", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Licensed under the BSD 3-Clause License."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc0", "Released under CC0 1.0 Universal, dedicated to the public domain."),
    ("reserved", "All rights reserved."),
)


@dataclass(frozen=True)
class LicenceModel:
    families: tuple[str, ...]
    grams: tuple[str, ...]
    weights: tuple[tuple[float, ...], ...]
    intercepts: tuple[float, ...]
    threshold: float


def plain(text: Column) -> Column:
    """Lower case, with spaces between words; points at the end of words are cut off, inner ones stay (``2.0``)."""
    bare = F.regexp_replace(F.lower(F.concat(text, F.lit(" "))), BREAK, " ")
    return F.replace(F.replace(bare, F.lit(". "), F.lit(" ")), F.lit(".\n"), F.lit("\n"))


def split_words(line: Column) -> Column:
    return F.array_remove(F.split(line, " ", -1), "")


def words_of(line: Column) -> Column:
    return split_words(plain(line))


def grams_of(words: Column, n: int) -> Column:
    last = F.size(words) - (n - 1)
    return F.when(last < 1, F.array().cast("array<string>")).otherwise(
        bound(words, lambda w: F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(w, i, n), " ")))
    )


def features_of(words: Column) -> Column:
    """Distinct bigrams and trigrams with a word beside the common ones."""
    telling = F.filter(F.concat(grams_of(words, 2), grams_of(words, 3)), lambda g: F.size(F.array_except(F.split(g, " "), F.lit(COMMON))) > 0)
    return F.array_distinct(telling)


def literal_rows(spark, names: str, rows) -> DataFrame:
    """A small table written out in the plan."""
    fields = names.split()
    items = [F.struct(*[F.lit(v).alias(f) for f, v in zip(fields, row, strict=True)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*items)))


def template_table(spark, templates=TEMPLATES) -> DataFrame:
    rows = literal_rows(spark, "family number text", [(f, n, t) for n, (f, t) in enumerate(templates)])
    return rows.withColumn("words", words_of(F.col("text"))).drop("text")


def train_licences(
    docs: DataFrame, text: str = "text", templates=TEMPLATES, sample: int = 400, paragraphs: int = 20_000, beyond: float = 0.001
) -> LicenceModel:
    """Fit on bounded rows, calibrate on the whole table.

    ``sample`` distinct texts and ``paragraphs`` distinct paragraphs of them, those with the smallest
    hashes, bound the unknown rows of the fit.  The threshold is of all other texts: the probability that at most
    the share ``beyond`` of the distinct feature sets of paragraphs without licence wording exceed.
    """
    known = template_table(docs.sparkSession, templates)
    grams = [r[0] for r in known.select(F.explode(features_of(F.col("words")))).distinct().sort("col").collect()]
    families = sorted({f for f, _ in templates}) + [UNKNOWN]
    # Each template whole, and with words before or after it as a longer line has them.
    parts = known.select("family", F.col("words"), F.explode(F.lit([1.0, 1.0, 1.0])).alias("weight"))
    listed = sorted(r[0] for r in known.select(F.explode(grams_of(F.col("words"), 3)).alias("g")).distinct().collect())
    worded = lambda words: F.exists(grams_of(words, 3), lambda g: g.isin(listed))
    texts = docs.select(F.col(text).alias("t")).where("t is not null").withColumn("h", F.xxhash64("t"))
    # The texts follow once the hashes, eight bytes each, say which they are; copies count once.
    smallest = [r[0] for r in texts.select("h").distinct().orderBy("h").limit(sample).collect()]
    last = smallest[-1] if smallest else 0
    lines = texts.where(F.col("h") <= last).select(F.explode(F.split("t", "\n")).alias("line")).select(words_of(F.col("line")).alias("words"))
    other = written(
        lines.where((F.size("words") > 0) & ~worded(F.col("words"))).distinct().orderBy(F.xxhash64("words"), "words").limit(paragraphs)
    )
    vector = lambda df: df.withColumn("x", array_to_vector(presence(F.col("words"), grams)))
    label = F.array_position(F.lit(families), F.col("family")).cast("double") - 1
    # Words of running text that templates hold too, so that single shared bigrams do not suffice.
    pieces = known.select(F.lit(UNKNOWN).alias("family"), F.explode(grams_of(F.col("words"), 2)).alias("g"))
    pieces = pieces.distinct().select("family", F.split("g", " ").alias("words"), F.lit(0.3).alias("weight"))
    unknown = other.select(F.lit(UNKNOWN).alias("family"), "words", F.lit(0.05).alias("weight"))
    rows = vector(parts.unionByName(pieces).unionByName(unknown)).withColumn("label", label).coalesce(1)
    fit = LogisticRegression(
        featuresCol="x", labelCol="label", weightCol="weight", family="multinomial", regParam=0.001, elasticNetParam=0.5,
        standardization=False, maxIter=60,
    ).fit(rows)
    weights = tuple(tuple(float(w) for w in column) for column in fit.coefficientMatrix.toArray().T)
    intercepts = tuple(float(b) for b in fit.interceptVector.toArray())
    model = LicenceModel(tuple(families), tuple(grams), weights, intercepts, 0.0)
    held = texts.where(F.col("h") > last).select(F.explode(F.split(plain(F.col("t")), "\n")).alias("line"))
    return replace(model, threshold=calibrated(held.select(split_words(F.col("line")).alias("words")), model, worded, beyond))


def calibrated(paragraphs: DataFrame, model: LicenceModel, worded: Callable[[Column], Column], beyond: float) -> float:
    """The family probability that at most ``beyond`` of the distinct feature sets of paragraphs without licence wording exceed.

    The sets are made distinct before they are scored, so that copies of one line do not decide;
    the counts of probabilities, rounded down to 1/1000, are at most 1,001 rows.  0.0 without any such paragraph.
    """
    near = paragraphs.where(F.arrays_overlap("words", F.lit(telling_words(model))) & ~worded(F.col("words")))
    sets = near.select(F.explode(F.filter(F.array(F.array_sort(hits(F.col("words"), model.grams))), lambda h: F.size(h) > 0)).alias("hits"))
    highest = F.array_max(F.slice(probabilities(F.col("hits"), model), 1, len(model.families) - 1))
    counts = sets.distinct().groupBy(F.floor(1000 * highest).cast("int").alias("level")).agg(F.count("*").alias("n")).sort(F.desc("level")).collect()
    room, level = beyond * sum(r["n"] for r in counts), 0
    for r in counts:
        room -= r["n"]
        if room < 0:
            level = r["level"] + 1
            break
    return min(level, 1000) / 1000


def telling_words(model: LicenceModel) -> list[str]:
    return sorted({w for g in model.grams for w in g.split(" ")} - set(COMMON))


def presence(words: Column, grams: list[str]) -> Column:
    return bound(features_of(words), lambda f: F.transform(F.lit(grams), lambda g: F.array_contains(f, g).cast("double")))


def hits(words: Column, grams) -> Column:
    """The features of a paragraph."""
    known = list(grams)
    pick = lambda n: F.filter(grams_of(words, n), lambda g: g.isin([k for k in known if k.count(" ") == n - 1]))
    return F.array_distinct(F.concat(pick(2), pick(3)))


def probabilities(features: Column, model: LicenceModel) -> Column:
    """One probability per family: intercepts plus the weights of the features, then softmax."""
    table = F.lit([[float(w) for w in row] for row in model.weights])
    at = lambda g: F.array_position(F.lit(list(model.grams)), g).cast("int")
    add = lambda total, g: F.zip_with(total, F.element_at(table, at(g)), lambda a, b: a + b)
    scores = F.aggregate(features, F.lit(list(model.intercepts)), add)
    return bound(
        bound(scores, lambda s: F.transform(s, lambda v: F.exp(v - F.array_max(s)))),
        lambda e: F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b)),
    )


def licence_scan(docs: DataFrame, model: LicenceModel, key: str = "doc_id", text: str = "text", templates=TEMPLATES, confirm: float = 0.7) -> DataFrame:
    """``(key, paragraph, family, probability, similarity, confirmed)`` for each paragraph taken for a licence.

    ``paragraph`` counts lines from 0.  The join has the templates on one side: a fixed list.
    Notices over several lines are reported, confirmed ones only, at the line where they begin,
    and again at a following line where ``confirm`` of them lies from there on.
    """
    telling = telling_words(model)
    lines = docs.select(F.col(key), F.posexplode(F.split(plain(F.coalesce(text, F.lit(""))), "\n", -1)).alias("paragraph", "line"))
    words = lines.select(key, "paragraph", split_words(F.col("line")).alias("words")).where(F.arrays_overlap("words", F.lit(telling)))
    # Each step is unpacked from an array, so that the optimizer does not write it out again in the later filters.
    found = words.select("*", F.explode(F.filter(F.array(hits(F.col("words"), model.grams)), lambda h: F.size(h) > 0)).alias("hits"))
    scored = found.select("*", F.explode(F.array(probabilities(F.col("hits"), model))).alias("p"))
    best = F.array_max("p")
    family = F.element_at(F.lit(list(model.families)), F.array_position("p", best).cast("int"))
    named = scored.select(key, "paragraph", "words", F.inline(F.array(F.struct(best.alias("probability"), family.alias("family")))))
    taken = named.where((F.col("family") != UNKNOWN) & (F.col("probability") > model.threshold))
    known = template_table(docs.sparkSession, templates)
    shapes = known.select("family", compared(F.col("words")).alias("shape")).groupBy("family").agg(F.collect_list("shape").alias("shapes"))
    mine = taken.withColumn("own", compared(F.col("words"))).join(F.broadcast(shapes), "family")
    share = F.array_max(F.transform("shapes", lambda s: F.size(F.array_intersect(s, F.col("own"))) / F.size(s)))
    alone = mine.select(key, "paragraph", "family", "probability", share.alias("similarity"), (share >= confirm).alias("confirmed"))
    return alone.unionByName(wrapped_notices(docs, model, key, text, templates, confirm))


def wrapped_notices(docs: DataFrame, model: LicenceModel, key: str, text: str, templates, confirm: float) -> DataFrame:
    """The notices that no single line confirms.

    For each line end inside a block of lines with words: as many words as the longest template
    has, before it in the line and after it in the block.  A template counts if it has enough
    trigrams there, fewer in each single line, and some that need the first line; it gives way to one with
    a larger share that holds the same trigrams, and to one of its family that lies within it or holds it.  The classifier sees the features of the template that are present.
    """
    telling = telling_words(model)
    known = template_table(docs.sparkSession, templates)
    shapes = known.select("family", compared(F.col("words")).alias("shape"), features_of(F.col("words")).alias("features"), F.size("words").alias("n"))
    shapes = shapes.collect()
    longest = max(r["n"] for r in shapes)
    forms = F.array(*[F.struct(F.lit(r["family"]).alias("family"), F.lit(r["shape"]).alias("shape"), F.lit(r["features"]).alias("features")) for r in shapes])
    listed = sorted({g for r in shapes for g in r["shape"]})

    def after(lines: Column, i: Column) -> Column:
        """The lines after line ``i``, each cut to ``longest`` words, up to a blank one or until there are enough words."""
        state = F.struct(F.array().cast("array<array<string>>").alias("lines"), F.lit(0).alias("n"))
        full = lambda s, w: (s["n"] >= longest) | (F.size(w) == 0)
        step = lambda s, w: F.when(full(s, w), F.struct(s["lines"].alias("lines"), F.lit(longest).alias("n"))).otherwise(
            F.struct(F.concat(s["lines"], F.array(F.slice(w, 1, F.lit(longest) - s["n"]))).alias("lines"), (s["n"] + F.size(w)).alias("n"))
        )
        return F.aggregate(F.slice(lines, i + 2, longest), state, step, lambda s: s["lines"])

    lines = docs.select(F.col(key), F.transform(F.split(plain(F.coalesce(text, F.lit(""))), "\n", -1), split_words).alias("lines"))
    tail = lambda w: F.slice(w, F.greatest(F.size(w) - (longest - 1), F.lit(1)), longest)
    starts = F.filter(
        F.transform("lines", lambda w, i: F.when(
            F.arrays_overlap(w, F.lit(telling)) & (F.size(F.get("lines", i + 1)) > 0),
            F.struct(i.alias("paragraph"), tail(w).alias("head"), after(F.col("lines"), i).alias("more")),
        )),
        lambda x: x.isNotNull(),
    )
    parts = lines.select(key, F.inline(starts))
    parts = parts.select("*", F.explode(F.array(F.flatten("more"))).alias("rest"))
    parts = parts.select("*", F.explode(F.array(F.concat("head", "rest"))).alias("words"))
    own = F.filter(F.array(F.filter(compared(F.col("words")), lambda g: g.isin(listed))), lambda g: F.size(g) > 0)
    parts = parts.select("*", F.explode(own).alias("own"))
    singles = F.transform(F.concat(F.array("head"), "more"), compared)
    parts = parts.withColumns({"singles": singles, "later": compared(F.col("rest"))})
    held = F.filter(
        F.transform(forms, lambda f: F.struct(f["family"].alias("family"), f["features"].alias("features"), f["shape"].alias("shape"), F.array_intersect(f["shape"], F.col("own")).alias("met"))),
        lambda f: F.size(f["met"]) >= confirm * F.size(f["shape"]),
    )
    some = parts.select(key, "paragraph", "words", "singles", "later", F.explode(F.filter(F.array(held), lambda h: F.size(h) > 0)).alias("held"))
    portion = lambda f: F.size(f["met"]) / F.size(f["shape"])
    single = lambda f: F.exists("singles", lambda s: F.size(F.array_intersect(f["shape"], s)) >= confirm * F.size(f["shape"]))
    within = lambda f, g: F.size(F.array_except(f["met"], g["met"])) == 0

    def beaten(f: Column) -> Column:
        def by(g: Column) -> Column:
            larger = portion(g) > portion(f)
            longer = (portion(g) == portion(f)) & (F.size(g["shape"]) > F.size(f["shape"]))
            same = (g["family"] == f["family"]) & ((within(g, f) & (single(g) | larger)) | (within(f, g) & longer))
            return (larger & within(f, g)) | same

        return F.exists("held", by)

    begins = lambda f: F.size(F.array_intersect(f["shape"], F.col("later"))) < F.size(f["met"])
    forms_met = some.select(key, "paragraph", "words", F.explode(F.filter("held", lambda f: begins(f) & ~single(f) & ~beaten(f))).alias("f"))
    fitted = forms_met.select(key, "paragraph", "f", F.explode(F.array(F.array_intersect(hits(F.col("words"), model.grams), F.col("f.features")))).alias("hits"))
    scored = fitted.select(key, "paragraph", "f", F.explode(F.array(probabilities(F.col("hits"), model))).alias("p"))
    best = F.array_max("p")
    family = F.element_at(F.lit(list(model.families)), F.array_position("p", best).cast("int"))
    taken = scored.where((family == F.col("f.family")) & (best > model.threshold))
    return taken.select(key, "paragraph", family.alias("family"), best.alias("probability"), portion(F.col("f")).alias("similarity"), F.lit(True).alias("confirmed"))


def compared(words: Column) -> Column:
    """Distinct trigrams, or the words of a text that has fewer than three."""
    return F.when(F.size(words) < 3, words).otherwise(F.array_distinct(grams_of(words, 3)))
