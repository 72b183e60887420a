"""Decontamination, line dedup and the Jaccard join against brute force."""

import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import rows_of
from tripleloom.llm import decontaminate, jaccard, line_dedup
from tripleloom.llm.components import components


def words(draw, n, names=400):
    return [f"w{draw.randrange(names)}" for _ in range(n)]


# -- decontamination --------------------------------------------------------------------------


@pytest.fixture(scope="module")
def leaks(spark, docs):
    draw = random.Random(7)
    items = [(n, words(draw, draw.randrange(14, 60))) for n in range(20)] + [(20, words(draw, 9)), (21, words(draw, 5)), (22, [])]
    rows, wanted = [], set()
    for n, item in items[:21]:
        for _ in range(4):
            body, own = words(draw, draw.randrange(0, 200), 9000), list(item)
            edit = draw.choice(["none", "one", "half"]) if len(own) > 12 else "none"
            if edit == "one":
                own[draw.randrange(len(own))] = "other"
            if edit == "half":
                own = own[: max(13, len(own) // 2)]
            at = draw.randrange(len(body) + 1)
            wanted.add((len(rows), n))
            rows.append((len(rows), " ".join(body[:at] + own + body[at:]).upper().replace(" ", ", ")))
    rows += [(len(rows) + n, " ".join(words(draw, 300))) for n in range(40)]
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in items] + [(30, None)], "item_id long, text string")
    return docs(rows), bench, wanted


@pytest.mark.parametrize("block", [1_000_000, 150])
def test_leaks_are_found(leaks, block):
    rows, bench, wanted = leaks
    found = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminations(rows, bench, block_words=block).collect()}
    assert set(found) == wanted
    assert all(r["equal_words"] <= r["length"] for r in found.values())
    kept = {r["doc_id"] for r in decontaminate.decontaminated(rows, bench, block_words=block).collect()}
    assert kept == set(range(rows.count())) - {d for d, _ in wanted}


def placed_hits(masks, length, subs):
    """Whether some mask, laid somewhere in the item, keeps none of the substituted places."""
    return any(
        all(at + k not in subs for k, kept in enumerate(mask) if kept == "1") for mask in masks for at in range(length - len(mask) + 1)
    )


@pytest.mark.parametrize("length", range(3, 31))
def test_masks_leave_a_hit_for_all_placements(length):
    for subs in combinations(range(length), decontaminate.allowed(length)):
        assert placed_hits(decontaminate.masks_of(length), length, set(subs)), subs


@pytest.mark.parametrize("length", range(12, 16))
def test_masks_of_long_items_hit_stretches(length):
    for subs in combinations(range(length), min(2, length - 10)):
        assert placed_hits(decontaminate.masks_of(40), length, set(subs)), subs


def test_short_items_with_all_substitutions(spark, docs):
    """Items of 3 to 20 words, one document for each placement of up to one substitution more than allowed."""
    draw = random.Random(12)
    rows, sure, possible, items = [], set(), set(), []
    for length in range(3, 21):
        item = [f"w{length}x{k}" for k in range(length)]
        items.append((length, " ".join(item)))
        for n in range(decontaminate.allowed(length) + 2):
            placements = list(combinations(range(length), n))
            for subs in placements if len(placements) <= 200 else draw.sample(placements, 200):
                own = ["other" if k in subs else w for k, w in enumerate(item)]
                gain = best = 0
                run = top = 0
                for k in range(length):
                    gain, run = (gain + 1, run + 1) if k not in subs else (gain - 3, run)
                    if gain < 0:
                        gain = run = 0
                    if gain > best:
                        best, top = gain, run
                whole = n <= decontaminate.allowed(length)
                clean = any(not any(at <= s < at + 12 for s in subs) for at in range(length - 11))
                if whole or clean or n == 3 and top >= 12 and length - max(subs) + min(subs) > 13:
                    sure.add((len(rows), length))
                if whole or top >= 12:
                    possible.add((len(rows), length))
                rows.append((len(rows), " ".join(["start", "here"] * 3 + own + ["end"])))
    bench = spark.createDataFrame([*items, (1, "alpha"), (2, "start here"), (None, "")], "item_id long, text string")
    found = decontaminate.contaminations(docs(rows), bench).collect()
    assert sure <= {(r["doc_id"], r["item_id"]) for r in found} <= possible


def test_contaminations_equal_all_diagonals(spark, docs):
    """Against every diagonal of every document and item, over few words, so that much agrees by chance."""
    draw = random.Random(13)
    items = [[draw.choice("abcdefghijkl") for _ in range(draw.randrange(3, 25))] for _ in range(12)]
    rows = []
    for n in range(120):
        body = [draw.choice("abcdefghijkl") for _ in range(draw.randrange(40))]
        own = list(draw.choice(items))
        for _ in range(draw.randrange(4)):
            own[draw.randrange(len(own))] = draw.choice("abcdefghijkl")
        at = draw.randrange(len(body) + 1)
        rows.append((n, body[:at] + own + body[at:]))
    least, sure, possible = 12, set(), set()
    for n, words_ in rows:
        for m, item in enumerate(items):
            for shift in range(-len(item) + 1, len(words_)):
                same = [0 <= k + shift < len(words_) and words_[k + shift] == w for k, w in enumerate(item)]
                if sum(same) >= len(item) - decontaminate.allowed(len(item)):
                    sure.add((n, m))
                gain = run = 0
                for hit in same:
                    gain, run = (gain + 1, run + 1) if hit else (gain - 3, run)
                    if gain < 0:
                        gain = run = 0
                    if run >= least:
                        possible.add((n, m))
    bench = spark.createDataFrame([(m, " ".join(w)) for m, w in enumerate(items)], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminations(docs([(n, " ".join(w)) for n, w in rows]), bench).collect()}
    assert sure <= found <= sure | possible


def test_items_without_ids_of_their_own(spark, docs):
    bench = spark.createDataFrame([(None, f"word{n} and some more words of item number {n} here to be found") for n in range(30)], "item_id long, text string")
    rows = [(n, f"so word{n} and some more words of item number {n} here to be found x") for n in range(30)]
    blocks = list(decontaminate.benchmark_blocks(bench, "item_id", "text", 12, 60))
    assert len(blocks) > 3 and sum(len(b.ids) for b in blocks) == 30
    assert decontaminate.decontaminated(docs(rows), bench, block_words=60).count() == 0
    same = decontaminate.contaminations(docs(rows), bench.withColumnRenamed("item_id", "doc_id"), item="doc_id")
    assert same.columns[:2] == ["doc_id", "benchmark_doc_id"]


def test_contaminations_awkward(spark, awkward, nothing):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta " * 4), (None, "alpha beta gamma delta " * 4), (2, None)], "item_id long, text string")
    found = decontaminate.contaminations(awkward, bench).collect()
    assert Counter((r["doc_id"], r["item_id"]) for r in found) == {(4, 1): 2, (4, None): 2}
    assert decontaminate.decontaminated(awkward, bench).columns == awkward.columns
    assert decontaminate.decontaminated(awkward, bench).count() == 6
    assert decontaminate.contaminations(nothing, bench).count() == 0
    assert decontaminate.contaminations(awkward, bench.limit(0)).count() == 0
    assert decontaminate.decontaminated(awkward, bench.limit(0)).count() == 8


# -- lines ------------------------------------------------------------------------------------

SPACE = " \t\n\x0b\x0c\r"


def brute_lines(rows, shortest=40, least=5):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    keys = lambda t: [line.strip(SPACE).translate(lower) for line in (t or "").split("\n")]
    holders = defaultdict(set)
    for i, t in rows:
        for k in keys(t):
            if len(k) >= shortest:
                holders[k].add(i)
    out = {}
    for i, t in rows:
        gone = [len(holders.get(k, ())) >= least and i != max(holders[k]) for k in keys(t)]
        out[i] = (len(gone), sum(gone), "\n".join(x for x, g in zip((t or "").split("\n"), gone) if not g))
    return out


def test_filters_follow_the_lines(docs, monkeypatch):
    """Filters of many slices suspect what repeats and few others, whatever the number of lines."""
    monkeypatch.setattr(line_dedup, "WIDTH", 1 << 12)
    for n in (500, 8_000):
        rows = docs([(k, "\n".join(f"a line of its own with number {k} and {m} in it" for m in range(20)) + "\n" + "the same line in each of the documents " * 2) for k in range(n // 20)])
        filters = line_dedup.repeat_filter(rows, "text", 40)
        assert len(filters) == (1 << (12 * n).bit_length()) // 4096 or len(filters) == (1 << (12 * (n + n // 20)).bit_length()) // 4096
        _, suspects = line_dedup.repeated_lines(rows)
        assert n // 20 <= suspects.count() <= n // 20 + 0.05 * n
    assert line_dedup.repeat_filter(rows, "text", 40, most=1 << 10) is None


@pytest.mark.parametrize("bits, keys", [(None, 500_000), (1 << 27, 500_000), (1 << 14, 500_000), (1 << 20, 0), (1 << 40, 0)])
def test_lines_equal_brute_force(docs, bits, keys):
    draw = random.Random(8)
    shared = ["Line %d " % n + "é" * draw.randrange(20, 60) + " END" for n in range(12)]
    rows = [
        (i, "\n".join(draw.choice([draw.choice(shared), " " + draw.choice(shared).upper() + "\t", f"own line {draw.random()} " * 3, ""]) for _ in range(draw.randrange(8))))
        for i in range(120)
    ]
    found = rows_of(line_dedup.deduplicated(docs(rows), bits=bits, broadcast_keys=keys))
    assert {i: (r["n_lines"], r["n_dropped"], r["text"]) for i, r in found.items()} == brute_lines(rows)


@pytest.mark.parametrize("keys", [500_000, 0])
def test_lines_awkward(docs, awkward, nothing, keys):
    line = "a line that is long enough to be compared with others"
    rows = docs([(None, line), (None, line), (1, line), (2, line), (2, line)]).withColumn("n_lines", F.lit("x"))
    found = line_dedup.deduplicated(rows, broadcast_keys=keys).collect()
    assert Counter((r["doc_id"], r["text"]) for r in found) == {(None, ""): 2, (1, ""): 1, (2, line): 2}
    assert {type(r["n_lines"]) for r in found} == {int}
    same = line_dedup.deduplicated(awkward, broadcast_keys=keys)
    assert same.where("n_dropped > 0").count() == 0 and same.count() == 8
    assert line_dedup.deduplicated(nothing, broadcast_keys=keys).count() == 0


# -- Jaccard ----------------------------------------------------------------------------------


def brute_components(rows, n, num, den):
    sets = {}
    for i, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    for i, s in sets.items():
        for j, both in Counter(j for g in s for j in holders[g] if j > i).items():
            if den * both >= num * (len(s) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


def near_copies(seed):
    draw = random.Random(seed)
    rows = []
    for size in [1, 2, 3, 4, 5, 6, 7, 8, 10, 13, 17, 25, 40, 70, 120, 250, 600] * 3:
        base = words(draw, size)
        for _ in range(10):
            own = list(base)
            for _ in range(draw.randrange(0, max(2, size // 20) + 1)):
                own[draw.randrange(size)] = f"x{draw.randrange(10**6)}"
            rows.append((len(rows), " ".join(own[: size - draw.randrange(0, size // 7 + 1)] if draw.random() < 0.3 else own)))
    return rows + [(len(rows), ""), (len(rows) + 1, None), (len(rows) + 2, "\n \t")]


@pytest.mark.parametrize("n, num, den", [(4, 85, 100), (5, 80, 100)])
def test_components_equal_brute_force(docs, n, num, den):
    rows = near_copies(n)
    found = rows_of(jaccard.similar_documents(docs(rows), n=n, num=num, den=den))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in found.items()} == brute_components(rows, n, num, den)


def test_large_groups_go_through_tiles(docs, monkeypatch):
    """A group of near copies around a centre that is not the smallest node, in small tiles."""
    monkeypatch.setattr(jaccard, "TILE", 3_000)
    monkeypatch.setattr(jaccard, "SMALL", 3)
    draw = random.Random(11)
    base = words(draw, 90)
    rows = []
    for i in range(150):
        own = list(base)
        for _ in range(draw.randrange(0, 3)):
            own[draw.randrange(90)] = f"x{draw.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    found = rows_of(jaccard.similar_documents(docs(rows)))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in found.items()} == brute_components(rows, 4, 85, 100)


def test_one_of_each_keeps_smallest(docs):
    text = "one two three four five six seven eight nine ten"
    kept = jaccard.one_of_each(docs([(5, text), (3, text), (9, "other words altogether"), (None, text), (1, "")]))
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [1, 3, 9]


def test_one_of_each_with_repeated_and_null_keys(docs):
    text = "one two three four five six seven eight nine ten"
    for keys, left in (([1, 1, None, None, 2], [1]), ([None, None], [None]), ([None, 7], [7]), ([4, 4, 4], [4])):
        kept = jaccard.one_of_each(docs([(k, text) for k in keys] + [(9, None), (9, None), (None, "")]))
        assert sorted((r["doc_id"] or -1 for r in kept.where("text = '" + text + "'").collect())) == [k or -1 for k in left]
        assert kept.where("coalesce(text, '') = ''").count() == 3
    near = docs([(3, text), (3, text + " eleven"), (3, text + " eleven"), (8, "something else entirely")]).withColumn("id", F.monotonically_increasing_id())
    kept = jaccard.one_of_each(near, n=2)
    assert kept.columns == near.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 8]


def test_jaccard_awkward(awkward, nothing):
    found = jaccard.similar_documents(awkward).collect()
    assert len(found) == 8
    by_id = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found}
    assert by_id[1] == (0, 1) and by_id[4] == (4, 4) and by_id[None] == (1, None)
    assert jaccard.similar_documents(nothing).count() == 0


def test_star_contraction(spark):
    """Long paths, a star and a cycle."""
    path = [(n, n + 1) for n in range(60)]
    star = [(100, 100 + n) for n in range(1, 50)]
    cycle = [(200 + n, 200 + (n + 1) % 9) for n in range(9)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(path + star + cycle, "a long, b long")).collect()}
    assert found == dict.fromkeys(range(61), 0) | dict.fromkeys(range(100, 150), 100) | dict.fromkeys(range(200, 209), 200)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def shuffled_path(n, seed):
    ids = list(range(1, n + 1))
    random.Random(seed).shuffle(ids)
    return list(zip(ids, ids[1:]))


@pytest.mark.parametrize("links", [[(4, 1), (4, 3), (5, 3), (5, 2)], *[shuffled_path(n, s) for n, s in ((5, 3), (6, 19), (7, 8), (8, 10))]])
def test_single_paths_are_one_component(spark, links):
    """Alone, such a path has a round where a node holds two roots and no root holds a smaller node."""
    found = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert sorted(map(tuple, found)) == [(n, 1) for n in range(1, len(links) + 2)]
