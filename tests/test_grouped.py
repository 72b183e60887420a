"""Row groups give what the joins give: null and repeated entries, rows over the budget, both ways of counting."""

import numpy as np
import pytest

from tripleloom import Matrix, spgemm
from tripleloom.operators import bitmaps, grouped, masked
from tripleloom.operators import multiply as mul
from tripleloom.operators import rowstats, sketches
from tripleloom.plans import workload


def rows(df) -> list[str]:
    return sorted(map(repr, df.collect()))


@pytest.fixture(scope="module")
def odd(spark):
    """Two matrices with repeated positions, and nulls in each column."""
    rng = np.random.default_rng(1)

    def build(n, m, entries):
        drawn = [[int(i), int(j), float(v)] for i, j, v in zip(rng.integers(0, n, entries), rng.integers(0, m, entries), rng.integers(-3, 9, entries))]
        for x in range(9):
            drawn[x][x % 3] = None
        return Matrix(spark.createDataFrame([tuple(r) for r in drawn], "i long, j long, v double"), n, m)

    return build(60, 40, 500), build(40, 900, 700)


def made(a, b) -> list[list[str]]:
    return [
        rows(mul.spgemm(a, b, broadcast_rows=0).entries), rows(spgemm(a, b, upper=True, broadcast_rows=0).entries),
        rows(mul.symbolic(a, b)), rows(mul.output_row_lengths(a, b)), rows(rowstats.bucket_lengths(a, b, 5)),
    ]


@pytest.mark.parametrize("longest, held", [(grouped.LONGEST, grouped.HELD), (grouped.LONGEST, 0), (100, grouped.HELD)])
def test_groups_make_what_the_joins_make(odd, monkeypatch, longest, held):
    a, b = odd
    monkeypatch.setattr(bitmaps, "by_bitmaps", lambda work, least=0: False)
    wanted = made(a, b)
    monkeypatch.setattr(grouped, "GROUPED", 0)
    monkeypatch.setattr(bitmaps, "BROADCAST_BITMAPS", 0)
    monkeypatch.setattr(grouped, "LONGEST", longest)
    monkeypatch.setattr(grouped, "LEAST", 3)
    monkeypatch.setattr(grouped, "HELD", held)
    monkeypatch.setattr(grouped, "PIECE", 4)
    assert made(a, b) == wanted
    plan = mul.output_row_lengths(a, b)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan


@pytest.mark.parametrize("longest", [grouped.LONGEST, 100])
def test_registers_merge_in_groups(odd, monkeypatch, longest):
    a, b = odd
    wanted = [rows(sketches.merged_hll(a, b)), rows(sketches.merged_minhash(a, b))]
    monkeypatch.setattr(sketches, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(grouped, "LONGEST", longest)
    monkeypatch.setattr(grouped, "LEAST", 3)
    assert [rows(sketches.merged_hll(a, b)), rows(sketches.merged_minhash(a, b))] == wanted
    plan = sketches.merged_hll(a, b)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan


@pytest.mark.parametrize("longest", [grouped.LONGEST, 100])
def test_known_positions_meet_in_groups(odd, spark, monkeypatch, longest):
    a, b = odd
    a, b = (Matrix(m.entries.where("v is not null"), m.rows, m.cols) for m in (a, b))
    structure = mul.pair_positions(mul.left_side(a), b).where("(i + j) % 3 = 0 or i is null or j is null").unionByName(spark.range(3).selectExpr("id i", "id j"))
    wanted = [rows(masked.masked_product(structure, a, b).entries), rows(masked.product_plan(structure, a, b))]
    monkeypatch.setattr(masked, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(grouped, "LONGEST", longest)
    monkeypatch.setattr(grouped, "LEAST", 3)
    assert [rows(masked.masked_product(structure, a, b).entries), rows(masked.product_plan(structure, a, b))] == wanted


def test_native_sketches_merge_where_a_row_is(odd, monkeypatch):
    a, b = odd
    wanted = rows(sketches.native_hll_estimate(a, b))
    monkeypatch.setattr(sketches, "SKETCH_BYTES", 0)
    merged = sketches.native_hll_estimate(a, b)
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert rows(merged) == wanted and "REPARTITION_BY_NUM" in plan and "partial_hll_union_agg" not in plan.split("REPARTITION_BY_NUM")[1]


@pytest.mark.parametrize("bound", [50, 3])
def test_a_large_side_is_broadcast_in_slices(odd, bound):
    a, b = odd
    whole = rows(spgemm(a, b, method="broadcast").entries)
    assert rows(spgemm(a, b, method="broadcast", broadcast_rows=bound * 10).entries) == whole
    if bound == 3:
        few = Matrix(b.entries.where("i < 2"), b.rows, b.cols)
        assert rows(spgemm(a, few, method="broadcast", broadcast_rows=12).entries) == rows(spgemm(a, few, method="broadcast").entries)


def test_partitions_that_multiply_are_not_merged(spark, odd):
    a, b = odd
    left, right = workload.co_partitioned(mul.left_side(a), mul.right_side(b), ["k"], 3)
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    assert all(f", {usual})" in p and "REPARTITION_BY_NUM" in p for p in (df._jdf.queryExecution().executedPlan().toString() for df in (left, right)))


def test_many_products_are_shuffled_once(odd, monkeypatch):
    a, b = odd
    wanted = rows(spgemm(a, b, method="outer").entries)
    monkeypatch.setattr(grouped, "GROUPED", 0)
    c = spgemm(a, b, method="outer").entries
    assert rows(c) == wanted
    assert "REPARTITION_BY_NUM" in c._jdf.queryExecution().executedPlan().toString()


def test_crowded_products_add_up_in_groups(odd, monkeypatch):
    a, b = odd
    wanted = rows(spgemm(a, b).entries)
    monkeypatch.setattr(grouped, "GROUPED", 0)
    monkeypatch.setattr(grouped, "LEAST", 3)
    monkeypatch.setattr(mul, "CROWDED", 0)
    c = spgemm(a, b).entries
    assert rows(c) == wanted and "FlatMapCoGroupsInArrow" in c._jdf.queryExecution().executedPlan().toString()


def test_one_inner_tile_needs_no_second_shuffle(matrix):
    m = np.arange(1.0, 61).reshape(20, 3)
    c = mul.tiled_product(matrix(m), matrix(m.T), edge=4, side=2)
    assert {(r["i"], r["j"]): r["v"] for r in c.entries.collect()} == {(i, j): v for (i, j), v in np.ndenumerate(m @ m.T)}
    assert "Sort [bi" not in c.entries._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("far, step, types", [(0, 1.0, ("int", "float")), (1 << 33, 0.1, ("bigint", "double"))])
def test_arrays_travel_as_narrow_as_they_fit(spark, odd, monkeypatch, far, step, types):
    a, b = odd
    b = Matrix(b.entries.selectExpr("i", f"j + {far} * (j % 2) as j", f"v * {step}D as v"), b.rows, b.cols + far)
    wanted = [rows(spgemm(a, b, upper=upper, broadcast_rows=0).entries.selectExpr("i", "j", "round(v, 6) v")) for upper in (False, True)]
    arrays = grouped.row_arrays(mul.right_side(b), ["j", "rv"])
    assert tuple(t for _, t in arrays.dtypes) == ("bigint", f"array<{types[0]}>", f"array<{types[1]}>")
    monkeypatch.setattr(grouped, "GROUPED", 0)
    monkeypatch.setattr(grouped, "LEAST", 3)
    c = [spgemm(a, b, upper=upper, broadcast_rows=0).entries for upper in (False, True)]
    assert "FlatMapCoGroupsInArrow" in c[0]._jdf.queryExecution().executedPlan().toString()
    assert [rows(m.selectExpr("i", "j", "round(v, 6) v")) for m in c] == wanted


@pytest.mark.parametrize("bound", [masked.BROADCAST_ROWS, 0])
def test_plan_rows_without_numbers_look_nothing_up(spark, odd, monkeypatch, bound):
    a, b = (Matrix(m.entries.where("i is not null and j is not null and v is not null"), m.rows, m.cols) for m in odd)
    structure = mul.pair_positions(mul.left_side(a), b).unionByName(spark.range(3).selectExpr("id i", "id j"))
    wanted = rows(masked.masked_product(structure, a, b).entries)
    monkeypatch.setattr(masked, "BROADCAST_ROWS", bound)
    numbers = masked.numbered(a), masked.numbered(b)
    plan = masked.written(masked.product_plan(structure, a, b, numbers))
    # With equal entries the numbers may differ; the sums may not.
    c = masked.planned_product(plan, masked.entry_values(a, numbers[0]), masked.entry_values(b, numbers[1]), a.rows, b.cols).entries
    assert rows(c) == wanted
    assert "PushedFilters: [IsNotNull(le), IsNotNull(re)]" in c._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("ranges, longest", [(grouped.RANGES, grouped.LONGEST), (0, grouped.LONGEST), (grouped.RANGES, 100)])
def test_rows_find_their_group_by_its_first_row(odd, monkeypatch, ranges, longest):
    a, b = odd
    monkeypatch.setattr(grouped, "RANGES", ranges)
    monkeypatch.setattr(grouped, "LONGEST", longest)
    left, right = mul.left_side(a), mul.right_side(b)
    found = grouped.row_groups(left, right, a.rows, 50)
    rest = {r["i"] for r in found.rest.collect()} if found.rest is not None else set()
    groups = {r["i"]: r["g"] for r in found.groups.collect()}
    assert found.count > 3 and not rest & set(groups) and (longest > 100 or len(rest) > 1)
    placed = found.placed(left)
    got = {(r["i"], r["g"]) for r in placed.collect()}
    if ranges:
        assert rest or "Join" not in placed._jdf.queryExecution().optimizedPlan().toString()
        order = {g: n for n, g in enumerate(sorted(set(groups.values())))}
        assert {pair for pair in got if pair[0] in groups} == {(i, order[g]) for i, g in groups.items()}
        assert not {i for i, _ in got} & (rest | {None})
    else:
        assert found.firsts is None and got == set(groups.items())


def test_pairs_are_dealt_to_the_arrays_once(odd, monkeypatch):
    a, b = odd
    monkeypatch.setattr(grouped, "GROUPED", 0)
    c = mul.spgemm(a, b, broadcast_rows=0).entries
    plan = c._jdf.queryExecution().optimizedPlan().toString()
    usual = a.entries.sparkSession.conf.get("spark.sql.shuffle.partitions")
    # Both sides of the join on k have a fixed number of partitions.
    assert sum("RepartitionByExpression" in line and f"], {usual}" in line for line in plan.splitlines()) == 2
    assert plan.count("RepartitionByExpression") == 4 and "piece" not in plan
