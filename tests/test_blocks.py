"""Blocks give what the joins give: null and repeated entries, heavy lines, rows over a task's budget; and they shuffle no product."""

import numpy as np
import pytest

from tests.test_grouped import odd, rows  # noqa: F401
from tripleloom import Matrix, spgemm
from tripleloom.operators import bitmaps, blocks, grouped, masked, tiles
from tripleloom.operators import multiply as mul
from tripleloom.operators import rowstats


def made(a, b) -> list[list[str]]:
    return [
        rows(spgemm(a, b, broadcast_rows=0).entries), rows(spgemm(a, b, upper=True, broadcast_rows=0).entries),
        rows(spgemm(a, b, method="outer", task_products=20000).entries), rows(spgemm(a, b, method="columnwise", upper=True, task_products=50).entries),
        rows(mul.symbolic(a, b)), rows(mul.symbolic(a, b, upper=True)), rows(mul.output_row_lengths(a, b)), rows(rowstats.bucket_lengths(a, b, 5)),
    ]


def in_blocks(monkeypatch, side=1 << 20):
    monkeypatch.setattr(blocks, "BLOCKED", 0)
    monkeypatch.setattr(bitmaps, "BROADCAST_BITMAPS", 0)
    monkeypatch.setattr(blocks, "LEAST", 6)
    monkeypatch.setattr(blocks, "SIDE", side)


@pytest.mark.parametrize("side, once", [(1 << 20, grouped.AT_ONCE), (300, 7)])
def test_blocks_make_what_the_joins_make(odd, monkeypatch, side, once):  # noqa: F811
    a, b = odd
    # A hot row and a hot column: with 300 entries to a range they are heavy.
    hot = a.entries.sparkSession.range(1200).selectExpr("3L i", "id % 40 j", "double(id) v")
    a = Matrix(a.entries.unionByName(hot), a.rows, a.cols)
    b = Matrix(b.entries.unionByName(hot.selectExpr("j i", "7L j", "v")), b.rows, b.cols)
    monkeypatch.setattr(bitmaps, "by_bitmaps", lambda work, least=0: False)
    wanted = made(a, b)
    in_blocks(monkeypatch, side)
    monkeypatch.setattr(grouped, "AT_ONCE", once)
    assert blocks.line_ranges(a.entries, "i", a.nnz(), 6).heavy == ([3] if side == 300 else [])
    assert made(a, b) == wanted


def test_blocks_shuffle_each_entry_once(odd, monkeypatch):  # noqa: F811
    a, b = odd
    in_blocks(monkeypatch)
    for c in (spgemm(a, b, broadcast_rows=0).entries, spgemm(a, b, method="outer", task_products=300).entries, mul.symbolic(a, b)):
        plan = c._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" in plan and "FlatMapCoGroupsInArrow" not in plan and "hashpartitioning" not in plan


def test_packs_give_back_what_they_got():
    rng = np.random.default_rng(5)
    columns = [
        np.sort(rng.integers(-5, 1 << 40, 1000)), rng.integers(7, 9, 1000), np.r_[grouped.MISSING, 5, 1 << 62], np.zeros(0, np.int64), np.full(9, 1 << 33),
        rng.integers(0, 50, 1000).astype(float), rng.random(100), np.r_[0.5, 1.25], np.r_[0.0, -0.0], np.r_[1.0, np.nan, np.inf], np.zeros(0), np.r_[1e300, 2.0],
    ]
    pack = blocks.packed(columns)
    for one, other in zip(columns, blocks.unpacked(memoryview(pack)), strict=True):
        assert one.dtype == other.dtype and one.tobytes() == other.tobytes()
    assert len(blocks.packed([rng.integers(0, 50, 8000).astype(float)])) < 8000


def test_a_pair_of_packs_is_one_task(odd, monkeypatch):  # noqa: F811
    a, b = odd
    in_blocks(monkeypatch, 50)
    left, right = mul.left_side(a), mul.right_side(b)
    found = blocks.line_ranges(left, "i", a.nnz(), 10), blocks.line_ranges(right, "j", b.nnz(), 14)
    packs = blocks.entry_packs(left, found[0], "i", "lv", "a"), blocks.entry_packs(right, found[1], "j", "rv", "b")
    pairs = blocks.met(*packs)
    per_task = pairs.selectExpr("spark_partition_id() p").groupBy("p").count().collect()
    assert len(per_task) == found[0].count * found[1].count and {r["count"] for r in per_task} == {1}
    n = {r["r"]: r["n"] for r in found[0].placed(left.where("k is not null"), "i").groupBy("r").agg({"*": "count"}).toDF("r", "n").collect()}
    assert max(n.values()) < 3 * 500 / 10


def test_known_positions_meet_in_blocks(odd, spark, monkeypatch):  # noqa: F811
    a, b = odd
    a, b = (Matrix(m.entries.where("v is not null"), m.rows, m.cols) for m in (a, b))
    b = Matrix(b.entries.where("j > 1 or j is null"), b.rows, b.cols)
    # Positions of empty rows and columns, and before the first column, stay.
    structure = mul.pair_positions(mul.left_side(a), b).where("(i + j) % 3 = 0 or i is null or j is null").unionByName(spark.range(3).selectExpr("id i", "id j"))
    structure = structure.unionByName(spark.sql("select 1000L i, 5L j union all select 5L, 2000L")).distinct()
    wanted = [rows(masked.masked_product(structure, a, b).entries), rows(masked.product_plan(structure, a, b))]
    monkeypatch.setattr(masked, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(blocks, "BLOCKED", 0)
    monkeypatch.setattr(blocks, "LEAST", 6)
    made = [masked.masked_product(structure, a, b).entries, masked.product_plan(structure, a, b)]
    assert all("CartesianProduct" in df._jdf.queryExecution().executedPlan().toString() for df in made)
    assert [rows(df) for df in made] == wanted


@pytest.mark.parametrize("shape", [(20, 3), (20, 33)])
def test_tiles_travel_with_their_ranges(matrix, monkeypatch, shape):
    m = np.arange(1.0, shape[0] * shape[1] + 1).reshape(shape) % 7
    wanted = m @ m.T
    for bound, kind in ((tiles.COPIED, "FlatMapCoGroups"), (0, "CartesianProduct")):
        monkeypatch.setattr(tiles, "COPIED", bound)
        monkeypatch.setattr(blocks, "LEAST", 4)
        c = tiles.tiled_product(matrix(m), matrix(m.T), edge=4, side=2).entries
        plan = c._jdf.queryExecution().executedPlan().toString()
        assert kind in plan and (bound or "FlatMapCoGroups" not in plan)
        assert {(r["i"], r["j"]): r["v"] for r in c.collect()} == {(i, j): v for (i, j), v in np.ndenumerate(wanted)}
        upper = tiles.tiled_product(matrix(m), matrix(m.T), edge=4, side=2, upper=True).entries
        assert {(r["i"], r["j"]): r["v"] for r in upper.collect()} == {(i, j): v for (i, j), v in np.ndenumerate(wanted) if j >= i}
