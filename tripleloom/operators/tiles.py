"""Dense accumulation: square tiles multiplied inside tasks, for matrices with few zeros.

Tiles bound what a task holds (a block's factors and one row of its result) and cut the
shuffled rows by up to the tile edge against single products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleloom.functions.scalar import whole
from tripleloom.matrix import Matrix
from tripleloom.operators import blocks
from tripleloom.plans.sizing import broadcast_if_small


def to_tiles(m: Matrix, edge: int) -> DataFrame:
    """``(bi, bj, li, lj, v)``: one row per tile that holds an entry."""
    e = m.combined().entries
    return (
        e.select(
            whole(F.col("i"), edge).alias("bi"),
            whole(F.col("j"), edge).alias("bj"),
            F.struct(
                F.pmod("i", F.lit(edge)).cast("int").alias("r"),
                F.pmod("j", F.lit(edge)).cast("int").alias("c"),
                F.col("v").alias("v"),
            ).alias("cell"),
        )
        .groupBy("bi", "bj")
        .agg(F.collect_list("cell").alias("cells"))
        .select("bi", "bj", F.col("cells.r").alias("li"), F.col("cells.c").alias("lj"), F.col("cells.v").alias("v"))
    )


#: Tiles of either side that meet in one block; a block's dense factors have ``SIDE * edge`` rows and columns.
SIDE = 8
#: Rows of a tile that travel together.
STRIP = 8
#: Copies of tiles from which tiles travel with the ranges of their tile rows and columns.
COPIED = 1 << 20
#: Strips that a task adds up before it hands them on.
HELD = 4_096
PARTIAL = "bi long, bj long, strip int, cell array<int>, v array<double>"


def block_grid(a: Matrix, b: Matrix, edge: int, side: int) -> DataFrame:
    """``(bk, lparts, rparts)``: blocks of at most about ``side`` tiles, by the counted tiles of each inner tile index."""

    def counted(m: Matrix, inner: str, outer: str, name: str) -> DataFrame:
        tiles = m.entries.select(whole(F.col(inner), edge).alias("bk"), whole(F.col(outer), edge).alias("o")).distinct()
        return tiles.groupBy("bk").agg(F.ceil(F.count(F.lit(1)) / F.lit(side)).cast("int").alias(name))

    return counted(a, "j", "i", "lparts").join(counted(b, "i", "j", "rparts"), "bk")


def tiled_product(
    a: Matrix, b: Matrix, edge: int = 128, upper: bool = False, eps: float | None = None, side: int = SIDE
) -> Matrix:
    """``A·B`` by dense tiles; an entry exists where a product contributes, as with every method.

    The tiles of each inner tile index are counted and cut into a grid of blocks of about ``side``
    by ``side`` tiles, so an index that all tiles share is many blocks, and every pair of tiles meets in one.
    A block is one dense product.  Its results travel as arrays of filled cells, are added
    up in the task that makes them, and once more where all parts of a tile meet.

    With ``eps`` entries with ``|v| <= eps`` are dropped, as dense results have no structure.
    """
    a.require_inner(b)
    grid = broadcast_if_small(block_grid(a, b, edge, side))
    entries = _tiles_in_ranges(a, b, edge, upper, side)
    if entries is None:
        entries = _tiles_dealt(a, b, grid, edge, upper, side)
    if upper:
        entries = entries.where("j >= i")
    if eps is not None:
        entries = entries.where(F.abs("v") > eps)
    return Matrix(entries, a.rows, b.cols)


def _tiles_in_ranges(a: Matrix, b: Matrix, edge: int, upper: bool, side: int) -> DataFrame | None:
    """Cells of the product where copies of tiles would be many, else None.

    A range of tile rows and one of tile columns come to a task once and are cut into blocks of ``side`` tiles there; with all inner
    tile indices in place, nothing is added up elsewhere.
    """
    left, right = to_tiles(a, edge), to_tiles(b, edge)
    inner = left.groupBy("bj").agg(F.count(F.lit(1)).alias("l")).withColumnRenamed("bj", "bk").join(
        right.groupBy("bi").agg(F.count(F.lit(1)).alias("r")).withColumnRenamed("bi", "bk"), "bk"
    )
    pairs = F.col("l").cast("double") * F.col("r")
    facts = inner.agg(F.sum(pairs).alias("pairs"), F.sum("l").alias("l"), F.sum("r").alias("r")).first()
    # A pair of tiles has its share of a block's copies.
    if 2 * (facts["pairs"] or 0) / side <= COPIED:
        return None
    cells = edge * edge
    counts = blocks.grid(facts["l"] * cells, facts["r"] * cells, int(facts["pairs"]) * cells, blocks.MADE)
    rows, columns = blocks.line_ranges(left, "bi", facts["l"] * cells, counts[0]), blocks.line_ranges(right, "bj", facts["r"] * cells, counts[1])
    if rows.heavy or columns.heavy:
        return None
    one = blocks.packs(left.withColumnRenamed("bj", "bk"), rows, "bi", _tile_pack("bi"), blocks.PACK, "a")
    other = blocks.packs(right.withColumnRenamed("bi", "bk"), columns, "bj", _tile_pack("bj"), blocks.PACK, "b")
    met = blocks.met(one, other, upper).select("a_pack", "b_pack")
    return met.mapInArrow(_multiply_ranges(edge, upper, side), "i long, j long, v double")


def _tile_pack(outer: str):
    def pack(tiles: pa.Table) -> dict[str, object]:
        tiles = tiles.select(["bk", outer, "li", "lj", "v"]).sort_by([("bk", "ascending"), (outer, "ascending")])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, tiles.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
            stream.write_table(tiles)
        return {"pack": sink.getvalue().to_pybytes()}

    return pack


def _multiply_ranges(edge: int, upper: bool, side: int):
    multiply, added, cells = _multiply_blocks(edge, upper), _added(edge, HELD), _cells(edge)

    def parts(tiles: pa.Table, outer: str) -> list[dict[int, pa.Table]]:
        """Blocks of ``side`` tile numbers, each with its tiles by inner index."""
        bk, own = (tiles.column(c).to_numpy() for c in ("bk", outer))
        numbers, number = np.unique(own, return_inverse=True)
        found = []
        for block in range(0, len(numbers), side):
            mine = np.flatnonzero((number >= block) & (number < block + side))
            ends = np.r_[0, np.flatnonzero(np.diff(bk[mine])) + 1, len(mine)]
            found.append({int(bk[mine[low]]): tiles.take(pa.array(mine[low:high])).combine_chunks() for low, high in zip(ends, ends[1:])})
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                left, right = (pa.ipc.open_stream(batch.column(c)[n].as_buffer()).read_all().combine_chunks() for c in ("a_pack", "b_pack"))
                columns = parts(right, "bj")
                for mine in parts(left, "bi"):
                    for other in columns:
                        common = sorted(mine.keys() & other.keys())
                        strips = (x for k in common for x in multiply(mine[k], other[k]).to_batches())
                        yield from cells(strips if len(common) == 1 else added(strips))

    return run


def _tiles_dealt(a: Matrix, b: Matrix, grid: DataFrame, edge: int, upper: bool, side: int) -> DataFrame:
    """Cells of the product; a tile is copied to each of its blocks."""
    keys = ["bk", "ls", "rs"]

    def dealt(tiles: DataFrame, outer: str, own: str, parts: str, other: str, every: str) -> DataFrame:
        mine = F.pmod(F.xxhash64(outer), F.col(parts)).cast("int").alias(own)
        copies = F.explode(F.sequence(F.lit(0), F.col(every) - 1)).alias(other)
        return tiles.join(grid, "bk").select("bk", mine, copies, outer, "li", "lj", "v")

    left = dealt(to_tiles(a, edge).withColumnRenamed("bj", "bk"), "bi", "ls", "lparts", "rs", "rparts")
    right = dealt(to_tiles(b, edge).withColumnRenamed("bi", "bk"), "bj", "rs", "rparts", "ls", "lparts")
    blocks = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_multiply_blocks(edge, upper), PARTIAL)
    strips = blocks
    # With one inner tile index a strip has one part, in the block that made it: there is nothing to add up.
    if grid.count() > 1:
        partial = blocks.mapInArrow(_added(edge, HELD), PARTIAL)
        strips = partial.repartition("bi", "bj", "strip").sortWithinPartitions("bi", "bj", "strip").mapInArrow(_added(edge, 1), PARTIAL)
    return strips.mapInArrow(_cells(edge), "i long, j long, v double")


def _dense(tiles: pa.Table, outer: str, edge: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tile numbers, and the tiles of a block one after another with their stored places."""
    numbers = tiles.column(outer).to_numpy()
    size = np.diff(tiles.column("v").combine_chunks().offsets.to_numpy())
    tile = np.repeat(np.arange(len(numbers)), size)
    cell = [tiles.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("li", "lj", "v")]
    values = np.zeros((len(numbers), edge, edge))
    values[tile, cell[0], cell[1]] = cell[2]
    stored = np.zeros(values.shape, np.float32)
    stored[tile, cell[0], cell[1]] = 1.0
    return numbers, values, stored


def _multiply_blocks(edge: int, upper: bool):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, columns, strips, cells, values = [], [], [], [], []
        if left.num_rows and right.num_rows:
            bi, lv, lm = _dense(left, "bi", edge)
            bj, rv, rm = _dense(right, "bj", edge)
            across = [x.transpose(1, 0, 2).reshape(edge, -1) for x in (rv, rm)]
            for n, i in enumerate(bi.tolist()):
                out, met = lv[n] @ across[0], (lm[n] @ across[1]) > 0
                for m, j in enumerate(bj.tolist()):
                    if upper and j < i:
                        continue
                    part, mask = out[:, m * edge : (m + 1) * edge], met[:, m * edge : (m + 1) * edge]
                    for strip in range(0, edge, STRIP):
                        cell = np.flatnonzero(mask[strip : strip + STRIP])
                        if len(cell):
                            rows.append(i)
                            columns.append(j)
                            strips.append(strip // STRIP)
                            cells.append(cell)
                            values.append(part[strip : strip + STRIP].ravel()[cell])
        return pa.Table.from_batches([_strips(rows, columns, strips, cells, values)])

    return run


def _strips(rows: list, columns: list, strips: list, cells: list, values: list) -> pa.RecordBatch:
    offsets = pa.array(np.concatenate([[0], np.cumsum([len(c) for c in cells])]).astype(np.int32))
    flat = [np.concatenate(x) if x else np.zeros(0) for x in (cells, values)]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(rows, pa.int64()), pa.array(columns, pa.int64()), pa.array(strips, pa.int32()),
            pa.ListArray.from_arrays(offsets, pa.array(flat[0].astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(flat[1].astype(float))),
        ],
        ["bi", "bj", "strip", "cell", "v"],
    )


def _added(edge: int, most: int):
    """Strips of one place added up, while ``most`` of them or fewer are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}

        def flush() -> pa.RecordBatch:
            places = list(held)
            cells = [np.flatnonzero(mask) for _, mask in held.values()]
            values = [total[c] for (total, _), c in zip(held.values(), cells)]
            held.clear()
            return _strips(*([p[n] for p in places] for n in range(3)), cells, values)

        for batch in batches:
            ready = []
            cell, v = batch.column(3), batch.column(4)
            offsets = cell.offsets.to_numpy() - cell.offsets[0].as_py()
            flat, numbers = cell.flatten().to_numpy(zero_copy_only=False), v.flatten().to_numpy(zero_copy_only=False)
            for n, place in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)))):
                if place not in held:
                    if len(held) >= most:
                        ready.append(flush())
                    held[place] = np.zeros(STRIP * edge), np.zeros(STRIP * edge, bool)
                mine = flat[offsets[n] : offsets[n + 1]]
                held[place][0][mine] += numbers[offsets[n] : offsets[n + 1]]
                held[place][1][mine] = True
            if ready:
                yield from pa.Table.from_batches(ready).combine_chunks().to_batches()
        if held:
            yield flush()

    return run


def _cells(edge: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.diff(batch.column(3).offsets.to_numpy())
            cell = batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            bi, bj, strip = (np.repeat(batch.column(c).to_numpy().astype(np.int64), size) for c in range(3))
            yield pa.RecordBatch.from_arrays(
                [pa.array(bi * edge + strip * STRIP + cell // edge), pa.array(bj * edge + cell % edge), batch.column(4).flatten()], ["i", "j", "v"]
            )

    return run
