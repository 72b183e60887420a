"""Links between documents whose sets of word shingles are similar, exactly and without all pairs.

A document is the set of its distinct hashed word n-grams; equal sets are one node.

**Bands and keys.** Sets are banded by size so that similar ones lie in the same or
adjacent bands.  Sets with Jaccard ``>= num/den`` differ in at most ``k`` elements,
so when the hash space is cut into ``k + 1 + c`` ranges, at least ``c + 1`` ranges hold
the same elements in both.  Each set gives one key per non-empty range, for its
band and the one below.  A set with more than ``c`` empty ranges also gives its smallest
hashes, one of which any similar set holds; a partner that shares empty ranges
only has as many, so nothing is lost.

**Tiles.** A tile is a block of one key's sets, or one set and those that share a key
with it; sets of a tile are compared inside a task.  Hashed bitmaps (two to four bits per element) bound
the overlap from above, ``min(|A| - |a & ~b|, |B| - |b & ~a|)`` by bit counts, before
sorted arrays are intersected exactly.  Tiles are cut by the number of elements.

**Rounds.** 1: each key's sets against its smallest id, once per distinct pair. 2: keys
whose sets are not yet one component: all pairs of different components, once per
distinct pair for keys of up to ``SMALL`` sets, tile by tile for others.  In both the
bitmaps come first; only sets that they leave possible are made again from the texts.
A tile keeps a union-find over the known components and reports joining links only.

Two shingles of one text, or two sets, are told apart by 64 bits of hash; nodes also by size.

Defined results: nulls, empty texts and texts without words have empty sets and
are linked with nothing; repeated rows and ids are classed by their sets; a component's
id ignores null ids; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripleloom.llm.components import components
from tripleloom.llm.words import SPACED, Words, mixed, shingles, slices
from tripleloom.session import written

#: Least width of a bitmap; a larger set has the next power of two above twice its size.
BITS = 1024
#: Elements of the sets of one tile, with 100 added for each set.
TILE = 200_000
SMALL = 24
#: Rows of a tile that are compared at once.
ROWS = 512
#: Possible pairs per row of a tile up to which they are checked one by one, each once whatever the key.
DENSE = 8
#: Bits of the filter that names the sets to be fetched, in slices.
FILTER_BITS, SLICES = 1 << 27, 64
#: Nodes that a task remembers, to give a repeated set's keys once.
SEEN = 500_000


@cache
def bands(num: int, den: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First size, number of ranges and tolerated empty ranges of each band, up to ``most`` elements."""
    first, parts, spare = [1], [], []
    while True:
        top = first[-1] * den // num
        k = (den - num) * (top + top * den // num) // (den + num)
        c = 0 if k == 0 else max(1, (k + 1) // 40)
        parts.append(k + 1 + c)
        spare.append(c)
        if top >= most:
            return np.array(first), np.array(parts), np.array(spare)
        first.append(top + 1)


def node_of(own: np.ndarray) -> int:
    """A set's id: a scrambled sum over its elements and its size."""
    total = mixed(own).sum(keepdims=True) + np.array([len(own)], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return int(mixed(total).view(np.int64)[0])


def keys_of(own: np.ndarray, num: int, den: int) -> np.ndarray:
    """Keys of one set for its band and the one below."""
    first, parts, spare = bands(num, den, 1 << max(12, len(own).bit_length()))
    mine = int(np.searchsorted(first, len(own), "right")) - 1
    deep = mixed(own ^ np.uint64(0x5DEECE66D))
    out = []
    for band in (mine, mine - 1):
        if band < 0:
            continue
        m = int(parts[band])
        part = ((own >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        salt = np.uint64(band * 1_000_003 + 17)
        out.append(mixed(np.add.reduceat(deep, starts) ^ mixed(part[starts] + (salt << np.uint64(24)))))
        if m - len(starts) > spare[band]:
            least = -(-num * len(own) // den)
            out.append(mixed(own[: len(own) - least + 1] ^ mixed(np.array([salt << np.uint64(25)], np.uint64))))
    return np.unique(np.concatenate(out))


def sets_of(batches: Iterator[pa.RecordBatch], column: int, n: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for whole in batches:
        for batch in slices(whole, column):
            words = Words(batch.column(column), SPACED)
            yield batch, shingles(words.hashes, words.first, n)


def bitmap(own: np.ndarray) -> bytes:
    width = max(BITS, 1 << (2 * len(own) - 1).bit_length())
    bits = np.zeros(width, bool)
    bits[(mixed(own) % np.uint64(width)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def document_nodes(docs: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """``(key, n_shingles, node, bits)`` per row; ``node`` and ``bits`` are null for an empty set."""

    def run(batches):
        for batch, sets in sets_of(batches, 1, n):
            size = pa.array([len(s) for s in sets], pa.int64())
            node = pa.array([node_of(s) if len(s) else None for s in sets], pa.int64())
            bits = pa.array([bitmap(s) if len(s) else None for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, node, bits], [key, "n_shingles", "node", "bits"])

    rows = docs.select(key, text)
    out = f"`{key}` {rows.schema[key].dataType.simpleString()}, n_shingles long, node long, bits binary"
    return rows.mapInArrow(run, out)


def node_keys(docs: DataFrame, text: str, n: int, num: int, den: int) -> DataFrame:
    """``(k, node)``: every key of every set, once per task."""

    def run(batches):
        seen: set[int] = set()
        for _, sets in sets_of(batches, 0, n):
            nodes, found = [], []
            for own in sets:
                if len(own) and (node := node_of(own)) not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(node)
                    found.append(keys_of(own, num, den))
                    nodes.append(node)
            size = [len(f) for f in found]
            every = np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(every), pa.array(np.repeat(np.array(nodes, np.int64), size))], ["k", "node"])

    return docs.select(text).mapInArrow(run, "k long, node long")


def named(nodes: DataFrame) -> np.ndarray:
    """A packed filter of ``FILTER_BITS`` bits with a bit set for every node, put together by slices."""
    width = FILTER_BITS // SLICES

    def run(batches):
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            place = mixed(batch.column(1).to_numpy().view(np.uint64)) % np.uint64(width)
            part = batch.column(0).to_numpy()
            for s in np.unique(part).tolist():
                parts.setdefault(s, np.zeros(width, bool))[place[part == s].astype(np.int64)] = True
        for s, bits in parts.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([np.packbits(bits).tobytes()])], ["slice", "bits"])

    rows = nodes.select(F.pmod("node", F.lit(SLICES)).cast("int").alias("slice"), "node").repartition(SLICES, "slice")
    out = np.zeros((SLICES, width // 8), np.uint8)
    for row in rows.mapInArrow(run, "slice int, bits binary").toLocalIterator():
        out[row["slice"]] |= np.frombuffer(row["bits"], np.uint8)
    return out


def contents(docs: DataFrame, text: str, n: int, wanted: DataFrame) -> DataFrame:
    """``(node, own)`` of the wanted nodes: the sorted arrays, made again from the texts."""
    shared = docs.sparkSession.sparkContext.broadcast(named(wanted))

    def run(batches):
        width, seen = FILTER_BITS // SLICES, set()
        for _, sets in sets_of(batches, 0, n):
            nodes, arrays = [], []
            for own in sets:
                if not len(own) or (node := node_of(own)) in seen:
                    continue
                place = int(mixed(np.array([node], np.int64).view(np.uint64))[0] % np.uint64(width))
                if shared.value[node % SLICES, place >> 3] >> (7 - (place & 7)) & 1:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(node)
                    nodes.append(node)
                    arrays.append(own.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(arrays, pa.binary())], ["node", "own"])

    rows = docs.select(text).mapInArrow(run, "node long, own binary")
    return written(rows.join(wanted, "node", "left_semi").dropDuplicates(["node"]))


class Tile:
    """Sets of one tile, rows ``(side, node, n, root, bits, own)``: side 0 against side 1, or all where ``square``."""

    def __init__(self, rows: list[tuple], num: int, den: int, square: bool):
        rows.sort(key=lambda r: r[:2])
        self.rows, self.num, self.den, self.square = rows, num, den, square
        self.side = np.array([r[0] for r in rows])
        self.size = np.array([r[2] for r in rows], np.int64)
        self.root = np.array([r[3] for r in rows], np.int64)
        # Wider bitmaps are folded to the least width; the places are residues of powers of two.
        width = min(len(r[4]) for r in rows)
        packed = np.stack([np.bitwise_or.reduce(np.frombuffer(r[4], np.uint8).reshape(-1, width), axis=0) for r in rows])
        self.bits = np.unpackbits(packed, axis=1).astype(np.float32)
        self.own = [np.frombuffer(r[5] or b"", np.uint64) for r in rows]

    def likely(self) -> Iterator[tuple[int, int, int]]:
        """Rows of different components whose overlap may reach the least one, and that least overlap."""
        left = np.arange(len(self.side)) if self.square else np.flatnonzero(self.side == 0)
        right = left if self.square else np.flatnonzero(self.side == 1)
        for at in range(0, len(left), ROWS):
            for to in range(0, len(right), ROWS):
                yield from self._block(left[at : at + ROWS], right[to : to + ROWS])

    def _block(self, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, int, int]]:
        a, b = self.size[left][:, None], self.size[right][None, :]
        common = self.bits[left] @ self.bits[right].T
        bound = np.minimum(a - self.bits[left].sum(1)[:, None] + common, b - self.bits[right].sum(1)[None, :] + common)
        least = -(-self.num * (a + b) // (self.num + self.den))
        likely = (bound >= least) & (self.root[left][:, None] != self.root[right][None, :])
        if self.square:
            likely &= left[:, None] < right[None, :]
        for x, y in np.argwhere(likely).tolist():
            yield int(left[x]), int(right[y]), int(least[x, y])

    def links(self) -> list[tuple[int, int]]:
        """Pairs of nodes that join components of the tile, exactly."""
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = x = parent.get(up, up)
            return x

        out = []
        for u, v, least in self.likely():
            p, q = find(int(self.root[u])), find(int(self.root[v]))
            if p != q and overlap(self.own[u], self.own[v]) >= least:
                parent[max(p, q)] = min(p, q)
                out.append((self.rows[u][1], self.rows[v][1]))
        return out


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common elements of two sorted arrays."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())


TILE_COLUMNS = ("k", "t", "u", "side", "node", "n", "root", "bits", "own")


def over_tiles(rows: DataFrame, num: int, den: int, answer, out: str) -> DataFrame:
    """``answer(tile, key)`` rows for each tile ``(k, t, u)`` of ``rows``; tiles with ``t = u`` are square."""

    def run(batches):
        open_key, rows = None, []
        for batch in batches:
            found = []
            for *key, side, node, n, root, bits, own in zip(*(c.to_pylist() for c in batch.columns)):
                if key != open_key:
                    found += answer(Tile(rows, num, den, open_key[1] == open_key[2]), open_key) if rows else []
                    open_key, rows = key, []
                rows.append((side, node, n, root, bits, own))
            yield _table(found, out)
        if rows:
            yield _table(answer(Tile(rows, num, den, open_key[1] == open_key[2]), open_key), out)

    dealt = rows.select(*TILE_COLUMNS).repartition("k", "t", "u").sortWithinPartitions("k", "t", "u")
    return dealt.mapInArrow(run, out)


def _table(found: list[tuple], out: str) -> pa.RecordBatch:
    names = [c.split()[0] for c in out.split(", ")]
    columns = list(zip(*found)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def _joining(tile: Tile, key: list) -> list[tuple]:
    return tile.links()


def _possible(tile: Tile, key: list) -> list[tuple]:
    return [(tile.rows[u][1], tile.rows[v][1]) for u, v, _ in tile.likely()]


def _open_rows(tile: Tile, key: list) -> list[tuple]:
    """Possible pairs ``(0, a, 0, 0, 0, b, 0)``; with more than ``DENSE`` per row, the rows ``(1, *key, side, node, root)``."""
    pairs, rows = [], set()
    for u, v, _ in tile.likely():
        rows.update((u, v))
        if len(pairs) <= DENSE * len(tile.rows):
            pairs.append((0, tile.rows[u][1], 0, 0, 0, tile.rows[v][1], 0))
    if len(pairs) <= DENSE * len(tile.rows):
        return pairs
    return [(1, *key, int(tile.side[x]), tile.rows[x][1], int(tile.root[x])) for x in sorted(rows)]


def pair_tiles(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Tiles of one ``a`` and a share of its partners, from distinct pairs ``(a, b)``."""
    tiles = F.ceil(F.sum(F.col("n") + 100) / TILE).cast("int")
    hubs = pairs.join(nodes.select(F.col("node").alias("b"), "n"), "b").groupBy("a").agg(tiles.alias("tiles"))
    share = F.pmod(F.xxhash64("b"), F.col("tiles")).cast("int")
    members = pairs.join(hubs, "a").select(F.col("a").alias("k"), share.alias("t"), F.lit(1).alias("side"), F.col("b").alias("node"))
    every = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    heads = hubs.select(F.col("a").alias("k"), every.alias("t"), F.lit(0).alias("side"), F.col("a").alias("node"))
    return members.unionByName(heads).join(nodes, "node").withColumns({"u": F.lit(-1), "root": F.col("node")})


def possible_pairs(pairs: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """Those of the pairs that the bitmaps do not rule out."""
    rows = pair_tiles(pairs, nodes).withColumn("own", F.lit(None).cast("binary"))
    return over_tiles(rows, num, den, _possible, "a long, b long")


def pair_links(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Those of the pairs that join their nodes, exactly."""
    return over_tiles(pair_tiles(pairs, nodes).join(sets, "node"), num, den, _joining, "a long, b long")


def rooted(rows: DataFrame, roots: DataFrame, node: str, name: str) -> DataFrame:
    """``rows`` with the component of the node in column ``node``; an unlinked node is its own."""
    side = roots.select(F.col("node").alias("_tl_node"), F.col("root").alias("_tl_root"))
    joined = rows.join(side, F.col(node) == F.col("_tl_node"), "left")
    return joined.withColumn(name, F.coalesce("_tl_root", node)).drop("_tl_node", "_tl_root")


def node_components(docs: DataFrame, nodes: DataFrame, text: str = "text", n: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """``(node, root)`` of the nodes that are linked with another; ``nodes`` holds ``(node, n, bits)`` of all."""
    ends = F.explode(F.array("a", "b")).alias("node")
    same = Window.partitionBy("k")
    keys = node_keys(docs, text, n, num, den).withColumns({"lo": F.min("node").over(same), "hi": F.max("node").over(same)})
    # Copies of a set come from several tasks; each set counts once in a key.
    shared = written(keys.where("lo < hi").select("k", "node", "lo").distinct())
    stars = written(shared.where("node > lo").select(F.col("lo").alias("a"), F.col("node").alias("b")).distinct())
    likely = written(possible_pairs(stars, nodes, num, den))
    links = written(pair_links(likely, nodes, contents(docs, text, n, likely.select(ends).distinct()), num, den))
    roots = components(links)
    # Keys whose smallest set did not take all the others into its component.
    apart = rooted(rooted(stars, roots, "a", "p"), roots, "b", "q").where("p <> q").select(F.col("a").alias("lo"), F.col("b").alias("node"))
    open_keys = shared.join(apart, ["lo", "node"], "left_semi").select("k").distinct()
    rest = written(rooted(shared.join(open_keys, "k", "left_semi"), roots, "node", "root"))
    tiles = F.ceil(F.sum(F.col("n") + 100) / TILE).cast("int").alias("tiles")
    size = rest.join(nodes.select("node", "n"), "node").groupBy("k").agg(F.count("*").alias("g"), tiles)
    # Small keys: their pairs, each once.
    few = rest.join(size.where(f"g <= {SMALL}").select("k"), "k").select("k", "lo", "node", "root")
    other = few.select("k", F.col("node").alias("b"), F.col("root").alias("q"))
    pairs = few.join(other, "k").where("node < b and root <> q and node <> lo").select(F.col("node").alias("a"), "b").distinct()
    # Large keys: tiles; what a tile's bitmaps leave possible goes on to the exact step, as pairs or as a smaller tile.
    many = rest.join(size.where(f"g > {SMALL}").select("k", "tiles"), "k").withColumn("own_t", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    spread = many.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    side = (F.col("own_t") > F.col("other")).cast("int").alias("side")
    dealt = spread.select("k", F.least("own_t", "other").alias("t"), F.greatest("own_t", "other").alias("u"), side, "node", "root")
    left = over_tiles(
        dealt.join(nodes, "node").withColumn("own", F.lit(None).cast("binary")), num, den, _open_rows,
        "kind long, k long, t long, u long, side long, node long, root long",
    )
    left = written(left)
    more_pairs = left.where("kind = 0").select(F.least("k", "node").alias("a"), F.greatest("k", "node").alias("b"))
    likely = written(possible_pairs(pairs, nodes, num, den).unionByName(more_pairs).distinct())
    dense = left.where("kind = 1").drop("kind")
    sets = contents(docs, text, n, likely.select(ends).unionByName(dense.select("node")).distinct())
    in_tiles = over_tiles(dense.join(nodes, "node").join(sets, "node"), num, den, _joining, "a long, b long")
    return components(links.unionByName(pair_links(likely, nodes, sets, num, den)).unionByName(in_tiles))


def similar_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """``(key, n_shingles, component_id)``: the smallest key reachable by links of Jaccard ``>= num / den``."""
    rows = written(document_nodes(docs, key, text, n))
    nodes = written(rows.where("node is not null").select("node", F.col("n_shingles").alias("n"), "bits").dropDuplicates(["node"]))
    roots = node_components(docs, nodes, text, n, num, den)
    placed = rooted(rows.drop("bits"), roots, "node", "root")
    least = placed.where("root is not null").groupBy("root").agg(F.min(key).alias("component_id"))
    whole = placed.join(least, "root", "left")
    return whole.select(key, "n_shingles", F.coalesce("component_id", key).alias("component_id"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one row of each component; only the keys that go are joined.

    It is the row of the smallest key; a null key is larger than any other.  Rows that share this key are
    told apart by the hash of the text, and rows of one key and text by the hash of all columns.  Rows with an empty set
    stay, whatever their key.
    """
    h = F.xxhash64(text)
    rows = docs.select(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), h.alias("h")).alias("_tl_key"), F.col(text).alias("text"))
    found = written(similar_documents(rows, "_tl_key", "text", n, num, den))
    named = found.select(F.col("_tl_key.key").alias("_tl_k"), F.col("_tl_key.h").alias("_tl_h"), F.expr("component_id <> _tl_key").alias("gone"), "n_shingles")
    same = F.col(key).eqNullSafe(F.col("_tl_k")) & (h == F.col("_tl_h"))
    rest = docs.join(named.where("gone").select("_tl_k", "_tl_h").distinct(), same, "left_anti")
    left = named.where("n_shingles > 0 AND NOT gone")
    repeated = written(left.groupBy("_tl_k", "_tl_h").agg(F.count("*").alias("rows")).where("rows > 1").drop("rows"))
    if repeated.isEmpty():
        return rest
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    several = rest.join(repeated, same, "left_semi").groupBy(F.col(key), h).agg(F.min_by(row, F.xxhash64(row)).alias("_tl_row"))
    return rest.join(repeated, same, "left_anti").unionByName(several.select("_tl_row.*"))
