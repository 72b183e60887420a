"""Row groups: what neighbouring rows of ``A`` need of ``B`` comes to one task, once, and their result is made there whole.

Rows are cut into groups of about equal products by their counted prefix sums, so a group is a range of rows, and an entry
finds it among their first rows without a join.  A row of ``B`` travels to a group once, as
arrays, however many entries of the group refer to it; no product is shuffled, and no position has parts in two groups.
Rows beyond ``LONGEST`` products, and entries without a row number, are left to the caller's joins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleloom.operators.scans import prefix_sum
from tripleloom.plans.sizing import broadcast_if_small
from tripleloom.session import written

#: Products from which row groups take the place of joined pairs.
GROUPED = 1 << 26
#: Products of a group whose values are kept, and of one whose structure alone is wanted; groups wanted at least.
VALUES, STRUCTURE, LEAST = 1 << 24, 1 << 26, 64
#: Groups whose first rows are looked up in place; more are joined.
RANGES = 1 << 16
#: Products of a row that stays in a group, and products that a task expands at once.
LONGEST, AT_ONCE = 1 << 22, 1 << 22
#: Entries of one array.
PIECE = 1 << 16
#: Bytes of bitmaps that a task holds, and gathers at once.
HELD, GATHERED = 1 << 28, 1 << 25
#: Stands for a column that is null.
MISSING = np.iinfo(np.int64).min
#: Makes the result of its entries and the arrays they name, in batches.
Kernel = Callable[[pa.Table, pa.Table], Iterator[pa.RecordBatch]]


@dataclass(frozen=True)
class RowGroups:
    """``groups(i, g)``, or the sorted first rows of the groups; ``rest`` holds the rows without a group, null among them, or is None."""

    groups: DataFrame
    count: int
    rest: DataFrame | None
    firsts: list[int] | None

    @property
    def parts(self) -> int:
        """Partitions by ``k`` for the pairs of ``k`` and group: fixed, as adaptive execution would merge them into few large ones."""
        return max(self.count, int(self.groups.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def placed(self, df: DataFrame) -> DataFrame:
        """``df(i, …)`` with the group ``g`` of each row that has one; rows that meet nothing may be given one."""
        if self.firsts is None:
            return df.join(broadcast_if_small(self.groups), "i")
        df = df.where(F.col("i").isNotNull())
        if self.rest is not None:
            df = without(df, self.rest)
        # Rows that a DOUBLE cannot tell apart share a group, as each row has one place.
        return in_ranges(df, F.col("i").cast("double"), sorted(set(map(float, self.firsts[1:]))), "g")


def in_ranges(df: DataFrame, line: Column, cuts: list[float], name: str) -> DataFrame:
    """``df`` with the number of the range that ``line``, a DOUBLE, falls into."""
    if not cuts:
        return df.withColumn(name, F.lit(0).cast("long"))
    # Tasks import this module, and need no pyspark.ml.
    from pyspark.ml.feature import Bucketizer

    splits = [-float("inf"), *cuts, float("inf")]
    placed = Bucketizer(splits=splits, inputCol="at", outputCol=name).transform(df.withColumn("at", line))
    return placed.drop("at").withColumn(name, F.col(name).cast("long"))


def row_groups(left: DataFrame, right: DataFrame, rows: int, most: int) -> RowGroups:
    """Groups for the rows of ``left(i, k)`` by the entries of ``right(k, …)`` that they meet, ``most`` in a group."""
    lengths = right.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    # Dealt into a fixed number of parts: they look small to adaptive execution, but a task holds their rows in a hash table.
    dealt = left.select("i", "k").repartition(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), "k")
    costs = written(dealt.join(lengths, "k").groupBy("i").agg(F.sum("n").alias("n")))
    short = F.col("i").isNotNull() & (F.col("n") <= LONGEST)
    total, rest = costs.agg(F.sum(F.when(short, F.col("n"))), F.count_if(~short)).first()
    budget = min(most, max(1 << 16, (total or 0) // LEAST))
    placed = prefix_sum(costs.where(short), "i", F.col("n"), max(rows, 1), name="before")
    groups = written(placed.select("i", F.expr(f"before div {budget}").alias("g")))
    count = (total or 0) // budget + 1
    firsts = None
    if count <= RANGES:
        firsts = sorted(r["i"] for r in groups.groupBy("g").agg(F.min("i").alias("i")).collect())
    return RowGroups(groups, count, costs.where(~short).select("i") if rest else None, firsts)


def without(df: DataFrame, rest: DataFrame) -> DataFrame:
    """``df`` without its rows in ``rest(i)``."""
    return df.join(broadcast_if_small(rest), "i", "left_anti")


def rest_of(left: DataFrame, rest: DataFrame) -> DataFrame:
    """The entries of ``left`` in rows without a group."""
    other = broadcast_if_small(rest.withColumnRenamed("i", "o"))
    return left.join(other, F.col("i").eqNullSafe(F.col("o")), "left_semi")


def narrowed(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with those of the columns as INT or FLOAT that were counted to lose nothing by it: half of what travels."""
    kinds = {name: kind for name, kind in df.dtypes if name in columns and kind in ("bigint", "double")}
    narrow = {name: "int" if kind == "bigint" else "float" for name, kind in kinds.items()}
    back = {
        name: F.col(name).between(-(1 << 31), (1 << 31) - 1) if kind == "bigint" else F.col(name) == F.col(name).cast("float").cast("double")
        for name, kind in kinds.items()
    }
    if not kinds:
        return df
    lost = df.agg(*[F.count_if(~same).alias(name) for name, same in back.items()]).first()
    return df.select(*[F.col(c).cast(narrow[c]).alias(c) if c in kinds and not lost[c] else F.col(c) for c in df.columns])


def row_arrays(right: DataFrame, columns: list[str], parts: int = 0) -> DataFrame:
    """``(k, *columns)``: the entries of each ``k`` as arrays of at most about ``PIECE`` elements, as narrow as they fit."""
    right = narrowed(right, columns)
    cells = F.collect_list(F.struct(*columns)).alias("cells")
    counts = right.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > PIECE)
    if counts.isEmpty():
        # Dealt by k alone, the arrays lie where the groups ask for them.
        arrays = (right.repartition(parts, "k") if parts else right).groupBy("k").agg(cells)
    else:
        long = counts.select("k", F.ceil(F.col("n") / F.lit(PIECE)).alias("pieces"))
        cut = right.join(broadcast_if_small(long), "k", "left")
        piece = F.when(F.col("pieces").isNotNull(), F.pmod(F.xxhash64(columns[0]), F.col("pieces"))).otherwise(F.lit(0))
        arrays = cut.groupBy("k", piece.alias("piece")).agg(cells)
    return arrays.select("k", *[F.col(f"cells.{c}").alias(c) for c in columns])


def brought(
    left: DataFrame, arrays: DataFrame, found: RowGroups, kernel: Kernel, schema: str,
    beside: DataFrame | None = None,
) -> DataFrame:
    """``kernel`` over every group: its entries ``left(i, k, …)`` and, once each, the arrays of the ``k`` they name.

    ``beside`` are further rows ``(i, …)`` of the groups with the columns of ``left``; they ask for nothing.
    """
    mine = found.placed(left.where(F.col("k").isNotNull()))
    # Fresh names: both sides of the cogroup come from the same entries.  Dealt by k once, for the distinct pairs and the join.
    wanted = mine.select(F.col("g").alias("to"), F.col("k").alias("line")).repartition(found.parts, "line").distinct()
    supplied = wanted.join(arrays.withColumnRenamed("k", "line"), "line")
    every = mine if beside is None else mine.unionByName(found.placed(beside))
    one, other = every.repartition(found.count, "g"), supplied.repartition(found.count, "to")
    # An empty group still has the columns.
    columns = [(name, KINDS[kind]) for name, kind in (column.split() for column in schema.split(", "))]

    def whole(left: pa.Table, right: pa.Table) -> pa.Table:
        return pa.Table.from_batches(kernel(left, right), pa.schema(columns))

    return one.groupBy("g").cogroup(other.groupBy("to")).applyInArrow(whole, schema)


# --- inside a task --------------------------------------------------------------

KINDS = {"long": pa.int64(), "double": pa.float64()}


class Supply:
    """The arrays of a group, by sorted ``k`` (``line``): ``start`` and ``length`` of each in the flat columns."""

    def __init__(self, right: pa.Table):
        k = right.column("line").to_numpy()
        if (k[1:] < k[:-1]).any():
            right = right.take(pa.array(np.argsort(k, kind="stable")))
            k = right.column("line").to_numpy()
        self.flat, sizes = {}, np.zeros(0, np.int64)
        for name in right.column_names:
            if pa.types.is_list(right.schema.field(name).type):
                lists = right.column(name).combine_chunks()
                sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
                self.flat[name] = lists.flatten()
        self.k, first = np.unique(k, return_index=True)
        self.start = (np.cumsum(sizes) - sizes)[first]
        self.length = np.add.reduceat(sizes, first) if len(first) else sizes

    def columns(self, name: str) -> tuple[np.ndarray, np.ndarray]:
        """The distinct sorted columns, and the place of each flat element among them."""
        flat = self.flat[name]
        j = (flat.cast(pa.int64()).fill_null(MISSING) if flat.null_count else flat).to_numpy(zero_copy_only=False)
        if not len(j):
            return j.astype(np.int64), j
        low, span = int(j.min()), int(j.max()) - int(j.min()) + 1
        if low == MISSING or span > max(8 * len(j), 1 << 20):
            distinct, place = np.unique(j, return_inverse=True)
            return distinct.astype(np.int64), place
        seen = np.zeros(span, bool)
        seen[j - low] = True
        return np.flatnonzero(seen) + low, (np.cumsum(seen) - 1)[j - low]

    def values(self, name: str) -> tuple[np.ndarray, np.ndarray | None]:
        v, there = numbers(self.flat[name])
        return v.astype(np.float64, copy=False), there

    def payload(self, name: str) -> np.ndarray:
        """The flat elements as BIGINT or DOUBLE, however narrow they came."""
        p = self.flat[name].to_numpy(zero_copy_only=False)
        return p.astype(np.int64 if p.dtype.kind == "i" else np.float64, copy=False)


def numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray | None]:
    """Values with 0 for null, and which are present, or None where all are."""
    if not column.null_count:
        return column.to_numpy(zero_copy_only=False), None
    return pc.fill_null(column, 0).to_numpy(zero_copy_only=False), pc.is_valid(column).to_numpy(zero_copy_only=False)


class Entries:
    """The entries of a group that meet an array, sorted by row: ``rows`` distinct, ``row`` and ``at`` (place in the supply) of each."""

    def __init__(self, left: pa.Table, supply: Supply):
        i, k = (left.column(c).to_numpy() for c in ("i", "k"))
        at = np.searchsorted(supply.k, k)
        met = np.flatnonzero(supply.k[np.minimum(at, max(len(supply.k) - 1, 0))] == k) if len(supply.k) else np.zeros(0, np.int64)
        self.taken = met[np.argsort(i[met], kind="stable")]
        self.at = at[self.taken]
        i = i[self.taken]
        first = np.r_[True, i[1:] != i[:-1]] if len(i) else np.zeros(0, bool)
        self.rows, self.row = i[first], np.cumsum(first) - 1
        self.n = supply.length[self.at]
        self.start = supply.start[self.at]

    def parts(self, most: int = 0) -> Iterator[tuple[int, int]]:
        """Slices of whole rows that make about ``most`` products; a row of more is one by itself."""
        if not len(self.row):
            return
        most = most or AT_ONCE
        first = np.flatnonzero(np.r_[True, np.diff(self.row) > 0])
        cost = np.add.reduceat(self.n, first)
        alone = cost > most
        cuts = np.flatnonzero(np.r_[True, (np.diff((np.cumsum(cost) - cost) // most) > 0) | alone[1:] | alone[:-1]])
        ends = np.r_[first[cuts[1:]], len(self.row)]
        yield from zip(first[cuts].tolist(), ends.tolist())

    def pieces(self, low: int, high: int) -> Iterator[tuple[int, int]]:
        """A slice in pieces of about ``AT_ONCE`` products; only one of a single row has more than one."""
        n = self.n[low:high]
        cuts = np.flatnonzero(np.diff((np.cumsum(n) - n) // (2 * AT_ONCE)) > 0) + 1
        yield from zip([low, *(cuts + low).tolist()], [*(cuts + low).tolist(), high])

    def expanded(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each product of a slice: its entry, and its element of the supply."""
        n = self.n[low:high]
        of = np.repeat(np.arange(low, high), n)
        return of, np.arange(len(of)) + np.repeat(self.start[low:high] - (np.cumsum(n) - n), n)


def distinct_keys(key: np.ndarray, extent: int) -> np.ndarray:
    if extent <= 8 * len(key):
        seen = np.zeros(extent, bool)
        seen[key] = True
        return np.flatnonzero(seen)
    # Half as wide where that is enough, which sorts twice as fast.
    ordered = np.sort(key.astype(np.uint32) if extent < 1 << 32 else key)
    return ordered[np.r_[True, ordered[1:] != ordered[:-1]]].astype(np.int64) if len(ordered) else key


def summed(key: np.ndarray, extent: int, weights: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The distinct keys in order, and the sums of each of the weights."""
    if extent <= 8 * len(key):
        place = distinct_keys(key, extent)
        return place, [np.bincount(key, w, extent)[place] for w in weights]
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(key) else np.zeros(0, np.int64)
    return ordered[first], [np.add.reduceat(w[order], first) + 0.0 if len(first) else w for w in weights]


def batches(schema: list[tuple[str, pa.DataType]], parts: Iterator[list]) -> Iterator[pa.RecordBatch]:
    """Parts of columns as record batches of bounded size."""
    names = pa.schema(schema)
    for columns in parts:
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) if not isinstance(c, pa.Array) else c for c, (_, t) in zip(columns, schema)], schema=names)
        yield from (batch.slice(at, 1 << 16) for at in range(0, batch.num_rows, 1 << 16))


def line_numbers(lines: np.ndarray, place: np.ndarray) -> pa.Array:
    """Of the sorted lines those at the places, with null for what stands for it."""
    missing = len(lines) > 0 and lines[0] == MISSING
    return pa.array(lines[place], pa.int64(), mask=(place == 0) if missing else None)


# --- products -------------------------------------------------------------------

POSITION = [("i", pa.int64()), ("j", pa.int64())]


def sums(upper: bool) -> Kernel:
    def run(left: pa.Table, right: pa.Table) -> Iterator[pa.RecordBatch]:
        supply = Supply(right)
        entries = Entries(left, supply)
        columns, of_column = supply.columns("j")
        lv, l_there = numbers(left.column("lv").combine_chunks().take(pa.array(entries.taken)))
        rv, r_there = supply.values("rv")

        def added(low: int, high: int, base: int, extent: int) -> tuple[np.ndarray, list[np.ndarray]]:
            of, at = entries.expanded(low, high)
            if upper:
                kept = columns[of_column[at]] >= entries.rows[entries.row[of]]
                of, at = of[kept], at[kept]
            key = (entries.row[of] - base) * len(columns) + of_column[at]
            weights = [lv[of] * rv[at]]
            if l_there is not None or r_there is not None:
                there = np.ones(len(of), bool) if l_there is None else l_there[of]
                there = there if r_there is None else there & r_there[at]
                weights = [np.where(there, weights[0], 0.0), there.astype(float)]
            return summed(key, extent, weights)

        def parts() -> Iterator[list]:
            for low, high in entries.parts():
                base = entries.row[low]
                extent = int(entries.row[high - 1] - base + 1) * len(columns)
                place, totals = joined_sums([added(*piece, base, extent) for piece in entries.pieces(low, high)], extent)
                v = pa.array(totals[0], pa.float64(), mask=totals[1] == 0 if len(totals) > 1 else None)
                yield [line_numbers(entries.rows, place // len(columns) + base), line_numbers(columns, place % len(columns)), v]

        return batches([*POSITION, ("v", pa.float64())], parts())

    return run


def joined_sums(pieces: list[tuple[np.ndarray, list[np.ndarray]]], extent: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The sums of pieces of one row as one."""
    if len(pieces) == 1:
        return pieces[0]
    place = np.concatenate([place for place, _ in pieces])
    return summed(place, extent, [np.concatenate(w) for w in zip(*(weights for _, weights in pieces))])


def positions(upper: bool) -> Kernel:
    def run(left: pa.Table, right: pa.Table) -> Iterator[pa.RecordBatch]:
        supply = Supply(right)
        entries = Entries(left, supply)
        columns, of_column = supply.columns("j")

        def parts() -> Iterator[list]:
            for low, high, place in _places(entries, columns, of_column):
                row, column = place // len(columns) + entries.row[low], place % len(columns)
                if upper:
                    kept = columns[column] >= entries.rows[row]
                    row, column = row[kept], column[kept]
                yield [line_numbers(entries.rows, row), line_numbers(columns, column)]

        return batches(POSITION, parts())

    return run


def _places(entries: Entries, columns: np.ndarray, of_column: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    for low, high in entries.parts():
        base = entries.row[low]
        extent = int(entries.row[high - 1] - base + 1) * len(columns)
        found = []
        for piece in entries.pieces(low, high):
            of, at = entries.expanded(*piece)
            found.append(distinct_keys((entries.row[of] - base) * len(columns) + of_column[at], extent))
        yield low, high, found[0] if len(found) == 1 else distinct_keys(np.concatenate(found), extent)


def _bucket(columns: np.ndarray, buckets: int, cols: int) -> np.ndarray:
    """As ``column_bucket``, whose division drops the fraction; null columns come first, with the least number."""
    x = np.where(columns == MISSING, 0, columns + 1) * buckets - 1
    return np.where(columns == MISSING, MISSING, np.sign(x) * (np.abs(x) // cols))


def lengths(buckets: int, cols: int, name: str) -> Kernel:
    schema = [("i", pa.int64()), *([("b", pa.int64())] if buckets else []), (name, pa.int64())]

    def run(left: pa.Table, right: pa.Table) -> Iterator[pa.RecordBatch]:
        supply = Supply(right)
        entries = Entries(left, supply)
        columns, of_column = supply.columns("j")
        kinds, kind = np.unique(_bucket(columns, buckets, cols), return_inverse=True) if buckets else (np.zeros(1, np.int64), np.zeros(len(columns), np.int64))
        if not len(entries.row):
            return batches(schema, iter(()))
        # Columns of one bucket begin a new word of the bitmaps.
        first = np.flatnonzero(np.r_[True, np.diff(kind) > 0])
        size = np.diff(np.r_[first, len(columns)])
        words = np.r_[0, np.cumsum(-(-size // 64))]
        width = int(words[-1]) * 8

        def counted() -> Iterator[tuple[int, np.ndarray]]:
            if (len(supply.k) + len(entries.rows)) * width <= HELD and len(entries.row) * width <= 64 * entries.n.sum():
                bit = words[kind] * 64 + np.arange(len(columns)) - first[kind]
                bits = np.zeros((len(supply.k), width), np.uint8)
                of = np.repeat(np.arange(len(supply.k)), supply.length)
                own = bit[of_column]
                np.bitwise_or.at(bits.reshape(-1), of * width + (own >> 3), (1 << (own & 7)).astype(np.uint8))
                bits = bits.view(np.uint64)
                merged = np.zeros((len(entries.rows), width // 8), np.uint64)
                step = max(1, GATHERED // width)
                for low in range(0, len(entries.row), step):
                    row = entries.row[low : low + step]
                    starts = np.flatnonzero(np.r_[True, np.diff(row) > 0])
                    merged[row[starts]] |= np.bitwise_or.reduceat(bits[entries.at[low : low + step]], starts, axis=0)
                yield 0, np.add.reduceat(np.bitwise_count(merged), words[:-1], axis=1, dtype=np.int64)
                return
            for low, high, place in _places(entries, columns, of_column):
                rows = int(entries.row[high - 1] - entries.row[low] + 1)
                bounds = (np.arange(rows)[:, None] * len(columns) + first).ravel()
                counts = np.diff(np.searchsorted(place, np.r_[bounds, rows * len(columns)]))
                yield int(entries.row[low]), counts.reshape(rows, len(kinds))

        def parts() -> Iterator[list]:
            for base, counts in counted():
                row, of_kind = np.nonzero(counts)
                yield [line_numbers(entries.rows, base + row), *([line_numbers(kinds, of_kind)] if buckets else []), counts[row, of_kind]]

        return batches(schema, parts())

    return run


def grouped_sums(left: DataFrame, right: DataFrame, rows: int, upper: bool, small: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """The sums ``(i, j, v)`` of ``left(i, k, lv)`` times ``right(k, j, rv)``, and the entries of rows without a group.

    With a ``small`` side groups may be larger, as what they are brought is bounded by it.
    """
    found = row_groups(left, right, rows, STRUCTURE if small else VALUES)
    made = brought(left, row_arrays(right, ["j", "rv"], found.parts), found, sums(upper), "i long, j long, v double")
    return made, found.rest and rest_of(left, found.rest)


def grouped_positions(left: DataFrame, right: DataFrame, rows: int, upper: bool) -> tuple[DataFrame, DataFrame | None]:
    """As ``grouped_sums``, without values."""
    found = row_groups(left, right, rows, VALUES)
    made = brought(left.select("i", "k"), row_arrays(right, ["j"], found.parts), found, positions(upper), "i long, j long")
    return made, found.rest and rest_of(left, found.rest)


def grouped_lengths(left: DataFrame, right: DataFrame, rows: int, name: str, buckets: int = 0, cols: int = 0) -> tuple[DataFrame, DataFrame | None]:
    """``(i, name)``, or ``(i, b, name)`` by column bucket: exact entries of the rows; and the entries of rows without a group."""
    found = row_groups(left, right, rows, STRUCTURE)
    schema = f"i long, {'b long, ' if buckets else ''}{name} long"
    made = brought(left.select("i", "k"), row_arrays(right, ["j"], found.parts), found, lengths(buckets, cols, name), schema)
    return made, found.rest and rest_of(left, found.rest)


# --- merges ---------------------------------------------------------------------


def _merges(parts: int, largest: bool) -> Kernel:
    schema = [("i", pa.int64()), ("code", pa.int64())]

    def run(left: pa.Table, right: pa.Table) -> Iterator[pa.RecordBatch]:
        supply = Supply(right)
        entries = Entries(left, supply)
        code = supply.flat["code"].to_numpy(zero_copy_only=False).astype(np.uint32).astype(np.int64)
        none = -1 if largest else 1 << 32

        def found() -> Iterator[list]:
            for low, high in entries.parts():
                of, at = entries.expanded(low, high)
                base = entries.row[low]
                held = np.full(int(entries.row[high - 1] - base + 1) * parts, none)
                merge = np.maximum if largest else np.minimum
                merge.at(held, (entries.row[of] - base) * parts + (code[at] & (parts - 1)), code[at])
                there = np.flatnonzero(held != none)
                yield [entries.rows[there // parts + base], held[there]]

        return batches(schema, found())

    return run


def grouped_merge(left: DataFrame, right: DataFrame, rows: int, parts: int, largest: bool) -> tuple[DataFrame, DataFrame | None]:
    """``(i, code)``: of the 32-bit ``right(k, code)`` that a row of ``left(i, k)`` meets, the largest or least of each ``code % parts``."""
    found = row_groups(left, right, rows, VALUES)
    kernel = _merges(parts, largest)
    # As INT the bits of a code stay as they are.
    signed = right.select("k", F.expr("cast(case when code >= 2147483648 then code - 4294967296 else code end as int)").alias("code"))
    return brought(left, row_arrays(signed, ["code"], found.parts), found, kernel, "i long, code long"), found.rest and rest_of(left, found.rest)


# --- values at known positions ------------------------------------------------------


class Met:
    """Positions of a group beside the entries of their rows: which entry meets which element of the position's column."""

    def __init__(self, left: pa.Table, right: pa.Table):
        own = left.column("own").combine_chunks()
        self.positions, rows = left.filter(pc.invert(own)), left.filter(own)
        self.supply = Supply(right)
        self.entries = Entries(self.positions, self.supply)
        inner, self.inner = self.supply.columns("c")
        i, c = (rows.column(name).to_numpy() for name in ("i", "k"))
        row, at = np.searchsorted(self.entries.rows, i), np.searchsorted(inner, c)
        some = bool(len(inner) and len(self.entries.rows))
        same = (self.entries.rows[np.minimum(row, len(self.entries.rows) - 1)] == i) & (inner[np.minimum(at, len(inner) - 1)] == c) if some else np.zeros(len(i), bool)
        self.width = len(inner)
        key = row[same] * self.width + at[same]
        order = np.argsort(key, kind="stable")
        self.key = key[order]
        payload = rows.column("p").combine_chunks().to_numpy(zero_copy_only=False)
        self.left, self.right = payload[np.flatnonzero(same)[order]], self.supply.payload("p")

    def __iter__(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Position number, left and right payload of every pair; equal positions of entries pair up in full."""
        for low, high in self.entries.parts():
            of, at = self.entries.expanded(low, high)
            key = self.entries.row[of] * self.width + self.inner[at]
            first = np.searchsorted(self.key, key, "left")
            n = np.searchsorted(self.key, key, "right") - first
            pair = np.repeat(np.arange(len(of)), n)
            mine = np.arange(len(pair)) + np.repeat(first - (np.cumsum(n) - n), n)
            yield self.entries.taken[of[pair]], self.left[mine], self.right[at[pair]]


def met_sums(left: pa.Table, right: pa.Table) -> Iterator[pa.RecordBatch]:
    met = Met(left, right)
    v = np.zeros(met.positions.num_rows)
    for number, one, other in met:
        v += np.bincount(number, one * other, len(v))
    i, j = (met.positions.column(c).to_numpy() for c in ("i", "k"))
    order = np.lexsort((j, i))
    first = np.flatnonzero(np.r_[True, (np.diff(i[order]) != 0) | (np.diff(j[order]) != 0)]) if len(order) else order
    v = np.add.reduceat(v[order], first) if len(first) else v
    return batches([*POSITION, ("v", pa.float64())], iter([[i[order][first], j[order][first], v]]))


def met_pairs(left: pa.Table, right: pa.Table) -> Iterator[pa.RecordBatch]:
    met = Met(left, right)
    i, j = (met.positions.column(c).to_numpy() for c in ("i", "k"))
    parts = ([i[number], j[number], one, other] for number, one, other in met)
    return batches([*POSITION, ("le", pa.int64()), ("re", pa.int64())], parts)


def grouped_positions_met(structure: DataFrame, a: DataFrame, b: DataFrame, payload: str, rows: int) -> tuple[DataFrame, DataFrame]:
    """Sums ``(i, j, v)``, or pairs ``(i, j, le, re)`` for entry numbers ``at``, at the positions; and the positions without a group.

    A column of ``B`` travels to a group of rows once, however many positions ask for it.
    """
    kind = a.schema[payload].dataType.simpleString()
    wanted = structure.select("i", F.col("j").alias("k"))
    columns = b.select(F.col("j").alias("k"), F.col("i").alias("c"), F.col(payload).alias("p")).where("c is not null")
    found = row_groups(wanted, columns, rows, VALUES)
    positions = wanted.select("i", "k", F.lit(None).cast(kind).alias("p"), F.lit(False).alias("own"))
    entries = a.select("i", F.col("j").alias("k"), F.col(payload).alias("p"), F.lit(True).alias("own")).where("k is not null")
    kernel, schema = (met_sums, "i long, j long, v double") if payload == "v" else (met_pairs, "i long, j long, le long, re long")
    made = brought(positions, row_arrays(columns, ["c", "p"], found.parts), found, kernel, schema, entries)
    known = structure.where("j is not null")
    if found.firsts is None:
        groups = broadcast_if_small(found.groups.select("i").distinct())
        return made, structure.where("j is null").unionByName(known.join(groups, "i", "left_anti"))
    rest = structure.where("j is null").unionByName(known.where("i is null"))
    if found.rest is not None:
        rest = rest.unionByName(known.join(broadcast_if_small(found.rest), "i", "left_semi"))
    return made, rest
