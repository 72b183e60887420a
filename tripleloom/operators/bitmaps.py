"""The symbolic phase of a product by bitmaps: which columns a row of ``A·B`` has, without making its products.

A row of ``B`` is cut into blocks of 32,768 columns, and each block that holds an entry is one bitmap.  A row
of ``A·B`` is the "or" of the bitmaps that its row of ``A`` refers to, and its length is the number of
bits: one step of a fixed 4,096 bytes per entry of ``A`` and block in place of one hashed pair per product.
That pays where a block holds many entries, so ``by_bitmaps`` counts first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleloom.functions.scalar import column_bucket, whole
from tripleloom.matrix import Matrix

#: Fixed: columns of one bitmap of Spark, and its bytes.
BLOCK, BYTES = 32_768, 4_096
#: Bitmaps that are broadcast, 128 MB.
BROADCAST_BITMAPS = 32_768
#: Products per merged bitmap from which bitmaps are less work than pairs: broadcast, or shuffled with the merge.
DENSE, DENSE_SHUFFLED = 16, 512


def block_directory(b: Matrix, group: dict[str, Column]) -> DataFrame:
    """``(k, *group, block, n)``: the blocks of each row of ``B`` and their entries; repeated positions count again."""
    columns = [whole(F.col("j"), BLOCK).alias("block"), *[c.alias(name) for name, c in group.items()]]
    return b.entries.select(F.col("i").alias("k"), *columns).groupBy("k", *group, "block").agg(F.count(F.lit(1)).alias("n"))


def row_bitmaps(b: Matrix, group: dict[str, Column]) -> DataFrame:
    """``(k, *group, block, bits)``: the columns of each block as one bitmap."""
    columns = [whole(F.col("j"), BLOCK).alias("block"), *[c.alias(name) for name, c in group.items()]]
    places = b.entries.select(F.col("i").alias("k"), F.pmod("j", F.lit(BLOCK)).alias("place"), *columns)
    return places.groupBy("k", *group, "block").agg(F.bitmap_construct_agg("place").alias("bits"))


def bitmap_work(a: Matrix, b: Matrix, group: dict[str, Column]) -> dict[str, int]:
    """Counted: bitmaps of ``B``, bitmaps that ``A`` merges, products."""
    blocks = block_directory(b, group).groupBy("k").agg(F.count(F.lit(1)).alias("blocks"), F.sum("n").alias("n"))
    uses = a.entries.groupBy(F.col("j").alias("k")).agg(F.count(F.lit(1)).alias("uses"))
    both = blocks.join(uses, "k", "left")
    row = both.agg(
        F.sum("blocks").alias("bitmaps"), F.sum(F.col("blocks") * F.col("uses")).alias("merges"),
        F.sum(F.col("n").cast("double") * F.col("uses")).alias("products"),
    ).first()
    return {name: int(row[name] or 0) for name in ("bitmaps", "merges", "products")}


def by_bitmaps(work: dict[str, int], least: int = DENSE) -> bool:
    """Whether merging bitmaps is less work than hashing the products."""
    if work["bitmaps"] > BROADCAST_BITMAPS:
        least = DENSE_SHUFFLED
    return work["products"] >= least * max(work["merges"], 1)


def merged_bitmaps(a: Matrix, b: Matrix, group: dict[str, Column] | None = None, work: dict[str, int] | None = None) -> DataFrame:
    """``(i, *group, block, bits)``: the structure of ``A·B``."""
    group = group or {}
    work = work or bitmap_work(a, b, group)
    keys = ["k", *group, "block"]
    bitmaps, directory = row_bitmaps(b, group), block_directory(b, group).drop("n")
    entries = a.entries.select("i", F.col("j").alias("k"))
    if work["bitmaps"] <= BROADCAST_BITMAPS:
        # Narrow rows are sorted once; the bitmaps then come beside them in order, and are merged as they pass.
        one = not group and b.cols <= BLOCK
        order = ["i"] if one else ["i", *group, "block"]
        needed = entries if one else entries.join(F.broadcast(directory), "k")
        needed = needed.repartition("i").sortWithinPartitions(*order)
        # Always true; without it the optimizer takes the sort away and sorts the bitmaps themselves.
        needed = needed.where(F.spark_partition_id() >= 0)
        if one:
            # A constant block among the keys would bring the sort of the bitmaps back.
            merged = needed.join(F.broadcast(bitmaps.drop("block")), "k").groupBy("i").agg(F.bitmap_or_agg("bits").alias("bits"))
            return merged.select("i", F.lit(0).cast("long").alias("block"), "bits")
        return needed.join(F.broadcast(bitmaps), keys).groupBy(*order).agg(F.bitmap_or_agg("bits").alias("bits"))
    # Merged per task first, then once more by row and block.
    return entries.join(bitmaps, "k").groupBy("i", *group, "block").agg(F.bitmap_or_agg("bits").alias("bits"))


def bitmap_lengths(a: Matrix, b: Matrix, group: dict[str, Column] | None = None, work: dict[str, int] | None = None, name: str = "c_nnz") -> DataFrame:
    """``(i, *group, name)``: exact entries of each product row, in each group of columns."""
    group = group or {}
    bits = merged_bitmaps(a, b, group, work).select("i", *group, F.bitmap_count("bits").alias("n"))
    return bits.groupBy("i", *group).agg(F.sum("n").alias(name))


def bitmap_positions(a: Matrix, b: Matrix, work: dict[str, int] | None = None) -> DataFrame:
    """``(i, j)``: every position of ``A·B``, read from its bitmaps."""
    return merged_bitmaps(a, b, work=work).select("i", "block", "bits").mapInArrow(_positions, "i long, j long")


def _positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole_batch in batches:
        for at in range(0, whole_batch.num_rows, 256):
            batch = whole_batch.slice(at, 256)
            bits = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(batch.num_rows, BYTES)
            row, place = np.nonzero(np.unpackbits(bits, axis=1, bitorder="little"))
            i, block = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(i[row]), pa.array(block[row] * BLOCK + place)], ["i", "j"])


def bucket_group(buckets: int, cols: int) -> dict[str, Column]:
    return {"b": column_bucket(F.col("j"), buckets, cols)}
