"""Bit and hash expressions on 32-bit unsigned values held in BIGINT columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# MurmurHash3 (x86, 32 bit) constants and the seed in use.
MURMUR_SEED = 1234
MURMUR_C1 = 0xCC9E2D51
MURMUR_C2 = 0x1B873593
MURMUR_ADD = 0xE6546B64
MURMUR_MIX1 = 0x85EBCA6B
MURMUR_MIX2 = 0xC2B2AE35

MASK32 = 0xFFFFFFFF


def u32(x: Column) -> Column:
    return x.bitwiseAND(F.lit(MASK32))


def mul32(x: Column, constant: int) -> Column:
    """``x * constant`` modulo 2**32.

    The factor is split in halves of 16 bits, so no BIGINT product overflows
    under ANSI arithmetic.
    """
    low = x * F.lit(constant & 0xFFFF)
    high = F.shiftleft((x * F.lit(constant >> 16)).bitwiseAND(F.lit(0xFFFF)), 16)
    return u32(low + high)


def rotl32(x: Column, r: int) -> Column:
    return u32(F.shiftleft(x, r)).bitwiseOR(F.shiftrightunsigned(x, 32 - r))


def xorshift(x: Column, r: int) -> Column:
    return x.bitwiseXOR(F.shiftrightunsigned(x, r))


def with_murmur3(df: DataFrame, key: str, name: str = "h") -> DataFrame:
    """``df`` with MurmurHash3 of one 4-byte key, as an unsigned value in a BIGINT.

    One projection per step: each step uses the one before twice, and a single
    expression would double in size every time.
    """
    steps = (
        lambda h: mul32(u32(h.cast("long")), MURMUR_C1),
        lambda h: rotl32(h, 15),
        lambda h: mul32(h, MURMUR_C2).bitwiseXOR(F.lit(MURMUR_SEED)),
        lambda h: rotl32(h, 13),
        lambda h: u32(h * F.lit(5) + F.lit(MURMUR_ADD)).bitwiseXOR(F.lit(4)),
        lambda h: xorshift(h, 16),
        lambda h: mul32(h, MURMUR_MIX1),
        lambda h: xorshift(h, 13),
        lambda h: mul32(h, MURMUR_MIX2),
        lambda h: xorshift(h, 16),
    )
    hashed = df.withColumn(name, F.col(key))
    for step in steps:
        hashed = hashed.withColumn(name, step(F.col(name)))
    return hashed


def bit_length32(x: Column) -> Column:
    """Number of significant bits; 0 for 0."""
    return F.when(x == 0, F.lit(0)).otherwise(F.length(F.bin(x)))


def power_of_two(exponent: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), exponent.cast("int"))


def leading_zeros32(x: Column) -> Column:
    return F.lit(32) - bit_length32(x)


def pack_key(i: Column, j: Column) -> Column:
    """Row in the upper, column in the lower 32 bits."""
    return F.shiftleft(i.cast("long"), 32).bitwiseOR(j.cast("long"))


def unpack_row(key: Column) -> Column:
    return F.shiftrightunsigned(key, 32)


def unpack_col(key: Column) -> Column:
    return u32(key)


def pack_row_in_column(row: Column, col: Column) -> Column:
    """Hash-table key of a block-local row: row from bit 27 upwards, column below."""
    return F.shiftleft(row.cast("long"), 27) + col.cast("long")
