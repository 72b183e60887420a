"""Sketches and the estimates read from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripleloom.catalog import Query
from tripleloom.catalog import tables as sql
from tripleloom.catalog.statistics import SLOTS
from tripleloom.operators import multiply as mul
from tripleloom.operators import sketches as sk

M32 = "4294967295"


def _mul(x: str, c: int) -> str:
    return f"(({x} * {c & 0xFFFF} + ((({x} * {c >> 16}) & 65535) << 16)) & {M32})"


def _rotl(x: str, r: int) -> str:
    return f"((({x} << {r}) & {M32}) | ({x} >> {32 - r}))"


# MurmurHash3 step by step, one subquery per step.
HASHED = f"""SELECT i, xor(h, h >> 16) AS h FROM (SELECT i, {_mul("h", 0xC2B2AE35)} AS h
FROM (SELECT i, xor(h, h >> 13) AS h FROM (SELECT i, {_mul("h", 0x85EBCA6B)} AS h
FROM (SELECT i, xor(h, h >> 16) AS h FROM (SELECT i, xor((h * 5 + {0xE6546B64}) & {M32}, 4) AS h
FROM (SELECT i, {_rotl("h", 13)} AS h FROM (SELECT i, xor(k, 1234) AS h FROM (SELECT i, {_mul("k", 0x1B873593)} AS k
FROM (SELECT i, {_rotl("k", 15)} AS k FROM (SELECT i, {_mul("j", 0xCC9E2D51)} AS k FROM ({sql.PART_SQUARE})))))))))))"""
RANK = "least(26, CASE WHEN h = 0 THEN 33 ELSE 33 - length(bin(h)) END)"
HLL_ROWS = f"SELECT i, h & 127 AS p, CAST(max({RANK}) AS BIGINT) AS reg FROM ({HASHED}) GROUP BY 1, 2"
MIN_ROWS = f"SELECT i, h & 127 AS p, min(h) AS minh FROM ({HASHED}) GROUP BY 1, 2"
HLL_MERGED = f"""SELECT a.i AS i, r.p AS p, max(r.reg) AS reg FROM ({sql.PART_SQUARE}) a
JOIN ({HLL_ROWS}) r ON a.j = r.i GROUP BY 1, 2"""
MIN_MERGED = f"""SELECT a.i AS i, r.p AS p, min(r.minh) AS minh FROM ({sql.PART_SQUARE}) a
JOIN ({MIN_ROWS}) r ON a.j = r.i GROUP BY 1, 2"""
LINEAR = "128 * ln(128.0::DOUBLE / nullif(128 - seen, 0))"


def _sized(inner: str) -> str:
    return f"""SELECT i, round(e, 2) AS distinct_est, est, {SLOTS.format(e="est")} AS slots
FROM (SELECT i, e, greatest(CAST(floor(e * 1.5::DOUBLE) AS BIGINT), 1) AS est FROM ({inner}))"""


HLL = _sized(f"""SELECT i, CASE WHEN seen < 128 AND 11714.56::DOUBLE / (power + 128 - seen) <= 320 THEN {LINEAR}
  ELSE 11714.56::DOUBLE / (power + 128 - seen) END AS e
FROM (SELECT i, count(*) AS seen, sum(2.0::DOUBLE ** (-reg)) AS power FROM ({HLL_MERGED}) GROUP BY 1)""")
MIN = _sized(f"""SELECT i, CASE WHEN seen < 128 THEN {LINEAR} ELSE 4294967296.0::DOUBLE * inverse - 128 END AS e
FROM (SELECT i, count(*) AS seen, sum(1.0::DOUBLE / nullif(minh, 0)) AS inverse FROM ({MIN_MERGED}) GROUP BY 1)""")
MIN_BOUNDED = _sized(f"""SELECT i, CASE WHEN seen < 128 THEN {LINEAR} ELSE 16256.0::DOUBLE / level END AS e
FROM (SELECT i, count(*) AS seen, sum(minh / 4294967296.0::DOUBLE) AS level FROM ({MIN_MERGED}) GROUP BY 1)""")


def _rounded(df):
    return df.withColumn("distinct_est", F.round("distinct_est", 2))


def _both(t):
    return t.once("part_square"), t.once("part_square")


def _close(t, estimate):
    """Exact lengths of the product rows, and whether the estimate lies within a tenth (or two) of them."""
    gap = F.abs(F.col("est") - F.col("c_nnz"))
    return mul.output_row_lengths(*_both(t)).join(estimate, "i").select(
        "i", "c_nnz", (gap <= F.greatest(F.lit(2.0), F.col("c_nnz") * 0.1)).alias("close")
    )


CLOSE = f"""SELECT a.i AS i, count(DISTINCT b.j) AS c_nnz, true AS close
FROM ({sql.PART_SQUARE}) a JOIN ({sql.PART_SQUARE}) b ON a.j = b.i GROUP BY 1"""

QUERIES = {
    "hll_registers": Query(lambda t: sk.hll_registers(t.part_square), HLL_ROWS),
    "hll_merged_registers": Query(lambda t: sk.merged_hll(*_both(t)), HLL_MERGED),
    "hll_estimate": Query(lambda t: _rounded(sk.hll_estimate(*_both(t))), HLL),
    "row_estimate_bound": Query(
        lambda t: sk.row_estimate(*_both(t), method="bound"),
        f"""SELECT i, CAST(n AS DOUBLE) AS distinct_est, n AS est, {SLOTS.format(e="n")} AS slots
FROM (SELECT a.i AS i, count(*) AS n FROM ({sql.PART_SQUARE}) a JOIN ({sql.PART_SQUARE}) b ON a.j = b.i GROUP BY 1)""",
    ),
    "minhash_registers": Query(lambda t: sk.minhash_registers(t.part_square), MIN_ROWS),
    "minhash_merged_registers": Query(lambda t: sk.merged_minhash(*_both(t)), MIN_MERGED),
    "minhash_estimate": Query(lambda t: _rounded(sk.minhash_estimate(*_both(t))), MIN),
    "minhash_estimate_bounded": Query(
        lambda t: _rounded(sk.minhash_estimate(*_both(t), bounded=True)), MIN_BOUNDED
    ),
    "native_hll": Query(lambda t: _close(t, sk.native_hll_estimate(*_both(t))), CLOSE),
    "native_theta": Query(lambda t: _close(t, sk.native_theta_estimate(*_both(t))), CLOSE),
}
