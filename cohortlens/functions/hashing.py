"""Repeatable pseudo-random numbers from row content.

A uniform draw is the first 32 bits of ``md5(key|...|seed)`` divided by 2^32.
It depends only on the row's key, never on partitioning or task order, so a
recomputed partition (lost executor, AQE re-plan) sees the same numbers, and
any SQL engine with ``md5`` reproduces them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

RANDOM_SEED = 1105  # fixed value: default seed of the modelled workflow

_TWO32 = 4294967296.0


def _as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hash_key(*parts) -> Column:
    """``concat_ws('|', parts...)`` with every part cast to string."""
    return F.concat_ws("|", *[_as_col(p).cast("string") for p in parts])


def uniform(*parts, seed: int = RANDOM_SEED) -> Column:
    """u in [0, 1) from md5 of the '|'-joined parts and the seed."""
    text = F.concat_ws("|", *[_as_col(p).cast("string") for p in parts], F.lit(str(seed)))
    return uniform_of_text(text)


def uniform_of_text(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(_TWO32)


def hash_bucket(u: Column, bits: int = 16) -> Column:
    """Leading ``bits`` bits of a uniform as an int bucket (order preserving)."""
    return F.floor(u * F.lit(float(1 << bits))).cast("int")


def poisson_thresholds(mean: float = 1.0, tail: float = 1e-12) -> list[float]:
    """Cumulative Poisson(mean) probabilities c_0 < c_1 < ... until 1 - c_k < tail."""
    out, term, acc, k = [], math.exp(-mean), 0.0, 0
    while True:
        acc += term
        out.append(acc)
        if 1.0 - acc < tail or k > 60:
            return out
        k += 1
        term *= mean / k


def poisson_weight(u: Column, mean: float = 1.0) -> Column:
    """Inverse-CDF Poisson draw from a uniform: number of thresholds <= u.

    ``u`` should be a column reference (materialised in a projection below):
    the CASE chain then compares one attribute, not a re-evaluated hash.
    """
    expr = None
    th = poisson_thresholds(mean)
    for k, c in enumerate(th):
        cond = u < F.lit(c)
        expr = F.when(cond, F.lit(k)) if expr is None else expr.when(cond, F.lit(k))
    return expr.otherwise(F.lit(len(th))).cast("int")


# fixed values: 32-bit golden-ratio increment and integer mixer multiplier
GOLDEN32 = 0x9E3779B9
MIX32 = 0x45D9F3B
MASK32 = 0xFFFFFFFF


def hash32(*parts, seed: int = RANDOM_SEED) -> Column:
    """First 32 bits of md5(parts|seed) as a bigint in [0, 2^32)."""
    text = F.concat_ws("|", *[_as_col(p).cast("string") for p in parts], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def mix32(x: Column) -> Column:
    """Bijective 32-bit integer mixer (xor-shift-multiply, two rounds).

    All intermediates stay below 2^59, so bigint arithmetic never overflows
    (ANSI mode) and any SQL engine with 64-bit integers reproduces it.
    """
    mask = F.lit(MASK32).cast("bigint")
    for _ in range(2):
        x = (F.shiftright(x, 16).bitwiseXOR(x) * F.lit(MIX32)).bitwiseAND(mask)
    return F.shiftright(x, 16).bitwiseXOR(x)


def stream_uniform(base32: Column, index: Column) -> Column:
    """Uniform number ``index`` of the per-row stream seeded by ``base32``.

    One md5 per row seeds the stream; each draw is a counter step by the
    golden-ratio increment pushed through ``mix32`` (a 32-bit splitmix).
    """
    x = (base32 + index.cast("bigint") * F.lit(GOLDEN32)).bitwiseAND(F.lit(MASK32).cast("bigint"))
    return mix32(x) / F.lit(_TWO32)
