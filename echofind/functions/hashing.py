"""Shingles and MinHash expressions; all 64-bit arithmetic is safe under ANSI overflow checks."""

from __future__ import annotations

import random

from pyspark.sql import Column
from pyspark.sql import functions as F

PRIME = 2147483647
#: The 64-bit FNV-1a offset (as a signed number) and the low part of its prime 2**40 + 435.
FNV_OFFSET, FNV_LOW = -3750763034362895579, 435


def packed_shingles(tokens: Column, k: int) -> Column:
    """One number per window of ``k`` (at most 7) categories, 8 bits each; none if the text is shorter."""
    if not 1 <= k <= 7:
        raise ValueError("k must lie between 1 and 7")
    n = F.size(tokens)
    own = lambda i: F.aggregate(F.slice(tokens, i, k), F.lit(0).cast("long"), lambda a, t: a * 256 + t)
    return F.when(n >= k, F.transform(F.sequence(F.lit(1), n - k + 1), own)).otherwise(F.array().cast("array<bigint>"))


def _fnv_step(h: Column, byte: Column) -> Column:
    x = h.bitwiseXOR(byte.cast("long"))
    low32 = F.lit(0xFFFFFFFF).cast("long")
    lo, hi = x.bitwiseAND(low32), F.shiftrightunsigned(x, 32)
    low = lo * FNV_LOW
    high = (hi * FNV_LOW + F.shiftrightunsigned(low, 32) + lo * 256).bitwiseAND(low32)
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(low32))


def fnv_shingles(tokens: Column, k: int) -> Column:
    """FNV-1a over the four little-endian bytes of each of ``k`` tokens; 64-bit patterns as signed numbers."""
    n = F.size(tokens)

    def own(i: Column) -> Column:
        bytes_ = F.flatten(F.transform(F.slice(tokens, i, k), lambda t: F.array(*(F.shiftrightunsigned(t, s).bitwiseAND(255) for s in (0, 8, 16, 24)))))
        return F.aggregate(bytes_, F.lit(FNV_OFFSET).cast("long"), _fnv_step)

    if k < 1:
        return F.array().cast("array<bigint>")
    return F.when(n >= k, F.transform(F.sequence(F.lit(1), n - k + 1), own)).otherwise(F.array().cast("array<bigint>"))


# The prime 2**64 - 59, and the golden ratio and multipliers of the coefficient mixer.
PRIME64, GOLDEN, MIX1, MIX2 = 0xFFFFFFFFFFFFFFC5, 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def coefficients64(n: int, seed: int = 42) -> list[tuple[int, int]]:
    """Pairs (a, b) of the family (a * x + b) mod 2**64 mod PRIME64, a odd: numbers 1, 2, 3... of a mixer of the seed."""
    whole = (1 << 64) - 1

    def number(k: int) -> int:
        x = seed ^ k * GOLDEN & whole
        x = (x ^ x >> 30) * MIX1 & whole
        x = (x ^ x >> 27) * MIX2 & whole
        return x ^ x >> 31

    return [(number(2 * i + 1) | 1, number(2 * i + 2)) for i in range(n)]


def affine64(x: Column, a: int, b: int) -> Column:
    """(a * x + b) mod 2**64 mod PRIME64 of 64-bit patterns, by halves; a signed number, so order it by ``unsigned``."""
    low32, low16 = F.lit(0xFFFFFFFF).cast("long"), F.lit(0xFFFF).cast("long")
    xl, xh = x.bitwiseAND(low32), F.shiftrightunsigned(x, 32)
    al, ah = F.lit(a & 0xFFFFFFFF).cast("long"), F.lit(a >> 32).cast("long")

    def low_product(p: Column, q: Column) -> Column:  # the low half of a product of halves
        return (p * q.bitwiseAND(low16) + F.shiftleft((p * F.shiftrightunsigned(q, 16)).bitwiseAND(low16), 16)).bitwiseAND(low32)

    first, second = al * xl.bitwiseAND(low16), al * F.shiftrightunsigned(xl, 16)
    low = first.bitwiseAND(low32) + F.shiftleft(second.bitwiseAND(low16), 16) + F.lit(b & 0xFFFFFFFF).cast("long")
    high = F.shiftrightunsigned(first, 32) + F.shiftrightunsigned(second, 16) + F.shiftrightunsigned(low, 32) + low_product(ah, xl) + low_product(xh, al) + F.lit(b >> 32).cast("long")
    low, high = low.bitwiseAND(low32), high.bitwiseAND(low32)
    over = low - F.lit(PRIME64 & 0xFFFFFFFF).cast("long")
    return F.when((high == low32) & (over >= 0), over).otherwise(F.shiftleft(high, 32).bitwiseOR(low))


def unsigned(x: Column) -> Column:
    """A number whose signed order is the unsigned order of ``x``; its own inverse."""
    return x.bitwiseXOR(F.lit(-(1 << 63)).cast("long"))


def word_key(words: Column) -> Column:
    """28 bits of a string, the same in other SQL engines: the first seven hex digits of its md5."""
    return F.conv(F.substring(F.md5(words), 1, 7), 16, 10).cast("long")


def coefficients(n: int, seed: int = 42) -> list[tuple[int, int]]:
    """Seeded pairs (a, b) of the family (a * x + b) mod PRIME."""
    rng = random.Random(seed)
    return [(rng.randrange(1, PRIME), rng.randrange(PRIME)) for _ in range(n)]


def affine(x: Column, a: int, b: int) -> Column:
    return (x * F.lit(a).cast("long") + F.lit(b).cast("long")) % PRIME
