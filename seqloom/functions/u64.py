"""Unsigned 64-bit arithmetic on BIGINT bit patterns, as column expressions that ANSI mode doesn't stop."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_LOW = (1 << 32) - 1
# Multipliers and step of the splitmix64 generator, prime and offset of the 64-bit FNV-1a hash used here.
MIX_1, MIX_2, GAMMA = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15
FNV_PRIME, FNV_OFFSET = 1099511628211, 1469598103934665603


def signed(x: int) -> int:
    """The BIGINT with the bits of x modulo 2 ** 64."""
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def lit64(x: int) -> Column:
    return F.lit(signed(x)).cast("long")


def let(x: Column, body: Callable[[Column], Column]) -> Column:
    """body of x, with x evaluated once however often body names it; keeps nested expressions small."""
    return F.element_at(F.transform(F.array(x), body), 1)


def add64(a: Column, b: Column) -> Column:
    mask = F.lit(_LOW)

    def halves(p: Column) -> Column:
        low = p["a"].bitwiseAND(mask) + p["b"].bitwiseAND(mask)
        return let(low, lambda s: F.shiftleft(F.shiftrightunsigned(p["a"], 32) + F.shiftrightunsigned(p["b"], 32) + F.shiftrightunsigned(s, 32), 32).bitwiseOR(s.bitwiseAND(mask)))

    return let(F.struct(a.alias("a"), b.alias("b")), halves)


def mul64(a: Column, by: int) -> Column:
    """a * by modulo 2 ** 64: 32-bit halves of a times 16-bit limbs of the constant, every sum below 2 ** 63."""
    c = [F.lit(by >> k & 0xFFFF).cast("long") for k in (0, 16, 32, 48)]
    mask, short = F.lit(_LOW), F.lit(0xFFFF).cast("long")
    up = lambda x: F.shiftleft(x.bitwiseAND(short), 16)

    def product(x: Column) -> Column:
        lo, hi = x.bitwiseAND(mask), F.shiftrightunsigned(x, 32)
        low = lo * c[0] + up(lo * c[1])
        high = F.shiftrightunsigned(lo * c[1], 16) + lo * c[2] + up(lo * c[3]) + hi * c[0] + up(hi * c[1])
        return let(low, lambda s: F.shiftleft(high + F.shiftrightunsigned(s, 32), 32).bitwiseOR(s.bitwiseAND(mask)))

    return let(a, product)


def folded(x: Column, shift: int) -> Column:
    """x XOR x >>> shift."""
    return let(x, lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, shift)))


def hash64(x: Column) -> Column:
    return folded(mul64(folded(mul64(folded(x, 30), MIX_1), 27), MIX_2), 31)


def splitmix(seed: int, draw: Column) -> Column:
    """The generator's output number `draw` (from 1): any draw without those before it."""
    return hash64(add64(mul64(draw, GAMMA), lit64(seed)))


def unit(x: Column) -> Column:
    """In [0, 1), from the upper 53 bits."""
    return F.shiftrightunsigned(x, 11).cast("double") * F.lit(1.0 / (1 << 53))


def fnv1a(data: Column) -> Column:
    """FNV-1a of a string's UTF-8 bytes or of binary."""
    codes = F.transform(F.split(F.regexp_replace(F.hex(data), "(..)", "$1 "), " "), lambda h: F.conv(h, 16, 10).cast("long"))
    return F.aggregate(F.filter(codes, lambda c: c.isNotNull()), lit64(FNV_OFFSET), lambda h, c: mul64(h.bitwiseXOR(c), FNV_PRIME))


def unsigned_order(x: Column) -> Column:
    """Sorts BIGINT bit patterns as unsigned numbers."""
    return x.bitwiseXOR(lit64(1 << 63))
