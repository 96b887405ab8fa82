"""Unsigned 64-bit hashes on signed 64-bit columns.

Wrapping products are taken in 32-bit halves, so that no step overflows and ANSI mode can stay on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.text import let

# FNV-1a and the 64-bit MurmurHash3 finaliser.
FNV_OFFSET = 0xCBF29CE484222325
FNV_PRIME = 0x100000001B3
MIX_1 = 0xFF51AFD7ED558CCD
MIX_2 = 0xC4CEB9FE1A85EC53

_MASK = (1 << 32) - 1


def _signed(u: int) -> int:
    return u - (1 << 64) if u >> 63 else u


def times(x: Column, factor: int) -> Column:
    """``x * factor`` modulo 2**64."""

    return let(x, lambda v: _times(v, factor))


def _times(x: Column, factor: int) -> Column:
    def product(a: Column, b: int) -> Column:
        """Of two unsigned 32-bit numbers, modulo 2**64, through 16-bit parts of ``b``."""
        low, high = a * F.lit(b & 0xFFFF), a * F.lit(b >> 16)
        # low < 2**48, high < 2**48: the shifted sum wraps only through bit operations
        carry = F.shiftrightunsigned(low, 16) + high
        return F.shiftleft(carry, 16).bitwiseOR(low.bitwiseAND(F.lit(0xFFFF)))


    a0, a1 = x.bitwiseAND(F.lit(_MASK)), F.shiftrightunsigned(x, 32)
    b0, b1 = factor & _MASK, factor >> 32
    cross = product(a0, b1).bitwiseAND(F.lit(_MASK)) + product(a1, b0).bitwiseAND(F.lit(_MASK))

    def joined(base: Column) -> Column:
        high = (F.shiftrightunsigned(base, 32) + cross).bitwiseAND(F.lit(_MASK))
        return F.shiftleft(high, 32).bitwiseOR(base.bitwiseAND(F.lit(_MASK)))

    return let(product(a0, b0), joined)


def fnv1a64(text: Column) -> Column:
    """FNV-1a over the UTF-8 bytes."""


    def bytes_of(hexed: Column) -> Column:
        places = F.sequence(F.lit(1), F.length(hexed) - 1, F.lit(2))
        return F.when(hexed == "", F.array().cast("array<long>")).otherwise(F.transform(places, lambda i: F.conv(F.substring(hexed, i, F.lit(2)), 16, 10).cast("long")))

    codes = let(F.hex(F.encode(text, "UTF-8")), bytes_of)
    return F.aggregate(codes, F.lit(_signed(FNV_OFFSET)), lambda h, b: times(h.bitwiseXOR(b), FNV_PRIME))


def fmix64(h: Column) -> Column:
    """The finaliser: xor-shifts by 33 around two products."""
    for factor in (MIX_1, MIX_2):
        h = times(let(h, lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, 33))), factor)
    return let(h, lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, 33)))


def fraction(h: Column) -> Column:
    """The unsigned value over 2**64 - 1."""
    return let(h, lambda v: _fraction(v))


def _fraction(h: Column) -> Column:
    return (F.shiftrightunsigned(h, 1).cast("double") * 2 + h.bitwiseAND(F.lit(1)).cast("double")) / F.lit(float((1 << 64) - 1))


def byte_alphabet(spark: SparkSession) -> DataFrame:
    """The bijection of bytes to printable characters: ``b`` and the code point ``shown``."""
    from pyspark.sql.window import Window

    b = F.col("b")
    plain = b.between(33, 126) | b.between(161, 172) | b.between(174, 255)
    nth = F.sum(F.when(plain, 0).otherwise(1)).over(Window.orderBy("b"))
    return spark.range(256).select(F.col("id").alias("b")).select("b", F.when(plain, b).otherwise(255 + nth).alias("shown"))
