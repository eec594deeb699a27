"""Bit tricks, logistic pair, little-endian integers, small hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bit_length(x: Column) -> Column:
    """Bits needed for a non-negative number; 0 for 0."""
    return F.when(x > 0, F.length(F.bin(x))).otherwise(0)


def ones(x: Column) -> Column:
    return F.bit_count(x)


def little_endian(data: Column, at: int, width: int) -> Column:
    """The unsigned integer in ``width`` (up to 7) bytes from byte ``at`` (from 0)."""
    h = F.hex(F.substring(data, at + 1, width))
    return F.conv(F.concat(*[F.substring(h, 2 * i + 1, 2) for i in range(width - 1, -1, -1)]), 16, 10).cast("long")


def to_little_endian(x: Column, width: int) -> Column:
    h = F.lpad(F.hex(x), 2 * width, "0")
    return F.unhex(F.concat(*[F.substring(h, 2 * i + 1, 2) for i in range(width - 1, -1, -1)]))


def float64(x: Column) -> Column:
    """The eight little-endian bytes of a finite double, zero or normal, from its sign, exponent and fraction."""
    size = F.abs(x)
    guess = F.floor(F.log2(size))
    unit = lambda e: size / F.pow(F.lit(2.0), e)
    power = guess + F.when(unit(guess) >= 2, 1).when(unit(guess) < 1, -1).otherwise(0)
    fraction = ((unit(power) - 1) * float(1 << 52)).cast("long")
    bits = F.shiftleft((power + 1023).cast("long"), 52) + fraction + F.when(x < 0, F.lit(-(2**63))).otherwise(F.lit(0))
    return to_little_endian(F.when(x == 0, F.lit(0)).otherwise(bits).cast("long"), 8)


def squash(x: Column) -> Column:
    """4096 / (1 + exp(-x / 256)), within 12 bits."""
    return F.least(F.lit(4095), F.greatest(F.lit(0), F.floor(4096 / (1 + F.exp(-x / 256.0))))).cast("long")


def stretch(p: Column) -> Column:
    """256 ln(p / (1 - p)) of a 12-bit probability, within 12 bits signed."""
    q = (p + 0.5) / 4096.0
    return F.least(F.lit(2047), F.greatest(F.lit(-2047), F.round(256 * F.log(q / (1 - q))))).cast("long")


def context_hash(a: Column, b: Column) -> Column:
    """(a + b + 512) * 773 modulo 2 ** 32."""
    return F.pmod((a + b + 512) * 773, F.lit(1 << 32))


def hash4(word: Column) -> Column:
    """A 16-bit fold of a big-endian 32-bit word."""
    return word.bitwiseXOR(F.shiftright(word, 16)).bitwiseAND(F.lit(0xFFFF))
