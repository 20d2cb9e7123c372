"""Colour arithmetic on channel columns, 0 to 255."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def div(x: Column, y: int) -> Column:
    """Whole part of x / y for x not below 0."""
    return F.floor(x / y).cast("long")


def quantised(c: Column, bits: int) -> Column:
    """A channel's nearest level with so many bits; one bit says whether it is 128 or more."""
    if bits == 1:
        return (c >= 128).cast("long")
    top = (1 << bits) - 1
    return div(c * top + 127, 255)


def expanded(q: Column, bits: int) -> Column:
    """A level as a channel again: its high bits repeat below."""
    if bits == 1:
        return q * 255
    if bits == 4:
        return q * 17
    return q * (1 << (8 - bits)) + div(q, 1 << (2 * bits - 8))


def luma(r: Column, g: Column, b: Column) -> Column:
    return div(r * 77 + g * 150 + b * 29 + 128, 256)


def over_black(c: Column, a: Column) -> Column:
    """A channel in front of black, which is also the premultiplied channel."""
    return div(c * a + 127, 255)


def over(c: Column, a: Column, back: int) -> Column:
    """A channel in front of a solid channel."""
    return div(c * a + (255 - a) * back + 127, 255)


def packed_rgba4444(r: Column, g: Column, b: Column, a: Column) -> Column:
    q = [quantised(c, 4) for c in (r, g, b, a)]
    return q[0] * 4096 + q[1] * 256 + q[2] * 16 + q[3]


def packed_rgb565(r: Column, g: Column, b: Column) -> Column:
    return quantised(r, 5) * 2048 + quantised(g, 6) * 32 + quantised(b, 5)


def packed_rgba5551(r: Column, g: Column, b: Column, a: Column) -> Column:
    return quantised(r, 5) * 2048 + quantised(g, 5) * 64 + quantised(b, 5) * 2 + quantised(a, 1)


def packed_rgba(r: Column, g: Column, b: Column, a: Column) -> Column:
    return r * 16777216 + g * 65536 + b * 256 + a
