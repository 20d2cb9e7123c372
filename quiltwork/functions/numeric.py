"""Integer and rounding helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ceil_to(x: Column, step: int) -> Column:
    """The least multiple of step that isn't below x; steps below 2 change nothing."""
    return x if step < 2 else (x + (step - 1) - F.pmod(x + (step - 1), F.lit(step))).cast("long")


def floor_to(x: Column, step: int) -> Column:
    return x if step < 2 else (x - F.pmod(x, F.lit(step))).cast("long")


def next_pot(x: Column) -> Column:
    """The least power of two that isn't below x; 1 for x below 2."""
    return F.when(x <= 1, F.lit(1).cast("long")).otherwise(F.expr("1L") * F.pow(F.lit(2), F.length(F.bin(x.cast("long") - 1))).cast("long"))


def prev_pot(x: Column) -> Column:
    """The greatest power of two that isn't above x; 1 for x below 2."""
    return F.when(x <= 1, F.lit(1).cast("long")).otherwise(F.pow(F.lit(2), F.length(F.bin(x.cast("long"))) - 1).cast("long"))


def snap_nearest(x: Column, step: int) -> Column:
    """The nearest multiple of step, halves up, never below 0."""
    return x if step < 2 else F.greatest(floor_to((x + step // 2).cast("long"), step), F.lit(0).cast("long"))


def scale_denominator(scale: Column, most: int = 64, slack: float = 5e-4) -> Column:
    """The least q up to most for which some p / q is within slack of the scale; null if there is none."""
    near = lambda q: F.abs(F.round(scale * q) / q - scale) <= slack
    return F.get(F.filter(F.sequence(F.lit(1), F.lit(most)), near), F.lit(0))


def scaled(x: Column, scale: Column) -> Column:
    """x times a scale in single precision, rounded half away from zero."""
    return F.round(x.cast("float") * scale.cast("float")).cast("long")


def lcm_capped(a: Column, b: Column, cap: int) -> Column:
    """The least common multiple of two positive numbers, at most cap; the greatest common divisor comes from Euclid's steps, of which 64-bit numbers need at most 92."""
    state = F.struct(F.greatest(a, b).cast("long").alias("p"), F.least(a, b).cast("long").alias("q"))
    step = lambda s, _: F.when(s["q"] > 0, F.struct(s["q"].alias("p"), F.pmod(s["p"], F.greatest(s["q"], F.lit(1).cast("long"))).alias("q"))).otherwise(s)
    divisor = F.aggregate(F.sequence(F.lit(1), F.lit(92)), state, step)["p"]
    many = F.floor(a / divisor).cast("decimal(38,0)") * b.cast("decimal(38,0)")
    return F.least(many, F.lit(cap).cast("decimal(38,0)")).cast("long")
