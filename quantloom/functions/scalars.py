"""Scalar helpers as column expressions."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")

#: Acklam's coefficients of the inverse normal distribution (central and tail fractions).
CENTRAL_TOP = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
CENTRAL_BOTTOM = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
TAIL_TOP = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
TAIL_BOTTOM = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
TAIL_BELOW = 0.02425


def exp_factor(period: float) -> float:
    return 2.0 / (period + 1)


def wilders_factor(period: float) -> float:
    return 1.0 / period


def gcd(a: Column, b: Column) -> Column:
    """Euclid's algorithm: 92 steps are enough for any two 64-bit integers."""
    start = F.struct(F.abs(a.cast("long")).alias("x"), F.abs(b.cast("long")).alias("y"))
    step = lambda s, _: F.struct(F.when(s["y"] == 0, s["x"]).otherwise(s["y"]).alias("x"), F.when(s["y"] == 0, s["y"]).otherwise(s["x"] % F.when(s["y"] != 0, s["y"])).alias("y"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step, lambda s: s["x"])


def lcm(a: Column, b: Column) -> Column:
    g = gcd(a, b)
    return F.when((a == 0) | (b == 0), F.lit(0).cast("long")).otherwise(F.abs(a.cast("long")) / g * F.abs(b.cast("long"))).cast("long")


def midpoint(a: Column, b: Column) -> Column:
    """The middle of two indices, rounded down."""
    return F.floor(a + (b - a) / 2)


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + t * (b - a)


def inv_lerp(a: Column, b: Column, v: Column) -> Column:
    return F.when(a != b, (v - a) / F.when(a != b, b - a)).otherwise(F.lit(NAN))


def remap(v: Column, a: Column, b: Column, c: Column, d: Column) -> Column:
    """v from the range a..b to the range c..d."""
    return lerp(c, d, inv_lerp(a, b, v))


def clamp(v: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(high, v))


def normal_pdf(x: Column) -> Column:
    return F.exp(-0.5 * x * x) / math.sqrt(2 * math.pi)


def _polynomial(coefficients: tuple[float, ...], x: Column) -> Column:
    return reduce(lambda acc, c: acc * x + c, coefficients[1:], F.lit(coefficients[0]))


def inv_normal_cdf(p: Column) -> Column:
    """Quantile of the standard normal distribution, to about nine digits; NaN at 0 and 1 and beyond."""
    q, inside = p - 0.5, (p > 0) & (p < 1)
    r = q * q
    central = _polynomial(CENTRAL_TOP, r) * q / _polynomial(CENTRAL_BOTTOM, r)

    def tail(x: Column) -> Column:
        t = F.sqrt(-2 * F.log(F.when(inside, x)))
        return _polynomial(TAIL_TOP, t) / _polynomial(TAIL_BOTTOM, t)

    return (
        F.when(~inside, F.lit(NAN))
        .when(p < TAIL_BELOW, tail(p))
        .when(p > 1 - TAIL_BELOW, -tail(1 - p))
        .otherwise(central)
    )
