"""Exact binomial tails as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def ln_factorial(x: Column) -> Column:
    """ln(x!) for x >= 0: Stirling's series at x + 9, stepped down; relative error below 1e-13."""
    z = x + F.lit(9.0)
    v = 1 / (z * z)
    series = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + (1 / 12 - v * (1 / 360 - v * (1 / 1260 - v * (1 / 1680 - v * (1 / 1188 - v * (691 / 360360)))))) / z
    for j in range(1, 9):
        series = series - F.log(x + F.lit(float(j)))
    return series


def lower_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p) and integer columns k <= n; 1 where k >= n * p.

    Below the mean the terms fall from k downwards, so they are summed from there; those beyond 60
    standard deviations are below the precision of a double.
    """
    kd, nd = k.cast("double"), n.cast("double")
    first = F.exp(ln_factorial(nd) - ln_factorial(kd) - ln_factorial(nd - kd) + kd * math.log(p) + (nd - kd) * math.log1p(-p))
    reach = F.least(k, (60 * F.sqrt(nd * p) + 60).cast("long"))
    steps = F.when(reach >= 1, F.sequence(k, k - reach + 1, F.lit(-1).cast("long")))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] * i.cast("double") / (nd - i.cast("double") + 1) * ((1 - p) / p)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    total = F.coalesce(F.aggregate(steps, start, step, lambda acc: acc["total"]), F.lit(1.0))
    return F.when(kd >= nd * p, F.lit(1.0)).otherwise(F.least(F.lit(1.0), first * total))
