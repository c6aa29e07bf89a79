"""Exact order statistics of groups that are too large for one task.

Values are placed by ranges (:mod:`quantloom.plans.ranges`): a quantile is read off the one or two rows at its
places, a rank is a row's place with ties averaged, and winsorising clips to two quantiles. Nulls and NaN have no
place: they are left out of counts and quantiles, and their rank and clipped value are null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quantloom.plans.ranges import COUNT, PLACE, RANGE, joined, placed
from quantloom.session import written


def _usable(value: str) -> Column:
    return F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))


def _quantiles(rows: DataFrame, by: list[str], value: str, qs: dict[str, float]) -> DataFrame:
    """Linear interpolation at q (n - 1), from placed rows: those beside the places only are gathered."""
    at = {name: float(q) * (F.col(COUNT) - 1) for name, q in qs.items()}
    near = lambda a: (F.col(PLACE) - 1 == F.floor(a)) | (F.col(PLACE) - 1 == F.ceil(a))
    beside = rows.where(reduce(lambda x, y: x | y, [near(a) for a in at.values()]))
    one = lambda a, edge: F.max(F.when(F.col(PLACE) - 1 == edge(a), F.col(value).cast("double")))
    part = {name: F.max(a - F.floor(a)) for name, a in at.items()}
    low, high = {n: one(a, F.floor) for n, a in at.items()}, {n: one(a, F.ceil) for n, a in at.items()}
    return beside.groupBy(*by).agg(*[(low[n] + (high[n] - low[n]) * part[n]).alias(n) for n in qs])


def quantiles(df: DataFrame, by: list[str], value: str, order: list[str], qs: dict[str, float]) -> DataFrame:
    """A row per group with the named quantiles."""
    rows = placed(df.where(_usable(value)).select(*by, value, *order), by, [F.asc(value), *map(F.asc, order)])
    return _quantiles(rows, by, value, qs)


def ranks(df: DataFrame, by: list[str], value: str, order: list[str], name: str = "rank") -> DataFrame:
    """The rows with their rank from 0 to 1, ties averaged; 1 for a group of one."""
    rows = placed(df.where(_usable(value)), by, [F.asc(value), *map(F.asc, order)])
    # A row per value and range: equal values can reach over ranges.
    ties = rows.groupBy(*by, value, RANGE).agg(F.min(PLACE).alias("_first"), F.count("*").alias("_n"))
    same = Window.partitionBy(*by, value)
    ties = ties.select(*by, value, RANGE, F.min("_first").over(same).alias("_first"), F.sum("_n").over(same).alias("_same"))
    n = F.col(COUNT)
    rank = F.when(n == 1, F.lit(1.0)).otherwise((F.col("_first") - 1 + (F.col("_same") - 1) / 2) / F.when(n > 1, n - 1))
    made = joined(rows, ties, [*by, value, RANGE]).withColumn(name, rank).drop("_first", "_same", PLACE, COUNT, RANGE)
    return made.unionByName(df.where(~F.coalesce(_usable(value), F.lit(False))).withColumn(name, F.lit(None).cast("double")))


def winsorized(df: DataFrame, by: list[str], value: str, order: list[str], lower: float = 0.05, upper: float = 0.95, name: str = "winsorized") -> DataFrame:
    """The rows with their value clipped to two quantiles of the group."""
    rows = placed(df.where(_usable(value)), by, [F.asc(value), *map(F.asc, order)])
    edges = _quantiles(rows, by, value, {"_low": lower, "_high": upper})
    # A row per group and range, so that a large group's rows need not meet to get its two numbers.
    edges = joined(rows.select(*by, RANGE).distinct(), edges, by)
    made = joined(rows, edges, [*by, RANGE]).withColumn(name, F.greatest("_low", F.least("_high", F.col(value).cast("double")))).drop("_low", "_high", PLACE, COUNT, RANGE)
    return made.unionByName(df.where(~F.coalesce(_usable(value), F.lit(False))).withColumn(name, F.lit(None).cast("double")))


def _value_ranks(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """Rows (by, value, _n ...) of distinct values and how many rows have them, with ``_d``: the rank of those rows,
    ties averaged, less the group's mean rank."""
    ranked = placed(values, by, [F.asc(value)], {"_rest": "_n"})
    return ranked.withColumn("_d", F.col("_rest_all") - F.col("_rest") + (F.col("_n") - F.col("_rest_all")) / 2).drop("_rest", "_rest_all", PLACE, COUNT, RANGE)


def spearman(df: DataFrame, by: list[str], x: str, y: str, order: list[str], name: str = "spearman") -> DataFrame:
    """A row per group: the correlation of the ranks of two columns, over rows that have both; null without
    variance. Ranks belong to distinct values, which partial aggregation makes: rows are never placed, and a
    value's rows add up their ranks of ``y`` before the ranks of ``x`` are known."""
    both = df.where(_usable(x) & _usable(y)).select(*by, F.col(x).alias("_x"), F.col(y).alias("_y"))
    n = F.count("*").cast("double").alias("_n")
    # written, so that Spark knows its size: few distinct values are broadcast
    ry = written(_value_ranks(both.groupBy(*by, "_y").agg(n), by, "_y"), "ranks")
    per_x = joined(both, ry.select(*by, "_y", "_d"), [*by, "_y"]).groupBy(*by, "_x").agg(n, F.sum("_d").alias("_s"))
    rx = _value_ranks(per_x, by, "_x").groupBy(*by).agg(F.sum(F.col("_d") * F.col("_s")).alias("_xy"), F.sum(F.col("_n") * F.col("_d") * F.col("_d")).alias("_xx"))
    yy = ry.groupBy(*by).agg(F.sum(F.col("_n") * F.col("_d") * F.col("_d")).alias("_yy"))
    corr = F.col("_xy") / (F.sqrt(F.nullif(F.col("_xx"), F.lit(0.0))) * F.sqrt(F.nullif(F.col("_yy"), F.lit(0.0))))
    return joined(rx, yy, by).select(*by, corr.alias(name))
