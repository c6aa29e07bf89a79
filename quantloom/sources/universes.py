"""Universes that change with time, for all dates at once.

A universe is spans of membership (symbol, since, until). Bars are matched to the span they lie in by an
equi-join: spans are copied to the periods that they touch, and a bar knows its period, so neither a date nor a
symbol is looked up against all spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

UNITS = ("day", "week", "month", "quarter", "year")


def _unit(unit: str) -> str:
    if unit not in UNITS:
        raise ValueError(f"a period is one of {', '.join(UNITS)}, not {unit!r}")
    return unit


def period_of(ts: Column, unit: str) -> Column:
    """The start of the period that a time lies in."""
    return F.date_trunc(_unit(unit), ts)


def _later(period: Column, n: Column | int, unit: str) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    if unit in ("day", "week"):
        return period + F.make_dt_interval(n * (7 if unit == "week" else 1))
    return period + F.make_ym_interval(months=n * {"month": 1, "quarter": 3, "year": 12}[unit])


def trailing_members(facts: DataFrame, symbol: str, ts: str, unit: str, back: int, having: Column) -> DataFrame:
    """(symbol, period): the symbols whose facts of the ``back`` periods before a period pass ``having``, an
    aggregate condition. Nothing of the period itself or later is looked at. A fact is copied to the periods
    after it that it counts for, up to the last that has facts or follows one."""
    start = period_of(F.col(ts), unit)
    counted = facts.where(F.col(ts).isNotNull() & F.col(symbol).isNotNull()).withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(int(back))))).withColumn("period", _later(start, F.col("_k"), unit))
    return counted.groupBy(F.col(symbol).alias("symbol"), "period").agg(having.alias("_in")).where("_in").select("symbol", "period")


def spans(members: DataFrame, unit: str) -> DataFrame:
    """(symbol, since, until): periods of membership that follow each other put together; ``until`` is the first
    moment after."""
    by = Window.partitionBy("symbol").orderBy("period")
    distinct = members.select("symbol", "period").distinct()
    first = ~F.coalesce(_later(F.lag("period").over(by), 1, unit) == F.col("period"), F.lit(False))
    runs = distinct.withColumn("_first", first).withColumn("_run", F.sum(F.col("_first").cast("int")).over(by))
    return runs.groupBy("symbol", "_run").agg(F.min("period").alias("since"), _later(F.max("period"), 1, unit).alias("until")).drop("_run")


def in_universe(bars: DataFrame, memberships: DataFrame, unit: str, symbol: str = "symbol", ts: str = "ts") -> DataFrame:
    """The bars whose symbol is a member at their time, once each however many spans they lie in. ``unit`` is the
    length of the periods that spans are dealt by: about as long as they are, or shorter."""
    step = {"day": "interval 1 day", "week": "interval 7 days", "month": "interval 1 month", "quarter": "interval 3 months", "year": "interval 1 year"}[_unit(unit)]
    touched = F.sequence(period_of(F.col("since"), unit), period_of(F.col("until") - F.expr("interval 1 microsecond"), unit), F.expr(step))
    dealt = memberships.where("since < until").select(F.col("symbol").alias("_symbol"), "since", "until", F.explode(touched).alias("_period"))
    match = (F.col(symbol) == F.col("_symbol")) & (period_of(F.col(ts), unit) == F.col("_period")) & (F.col(ts) >= F.col("since")) & (F.col(ts) < F.col("until"))
    return bars.join(dealt, match, "left_semi")
