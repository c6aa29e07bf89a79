"""Net asset value of dated weights, without a ledger: all symbols and periods in parallel.

Weights of a date are bought at the next date's open and held until the open after the next date with weights;
the last ones are valued at their symbol's last close. What a symbol makes of its share is a join of two prices;
a period's growth is a sum over its symbols, its costs come from the distance of the new weights from what the old
ones have drifted to, and the value is a running product over periods: a row per date, however many symbols.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quantloom.session import written


def _prices(points: DataFrame, bars: DataFrame) -> DataFrame:
    """points (symbol, no) with ``price``: the open of that date, else the last close before it, else null.

    Bars of symbols that no point asks for are left where they are; the others meet their points by symbol, in one
    exchange."""
    asked = points.select("symbol", "no").distinct()
    rows = bars.select("symbol", "no", F.col("open").cast("double").alias("open"), F.col("close").cast("double").alias("close"), F.lit(False).alias("asked"))
    rows = rows.join(asked.select("symbol").distinct(), "symbol", "left_semi")
    merged = rows.unionByName(asked.withColumn("asked", F.lit(True)), allowMissingColumns=True)
    # by date and not by row: the close of the date itself is not before it
    before = F.last("close", ignorenulls=True).over(Window.partitionBy("symbol").orderBy("no").rangeBetween(Window.unboundedPreceding, -1))
    here = F.max("open").over(Window.partitionBy("symbol", "no"))
    return merged.withColumn("price", F.coalesce(here, before)).where("asked").select("symbol", "no", "price")


def nav_of_weights(weights: DataFrame, bars: DataFrame, cost_rate: float = 0.0, cash: float = 1.0) -> DataFrame:
    """(ts, growth, turnover, nav) for every date with weights: what its holdings grew by, the part that was
    traded to get them, and the value at the end of its period, after ``cost_rate`` times the turnover.

    Dates are those of ``bars`` (symbol, ts, open, close). A share that has no price at its purchase stays cash;
    one without a later price keeps its value. Weights of a date after which no bar comes are not bought. Weights
    may sum to less than 1, the rest is cash; several rows of a date and symbol add up.

    Bars are read twice: where it takes work to make them, hand in a table of them (:func:`written`)."""
    # A row per date: these windows have as many rows as there are dates.
    dates = written(bars.select("ts").distinct().select("ts", F.row_number().over(Window.orderBy("ts")).alias("no")), "dates")
    numbered = bars.select("symbol", "ts", "open", "close").join(dates, "ts")
    chosen = written(weights.where("weight is not null").groupBy("ts", "symbol").agg(F.sum("weight").alias("weight")).join(dates, "ts"), "chosen")
    turns = chosen.select("ts", "no").distinct().join(dates.agg(F.max("no").alias("end")).hint("broadcast")).where("no < end")  # one row
    turns = turns.select("ts", (F.col("no") + 1).alias("bought"), F.coalesce(F.lead("no").over(Window.orderBy("no")) + 1, F.col("end") + 1).alias("sold"), F.row_number().over(Window.orderBy("no")).alias("turn"))
    turns = written(turns, "turns")
    held = written(chosen.select("ts", "symbol", "weight").join(turns, "ts"), "held")
    prices = _prices(held.select("symbol", F.col("bought").alias("no")).union(held.select("symbol", F.col("sold").alias("no"))), numbered)
    side = lambda at: prices.select("symbol", F.col("no").alias(at), F.col("price").alias(f"price_{at}"))
    valued = held.join(side("bought"), ["symbol", "bought"], "left").join(side("sold"), ["symbol", "sold"], "left").where("price_bought is not null")
    shares = written(valued.select("turn", "symbol", "weight", F.when(F.col("price_bought") != 0, F.coalesce("price_sold", "price_bought") / F.col("price_bought")).otherwise(F.lit(1.0)).alias("factor")), "shares")
    growth = turns.join(shares.groupBy("turn").agg(F.sum(F.col("weight") * (F.col("factor") - 1)).alias("g")), "turn", "left").select("turn", "ts", (1 + F.coalesce("g", F.lit(0.0))).alias("growth"))
    # What is left of the weights before, as parts of the value then, against the new ones.
    drifted = shares.join(growth.select("turn", "growth"), "turn").select((F.col("turn") + 1).alias("turn"), "symbol", F.when(F.col("growth") != 0, F.col("weight") * F.col("factor") / F.col("growth")).alias("old"))
    traded = shares.select("turn", "symbol", "weight").join(drifted, ["turn", "symbol"], "full").groupBy("turn").agg(F.sum(F.abs(F.coalesce("weight", F.lit(0.0)) - F.coalesce("old", F.lit(0.0)))).alias("turnover"))
    rows = growth.join(traded, "turn", "left").withColumn("turnover", F.coalesce("turnover", F.lit(0.0)))
    kept = F.product((1 - F.lit(float(cost_rate)) * F.col("turnover")) * F.col("growth")).over(Window.orderBy("turn").rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("ts", "growth", "turnover", (F.lit(float(cash)) * kept).alias("nav"))
