"""Bar sources: daily tables with adjustment factors, universes, and bars made from event tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quantloom.session import dealt

BAR_SCHEMA = T.StructType(
    [T.StructField("symbol", T.StringType()), T.StructField("ts", T.TimestampType())]
    + [T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume", "turnover")]
)
MARKET_OPEN = (9, 30)


def market_open(date: Column, fmt: str = "yyyyMMdd", hour: int = MARKET_OPEN[0], minute: int = MARKET_OPEN[1]) -> Column:
    """A date text as the timestamp of that day's opening."""
    return F.to_timestamp(date, fmt) + F.make_dt_interval(F.lit(0), F.lit(hour), F.lit(minute))


def date_text(ts: Column, fmt: str = "yyyyMMdd") -> Column:
    return F.date_format(ts, fmt)


def universe_frame(spark: SparkSession, symbols: Sequence[str]) -> DataFrame:
    """(symbol, universe_idx): the order of a universe breaks ties."""
    return spark.createDataFrame([(s, i) for i, s in enumerate(dict.fromkeys(symbols))], "symbol string, universe_idx int")


def daily_bars(daily: DataFrame, start: str | None = None, end: str | None = None, universe: DataFrame | None = None) -> DataFrame:
    """Bars of a daily table (ts_code, trade_date, open .. amount) between two dates, for a universe.

    The date filter is on the stored column, so it reaches the scan; the universe is a semi join.
    """
    rows = daily
    if start:
        rows = rows.where(F.col("trade_date") >= start)
    if end:
        rows = rows.where(F.col("trade_date") <= end)
    bars = rows.select(F.col("ts_code").alias("symbol"), market_open(F.col("trade_date")).alias("ts"), "open", "high", "low", "close", F.col("vol").alias("volume"), F.col("amount").alias("turnover"))
    return bars if universe is None else bars.join(universe.select("symbol"), "symbol", "left_semi")


def with_adjustment(bars: DataFrame, factors: DataFrame | None) -> DataFrame:
    """Bars with the last known factor ``adj`` and whether it is new or changed; without a table, none."""
    if factors is None:
        return bars.withColumn("adj", F.lit(None).cast("double")).withColumn("adj_changed", F.lit(False))
    known = factors.select(F.col("ts_code").alias("symbol"), market_open(F.col("trade_date")).alias("ts"), F.col("adj_factor").cast("double").alias("factor"))
    w = Window.partitionBy("symbol").orderBy("ts")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    carried = bars.join(known, ["symbol", "ts"], "left").withColumn("adj", F.last("factor", ignorenulls=True).over(upto)).drop("factor")
    return carried.withColumn("adj_changed", F.col("adj").isNotNull() & ~F.col("adj").eqNullSafe(F.lag("adj").over(w)))


def adjustment_snapshots(bars: DataFrame, factors: DataFrame | None) -> DataFrame:
    """(ts, symbol, adj): the factors of all symbols known by each date on which any of them changed."""
    changed = with_adjustment(bars, factors).where("adj_changed").select("symbol", "ts", "adj")
    dates = changed.select("ts").distinct()
    # one row per date with a change; a factor holds from its change to the one before its next
    numbered = dates.select("ts", F.row_number().over(Window.orderBy("ts")).alias("no"), F.count("*").over(Window.partitionBy()).alias("n"))
    at = changed.join(numbered, "ts").withColumn("next", F.lead("no").over(Window.partitionBy("symbol").orderBy("no")))
    held = at.select("symbol", "adj", F.explode(F.sequence("no", F.coalesce(F.col("next") - 1, F.col("n").cast("int")))).alias("no"))
    return held.join(numbered.select("ts", "no"), "no").select("ts", "symbol", "adj")


def complete_bars(bars: DataFrame) -> DataFrame:
    """Bars that can be traded: all of open, high, low and volume."""
    return bars.dropna(subset=["open", "high", "low", "volume"])


def bars_from_events(events: DataFrame, unit: str = "hour") -> DataFrame:
    """Bars of event values by type: the first and last by (ts, event_id) open and close."""
    order = F.struct("ts", "event_id")
    at = F.date_trunc(unit, "ts")
    return events.groupBy(F.col("event_type").alias("symbol"), at.alias("at")).agg(
        F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"),
        F.count("*").cast("double").alias("volume"), F.sum("value").alias("turnover"),
    ).withColumnRenamed("at", "ts")


def bars_from_lineitem(lineitem: DataFrame) -> DataFrame:
    """Daily bars of a supplier's unit prices; the open is the close before, within the day's range.

    Items are dealt by supplier, once for its days and for windows over them, to more tasks where there are more."""
    price = F.col("l_extendedprice") / F.col("l_quantity")
    items = lineitem.where("l_quantity <> 0").select(F.col("l_suppkey").cast("string").alias("symbol"), F.col("l_shipdate").alias("ts"), "l_extendedprice", "l_quantity")
    days = dealt(items, "symbol").groupBy("symbol", "ts").agg(
        F.max(price).alias("high"), F.min(price).alias("low"), (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close"), F.sum("l_quantity").alias("volume"), F.sum("l_extendedprice").alias("turnover"),
    )
    before = F.coalesce(F.lag("close").over(Window.partitionBy("symbol").orderBy("ts")), F.col("close"))
    return days.select("symbol", "ts", F.least("high", F.greatest("low", before)).alias("open"), "high", "low", "close", "volume", "turnover")


def resample(bars: DataFrame, unit: str) -> DataFrame:
    """Longer bars from shorter ones."""
    return bars.groupBy("symbol", F.date_trunc(unit, "ts").alias("at")).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"), F.sum("turnover").alias("turnover"),
    ).withColumnRenamed("at", "ts")


def random_universe(bars: DataFrame, n: int, min_bars: int = 1, seed: int = 7) -> DataFrame:
    """n symbols with at least so many bars, in an order by hash."""
    return bars.groupBy("symbol").count().where(F.col("count") >= min_bars).orderBy(F.xxhash64("symbol", F.lit(seed)), "symbol").limit(n).select("symbol")


def universe_from_sql(spark: SparkSession, query: str, as_of: str) -> DataFrame:
    """A point-in-time universe: one query with ``?`` markers for the date and one column of symbols."""
    found = spark.sql(query, args=[as_of] * query.count("?"))
    if len(found.columns) != 1:
        raise ValueError("a universe query has one column")
    return found.select(F.col(found.columns[0]).cast("string").alias("symbol")).distinct()
