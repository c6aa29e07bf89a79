"""Streams of ticks and bars."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from quantloom.session import ship_package


def bars_from_ticks(ticks: DataFrame, width: str = "1 hour", late: str = "1 hour", symbol: str = "event_type", ts: str = "ts", value: str = "value", tie: str = "event_id") -> DataFrame:
    """Bars of a stream (or table) of ticks: tumbling windows under a watermark."""
    order = F.struct(ts, tie)
    return (
        ticks.withWatermark(ts, late)
        .groupBy(F.col(symbol).alias("symbol"), F.window(ts, width).alias("w"))
        .agg(F.min_by(value, order).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, order).alias("close"), F.count("*").cast("double").alias("volume"), F.sum(value).alias("turnover"))
        .select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume", "turnover")
    )


class RunningEma(StatefulProcessor):
    """Exponential averages of one column per symbol: a state of one number for each alpha."""

    def __init__(self, column: str, alphas: tuple[float, ...]):
        self.column, self.alphas = column, alphas

    def init(self, handle: StatefulProcessorHandle) -> None:
        fields = [StructField("n", LongType()), *(StructField(f"y{i}", DoubleType()) for i in range(len(self.alphas)))]
        self.state = handle.getValueState("ema", StructType(fields))

    def handleInputRows(self, key, rows, timerValues):
        held = self.state.get() if self.state.exists() else None
        n, y = (held[0], list(held[1:])) if held else (0, [0.0] * len(self.alphas))
        for pdf in [pd.concat(list(rows)).sort_values("ts", kind="stable")]:
            made = []
            for x in pdf[self.column]:
                if x == x and x is not None:
                    y = [x if n == 0 else v + a * (x - v) for v, a in zip(y, self.alphas)]
                    n += 1
                    made.append(list(y))
                else:
                    made.append([None] * len(y))
            out = pdf[["symbol", "ts"]].copy()
            for i in range(len(y)):
                out[f"ema{i}"] = [m[i] for m in made]
            yield out
        self.state.update((n, *y))

    def close(self) -> None:
        pass


def running_ema(bars: DataFrame, alphas: tuple[float, ...], column: str = "close") -> DataFrame:
    """(symbol, ts, ema0, ema1, ...) of a stream of bars, in the order of ts within each micro-batch."""
    ship_package(bars.sparkSession)
    schema = "symbol string, ts timestamp, " + ", ".join(f"ema{i} double" for i in range(len(alphas)))
    return bars.groupBy("symbol").transformWithStateInPandas(RunningEma(column, tuple(alphas)), schema, "Append", "None")


def per_date(stream: DataFrame, weights: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Cross-sections of a stream of scores: ``weights`` is applied to each micro-batch, ``sink`` takes
    the result; with one complete date or more per batch this equals the batch result."""
    return stream.writeStream.foreachBatch(lambda df, epoch: sink(weights(df), epoch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
