"""Graphs on streams of bars.

Every micro-batch is worked out by the batch compiler, over its bars and what is kept of those before:

* as many complete bars of each symbol as the graph's windows see one after the other (its reach), which go
  before the new ones as a halo;
* totals of each symbol (count, mean, variance, skew, kurtosis, covariances, extremes) for what looks at all bars
  so far, which are merged with the batch's own.

Both are tables in ``state``/<batch number>, written whole for each batch and read by the next; the last two are
kept. A batch that is run again after a failure finds the state before it as it was, so it makes the same rows;
a stream that is stopped goes on from its checkpoint and its state. The sink gets (rows, batch number) and should
take a batch number twice, as with any ``foreachBatch``.

Bars of a symbol come in order of time from batch to batch, in any order within one. A watermark over ticks gives
such bars (:func:`quantloom.streaming.incremental.bars_from_ticks`). Bars that are not after their symbol's last
one are handed to ``late``; without it they raise. State machines and operators on inputs that are null between
values are not offered: what they depend on has no bound in rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quantloom.operators.spec import OpRegistry
from quantloom.plans.graph import GraphPlan, complete_bars
from quantloom.plans.slices import HALO, SLICE, SlicedFrame


class _StreamFrame(SlicedFrame):
    """A frame whose one slice is the micro-batch; totals of the batches before come from the state."""

    def __init__(self, df: DataFrame, symbol: str, ts: str, epoch: int, before: str | None, here: str):
        super().__init__(df, symbol, ts)
        self.epoch, self.before, self.here = epoch, before, here

    def _kept(self, carried: DataFrame) -> DataFrame:
        path = f"{self.here}/work{self._levels}"
        carried.write.mode("overwrite").parquet(path)
        return carried.sparkSession.read.schema(carried.schema).parquet(path)

    def _with_earlier(self, totals: DataFrame, tag: dict, moments: set, pairs: set) -> DataFrame:
        both = totals
        if self.before:
            earlier = totals.sparkSession.read.schema(totals.schema).parquet(f"{self.before}/totals{self._levels}")
            both = totals.unionByName(earlier)
        self._merged(both, tag, moments, pairs).select(*totals.columns).write.mode("overwrite").parquet(f"{self.here}/totals{self._levels}")
        return both

    def _merged(self, both: DataFrame, tag: dict, moments: set, pairs: set) -> DataFrame:
        """One row per symbol, as if its rows so far had been one batch."""
        symbol = Window.partitionBy(self.symbol)
        zero = lambda c: F.coalesce(c, F.lit(0.0))
        for t in (t for c, t in tag.items() if c in moments):
            both = both.withColumn(f"{t}_c", zero(F.sum(F.col(f"{t}_n") * F.col(f"{t}_m")).over(symbol) / F.nullif(F.sum(f"{t}_n").over(symbol), F.lit(0))))
        aggregates, after = [], {}
        for c, t in tag.items():
            n = F.col(f"{t}_n")
            aggregates += [F.sum(n).alias(f"{t}_n"), F.sum(f"{t}_sum").alias(f"{t}_sum"), F.min(f"{t}_min").alias(f"{t}_min"), F.max(f"{t}_max").alias(f"{t}_max"), F.max_by(f"{t}_last", F.when(F.col(f"{t}_last").isNotNull(), F.col(SLICE))).alias(f"{t}_last")]
            if c not in moments:
                continue
            d, v = zero(F.col(f"{t}_m") - F.col(f"{t}_c")), zero(F.col(f"{t}_v"))
            m3, m4 = zero(F.col(f"{t}_sk")) * F.pow(v, 1.5), F.when(v > 0, zero(F.col(f"{t}_ku")) + 3).otherwise(F.lit(0.0)) * v * v
            powers = {2: v + d * d, 3: m3 + 3 * d * v + F.pow(d, 3), 4: m4 + 4 * d * m3 + 6 * d * d * v + F.pow(d, 4)}
            aggregates += [F.first(f"{t}_c").alias(f"{t}_m"), *(F.sum(n * p).alias(f"_{t}_{k}") for k, p in powers.items())]
            some = F.nullif(F.col(f"{t}_n"), F.lit(0))
            var = F.col(f"_{t}_2") / some
            after |= {f"{t}_v": var, f"{t}_sk": F.when(var > 0, F.col(f"_{t}_3") / some / F.pow(var, 1.5)), f"{t}_ku": F.when(var > 0, F.col(f"_{t}_4") / some / (var * var) - 3)}
        for a, b in pairs:
            ta, tb = tag[a], tag[b]
            da, db = (zero(F.col(f"{t}_m") - F.col(f"{t}_c")) for t in (ta, tb))
            aggregates.append(F.sum(F.col(f"{ta}_n") * (zero(F.col(f"{ta}_cov{tb}")) + da * db)).alias(f"_{ta}_x{tb}"))
            after[f"{ta}_cov{tb}"] = F.col(f"_{ta}_x{tb}") / F.nullif(F.col(f"{ta}_n"), F.lit(0))
        return both.groupBy(self.symbol).agg(*aggregates).withColumns({**after, SLICE: F.lit(self.epoch).cast("long")})


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class GraphStream:
    """``step`` takes a micro-batch of bars and its number, from 0, and gives the sink the graph's outputs."""

    def __init__(self, graph: dict, sink: Callable[[DataFrame, int], None], state: str, outputs: list[str] | None = None, registry: OpRegistry | None = None, late: Callable[[DataFrame, int], None] | None = None, symbol: str = "symbol", ts: str = "ts"):
        self.plan, self.sink, self.state, self.late, self.symbol, self.ts = GraphPlan(graph, registry, outputs), sink, state.rstrip("/"), late, symbol, ts

    def step(self, batch: DataFrame, epoch: int) -> None:
        spark, symbol, ts = batch.sparkSession, self.symbol, self.ts
        batch = complete_bars(batch)
        if self.plan.stateless:
            self.sink(self.plan.result(self.plan.lower(_StreamFrame(batch, symbol, ts, epoch, None, ""))), epoch)
            return
        halo, read, complete = self.plan.reach(batch, symbol, ts)
        here, before = f"{self.state}/{epoch}", f"{self.state}/{epoch - 1}" if epoch else None
        new = batch.select(symbol, ts, *read)
        kept = spark.read.schema(new.schema).parquet(f"{before}/bars") if before else spark.createDataFrame([], new.schema)
        last = kept.groupBy(F.col(symbol).alias("_of")).agg(F.max(ts).alias("_last"))
        seen = new.join(last, F.col(symbol) == F.col("_of"), "left").withColumn("_late", F.coalesce(F.col(ts) <= F.col("_last"), F.lit(False))).drop("_of", "_last")
        if self.late:
            self.late(seen.where("_late").drop("_late"), epoch)
            new = seen.where("not _late").drop("_late")
        else:
            stop = F.raise_error(F.concat(F.lit("a bar is not after the last one of "), F.col(symbol).cast("string")))
            new = seen.where(F.when(F.col("_late"), stop.cast("boolean")).otherwise(F.lit(True))).drop("_late")
        rows = kept.withColumn(HALO, F.lit(True)).union(new.withColumn(HALO, F.lit(False))).withColumn(SLICE, F.lit(epoch).cast("long"))
        # Written once: the outputs and the state are made from the same rows.
        rows.write.mode("overwrite").parquet(f"{here}/rows")
        rows = spark.read.schema(rows.schema).parquet(f"{here}/rows")
        back = Window.partitionBy(symbol).orderBy(F.desc(ts))
        placed = rows.withColumn("_after", F.count(F.when(complete, 1)).over(back.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_place", F.row_number().over(back))
        placed.where((F.col("_after") < halo) | (F.col("_place") == 1)).select(*new.columns).write.mode("overwrite").parquet(f"{here}/bars")
        c = self.plan.lower(_StreamFrame(rows.repartition(symbol, SLICE), symbol, ts, epoch, before, here))
        c.frame.df = c.frame.df.where(~F.col(HALO))
        self.sink(self.plan.result(c), epoch)
        for path in [f"{here}/rows", *(f"{here}/work{k + 1}" for k in range(c.frame._levels)), *([f"{self.state}/{epoch - 2}"] if epoch > 1 else [])]:
            _remove(spark, path)


def stream_graph(graph: dict, bars: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, outputs: list[str] | None = None, registry: OpRegistry | None = None, late: Callable[[DataFrame, int], None] | None = None, symbol: str = "symbol", ts: str = "ts"):
    """A writer of a stream of bars that feeds the sink; ``.trigger(...)`` and ``.start()`` it. Its state is
    beside the checkpoint's own, in ``checkpoint``/graph, on a file system that all machines share."""
    stream = GraphStream(graph, sink, f"{checkpoint.rstrip('/')}/graph", outputs, registry, late, symbol, ts)
    return bars.writeStream.foreachBatch(stream.step).option("checkpointLocation", f"{checkpoint.rstrip('/')}/query")
