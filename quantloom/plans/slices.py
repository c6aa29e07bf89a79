"""Graphs over symbols of any length: a symbol's rows are cut into slices of time, and slices are partitions.

1. Rows per (symbol, bucket of time) are counted with partial sums; the counts, added up along each symbol,
   say which slice a bucket belongs to, and of which later slices it is part of the halo. That table has a row
   per bucket, however many rows a bucket has.
2. Rows join it by (symbol, bucket), so a symbol's rows are spread over all tasks, and are dealt by
   (symbol, slice). A slice starts with its halo: at least as many complete rows before it as the graph's
   windows see one after the other, so windows and exponential averages inside a slice equal those over the
   whole symbol. Halo rows leave the result.
3. What looks at all rows so far is a prefix scan of two levels: totals of each slice, their exclusive sums
   along the symbol (a row per slice), and sums within the slice on top. Means, variances, skews and
   covariances come from power sums about the symbol's mean. Only the bars and what slices carry over, a row per
   slice, are written: rows with all that windows have added to them would take many times the input's disk. The
   totals of a scan are a pass of their own, over the rows that are not copies and the columns that they ask for.

Not sliced, because what they see has no bound in rows: operators on inputs that are null between values (such
as gates), the parabolic stop, and the runs of KVO; they raise. A bucket with more rows than a slice is counted in
finer units of time, down to microseconds; only rows of one microsecond are never cut.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quantloom.operators.spec import Frame
from quantloom.session import written

SLICE, HALO = "_slice", "_halo"
#: Share of the mean square below which a variance from power sums is rounding.
ROUNDING = 1e-12
#: Units that a bucket is cut into where it has too many rows, and rows (copies too) to a partition of slices.
FINER = ("day", "hour", "minute", "second", "millisecond", "microsecond")
TASK_ROWS = 100_000


@dataclass(frozen=True)
class Slices:
    """About ``rows`` of a symbol to a slice, cut between buckets of ``bucket`` (a unit of ``date_trunc``)."""

    rows: int = 1_000_000
    bucket: str = "day"


def with_buckets(bars: DataFrame, slices: Slices, symbol: str, ts: str) -> DataFrame:
    """The bars with ``_bucket``: the unit of the slices, or where that holds more rows than a slice, the coarsest
    finer unit in whose buckets there are not as many."""
    coarse = F.date_trunc(slices.bucket, ts)
    counts = bars.groupBy(F.col(symbol).alias("_of"), coarse.alias("_at")).agg(F.count("*").alias("n"))
    heavy = written(counts.where(F.col("n") > slices.rows).select("_of", "_at"), "heavy", tidy=True)
    units, finer = [], FINER[FINER.index(slices.bucket) + 1 :] if slices.bucket in FINER else FINER
    for unit in finer:
        if heavy.isEmpty():
            break
        within = bars.join(heavy, (F.col(symbol) == F.col("_of")) & (coarse == F.col("_at")))
        most = within.groupBy("_of", "_at", F.date_trunc(unit, ts).alias("fine")).agg(F.count("*").alias("n")).groupBy("_of", "_at").agg(F.max("n").alias("n"))
        most = written(most, "finer", tidy=True)
        fits = F.lit(unit == finer[-1]) | (F.col("n") <= slices.rows)
        units.append(most.where(fits).select("_of", "_at", F.lit(unit).alias("_unit")))
        heavy = most.where(~fits).select("_of", "_at")
    if not units:
        return bars.withColumn("_bucket", coarse)
    cut_up = bars.join(reduce(DataFrame.union, units), (F.col(symbol) == F.col("_of")) & (coarse == F.col("_at")), "left")
    fine = reduce(lambda found, unit: F.when(F.col("_unit") == unit, F.date_trunc(unit, ts)).otherwise(found), finer, coarse)
    return cut_up.withColumn("_bucket", fine).drop("_of", "_at", "_unit")


def slice_map(bars: DataFrame, slices: Slices, halo: int, complete: Column, symbol: str) -> DataFrame:
    """(symbol, bucket, slice, halo, n): the slices that the rows of a bucket are part of, and how many they are."""
    counts = bars.groupBy(F.col(symbol).alias("symbol"), F.col("_bucket").alias("bucket")).agg(F.count("*").alias("n"), F.count(F.when(complete, 1)).alias("whole"))
    along = Window.partitionBy("symbol").orderBy("bucket")
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumns({"after": F.sum("n").over(upto), "whole_after": F.sum("whole").over(upto)}).withColumn("slice", F.floor((F.col("after") - F.col("n")) / slices.rows))
    placed = written(placed, "buckets", tidy=True)
    starts = placed.groupBy("symbol", "slice").agg(F.min(F.col("whole_after") - F.col("whole")).alias("start"))
    ranked = starts.withColumn("place", F.row_number().over(Window.partitionBy("symbol").orderBy("slice")))
    # A slice's rows can be in the halos of the slices from the next one on that start within the halo's length of it.
    near = Window.partitionBy("symbol").orderBy("start").rangeBetween(Window.currentRow, halo)
    spans = ranked.select("symbol", F.col("place").alias("next"), F.max("place").over(near).alias("upto"))
    places = ranked.select("symbol", "slice", (F.col("place") + 1).alias("next"))
    later = placed.join(places, ["symbol", "slice"]).join(spans, ["symbol", "next"]).withColumn("place", F.explode(F.sequence("next", "upto")))
    halos = later.drop("slice").join(ranked, ["symbol", "place"]).where(F.col("whole_after") > F.col("start") - halo)
    return placed.select("symbol", "bucket", "slice", F.lit(False).alias("halo"), "n").union(halos.select("symbol", "bucket", "slice", F.lit(True), "n"))


def cut(bars: DataFrame, slices: Slices, halo: int, complete: Column, symbol: str, ts: str) -> DataFrame:
    """The bars with ``_slice`` and ``_halo``, dealt by symbol and slice; halo rows are copies."""
    return cut_into(bars, slices, halo, complete, symbol, ts)[0]


def cut_into(bars: DataFrame, slices: Slices, halo: int, complete: Column, symbol: str, ts: str) -> tuple[DataFrame, int | None]:
    """The same, and how many partitions the number of rows calls for, not fewer than cores (or than Spark's setting,
    if that is less); None where they are one partition's."""
    # written once: the bars are counted, perhaps in several units, and then dealt
    bars = with_buckets(written(bars, "bars", tidy=True), slices, symbol, ts)
    where = written(slice_map(bars, slices, halo, complete, symbol), "slices", tidy=True)
    n = -(-(where.agg(F.sum("n")).first()[0] or 0) // TASK_ROWS)
    where = where.select(F.col("symbol").alias("_symbol"), F.col("bucket").alias("_at"), F.col("slice").alias(SLICE), F.col("halo").alias(HALO))
    joined = bars.join(where, (F.col(symbol) == F.col("_symbol")) & (F.col("_bucket") == F.col("_at"))).drop("_symbol", "_bucket", "_at")
    # without a number Spark puts partitions together up to 64 MB of narrow rows, which windows then widen and spill
    if n <= 1:
        return joined.repartition(symbol, SLICE), None
    spark = bars.sparkSession
    n = max(n, min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))
    return joined.repartition(n, symbol, SLICE), n


class SlicedFrame(Frame):
    """A frame whose windows stay within slices, halo included; cumulative values are carried over."""

    def __init__(self, df: DataFrame, symbol: str, ts: str, partitions: int | None = None):
        super().__init__(df, symbol, ts, (symbol, SLICE))
        self._levels, self._partitions, self._slid = 0, partitions, 0

    def upto(self):
        raise ValueError("an operator looks at all rows so far in a way that slices don't offer")

    def cumulative(self, *requests: tuple) -> list[Column]:
        self._levels += 1
        own = ~F.col(HALO) if self.valid is None else ~F.col(HALO) & self.valid
        columns = {str(c): c for _, *cols in requests for c in cols}
        masked = dict(zip(columns, self.add_many([F.when(own, c) for c in columns.values()])))
        pairs = {(str(a), str(b)) for kind, *cols in requests if kind == "covar_pop" for a, b in [cols]}
        moments = {str(c) for kind, *cols in requests if kind not in ("count", "sum", "min", "max", "last") for c in cols}
        self._settle()
        tag = {c: f"_l{self._levels}_{i}" for i, c in enumerate(columns)}
        totals = self.df.where(~F.col(HALO)).groupBy(*self.keys).agg(*self._totals(masked, tag, moments, pairs))
        totals = self._with_earlier(totals, tag, moments, pairs)
        carried = self._kept(self._carried(totals, tag, moments, pairs, {kind for kind, *_ in requests}))
        # Both sides meet by (symbol, slice), the keys of all windows, so only what is carried moves.
        self.df = self.df.join(carried.hint("shuffle_hash"), list(self.keys))
        within = self._ordered().rowsBetween(Window.unboundedPreceding, 0)
        sums: dict[tuple, Column] = {}
        for c, t in tag.items():
            d = masked[c] - F.col(f"{t}_c") if c in moments else None
            sums[c, 0] = F.col(f"{t}_s0") + F.count(masked[c]).over(within)
            for k in range(1, 5) if c in moments else ():
                sums[c, k] = F.col(f"{t}_s{k}") + F.coalesce(F.sum(F.pow(d, k)).over(within), F.lit(0.0))
        for a, b in pairs:
            product = (masked[a] - F.col(f"{tag[a]}_c")) * (masked[b] - F.col(f"{tag[b]}_c"))
            sums[a, b] = F.col(f"{tag[a]}_x{tag[b]}") + F.coalesce(F.sum(product).over(within), F.lit(0.0))
        self._names = dict(self._names)
        made = self.add_many(list(sums.values()))
        at = dict(zip(sums, made))
        return self.add_many([self._value(kind, [str(c) for c in cols], at, masked, tag, within) for kind, *cols in requests])

    def _settle(self) -> None:
        """After a pass through Arrow, which no scan should repeat, the rows are written and dealt again."""
        if len(self.slid) > self._slid:
            rows, self._slid = written(self.df, "slid", tidy=True), len(self.slid)
            self.df = rows.repartition(*([self._partitions] if self._partitions else []), *self.keys)

    def _kept(self, carried: DataFrame) -> DataFrame:
        """What slices carry over, written once: later scans, and the rows, read it."""
        return written(carried, "carried", tidy=True)

    def _with_earlier(self, totals: DataFrame, tag: dict, moments: set, pairs: set) -> DataFrame:
        """The totals of this table's slices, and of others before them, if there are any."""
        return totals

    def _totals(self, masked: dict, tag: dict, moments: set, pairs: set) -> list[Column]:
        """Statistics of a slice's own rows."""
        out = []
        for c, t in tag.items():
            x = masked[c]
            out += [F.count(x).alias(f"{t}_n"), F.sum(x).alias(f"{t}_sum"), F.min(x).alias(f"{t}_min"), F.max(x).alias(f"{t}_max"), F.max_by(x, F.when(x.isNotNull(), F.col(self.ts))).alias(f"{t}_last")]
            if c in moments:
                out += [F.avg(x).alias(f"{t}_m"), F.var_pop(x).alias(f"{t}_v"), F.skewness(x).alias(f"{t}_sk"), F.kurtosis(x).alias(f"{t}_ku")]
        return out + [F.covar_pop(masked[a], masked[b]).alias(f"{tag[a]}_cov{tag[b]}") for a, b in pairs]

    def _carried(self, totals: DataFrame, tag: dict, moments: set, pairs: set, kinds: set) -> DataFrame:
        """What the slices before each slice add up to: power sums about the symbol's mean, and what else the kinds need."""
        symbol = Window.partitionBy(self.symbol)
        before = symbol.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
        zero = lambda c: F.coalesce(c, F.lit(0.0))
        totals = totals.withColumns({f"{t}_c": zero(F.sum(F.col(f"{t}_n") * F.col(f"{t}_m")).over(symbol) / F.nullif(F.sum(f"{t}_n").over(symbol), F.lit(0))) for c, t in tag.items() if c in moments} or {"_none": F.lit(0)})
        out = []
        for c, t in tag.items():
            n = F.col(f"{t}_n")
            ends = {"sum": F.sum(f"{t}_sum").over(before).alias(f"{t}_before"), "min": F.min(f"{t}_min").over(before).alias(f"{t}_least"), "max": F.max(f"{t}_max").over(before).alias(f"{t}_most"), "last": F.last(f"{t}_last", ignorenulls=True).over(before).alias(f"{t}_latest")}
            out += [F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"{t}_s0"), *(end for kind, end in ends.items() if kind in kinds)]
            if c in moments:
                d, v = zero(F.col(f"{t}_m") - F.col(f"{t}_c")), zero(F.col(f"{t}_v"))
                m3, m4 = zero(F.col(f"{t}_sk")) * F.pow(v, 1.5), F.when(v > 0, zero(F.col(f"{t}_ku")) + 3).otherwise(F.lit(0.0)) * v * v
                powers = {1: d, 2: v + d * d, 3: m3 + 3 * d * v + F.pow(d, 3), 4: m4 + 4 * d * m3 + 6 * d * d * v + F.pow(d, 4)}
                out += [zero(F.sum(n * p).over(before)).alias(f"{t}_s{k}") for k, p in powers.items()] + [F.col(f"{t}_c")]
        for a, b in pairs:
            da, db = (zero(F.col(f"{tag[c]}_m") - F.col(f"{tag[c]}_c")) for c in (a, b))
            out.append(zero(F.sum(F.col(f"{tag[a]}_n") * (zero(F.col(f"{tag[a]}_cov{tag[b]}")) + da * db)).over(before)).alias(f"{tag[a]}_x{tag[b]}"))
        return totals.select(*self.keys, *out)

    def _value(self, kind: str, cols: list[str], at: dict, masked: dict, tag: dict, within) -> Column:
        c = cols[0]
        n, t, x = at[c, 0], tag[c], masked[c]
        if kind == "count":
            return n
        if kind == "sum":
            return F.when(n > 0, F.coalesce(F.col(f"{t}_before"), F.lit(0.0)) + F.coalesce(F.sum(x).over(within), F.lit(0.0)))
        if kind in ("min", "max"):
            pick, end = (F.least, "least") if kind == "min" else (F.greatest, "most")
            return pick(F.col(f"{t}_{end}"), (F.min if kind == "min" else F.max)(x).over(within))
        if kind == "last":
            return F.coalesce(F.last(x, ignorenulls=True).over(within), F.col(f"{t}_latest"))
        if kind == "product":
            raise ValueError("a product over all rows so far is not sliced")
        some = F.when(n > 0, n)
        m1, m2 = at[c, 1] / some, at[c, 2] / some
        var = m2 - m1 * m1
        var = F.when(var <= ROUNDING * m2, F.lit(0.0)).otherwise(var)
        if kind == "avg":
            return F.col(f"{t}_c") + m1
        if kind == "var_pop":
            return var
        if kind == "stddev_samp":
            return F.when(n > 1, F.sqrt(var * n / (n - 1)))
        if kind == "covar_pop":
            return at[c, cols[1]] / some - m1 * (at[cols[1], 1] / some)
        m3 = at[c, 3] / some - 3 * m1 * m2 + 2 * F.pow(m1, 3)
        if kind == "skewness":
            return F.when(var > 0, m3 / F.pow(var, 1.5))
        m4 = at[c, 4] / some - 4 * m1 * (at[c, 3] / some) + 6 * m1 * m1 * m2 - 3 * F.pow(m1, 4)
        return F.when(var > 0, m4 / (var * var) - 3)
