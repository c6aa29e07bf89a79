"""Batch statistics of series: rows grouped by key columns and ordered within a group.

Aggregates give one row per group, transforms one more column; both run as partial aggregation or as one
window over the group. NaN marks an undefined result. :func:`exploded` brings array columns into this form.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

NAN = float("nan")


def exploded(df: DataFrame, keys: list[str], array: str) -> DataFrame:
    """A row per element: keys, idx from 0, value."""
    return df.select(*keys, F.posexplode(array).alias("idx", "value")).withColumn("value", F.col("value").cast("double"))


def _undefined(value: Column, otherwise: float = NAN) -> Column:
    return F.coalesce(value, F.lit(otherwise))


# Aggregates: expressions over the value column (and the index that orders it)


def total(x: Column) -> Column:
    return F.coalesce(F.sum(x), F.lit(0.0))


def smallest(x: Column) -> Column:
    return _undefined(F.min(x))


def largest(x: Column) -> Column:
    return _undefined(F.max(x))


def argmin(x: Column, idx: Column) -> Column:
    """Index of the first minimum; -1 without values."""
    return F.coalesce(F.min_by(idx, F.struct(x, idx)), F.lit(-1))


def argmax(x: Column, idx: Column) -> Column:
    return F.coalesce(F.max_by(idx, F.struct(x, -idx)), F.lit(-1))


def mean(x: Column) -> Column:
    return _undefined(F.avg(x))


def variance(x: Column, ddof: int = 0) -> Column:
    n = F.count(x)
    return F.when(n > ddof, F.var_pop(x) * n / (n - ddof) if ddof else F.var_pop(x)).otherwise(F.lit(NAN))


def stddev(x: Column, ddof: int = 0) -> Column:
    return F.sqrt(variance(x, ddof))


def skew(x: Column) -> Column:
    return F.when(F.var_pop(x) > 0, F.skewness(x)).otherwise(F.lit(NAN))


def kurt(x: Column) -> Column:
    return F.when(F.var_pop(x) > 0, F.kurtosis(x)).otherwise(F.lit(NAN))


def cov(x: Column, y: Column, ddof: int = 0) -> Column:
    n = F.count(x)
    return F.when(n > ddof, F.covar_pop(x, y) * n / (n - ddof) if ddof else F.covar_pop(x, y)).otherwise(F.lit(NAN))


def corr(x: Column, y: Column) -> Column:
    return F.when(F.var_pop(x) * F.var_pop(y) == 0, F.lit(0.0)).otherwise(_undefined(F.corr(x, y)))


def median(x: Column) -> Column:
    return _undefined(F.percentile(x, F.lit(0.5)))


def quantile(x: Column, q: float) -> Column:
    """Linear interpolation at q (n - 1)."""
    return _undefined(F.percentile(x, F.lit(float(q))))


def parametric_cvar(x: Column, alpha: float = 0.05) -> Column:
    if not 0 < alpha < 1:
        return F.first(F.lit(NAN))
    shape = NormalDist().pdf(NormalDist().inv_cdf(alpha)) / alpha
    return F.when(F.count(x) < 2, F.lit(NAN)).otherwise(F.avg(x) - F.coalesce(F.stddev_samp(x), F.lit(0.0)) * shape)


def sharpe(x: Column, riskfree: float = 0.0) -> Column:
    sd = F.stddev_samp(x)
    return F.when(F.count(x) == 0, F.lit(0.0)).when(F.count(x) == 1, F.lit(NAN)).when(sd == 0, F.lit(0.0)).otherwise((F.avg(x) - riskfree) / F.when(sd != 0, sd))


def sortino(x: Column, riskfree: float = 0.0) -> Column:
    down = F.when(x < riskfree, x - riskfree)
    sd = F.stddev_samp(down)
    return F.when(F.count(down) == 0, F.lit(0.0)).when(F.count(down) == 1, F.lit(NAN)).when(sd == 0, F.lit(0.0)).otherwise((F.avg(x) - riskfree) / F.when(sd != 0, sd))


def win_rate(x: Column, threshold: float = 0.0) -> Column:
    return F.coalesce(F.avg((x > threshold).cast("double")), F.lit(0.0))


def _split(x: Column, threshold: float) -> tuple[Column, Column]:
    return F.when(x > threshold, x), F.when(x < threshold, x)


def gain_loss(x: Column, threshold: float = 0.0) -> Column:
    gain, loss = _split(x, threshold)
    down = F.abs(F.avg(loss))
    return F.when(F.count(loss) == 0, F.lit(0.0)).otherwise(_undefined(F.avg(gain) / F.when(down != 0, down)))


def expectancy(x: Column, threshold: float = 0.0) -> Column:
    gain, loss = _split(x, threshold)
    n = F.count(x)
    value = (F.coalesce(F.sum(gain), F.lit(0.0)) - F.abs(F.coalesce(F.sum(loss), F.lit(0.0)))) / F.when(n > 0, n)
    return F.coalesce(value, F.lit(0.0))


def profit_factor(x: Column, threshold: float = 0.0) -> Column:
    gain, loss = _split(x, threshold)
    down = F.coalesce(F.sum(F.abs(loss)), F.lit(0.0))
    return F.when(down == 0, F.lit(0.0)).otherwise(F.coalesce(F.sum(gain), F.lit(0.0)) / F.when(down != 0, down))


# Transforms and aggregates that need the order


@dataclass(frozen=True)
class Series:
    """A frame with the columns that group it, order it and hold its values."""

    df: DataFrame
    by: tuple[str, ...]
    order: str
    value: str

    def _w(self):
        return Window.partitionBy(*self.by).orderBy(self.order)

    def _all(self):
        return Window.partitionBy(*self.by)

    def _upto(self):
        return self._w().rowsBetween(Window.unboundedPreceding, 0)

    @property
    def x(self) -> Column:
        return F.col(self.value)

    def with_(self, name: str, column: Column) -> DataFrame:
        return self.df.withColumn(name, column)

    def on(self, df: DataFrame, value: str | None = None) -> Series:
        return Series(df, self.by, self.order, value or self.value)

    def argsort(self, name: str = "argsort") -> DataFrame:
        """Place of each row in ascending order, stable, from 0."""
        return self.with_(name, F.row_number().over(Window.partitionBy(*self.by).orderBy(self.value, self.order)) - 1)

    def rank(self, name: str = "rank") -> DataFrame:
        """Rank from 0 to 1, ties averaged; 1 for a single value."""
        by_value = Window.partitionBy(*self.by).orderBy(self.value)
        # peers of the same order, so that rows are not sorted anew
        ties = F.count("*").over(by_value.rangeBetween(Window.currentRow, Window.currentRow))
        n = F.count("*").over(self._all())
        return self.with_(name, F.when(n == 1, F.lit(1.0)).otherwise((F.rank().over(by_value) - 1 + (ties - 1) / 2) / F.when(n > 1, n - 1)))

    def norm(self, name: str = "norm", ddof: int = 0) -> DataFrame:
        sd = F.sqrt(variance(self.x, ddof).over(self._all())) if not ddof else F.sqrt(F.var_pop(self.x).over(self._all()) * F.count("*").over(self._all()) / F.greatest(F.lit(1), F.count("*").over(self._all()) - ddof))
        sd = F.stddev_pop(self.x).over(self._all()) if not ddof else sd
        return self.with_(name, F.when(sd == 0, F.lit(0.0)).otherwise((self.x - F.avg(self.x).over(self._all())) / F.when(sd != 0, sd)))

    def sign(self, name: str = "sign") -> DataFrame:
        return self.with_(name, F.signum(self.x))

    def cumsum(self, name: str = "cumsum") -> DataFrame:
        return self.with_(name, F.sum(self.x).over(self._upto()))

    def lag(self, name: str = "lag", n: int = 1) -> DataFrame:
        return self.with_(name, self.x if n <= 0 else _undefined(F.lag(self.x, n).over(self._w())))

    def lead(self, name: str = "lead", n: int = 1) -> DataFrame:
        return self.with_(name, self.x if n <= 0 else _undefined(F.lead(self.x, n).over(self._w())))

    def diff(self, name: str = "diff") -> DataFrame:
        return self.with_(name, _undefined(self.x - F.lag(self.x).over(self._w())))

    def pct_change(self, name: str = "pct_change") -> DataFrame:
        before = F.lag(self.x).over(self._w())
        by_zero = F.when(self.x == 0, F.lit(NAN)).otherwise(F.signum(self.x) * F.lit(math.inf))
        return self.with_(name, _undefined(F.when(before == 0, by_zero).otherwise((self.x - before) / F.when(before != 0, before))))

    def returns(self, name: str = "returns") -> DataFrame:
        return self.pct_change(name)

    def log_returns(self, name: str = "log_returns") -> DataFrame:
        log = F.when(self.x > 0, F.log(self.x)).when(self.x == 0, F.lit(-math.inf)).otherwise(F.lit(NAN))
        return self.with_(name, _undefined(log - F.lag(log).over(self._w())))

    def coalesce(self, name: str = "coalesce", fill: float = 0.0) -> DataFrame:
        return self.with_(name, F.nanvl(self.x, F.lit(fill)))

    def locf(self, name: str = "locf") -> DataFrame:
        return self.with_(name, _undefined(F.last(F.when(~F.isnan(self.x), self.x), ignorenulls=True).over(self._upto())))

    def winsorize(self, name: str = "winsorize", lower: float = 0.05, upper: float = 0.95) -> DataFrame:
        low, high = (F.percentile(self.x, F.lit(q)).over(self._all()) for q in (lower, upper))
        return self.with_(name, F.greatest(low, F.least(high, self.x)))

    def spearman(self, other: str, name: str = "spearman") -> DataFrame:
        """Correlation of the ranks of two value columns, per group."""
        ranked = self.on(self.rank("_rank_x"), other).rank("_rank_y")
        return ranked.groupBy(*self.by).agg(corr(F.col("_rank_x"), F.col("_rank_y")).alias(name))

    def historical_cvar(self, name: str = "historical_cvar", alpha: float = 0.05) -> DataFrame:
        """Mean of the ceil(n alpha) worst values."""
        if not 0 < alpha < 1:
            return self.df.groupBy(*self.by).agg(F.first(F.lit(NAN)).alias(name))
        placed = self.with_("_rn", F.row_number().over(Window.partitionBy(*self.by).orderBy(self.value, self.order))).withColumn("_n", F.count("*").over(self._all()))
        return placed.where(F.col("_rn") <= F.ceil(F.col("_n") * alpha)).groupBy(*self.by).agg(F.avg(self.value).alias(name))

    def exp_weighted_cvar(self, name: str = "exp_weighted_cvar", alpha: float = 0.05, decay: float = 0.996) -> DataFrame:
        shape = NormalDist().pdf(NormalDist().inv_cdf(alpha)) / alpha
        age = F.count("*").over(self._all()) - F.row_number().over(self._w())
        weighted = self.with_("_w", F.pow(F.lit(decay), age)).withColumn("_m", F.sum(F.col("_w") * self.x).over(self._all()) / F.sum("_w").over(self._all()))
        per = weighted.groupBy(*self.by).agg(F.first("_m").alias("_m"), (F.sum(F.col("_w") * F.pow(self.x - F.col("_m"), 2)) / F.sum("_w")).alias("_v"))
        return per.select(*self.by, (F.col("_m") - F.sqrt("_v") * shape).alias(name))

    def movements(self, **wanted: tuple[bool, bool]) -> DataFrame:
        """For each name and (down, relative) a struct<value, from, to> of the largest move from a running extreme,
        the first of equal ones; all of them from one pass over the rows.

        Relative moves leave out leading zeros."""
        rows = self.with_("_i", (F.row_number().over(self._w()) - 1).cast("int"))
        rows = rows.withColumn("_seen", F.max((self.x != 0).cast("int")).over(self._upto()) == 1)
        own = {name: F.col("_seen") if relative else F.lit(True) for name, (_, relative) in wanted.items()}
        extremes = {}
        for name, (down, _) in wanted.items():
            extreme = (F.max if down else F.min)(F.when(own[name], F.struct(self.x.alias("v"), (-F.col("_i") if down else F.col("_i")).alias("i"))))
            extremes[f"_e_{name}"] = extreme.over(self._upto())
        rows = rows.withColumns(extremes)
        made = []
        for name, (down, relative) in wanted.items():
            high = F.col(f"_e_{name}.v")
            move = self.x - high
            if relative:
                move = F.when(high != 0, move / F.when(high != 0, high)).otherwise(move)
            best = F.struct(move.alias("value"), F.abs(F.col(f"_e_{name}.i")).alias("from"), F.col("_i").alias("to"))
            key = F.when(own[name] & (move < 0 if down else move > 0), F.struct(move if down else -move, F.col("_i")))
            zero = F.coalesce(F.min(F.when(own[name], F.col("_i"))), F.lit(0))
            made.append(F.coalesce(F.min_by(best, key), F.struct(F.lit(0.0).alias("value"), zero.alias("from"), zero.alias("to"))).alias(name))
        return rows.groupBy(*self.by).agg(*made)

    def max_drawdown(self, name: str = "max_drawdown") -> DataFrame:
        return self.movements(**{name: (True, False)})

    def max_rel_drawdown(self, name: str = "max_rel_drawdown") -> DataFrame:
        return self.movements(**{name: (True, True)})

    def max_drawup(self, name: str = "max_drawup") -> DataFrame:
        return self.movements(**{name: (False, False)})

    def max_rel_drawup(self, name: str = "max_rel_drawup") -> DataFrame:
        return self.movements(**{name: (False, True)})

    def calmar(self, periods_per_year: float, name: str = "calmar") -> DataFrame:
        """Annual mean return over the deepest drawdown of the compounded returns, from 1."""
        grown = self.with_("_g", F.product(1 + self.x).over(self._upto()))
        fallen = grown.withColumn("_p", F.greatest(F.lit(1.0), F.max("_g").over(self._upto())))
        per = fallen.groupBy(*self.by).agg(F.max((F.col("_p") - F.col("_g")) / F.col("_p")).alias("_d"), F.avg(self.value).alias("_m"))
        return per.select(*self.by, F.when(F.col("_d") <= 0, F.lit(0.0)).otherwise(F.col("_m") * periods_per_year / F.when(F.col("_d") > 0, F.col("_d"))).alias(name))
