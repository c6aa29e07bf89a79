"""The portfolio steps for dates with more symbols than one task should hold.

The same results as :mod:`quantloom.plans.portfolio`, whose windows gather a date; here ranks come from ranges,
totals from partial sums that are dealt back over salts. Use them by ``compile_recipe(recipe, wide=True)``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.plans.ranges import COUNT, PLACE, RANGE, first_of_each, joined, placed, with_totals
from quantloom.session import written

DATE = ["ts"]
OWN = [PLACE, COUNT, RANGE]


def _best(descending: bool = True) -> list[Column]:
    return [F.desc("score") if descending else F.asc("score"), F.asc("universe_idx"), F.asc("symbol")]


def scored(scores: DataFrame, universe: DataFrame | None = None, score: str = "score") -> DataFrame:
    """Scores without nulls and NaN; without a universe, symbols are ordered by name."""
    rows = scores.select("ts", "symbol", F.col(score).cast("double").alias("score")).where(F.col("score").isNotNull() & ~F.isnan("score"))
    if universe is None:
        return placed(rows, DATE, [F.asc("symbol")]).withColumn("universe_idx", (F.col(PLACE) - 1).cast("int")).drop(*OWN)
    return rows.join(universe, "symbol")


def filter_top_n(s: DataFrame, n: int) -> DataFrame:
    return first_of_each(s, DATE, _best(), n, "symbol")


def filter_bottom_n(s: DataFrame, n: int) -> DataFrame:
    return first_of_each(s, DATE, _best(False), n, "symbol")


def filter_quantile(s: DataFrame, pct: float, side: str = "top") -> DataFrame:
    if side not in ("top", "bottom"):
        raise ValueError(f"side is top or bottom, not {side!r}")
    rows = placed(s, DATE, _best(side == "top"))
    return rows.where(F.col(PLACE) <= F.greatest(F.lit(1), F.floor(F.col(COUNT) * pct + 0.5))).drop(*OWN)


def norm_min_max(s: DataFrame, lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    rows, low, high = with_totals(s, DATE, {"_low": F.min("score"), "_high": F.max("score")}, "symbol"), F.col("_low"), F.col("_high")
    return rows.withColumn("score", F.when(low == high, F.lit((lo + hi) / 2)).otherwise(lo + (F.col("score") - low) / F.when(low != high, high - low) * (hi - lo))).drop("_low", "_high")


def norm_z_score(s: DataFrame) -> DataFrame:
    """Population z-scores; unchanged without deviation."""
    rows, sd = with_totals(s, DATE, {"_mean": F.avg("score"), "_sd": F.stddev_pop("score")}, "symbol"), F.col("_sd")
    return rows.withColumn("score", F.when(sd == 0, F.col("score")).otherwise((F.col("score") - F.col("_mean")) / F.when(sd != 0, sd))).drop("_mean", "_sd")


def norm_rank(s: DataFrame) -> DataFrame:
    """Ranks from 0 to 1, ties in order; 0 for a single symbol."""
    n = F.col(COUNT)
    return placed(s, DATE, _best(False)).withColumn("score", F.when(n == 1, F.lit(0.0)).otherwise((F.col(PLACE) - 1) / F.when(n > 1, n - 1))).drop(*OWN)


def basket_equal(s: DataFrame) -> DataFrame:
    return with_totals(s, DATE, {"_n": F.count("*")}, "symbol").withColumn("weight", 1 / F.col("_n")).drop("score", "_n")


def basket_proportional(s: DataFrame) -> DataFrame:
    """Scores over their sum; dates without a positive sum have no basket."""
    return with_totals(s, DATE, {"_sum": F.sum("score")}, "symbol").where("_sum > 0").withColumn("weight", F.col("score") / F.col("_sum")).drop("score", "_sum")


def basket_rank(s: DataFrame) -> DataFrame:
    """Linear weights by rank: the best of n has n shares, the last 1."""
    n = F.col(COUNT)
    return placed(s, DATE, _best()).withColumn("weight", (n - F.col(PLACE) + 1) / (n * (n + 1) / 2)).drop("score", *OWN)


def cap_weight(w: DataFrame, maximum: float) -> DataFrame:
    """No weight above the maximum, see :func:`quantloom.plans.portfolio.cap_weight`: what a row and those
    lighter than it hold comes from sums per range, and a date's scale is the least of its rows' candidates."""
    rows = placed(w, DATE, [F.desc("weight"), F.asc("universe_idx"), F.asc("symbol")], {"_rest": "weight"}).withColumn("_k", F.col(PLACE) - 1)
    total, weight = F.col("_rest_all"), F.col("weight")
    scale = (total - F.col("_k") * maximum) / F.when(F.col("_rest") > 0, F.col("_rest"))
    fits = F.when(scale * weight <= maximum + 1e-15, F.struct(F.col("_k"), scale.alias("c")))
    rows = written(rows, "weights")
    # A row per date and range: the least of the whole date, for each of its ranges.
    found = rows.groupBy(*DATE, RANGE).agg(F.min(fits).alias("_c"))
    least = found.groupBy(*DATE).agg(F.min("_c").alias("_c"))
    found = joined(found.select(*DATE, RANGE), least, DATE)
    c, most = F.col("_c")["c"], F.lit(float(maximum))
    capped = F.when(total <= 0, weight).when(c.isNull(), F.when(weight > 0, most).otherwise(F.lit(0.0))).otherwise(F.least(most, c * weight))
    return joined(rows, found, [*DATE, RANGE]).withColumn("weight", capped).drop("_rest", "_rest_all", "_k", "_c", *OWN)


TRANSFORMS: dict[str, Callable[[DataFrame, dict], DataFrame]] = {
    "filter_topN": lambda s, p: filter_top_n(s, p["n"]),
    "filter_bottomN": lambda s, p: filter_bottom_n(s, p["n"]),
    "filter_quantile": lambda s, p: filter_quantile(s, p["pct"], p.get("side", "top")),
    "norm_minMax": lambda s, p: norm_min_max(s, p.get("lo", 0.0), p.get("hi", 1.0)),
    "norm_zScore": lambda s, p: norm_z_score(s),
    "norm_rank": lambda s, p: norm_rank(s),
}
BASKETS: dict[str, Callable[[DataFrame], DataFrame]] = {"basket_equal": basket_equal, "basket_proportional": basket_proportional, "basket_rank": basket_rank}
CONTROLS: dict[str, Callable[[DataFrame, dict], DataFrame]] = {"risk_capWeight": lambda w, p: cap_weight(w, p["max"])}
