"""Weights from scores: filters, normalisers, weightings and risk controls per date, and recipes of them.

Frames have (ts, symbol, score, universe_idx) before weighting and (ts, symbol, weight, universe_idx)
after; ties keep the order of the universe. Only :func:`limit_deltas` looks at another date.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quantloom.session import ship_package


def _date():
    return Window.partitionBy("ts")


def _best(descending: bool = True):
    return _date().orderBy(F.desc("score") if descending else F.asc("score"), "universe_idx")


def scored(scores: DataFrame, universe: DataFrame | None = None, score: str = "score") -> DataFrame:
    """Scores without nulls and NaN; without a universe, symbols are ordered by name."""
    rows = scores.select("ts", "symbol", F.col(score).cast("double").alias("score")).where(F.col("score").isNotNull() & ~F.isnan("score"))
    if universe is None:
        return rows.withColumn("universe_idx", F.row_number().over(_date().orderBy("symbol")) - 1)
    return rows.join(universe, "symbol")


def filter_gate(s: DataFrame, threshold: float) -> DataFrame:
    return s.where(F.col("score") >= threshold)


def filter_top_n(s: DataFrame, n: int) -> DataFrame:
    return s.withColumn("_rn", F.row_number().over(_best())).where(F.col("_rn") <= n).drop("_rn")


def filter_bottom_n(s: DataFrame, n: int) -> DataFrame:
    return s.withColumn("_rn", F.row_number().over(_best(False))).where(F.col("_rn") <= n).drop("_rn")


def filter_quantile(s: DataFrame, pct: float, side: str = "top") -> DataFrame:
    if side not in ("top", "bottom"):
        raise ValueError(f"side is top or bottom, not {side!r}")
    n = F.greatest(F.lit(1), F.floor(F.count("*").over(_date()) * pct + 0.5))
    return s.withColumn("_n", n).withColumn("_rn", F.row_number().over(_best(side == "top"))).where("_rn <= _n").drop("_rn", "_n")


def norm_min_max(s: DataFrame, lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    low, high = F.min("score").over(_date()), F.max("score").over(_date())
    return s.withColumn("score", F.when(low == high, F.lit((lo + hi) / 2)).otherwise(lo + (F.col("score") - low) / F.when(low != high, high - low) * (hi - lo)))


def norm_z_score(s: DataFrame) -> DataFrame:
    """Population z-scores; unchanged without deviation."""
    sd = F.stddev_pop("score").over(_date())
    return s.withColumn("score", F.when(sd == 0, F.col("score")).otherwise((F.col("score") - F.avg("score").over(_date())) / F.when(sd != 0, sd)))


def norm_rank(s: DataFrame) -> DataFrame:
    """Ranks from 0 to 1, ties in order; 0 for a single symbol."""
    n = F.count("*").over(_date())
    return s.withColumn("score", F.when(n == 1, F.lit(0.0)).otherwise((F.row_number().over(_best(False)) - 1) / F.when(n > 1, n - 1)))


def _weights(s: DataFrame, weight) -> DataFrame:
    return s.withColumn("weight", weight).drop("score")


def basket_equal(s: DataFrame) -> DataFrame:
    return _weights(s, 1 / F.count("*").over(_date()))


def basket_proportional(s: DataFrame) -> DataFrame:
    """Scores over their sum; dates without a positive sum have no basket."""
    total = F.sum("score").over(_date())
    return _weights(s.withColumn("_sum", total).where("_sum > 0"), F.col("score") / F.col("_sum")).drop("_sum")


def basket_rank(s: DataFrame) -> DataFrame:
    """Linear weights by rank: the best of n has n shares, the last 1."""
    n = F.count("*").over(_date())
    return _weights(s, (n - F.row_number().over(_best()) + 1) / (n * (n + 1) / 2))


def cap_weight(w: DataFrame, maximum: float) -> DataFrame:
    """No weight above the maximum; what is cut off goes to the others in proportion, as long as any can
    take it, and is cash after that.

    In closed form: with weights in descending order, k of them are capped for the smallest k at which
    the rest, scaled to what is left, stays within the maximum."""
    by_weight, lightest_first = _date().orderBy(F.desc("weight"), "universe_idx"), _date().orderBy(F.asc("weight"), F.desc("universe_idx"))
    # sums from the light end on: a frame that reaches to the end would be summed anew for every row
    rest = F.sum("weight").over(lightest_first.rowsBetween(Window.unboundedPreceding, 0))
    rows = w.withColumn("_k", F.row_number().over(by_weight) - 1).withColumn("_sum", F.sum("weight").over(_date())).withColumn("_rest", rest)
    scale = (F.col("_sum") - F.col("_k") * maximum) / F.when(F.col("_rest") > 0, F.col("_rest"))
    fits = F.when(scale * F.col("weight") <= maximum + 1e-15, F.struct(F.col("_k"), scale.alias("c")))
    found = rows.withColumn("_c", F.min(fits).over(_date())["c"])
    capped = F.when(F.col("_sum") <= 0, F.col("weight")).when(F.col("_c").isNull(), F.when(F.col("weight") > 0, F.least(F.lit(float(maximum)), F.col("weight") * 0 + maximum)).otherwise(F.lit(0.0))).otherwise(F.least(F.lit(float(maximum)), F.col("_c") * F.col("weight")))
    return found.withColumn("weight", capped).drop("_k", "_sum", "_rest", "_c")


def limit_deltas(w: DataFrame, max_delta: float) -> DataFrame:
    """No weight moves by more than ``max_delta`` from the basket of the date before, which starts empty;
    weights that reach 0 leave.

    A symbol's limited weight depends on its own limited weight before, over all dates with a basket, so
    each symbol is a stream of its targets in order, with one number of state. Dates are numbered, and
    after its last target a symbol adds the dates on which its weight falls to 0, at most 1 / max_delta."""
    ship_package(w.sparkSession)
    dates = w.select("ts").distinct()
    # one row per date: this window has as many rows as there are dates, however many symbols
    dates = dates.select("ts", (F.row_number().over(Window.orderBy("ts")) - 1).cast("long").alias("date_no"), F.count("*").over(Window.partitionBy()).alias("n_dates"))
    following = F.lead("date_no").over(Window.partitionBy("symbol").orderBy("date_no"))
    rows = w.select("ts", "symbol", "universe_idx", "weight").join(dates, "ts").select("symbol", "universe_idx", "date_no", "weight", F.coalesce(following, F.col("n_dates")).alias("until"))
    rows = rows.repartition("symbol").sortWithinPartitions("symbol", "date_no")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        symbol, held = None, 0.0
        for pdf in batches:
            out = []
            for s, idx, no, target, until in zip(pdf["symbol"], pdf["universe_idx"], pdf["date_no"], pdf["weight"], pdf["until"]):
                if s != symbol:
                    symbol, held = s, 0.0
                held = max(0.0, min(held + max_delta, max(held - max_delta, target)))
                out.append((s, idx, no, held))
                for later in range(no + 1, until):
                    if held <= 0:
                        break
                    held = max(0.0, held - max_delta)
                    out.append((s, idx, later, held))
            yield pd.DataFrame(out, columns=["symbol", "universe_idx", "date_no", "weight"])

    kept = rows.mapInPandas(walk, rows.select("symbol", "universe_idx", "date_no", "weight").schema)
    return kept.where("weight > 0").join(dates.select("ts", "date_no"), "date_no").select("ts", "symbol", "universe_idx", "weight")


#: kind: (function, parameters with the check that each must pass)
_positive = lambda v: isinstance(v, int) and not isinstance(v, bool) and v > 0
_share = lambda v: isinstance(v, (int, float)) and 0 <= v <= 1
_number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
TRANSFORMS: dict[str, tuple[Callable, dict]] = {
    "filter_gate": (lambda s, p: filter_gate(s, p["threshold"]), {"threshold": _number}),
    "filter_topN": (lambda s, p: filter_top_n(s, p["n"]), {"n": _positive}),
    "filter_bottomN": (lambda s, p: filter_bottom_n(s, p["n"]), {"n": _positive}),
    "filter_quantile": (lambda s, p: filter_quantile(s, p["pct"], p.get("side", "top")), {"pct": _share}),
    "norm_minMax": (lambda s, p: norm_min_max(s, p.get("lo", 0.0), p.get("hi", 1.0)), {}),
    "norm_zScore": (lambda s, p: norm_z_score(s), {}),
    "norm_rank": (lambda s, p: norm_rank(s), {}),
}
BASKETS: dict[str, Callable] = {"basket_equal": basket_equal, "basket_proportional": basket_proportional, "basket_rank": basket_rank}
CONTROLS: dict[str, tuple[Callable, dict]] = {
    "risk_capWeight": (lambda w, p: cap_weight(w, p["max"]), {"max": _share}),
    "risk_limitDeltas": (lambda w, p: limit_deltas(w, p["maxDelta"]), {"maxDelta": _share}),
}

#: Gate at 0, the best 20, equal weights, at most a tenth each.
DEFAULT_RECIPE = {
    "scoredTransforms": [{"kind": "filter_gate", "threshold": 0}, {"kind": "filter_topN", "n": 20}],
    "basketCtor": {"kind": "basket_equal"},
    "riskControls": [{"kind": "risk_capWeight", "max": 0.1}],
}


def _kind(step) -> tuple[str, dict]:
    return (step, {}) if isinstance(step, str) else (step.get("kind"), step)


def validate_recipe(recipe: dict) -> list[str]:
    """What is wrong with a recipe."""
    errors = []
    for key, known in (("scoredTransforms", TRANSFORMS), ("riskControls", CONTROLS)):
        for i, step in enumerate(recipe.get(key) or []):
            kind, params = _kind(step)
            if kind not in known:
                errors.append(f'{key}[{i}]: unknown kind "{kind}"')
                continue
            if params.get("side", "top") not in ("top", "bottom"):
                errors.append(f"{key}[{i}].side: invalid")
            errors += [f"{key}[{i}].{name}: invalid" for name, ok in known[kind][1].items() if name not in params or not ok(params[name])]
    if _kind(recipe.get("basketCtor") or {})[0] not in BASKETS:
        errors.append("basketCtor: unknown kind")
    return errors


def compile_recipe(recipe: dict | None, wide: bool = False) -> Callable[[DataFrame], DataFrame]:
    """A function from scores to weights: transforms, weighting, controls, in order. ``wide`` takes the steps
    that don't gather a date in one task (:mod:`quantloom.plans.wide`)."""
    recipe = DEFAULT_RECIPE if recipe is None else recipe
    if errors := validate_recipe(recipe):
        raise ValueError("; ".join(errors))

    transforms, baskets, controls = {k: f for k, (f, _) in TRANSFORMS.items()}, dict(BASKETS), {k: f for k, (f, _) in CONTROLS.items()}
    if wide:
        from quantloom.plans import wide as steps

        transforms, baskets, controls = transforms | steps.TRANSFORMS, baskets | steps.BASKETS, controls | steps.CONTROLS

    def apply(s: DataFrame) -> DataFrame:
        for step in recipe.get("scoredTransforms") or []:
            kind, params = _kind(step)
            s = transforms[kind](s, params)
        w = baskets[_kind(recipe["basketCtor"])[0]](s)
        for step in recipe.get("riskControls") or []:
            kind, params = _kind(step)
            w = controls[kind](w, params)
        return w

    return apply
