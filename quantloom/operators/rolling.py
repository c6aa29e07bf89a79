"""Operators over the last ``period`` non-null inputs."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quantloom.operators import ordered
from quantloom.operators.spec import LONG_WINDOW, Frame, OpSpec, alpha_of, ratio

PERIOD = ("period",)
PERIOD_OR_ALPHA = ("period|alpha",)


def both(f: Frame, x: Column, y: Column) -> tuple[Column, Column]:
    """Two inputs, each null where the other is."""
    ok = x.isNotNull() & y.isNotNull()
    a, b = f.add_many([F.when(ok, x), F.when(ok, y)])
    return a, b


MEAN_AWAY, MEDIAN_AWAY = [("mean",), ("mean_deviation",)], [("middle",), ("middle_deviation",)]


def items(f: Frame, x: Column, period: int) -> Column:
    """The last inputs as an array, oldest first; null until there are enough."""
    return f.add(f.ready(x, period, F.collect_list(x).over(f.last(period))))


def variance(f: Frame, x: Column, period: int, ddof: int) -> tuple[Column, Column]:
    p = int(period)
    mean, pop = f.add_many([f.ready(x, p, F.avg(x).over(f.last(p))), f.ready(x, p, F.var_pop(x).over(f.last(p)))])
    return mean, pop if not ddof else F.when(F.lit(p > ddof), pop * p / max(p - ddof, 1)).otherwise(F.lit(float("nan")))


def middle(sorted_items: Column, n: int) -> Column:
    return sorted_items[n // 2] if n % 2 else (sorted_items[n // 2 - 1] + sorted_items[n // 2]) / 2


def sum_(f, x, p):
    return f.rolling(F.sum, x[0], p["period"])


def sma(f, x, p):
    return f.sma(x[0], p["period"])


def ewma(f, x, p):
    """Exponential weights within the window, normalised: the average over all rows so far, without what is
    older than the window."""
    n, decay = int(p["period"]), 1 - 2 / (int(p["period"]) + 1)
    if n == 1:
        return x[0]
    if (beside := ordered.found(f, x[0], n, ("weighted", decay))) is not None:
        return beside
    whole = f.ema(x[0], 1 - decay, seed=F.lit(0.0))
    f.reach += n
    older = f.add(F.coalesce(F.last(whole, ignorenulls=True).over(f.rows_before(n)), F.lit(0.0)))
    return f.ready(x[0], n, (whole - decay**n * older) / (1 - decay**n))


def mean_abs_deviation(f, x, p):
    n = int(p["period"])
    if n >= LONG_WINDOW:
        return dict(zip(("mean", "mad"), ordered.sliding(f, x[0], n, MEAN_AWAY)))
    window = items(f, x[0], n)
    mean = f.sma(x[0], n)
    mad = F.aggregate(F.transform(window, lambda e: F.abs(e - mean)), F.lit(0.0), lambda a, b: a + b) / n
    return {"mean": mean, "mad": mad}


def median_abs_deviation(f, x, p):
    n = int(p["period"])
    if n >= LONG_WINDOW:
        return dict(zip(("median", "mad"), ordered.sliding(f, x[0], n, MEDIAN_AWAY)))
    window = f.add(F.sort_array(items(f, x[0], n)))
    median = f.add(middle(window, n))
    away = f.add(F.sort_array(F.transform(window, lambda e: F.abs(e - median))))
    return {"median": median, "mad": middle(away, n)}


def places(f: Frame, x: Column, period: int, at: list[int]) -> list[Column]:
    """The values at some places of the sorted window."""
    n = int(period)
    if n >= LONG_WINDOW:
        return ordered.sliding(f, x, n, [("kth", k) for k in at])
    window = f.add(F.sort_array(items(f, x, n)))
    return [window[k] for k in at]


def _quarters(n: int) -> list[int]:
    return [int((n - 1) * 0.25), int((n - 1) * 0.75)]


def iqr(f, x, p):
    n = int(p["period"])
    q1, q3 = places(f, x[0], n, _quarters(n))
    return {"q1": q1, "q3": q3, "iqr": q3 - q1}


def extreme(f: Frame, x: Column, period: int, largest: bool) -> Column:
    beside = ordered.found(f, x, period, ("kth", int(period) - 1 if largest else 0))
    return beside if beside is not None else f.extreme(largest, x, period)


def min_(f, x, p):
    return extreme(f, x[0], p["period"], False)


def max_(f, x, p):
    return extreme(f, x[0], p["period"], True)


def min_max(f, x, p):
    return {"min": min_(f, x, p), "max": max_(f, x, p)}


def arg_extreme(f: Frame, x: Column, period: int, largest: bool) -> tuple[Column, Column]:
    """The extreme and how many bars ago it was; the newest of equal ones."""
    k = int(period) - 1 if largest else 0
    if (ago := ordered.found(f, x, period, ("newest", k))) is not None:
        return ordered.found(f, x, period, ("kth", k)), ago.cast("int")
    n = f.row(x)
    key = F.when(x.isNotNull(), F.struct(x.alias("v"), (n if largest else -n).alias("n")))
    best = f.extreme(largest, key, period)
    return best["v"], (n - F.abs(best["n"])).cast("int")


def arg_min(f, x, p):
    val, pos = arg_extreme(f, x[0], p["period"], False)
    return {"val": val, "pos": pos}


def arg_max(f, x, p):
    val, pos = arg_extreme(f, x[0], p["period"], True)
    return {"val": val, "pos": pos}


def arg_min_max(f, x, p):
    low, high = arg_extreme(f, x[0], p["period"], False), arg_extreme(f, x[0], p["period"], True)
    nested = lambda e: F.when(e[0].isNotNull(), F.struct(e[0].alias("val"), e[1].alias("pos")))
    return {"min": nested(low), "max": nested(high)}


def moments(f: Frame, x: Column, period: int | None = None) -> dict[str, Column]:
    """mean, variance, skew and excess kurtosis of the population over the last or all rows; 0 without variance."""
    mean, var, skew, kurt = f.aggregated(("avg", x), ("var_pop", x), ("skewness", x), ("kurtosis", x), period=period)
    flat = lambda v: F.when(var == 0, F.lit(0.0)).when(var.isNotNull(), F.coalesce(v, F.lit(0.0)))
    return {"mean": mean, "variance": var, "skew": flat(skew), "kurt": flat(kurt)}


def skew(f, x, p):
    made = moments(f, x[0], p["period"])
    return {k: made[k] for k in ("mean", "variance", "skew")}


def kurt(f, x, p):
    return moments(f, x[0], p["period"])


def _middles(n: int) -> list[int]:
    return [n // 2] if n % 2 else [n // 2, n // 2 - 1]


def median(f, x, p):
    n = int(p["period"])
    high, *low = places(f, x[0], n, _middles(n))
    return (low[0] + high) / 2 if low else high


def _cuts(n: int, quantiles: list[float]) -> list[int]:
    return [min(int(n * q + 0.5), n - 1) for q in quantiles]


def quantile(f, x, p):
    """Elements of the sorted window at round(period * q), at most the last."""
    n = int(p["period"])
    found = places(f, x[0], n, _cuts(n, p["quantiles"]))
    return F.when(found[0].isNotNull(), F.array(*found)) if found else F.array()


def var(f, x, p):
    mean, v = variance(f, x[0], p["period"], int(p["ddof"]))
    return {"mean": mean, "variance": v}


def stddev(f, x, p):
    mean, v = variance(f, x[0], p["period"], int(p["ddof"]))
    return {"mean": mean, "stddev": F.sqrt(v)}


def zscore(f, x, p):
    mean, v = variance(f, x[0], p["period"], 0)
    sd = f.add(F.sqrt(v))
    return {"mean": mean, "stddev": sd, "zscore": ratio(x[0] - mean, sd)}


def co_moments(f: Frame, x: Column, y: Column, ddof: int, period: int | None = None) -> dict[str, Column]:
    """Number, means, covariance, correlation and slope of y on x; 0 where a denominator is 0."""
    a, b, c, va, vb, n = f.aggregated(("avg", x), ("avg", y), ("covar_pop", x, y), ("var_pop", x), ("var_pop", y), ("count", x), period=period)
    return {
        "n": n,
        "meanX": a,
        "meanY": b,
        "cov": c * n / F.when(n != ddof, n - ddof) if ddof else c,
        "corr": F.when(va * vb == 0, F.lit(0.0)).otherwise(c / F.sqrt(va * vb)),
        "beta": F.when(va <= 0, F.lit(0.0)).otherwise(c / va),
    }


def _co(*names: str):
    def lower(f, x, p):
        a, b = both(f, x[0], x[1])
        made = co_moments(f, a, b, int(p["ddof"]), int(p["period"]))
        return {k: made[k] for k in names}

    return lower


def ew_moments(f: Frame, inputs: list[Column], alpha: float) -> dict[str, Column]:
    """Exponentially weighted means, variances and covariance of one or two inputs, without a start.

    With d the distance of an input from the mean before it, m moves by alpha d, and the (co)variance is
    the recurrence s = (1 - alpha)(s + alpha d d') from 0: an average of (1 - alpha) d d' seeded with 0.
    """
    x = list(both(f, *inputs)) if len(inputs) == 2 else [f.add(inputs[0])]
    n = f.row(x[0])
    means = [f.ema(c, alpha, first=n) for c in x]
    before = f.add_many([F.lag(m).over(f.over()) for m in means])
    d = [F.coalesce(c - b, F.when(c.isNotNull(), F.lit(0.0))) for c, b in zip(x, before)]
    out = {"n": n}
    for name, mean in zip(("meanX", "meanY"), means):
        out[name] = mean
    for name, a, b in [("varX", d[0], d[0])] + ([("varY", d[1], d[1]), ("cov", d[0], d[1])] if len(d) == 2 else []):
        square = f.add((1 - alpha) * a * b)
        out[name] = f.ema(square, alpha, seed=F.lit(0.0), first=n)
    ready = lambda v: F.when(n >= 2, v)
    return {k: v if k == "n" else ready(v) for k, v in out.items()}


def var_ew(f, x, p):
    m = ew_moments(f, x, alpha_of(p))
    return {"mean": m["meanX"], "variance": m["varX"]}


def stddev_ew(f, x, p):
    m = ew_moments(f, x, alpha_of(p))
    return {"mean": m["meanX"], "stddev": F.sqrt(m["varX"])}


def zscore_ew(f, x, p):
    m = ew_moments(f, x, alpha_of(p))
    sd = f.add(F.sqrt(m["varX"]))
    return {"mean": m["meanX"], "stddev": sd, "zscore": ratio(x[0] - m["meanX"], sd)}


def _co_ew(last: str | None):
    def lower(f, x, p):
        m = ew_moments(f, x, alpha_of(p))
        out = {"meanX": m["meanX"], "meanY": m["meanY"], "cov": m["cov"]}
        product = m["varX"] * m["varY"]
        if last == "corr":
            out["corr"] = F.when(product == 0, F.lit(0.0)).otherwise(m["cov"] / F.sqrt(product))
        if last == "beta":
            out["beta"] = ratio(m["cov"], m["varX"])
        return out

    return lower


def _op(name: str, group: str, lower, outputs: tuple[str, ...] = (), arity: int = 1, required=PERIOD, kind: str = "window", **init) -> OpSpec:
    return OpSpec(name, f"rolling.{group}", arity, lower, init, outputs, kind, required)


def _kth(at: Callable[[int, dict], list[int]]):
    return lambda n, p: [("kth", k) for k in at(n, p)]


_LEAST, _MOST = (lambda n, p: [("kth", 0)]), (lambda n, p: [("kth", n - 1)])
_WHEN_LEAST, _WHEN_MOST = (lambda n, p: [("kth", 0), ("newest", 0)]), (lambda n, p: [("kth", n - 1), ("newest", n - 1)])

#: What operators ask of the sorted window, and whether they need it sorted: others take what is there.
SORTED = {
    "MeanAbsDeviation": (lambda n, p: MEAN_AWAY, True), "MedianAbsDeviation": (lambda n, p: MEDIAN_AWAY, True), "IQR": (_kth(lambda n, p: _quarters(n)), True),
    "RollingMedian": (_kth(lambda n, p: _middles(n)), True), "RollingQuantile": (_kth(lambda n, p: _cuts(n, p["quantiles"])), True),
    "RollingMin": (_LEAST, False), "RollingMax": (_MOST, False), "RollingMinMax": (lambda n, p: _LEAST(n, p) + _MOST(n, p), False),
    "RollingArgMin": (_WHEN_LEAST, False), "RollingArgMax": (_WHEN_MOST, False), "RollingArgMinMax": (lambda n, p: _WHEN_LEAST(n, p) + _WHEN_MOST(n, p), False),
    "EWMA": (lambda n, p: [("weighted", 1 - 2 / (n + 1))], False),
}


def slide_together(f: Frame, nodes: list[tuple[OpSpec, Column, dict]]) -> None:
    """One pass for what nodes (operator, input, parameters) ask of sorted long windows, and with it what others
    can take from a window that is there."""
    asked: dict[tuple[str, int], list] = {}
    for spec, x, p in nodes:
        asked.setdefault((str(x), int(p["period"])), []).append((x, *SORTED[spec.name], p))
    requests = []
    for (text, n), some in asked.items():
        if n < LONG_WINDOW or not any(needs for _, _, needs, _ in some):
            continue
        x = some[0][0]
        double = dict(f.df.select(x.alias("x")).dtypes)["x"] == "double"
        stats = [stat for _, make, needs, p in some if needs or (double and n <= ordered.SIDE_BY_SIDE) for stat in make(n, p)]
        if any((text, n, str(f.valid), stat) not in f.slid for stat in stats):
            requests.append((x, n, stats))
    if requests:
        ordered.slide(f, requests)


OPS = [
    _op("RollingSum", "average", sum_),
    _op("SMA", "average", sma),
    _op("EWMA", "average", ewma),
    _op("MeanAbsDeviation", "deviation", mean_abs_deviation, ("mean", "mad")),
    _op("MedianAbsDeviation", "deviation", median_abs_deviation, ("median", "mad")),
    _op("IQR", "deviation", iqr, ("q1", "q3", "iqr")),
    _op("RollingMin", "minmax", min_),
    _op("RollingMax", "minmax", max_),
    _op("RollingMinMax", "minmax", min_max, ("min", "max")),
    _op("RollingArgMin", "minmax", arg_min, ("val", "pos")),
    _op("RollingArgMax", "minmax", arg_max, ("val", "pos")),
    _op("RollingArgMinMax", "minmax", arg_min_max, ("min", "max")),
    _op("RollingSkew", "moments", skew, ("mean", "variance", "skew")),
    _op("RollingKurt", "moments", kurt, ("mean", "variance", "skew", "kurt")),
    _op("RollingMedian", "rank", median),
    _op("RollingQuantile", "rank", quantile, required=("period", "quantiles")),
    _op("RollingVar", "stats", var, ("mean", "variance"), ddof=0),
    _op("RollingVarEW", "stats", var_ew, ("mean", "variance"), required=PERIOD_OR_ALPHA, kind="scan"),
    _op("RollingStddev", "stats", stddev, ("mean", "stddev"), ddof=0),
    _op("RollingStddevEW", "stats", stddev_ew, ("mean", "stddev"), required=PERIOD_OR_ALPHA, kind="scan"),
    _op("RollingZScore", "stats", zscore, ("mean", "stddev", "zscore")),
    _op("RollingZScoreEW", "stats", zscore_ew, ("mean", "stddev", "zscore"), required=PERIOD_OR_ALPHA, kind="scan"),
    _op("RollingCov", "stats", _co("meanX", "meanY", "cov"), ("meanX", "meanY", "cov"), 2, ddof=0),
    _op("RollingCorr", "stats", _co("meanX", "meanY", "cov", "corr"), ("meanX", "meanY", "cov", "corr"), 2, ddof=0),
    _op("RollingBeta", "stats", _co("meanX", "meanY", "cov", "beta"), ("meanX", "meanY", "cov", "beta"), 2, ddof=0),
    _op("RollingCovEW", "stats", _co_ew(None), ("meanX", "meanY", "cov"), 2, PERIOD_OR_ALPHA, "scan"),
    _op("RollingCorrEW", "stats", _co_ew("corr"), ("meanX", "meanY", "cov", "corr"), 2, PERIOD_OR_ALPHA, "scan"),
    _op("RollingBetaEW", "stats", _co_ew("beta"), ("meanX", "meanY", "cov", "beta"), 2, PERIOD_OR_ALPHA, "scan"),
]
