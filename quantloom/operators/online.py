"""Operators over all non-null inputs so far."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quantloom.operators.rolling import both, co_moments, moments
from quantloom.operators.spec import Frame, OpSpec, alpha_of, ratio


def cma(f, x, p):
    return f.running("avg", x[0])


def ema(f, x, p):
    return f.ema(f.add(x[0]), alpha_of(p))


def _down(f: Frame, ret: Column, threshold: float) -> tuple[Column, Column]:
    """Mean and sample deviation of what lies below the threshold so far; null until there are two."""
    below = f.add(F.when(ret < threshold, ret - threshold))
    n, mean, sd = f.cumulative(("count", below), ("avg", below), ("stddev_samp", below))
    ok = ret.isNotNull() & (n >= 2)
    return F.when(ok, mean), F.when(ok, sd)


def down_stats(f, x, p):
    mean, sd = _down(f, x[0], float(p["threshold"]))
    return {"mean": mean, "stddev": sd}


def sharpe(f, x, p):
    n, mean, sd = f.cumulative(("count", x[0]), ("avg", x[0]), ("stddev_samp", x[0]))
    return F.when(x[0].isNotNull() & (n >= 2), ratio(mean - float(p["riskfree"]), sd))


def sortino(f, x, p):
    mean, (_, sd) = f.running("avg", x[0]), _down(f, x[0], float(p["riskfree"]))
    return F.when(sd.isNotNull(), ratio(mean - float(p["riskfree"]), sd))


def _sides(f: Frame, x: Column, threshold: float) -> dict[str, Column]:
    gain, loss = f.add_many([F.when(x > threshold, x), F.when(x < threshold, x)])
    n, wins, losses, gains, lost = f.cumulative(("count", x), ("count", gain), ("count", loss), ("sum", gain), ("sum", loss))
    gains, lost = f.add_many([F.coalesce(gains, F.lit(0.0)), F.coalesce(lost, F.lit(0.0))])
    return {"n": n, "wins": wins, "losses": losses, "gains": gains, "lost": lost, "avg_gain": F.when(wins > 0, gains / wins).otherwise(F.lit(0.0)), "avg_loss": F.when(losses > 0, lost / losses).otherwise(F.lit(0.0))}


def win_rate(f, x, p):
    s = _sides(f, x[0], float(p["threshold"]))
    return F.when(x[0].isNotNull(), s["wins"] / s["n"])


def gain_loss(f, x, p):
    s = _sides(f, x[0], float(p["threshold"]))
    return F.when(x[0].isNotNull(), ratio(s["avg_gain"], F.abs(s["avg_loss"])))


def expectancy(f, x, p):
    s = _sides(f, x[0], float(p["threshold"]))
    return F.when(x[0].isNotNull(), (s["wins"] * s["avg_gain"] - s["losses"] * F.abs(s["avg_loss"])) / s["n"])


def profit_factor(f, x, p):
    s = _sides(f, x[0], float(p["threshold"]))
    return F.when(x[0].isNotNull(), ratio(s["gains"], F.abs(s["lost"])))


def _cumulative(f: Frame, x: Column) -> dict[str, Column]:
    return {k: F.when(x.isNotNull(), v) for k, v in moments(f, x).items()}


def cu_skew(f, x, p):
    made = _cumulative(f, f.add(x[0]))
    return {k: made[k] for k in ("mean", "variance", "skew")}


def cu_kurt(f, x, p):
    return _cumulative(f, f.add(x[0]))


def _variance(f: Frame, x: Column, ddof: int) -> tuple[Column, Column]:
    n, mean, pop = f.cumulative(("count", x), ("avg", x), ("var_pop", x))
    seen = x.isNotNull() & (n > ddof)
    return F.when(seen, mean), F.when(seen, pop * n / (n - ddof) if ddof else pop)


def cu_var(f, x, p):
    mean, v = _variance(f, x[0], int(p["ddof"]))
    return {"mean": mean, "variance": v}


def cu_stddev(f, x, p):
    mean, v = _variance(f, x[0], int(p["ddof"]))
    return {"mean": mean, "stddev": F.sqrt(v)}


def _co(*names: str):
    def lower(f, x, p):
        a, b = both(f, x[0], x[1])
        ddof = int(p["ddof"])
        made = co_moments(f, a, b, ddof)
        return {k: F.when(a.isNotNull() & (made["n"] > ddof), made[k]) for k in names}

    return lower


def _op(name: str, group: str, lower, outputs: tuple[str, ...] = (), arity: int = 1, required: tuple[str, ...] = (), kind: str = "window", **init) -> OpSpec:
    return OpSpec(name, f"online.{group}", arity, lower, init, outputs, kind, required)


OPS = [
    _op("CMA", "average", cma),
    _op("EMA", "average", ema, required=("period|alpha",), kind="scan"),
    _op("RunningDownStats", "metrics", down_stats, ("mean", "stddev"), threshold=0.0),
    _op("RunningSharpe", "metrics", sharpe, riskfree=0.0),
    _op("RunningSortino", "metrics", sortino, riskfree=0.0),
    _op("RunningWinRate", "metrics", win_rate, threshold=0.0),
    _op("RunningGainLoss", "metrics", gain_loss, threshold=0.0),
    _op("RunningExpectancy", "metrics", expectancy, threshold=0.0),
    _op("RunningProfitFactor", "metrics", profit_factor, threshold=0.0),
    _op("CuSkew", "moments", cu_skew, ("mean", "variance", "skew")),
    _op("CuKurt", "moments", cu_kurt, ("mean", "variance", "skew", "kurt")),
    _op("CuVar", "stats", cu_var, ("mean", "variance"), ddof=0),
    _op("CuStddev", "stats", cu_stddev, ("mean", "stddev"), ddof=0),
    _op("CuCov", "stats", _co("meanX", "meanY", "cov"), ("meanX", "meanY", "cov"), 2, ddof=0),
    _op("CuCorr", "stats", _co("meanX", "meanY", "cov", "corr"), ("meanX", "meanY", "cov", "corr"), 2, ddof=0),
    _op("CuBeta", "stats", _co("meanX", "meanY", "cov", "beta"), ("meanX", "meanY", "cov", "beta"), 2, ddof=0),
]
