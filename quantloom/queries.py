"""Registered queries over the reference tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.functions import scalars
from quantloom.functions.series import Series, exploded
from quantloom.functions import series as fs
from quantloom.plans import portfolio as pf
from quantloom.plans.backtest import Costs, Options, commission, equity, run_backtest, slipped_price
from quantloom.plans.graph import compile_graph
from quantloom.sources.bars import bars_from_events, bars_from_lineitem, daily_bars, resample, universe_frame, with_adjustment

DIGITS, SHIFT = 7, 3.7e-10
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

BARS_SQL = "SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, CAST(count(*) AS DOUBLE) AS volume, sum(value) AS turnover FROM events GROUP BY 1, 2"
BASE = "OVER (PARTITION BY symbol ORDER BY ts)"
UPTO = "OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """The columns, doubles rounded; timestamps as seconds.

    A small shift keeps values that lie on the middle of two roundings (means of prices, say) away from
    it, so that the last bits of a sum do not decide."""
    kinds = dict(df.dtypes)
    one = lambda c: F.round(F.col(c) + SHIFT, DIGITS) + F.lit(0.0) if kinds[c] == "double" else F.unix_timestamp(F.col(c).cast("timestamp")) if kinds[c].startswith("timestamp") else F.col(c).cast("long") if kinds[c] in ("int", "bigint") else F.col(c)
    return df.select(*[one(c).alias(c) for c in columns or df.columns])


def shown(x: str) -> str:
    """The same in SQL."""
    return f"round({x} + {SHIFT}::DOUBLE, {DIGITS}) + 0.0::DOUBLE"


def w(p: int) -> str:
    return f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {p - 1} PRECEDING AND CURRENT ROW)"


def roll(agg: str, x: str, p: int) -> str:
    return f"CASE WHEN count({x}) {w(p)} = {p} THEN {agg} {w(p)} END"


def sma(x: str, p: int) -> str:
    return roll(f"avg({x})", x, p)


def lag(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) {BASE}"


def ema(x: str, alpha: str, seed: str = "") -> str:
    """The recurrence over the non-null inputs so far, folded anew for every row."""
    return f"CASE WHEN {x} IS NOT NULL THEN list_reduce(list({x}) FILTER (WHERE {x} IS NOT NULL) {UPTO}, lambda a, v: a + CAST({alpha} AS DOUBLE) * (v - a){', CAST(' + seed + ' AS DOUBLE)' if seed else ''}) END"


def e(x: str, p: int) -> str:
    return ema(x, f"(2.0::DOUBLE / {p + 1})")


def wilder(x: str, p: int) -> str:
    return ema(x, f"(1.0::DOUBLE / {p})")


def layered(steps: list[dict[str, str]], outputs: list[str], kinds: dict[str, str], base: str = BARS_SQL) -> str:
    """SQL in which every step adds columns to the one before."""
    parts = [f"WITH s0 AS ({base})"]
    for i, step in enumerate(steps):
        parts.append(f"s{i + 1} AS (SELECT *, {', '.join(f'{x} AS {n}' for n, x in step.items())} FROM s{i})")
    show = lambda n: f"{shown(n)} AS {n}" if kinds.get(n, "double") == "double" else f"CAST({n} AS BIGINT) AS {n}" if kinds[n] == "long" else n
    return ", ".join(parts) + f" SELECT symbol, CAST(epoch(ts) AS BIGINT) AS ts, {', '.join(map(show, outputs))} FROM s{len(steps)}"


def graph(name: str, nodes: list[tuple], outputs: dict[str, str], steps: list[dict[str, str]] | None, kinds: dict[str, str] | None = None) -> None:
    """Register a graph over the event bars. nodes: (name, type, inputs, init); outputs: alias -> path."""
    body = [{"name": n[0], "type": n[1], "inputs": [x if "." in x or x.startswith("n_") else f"bar.{x}" for x in n[2]], **({"init": n[3]} if len(n) > 3 else {})} for n in nodes]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = compile_graph({"root": "bar", "nodes": body}, event_bars(spark, sf_dir), outputs=list(outputs.values()))
        named = found.withColumnsRenamed({p.replace(".", "_"): a for a, p in outputs.items()})
        return rounded(named, "symbol", "ts", *outputs)

    QUERIES[name] = run
    if steps is not None:
        ORACLE_SQL[name] = layered(steps, list(outputs), kinds or {})


HLC, HLCV, OHLC = ["high", "low", "close"], ["high", "low", "close", "volume"], ["open", "high", "low", "close"]


def ops(name: str, table: list[tuple], steps: list[dict[str, str]] | None, kinds: dict[str, str] | None = None) -> None:
    """Register one node per row (alias, type, inputs, init, fields ...) with all fields as outputs."""
    nodes, outputs = [], {}
    for alias, kind, inputs, init, *fields in table:
        nodes.append((f"n_{alias}", kind, inputs, init))
        if alias.startswith("_"):  # an input of others only
            continue
        outputs |= {f"{alias}_{f.replace('.', '_')}": f"n_{alias}.{f}" for f in fields} if fields else {alias: f"n_{alias}"}
    graph(name, nodes, outputs, steps, kinds)


# Core

ops("core_arithmetic", [
    ("k2", "Const", [], {"value": 2.5}), ("k0", "Const", [], {"value": 0}),
    ("add", "Add", ["close", "open"], {}), ("sub", "Sub", ["close", "open"], {}), ("mul", "Mul", ["close", "n_k2"], {}), ("div", "Div", ["close", "volume"], {}),
    ("modulo", "Mod", ["n_sub", "n_k2"], {}), ("pow", "Pow", ["volume", "n_k2"], {}), ("least", "Min", ["close", "open"], {}), ("most", "Max", ["close", "open"], {}),
    ("clamped", "Clamp", ["close", "volume", "high"], {}), ("lerped", "Lerp", ["low", "high", "n_k2"], {}), ("place", "InvLerp", ["n_k0", "turnover", "close"], {}),
    ("far", "RelDist", ["n_add", "open"], {}), ("sums", "SumOf", ["open", "high", "low"], {}), ("prod", "ProdOf", ["volume", "n_k2", "volume"], {}), ("mean", "AvgOf", ["open", "high", "low"], {}), ("lowest", "MinOf", ["open", "n_k2", "low"], {}), ("highest", "MaxOf", ["open", "close", "low"], {}),
], [{"k2": "2.5::DOUBLE", "k0": "0::DOUBLE", "add": "close + open", "sub": "close - open", "mul": "close * 2.5::DOUBLE", "div": "close / volume", "least": "least(close, open)", "most": "greatest(close, open)", "clamped": "greatest(volume, least(high, close))", "lerped": "low + 2.5::DOUBLE * (high - low)", "place": "close / turnover", "sums": "open + high + low", "mean": "(open + high + low) / 3", "lowest": "least(open, 2.5::DOUBLE, low)", "highest": "greatest(open, close, low)", "pow": "pow(volume, 2.5::DOUBLE)", "prod": "volume * 2.5::DOUBLE * volume", "far": "abs(close) / (abs(open) + 2.220446049250313e-16)"}, {"modulo": "sub - 2.5::DOUBLE * trunc(sub / 2.5::DOUBLE)"}])

ops("core_unary", [
    ("d", "Sub", ["close", "open"], {}), ("k", "Const", [], {"value": 0.001}), ("small", "Mul", ["close", "n_k"], {}),
    ("negate", "Negate", ["close"], {}), ("absolute", "Abs", ["n_d"], {}), ("sgn", "Sign", ["n_d"], {}), ("floored", "Floor", ["n_d"], {}), ("ceiled", "Ceil", ["n_d"], {}), ("halves_up", "Round", ["n_d"], {}),
    ("root", "Sqrt", ["close"], {}), ("logged", "Log", ["volume"], {}), ("exped", "Exp", ["n_small"], {}), ("log_1p", "Log1p", ["close"], {}), ("exp_m1", "Expm1", ["n_small"], {}), ("inverse", "Reciprocal", ["volume"], {}),
], [{"d": "close - open", "small": "close * 0.001::DOUBLE", "k": "0.001::DOUBLE"}, {"negate": "-close", "absolute": "abs(d)", "sgn": "sign(d)::DOUBLE", "floored": "floor(d)", "ceiled": "ceil(d)", "halves_up": "floor(d + 0.5::DOUBLE)", "root": "sqrt(close)", "logged": "ln(volume)", "exped": "exp(small)", "log_1p": "ln(1 + close)", "exp_m1": "exp(small) - 1", "inverse": "1 / volume"}])

_BOOL = "lt gt lte gte eq neq between outside anded ored inverted xored all_of any_of none_of finite positive negative zero nan".split()
ops("core_logic", [
    ("d", "Sub", ["close", "open"], {}), ("lt", "LT", ["close", "open"], {}), ("gt", "GT", ["close", "open"], {}), ("lte", "LTE", ["close", "open"], {}), ("gte", "GTE", ["close", "open"], {}), ("eq", "EQ", ["close", "high"], {}), ("neq", "NEQ", ["close", "high"], {}),
    ("between", "Between", ["open", "low", "close"], {}), ("outside", "Outside", ["open", "low", "close"], {}), ("anded", "And", ["n_lt", "n_eq"], {}), ("ored", "Or", ["n_lt", "n_eq"], {}), ("inverted", "Not", ["n_lt"], {}), ("xored", "Xor", ["n_lt", "n_eq"], {}),
    ("all_of", "AllOf", ["n_lte", "n_eq", "n_neq"], {}), ("any_of", "AnyOf", ["n_lt", "n_eq", "n_gt"], {}), ("none_of", "NoneOf", ["n_lt", "n_eq"], {}), ("finite", "IsFinite", ["n_d"], {}), ("positive", "IsPositive", ["n_d"], {}), ("negative", "IsNegative", ["n_d"], {}), ("zero", "IsZero", ["n_d"], {}), ("nan", "IsNaN", ["n_d"], {}),
    ("chosen", "IfThenElse", ["n_lt", "open", "close"], {}), ("gated", "Gate", ["n_gt", "close"], {}), ("first_in", "Coalesce", ["open", "n_gated"], {}), ("gated_sma", "SMA", ["n_gated"], {"period": 3}),
], [{"d": "close - open", "lt": "close < open", "gt": "close > open", "lte": "close <= open", "gte": "close >= open", "eq": "close = high", "neq": "close <> high", "between": "open BETWEEN low AND close", "outside": "open < low OR open > close", "positive": "close - open > 0", "negative": "close - open < 0", "zero": "close - open = 0", "finite": "true", "nan": "false"}, {"anded": "lt AND eq", "ored": "lt OR eq", "inverted": "NOT lt", "xored": "lt <> eq", "all_of": "lte AND eq AND neq", "any_of": "lt OR eq OR gt", "none_of": "NOT (lt OR eq)", "chosen": "CASE WHEN lt THEN open ELSE close END", "gated": "CASE WHEN gt THEN close END", "first_in": "CASE WHEN gt THEN open END", "gated_sma": "CASE WHEN gt AND count(*) OVER g = 3 THEN avg(close) OVER g END".replace("OVER g", "OVER (PARTITION BY symbol, gt ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")}], dict.fromkeys(_BOOL, "boolean"))

# Rolling

ops("rolling_average", [("total", "RollingSum", ["close"], {"period": 5}), ("mean", "SMA", ["close"], {"period": 10}), ("weighted", "EWMA", ["close"], {"period": 5})],
    [{"total": roll("sum(close)", "close", 5), "mean": sma("close", 10), "weighted": f"CASE WHEN row_number() {BASE} >= 5 THEN (" + " + ".join(f"pow(2.0::DOUBLE / 3, {k}) * {lag('close', k) if k else 'close'}" for k in range(5)) + ") / " + str(sum((2 / 3) ** k for k in range(5))) + "::DOUBLE END"}])
ops("rolling_deviation", [("mean_away", "MeanAbsDeviation", ["close"], {"period": 7}, "mean", "mad"), ("median_away", "MedianAbsDeviation", ["close"], {"period": 7}, "median", "mad"), ("spread", "IQR", ["close"], {"period": 10}, "q1", "q3", "iqr")],
    [{"l7": roll("list(close)", "close", 7), "l10": roll("list(close)", "close", 10), "mean_away_mean": sma("close", 7)}, {"median_away_median": "list_sort(l7)[4]", "spread_q1": "list_sort(l10)[3]", "spread_q3": "list_sort(l10)[7]"}, {"mean_away_mad": "list_avg(list_transform(l7, lambda v: abs(v - mean_away_mean)))", "median_away_mad": "list_sort(list_transform(l7, lambda v: abs(v - median_away_median)))[4]", "spread_iqr": "spread_q3 - spread_q1"}])
ops("rolling_minmax", [("least", "RollingMin", ["close"], {"period": 6}), ("most", "RollingMax", ["close"], {"period": 6}), ("both", "RollingMinMax", ["close"], {"period": 6}, "min", "max"), ("when_least", "RollingArgMin", ["close"], {"period": 6}, "val", "pos"), ("when_most", "RollingArgMax", ["close"], {"period": 6}, "val", "pos"), ("whens", "RollingArgMinMax", ["close"], {"period": 6}, "min.val", "max.pos")],
    [{"rn": f"row_number() {BASE}"}, {"least": roll("min(close)", "close", 6), "most": roll("max(close)", "close", 6), "lo_at": roll("min({'v': close, 'n': -rn})", "close", 6), "hi_at": roll("max({'v': close, 'n': rn})", "close", 6)}, {"both_min": "least", "both_max": "most", "when_least_val": "least", "when_least_pos": "rn + lo_at.n", "when_most_val": "most", "when_most_pos": "rn - hi_at.n", "whens_min_val": "least", "whens_max_pos": "rn - hi_at.n"}], {"when_least_pos": "long", "when_most_pos": "long", "whens_max_pos": "long"})


def _central(x: str, frame: str) -> dict[str, str]:
    return {f"m{k}": f"avg(pow({x}, {k})) {frame}" for k in range(1, 5)}


def _shape(ok: str) -> dict[str, str]:
    c2, c3, c4 = "(m2 - m1 * m1)", "(m3 - 3 * m1 * m2 + 2 * m1 * m1 * m1)", "(m4 - 4 * m1 * m3 + 6 * m1 * m1 * m2 - 3 * pow(m1, 4))"
    skew, kurt = f"CASE WHEN {ok} THEN CASE WHEN v > 1e-9 THEN {c3} / pow({c2}, 1.5) ELSE 0 END END", f"CASE WHEN {ok} THEN CASE WHEN v > 1e-9 THEN {c4} / ({c2} * {c2}) - 3 ELSE 0 END END"
    return {"lopsided_mean": f"CASE WHEN {ok} THEN m1 END", "lopsided_variance": f"CASE WHEN {ok} THEN v END", "lopsided_skew": skew, "tailed_skew": skew, "tailed_kurt": kurt}


ops("rolling_moments", [("lopsided", "RollingSkew", ["close"], {"period": 12}, "mean", "variance", "skew"), ("tailed", "RollingKurt", ["close"], {"period": 12}, "skew", "kurt")],
    [{"rn": f"row_number() {BASE}", **_central("close", w(12)), "v": f"var_pop(close) {w(12)}"}, _shape("rn >= 12")])
ops("rolling_rank", [("mid", "RollingMedian", ["close"], {"period": 8}), ("q", "RollingQuantile", ["close"], {"period": 10, "quantiles": [0.1, 0.5, 1.0]}, "0", "2")],
    [{"mid": roll("median(close)", "close", 8), "l": roll("list(close)", "close", 10)}, {"q_0": "list_sort(l)[2]", "q_2": "list_sort(l)[10]"}])
ops("rolling_variance", [("v", "RollingVar", ["close"], {"period": 10}, "mean", "variance"), ("v1", "RollingVar", ["close"], {"period": 10, "ddof": 1}, "variance"), ("sd", "RollingStddev", ["close"], {"period": 10, "ddof": 1}, "stddev"), ("z", "RollingZScore", ["close"], {"period": 10}, "stddev", "zscore")],
    [{"v_mean": sma("close", 10), "v_variance": roll("var_pop(close)", "close", 10), "v1_variance": roll("var_samp(close)", "close", 10), "sd_stddev": roll("stddev_samp(close)", "close", 10), "z_stddev": roll("stddev_pop(close)", "close", 10)}, {"z_zscore": "CASE WHEN z_stddev = 0 THEN 0 ELSE (close - v_mean) / z_stddev END"}])
ops("rolling_pairs", [("c", "RollingCov", ["open", "close"], {"period": 10}, "meanX", "cov"), ("c1", "RollingCov", ["open", "close"], {"period": 10, "ddof": 1}, "cov"), ("r", "RollingCorr", ["open", "close"], {"period": 10}, "corr"), ("b", "RollingBeta", ["open", "close"], {"period": 10}, "beta")],
    [{"c_meanX": sma("open", 10), "c_cov": roll("covar_pop(open, close)", "close", 10), "c1_cov": roll("covar_samp(open, close)", "close", 10), "vx": roll("var_pop(open)", "open", 10), "vy": roll("var_pop(close)", "close", 10)}, {"r_corr": "CASE WHEN vx * vy = 0 THEN 0 ELSE c_cov / sqrt(vx * vy) END", "b_beta": "CASE WHEN vx <= 0 THEN 0 ELSE c_cov / vx END"}])
_A = "0.15"
ops("rolling_ew", [("v", "RollingVarEW", ["close"], {"alpha": 0.15}, "mean", "variance"), ("sd", "RollingStddevEW", ["close"], {"alpha": 0.15}, "stddev"), ("z", "RollingZScoreEW", ["close"], {"alpha": 0.15}, "zscore"), ("c", "RollingCovEW", ["open", "close"], {"alpha": 0.15}, "cov"), ("r", "RollingCorrEW", ["open", "close"], {"alpha": 0.15}, "corr"), ("b", "RollingBetaEW", ["open", "close"], {"alpha": 0.15}, "beta")],
    [{"rn": f"row_number() {BASE}", "mc": ema("close", _A), "mo": ema("open", _A)}, {"dc": f"coalesce(close - lag(mc) {BASE}, 0)", "do_": f"coalesce(open - lag(mo) {BASE}, 0)"}, {"zc": "0.85::DOUBLE * dc * dc", "zo": "0.85::DOUBLE * do_ * do_", "zx": "0.85::DOUBLE * dc * do_"}, {"sc": ema("zc", _A, "0"), "so": ema("zo", _A, "0"), "sx": ema("zx", _A, "0")},
     {"v_mean": "CASE WHEN rn > 1 THEN mc END", "v_variance": "CASE WHEN rn > 1 THEN sc END", "sd_stddev": "CASE WHEN rn > 1 THEN sqrt(sc) END", "z_zscore": "CASE WHEN rn > 1 THEN CASE WHEN sc = 0 THEN 0 ELSE (close - mc) / sqrt(sc) END END", "c_cov": "CASE WHEN rn > 1 THEN sx END", "r_corr": "CASE WHEN rn > 1 THEN CASE WHEN sc * so = 0 THEN 0 ELSE sx / sqrt(sc * so) END END", "b_beta": "CASE WHEN rn > 1 THEN CASE WHEN so = 0 THEN 0 ELSE sx / so END END"}])

# Online

ops("online_average", [("mean", "CMA", ["close"], {}), ("smooth", "EMA", ["close"], {"period": 12}), ("slow", "EMA", ["close"], {"alpha": 0.03})], [{"mean": f"avg(close) {UPTO}", "smooth": e("close", 12), "slow": ema("close", "0.03")}])
ops("online_metrics", [("ret", "Sub", ["close", "open"], {}), ("down", "RunningDownStats", ["n_ret"], {}, "mean", "stddev"), ("sharpe", "RunningSharpe", ["n_ret"], {}), ("sortino", "RunningSortino", ["n_ret"], {}), ("wins", "RunningWinRate", ["n_ret"], {}), ("payoff", "RunningGainLoss", ["n_ret"], {}), ("expected", "RunningExpectancy", ["n_ret"], {}), ("factor", "RunningProfitFactor", ["n_ret"], {})],
    [{"ret": "close - open"}, {"n": f"count(*) {UPTO}", "m": f"avg(ret) {UPTO}", "sd": f"stddev_samp(ret) {UPTO}", "nl": f"count(*) FILTER (WHERE ret < 0) {UPTO}", "ng": f"count(*) FILTER (WHERE ret > 0) {UPTO}", "sg": f"coalesce(sum(ret) FILTER (WHERE ret > 0) {UPTO}, 0)", "sl": f"coalesce(sum(ret) FILTER (WHERE ret < 0) {UPTO}, 0)", "dm": f"avg(ret) FILTER (WHERE ret < 0) {UPTO}", "ds": f"stddev_samp(ret) FILTER (WHERE ret < 0) {UPTO}"},
     {"down_mean": "CASE WHEN nl >= 2 THEN dm END", "down_stddev": "CASE WHEN nl >= 2 THEN ds END", "sharpe": "CASE WHEN n >= 2 THEN CASE WHEN sd = 0 THEN 0 ELSE m / sd END END", "sortino": "CASE WHEN nl >= 2 THEN CASE WHEN ds = 0 THEN 0 ELSE m / ds END END", "wins": "ng::DOUBLE / n", "payoff": "CASE WHEN nl = 0 THEN 0 WHEN ng = 0 THEN 0 ELSE (sg / ng) / abs(sl / nl) END", "expected": "(sg - abs(sl)) / n", "factor": "CASE WHEN sl = 0 THEN 0 ELSE sg / abs(sl) END"}])
ops("online_moments", [("lopsided", "CuSkew", ["close"], {}, "mean", "variance", "skew"), ("tailed", "CuKurt", ["close"], {}, "skew", "kurt")], [{**_central("close", UPTO), "v": f"var_pop(close) {UPTO}"}, _shape("true")])
ops("online_stats", [("v", "CuVar", ["close"], {}, "mean", "variance"), ("sd", "CuStddev", ["close"], {"ddof": 1}, "stddev"), ("c", "CuCov", ["open", "close"], {"ddof": 1}, "meanY", "cov"), ("r", "CuCorr", ["open", "close"], {}, "corr"), ("b", "CuBeta", ["open", "close"], {}, "beta")],
    [{"rn": f"row_number() {BASE}", "v_mean": f"avg(close) {UPTO}", "v_variance": f"var_pop(close) {UPTO}", "vx": f"var_pop(open) {UPTO}", "cp": f"covar_pop(open, close) {UPTO}"}, {"sd_stddev": f"CASE WHEN rn > 1 THEN sqrt(v_variance * rn / (rn - 1)) END", "c_meanY": "CASE WHEN rn > 1 THEN v_mean END", "c_cov": "CASE WHEN rn > 1 THEN cp * rn / (rn - 1) END", "r_corr": "CASE WHEN vx * v_variance = 0 THEN 0 ELSE cp / sqrt(vx * v_variance) END", "b_beta": "CASE WHEN vx <= 0 THEN 0 ELSE cp / vx END"}])

# Indicators

_TR = {"pc": lag("close")}, {"tr": "CASE WHEN pc IS NULL THEN high - low ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END"}
ops("trend_windows", [("aroon", "AROON", ["high", "low"], {"period": 10}, "up", "down"), ("aroonosc", "AROONOSC", ["high", "low"], {"period": 10}), ("cci", "CCI", HLC, {"period": 10}), ("vhf", "VHF", ["close"], {"period": 10}), ("vi", "VI", HLC, {"period": 10}, "vi_plus", "vi_minus"), ("ichi", "ICHIMOKU", HLC, {"tenkan_period": 3, "kijun_period": 9, "senkou_b_period": 20, "displacement": 9}, "tenkan", "kijun", "senkou_a", "senkou_b", "chikou")],
    [{"rn": f"row_number() {BASE}", "pl": lag("low"), "ph": lag("high"), **_TR[0], "tp": "(high + low + close) / 3", "lc": lag("close", 8)}, {**_TR[1], "hi": roll("max({'v': high, 'n': rn})", "high", 10), "lo": roll("min({'v': low, 'n': -rn})", "low", 10), "tm": sma("tp", 10), "tl": roll("list(tp)", "tp", 10), "ch": "abs(close - pc)", "cl": "CASE WHEN rn > 1 THEN close END", "p": "abs(high - pl)", "m": "abs(low - ph)", "tn": f"(max(high) {w(3)} + min(low) {w(3)}) / 2", "kj": f"(max(high) {w(9)} + min(low) {w(9)}) / 2", "sb": f"(max(high) {w(20)} + min(low) {w(20)}) / 2"},
     {"aroon_up": "100.0::DOUBLE * (10 - (rn - hi.n)) / 10", "aroon_down": "100.0::DOUBLE * (10 - (rn + lo.n)) / 10", "mad": "list_avg(list_transform(tl, lambda v: abs(v - tm)))", "tr1": "CASE WHEN rn > 1 THEN tr END", "vhf": f"CASE WHEN count(ch) {w(10)} = 10 THEN CASE WHEN sum(ch) {w(10)} = 0 THEN 0 ELSE (max(cl) {w(10)} - min(cl) {w(10)}) / sum(ch) {w(10)} END END"},
     {"aroonosc": "aroon_up - aroon_down", "cci": "CASE WHEN mad = 0 THEN 0 ELSE (tp - tm) / (0.015::DOUBLE * mad) END", "st": roll("sum(tr1)", "tr1", 10), "sp": roll("sum(p)", "p", 10), "sm": roll("sum(m)", "m", 10)},
     {"vi_vi_plus": "CASE WHEN st <> 0 THEN sp / st END", "vi_vi_minus": "CASE WHEN st <> 0 THEN sm / st END", "ichi_tenkan": "CASE WHEN rn >= 20 THEN tn END", "ichi_kijun": "CASE WHEN rn >= 20 THEN kj END", "ichi_senkou_a": "CASE WHEN rn >= 20 THEN (tn + kj) / 2 END", "ichi_senkou_b": "CASE WHEN rn >= 20 THEN sb END", "ichi_chikou": "CASE WHEN rn >= 20 THEN coalesce(lc, close) END"}])
ops("trend_directional", [("dm", "DM", ["high", "low"], {"period": 7}, "plus", "minus"), ("di", "DI", HLC, {"period": 7}, "plus", "minus"), ("dx", "DX", HLC, {"period": 7}), ("adx", "ADX", HLC, {"period": 7}), ("adxr", "ADXR", HLC, {"period": 7})],
    [{"rn": f"row_number() {BASE}", **_TR[0], "u": f"high - lag(high) {BASE}", "d": f"lag(low) {BASE} - low"}, {**_TR[1], "p": "CASE WHEN u IS NOT NULL THEN CASE WHEN u > d AND u > 0 THEN u ELSE 0 END END", "m": "CASE WHEN u IS NOT NULL THEN CASE WHEN d > u AND d > 0 THEN d ELSE 0 END END"}, {"dm_plus": wilder("p", 7), "dm_minus": wilder("m", 7), "atr": wilder("tr", 7)}, {"di_plus": "CASE WHEN atr <> 0 THEN 100 * dm_plus / atr END", "di_minus": "CASE WHEN atr <> 0 THEN 100 * dm_minus / atr END"}, {"dx": "CASE WHEN di_plus + di_minus = 0 THEN 0 ELSE 100 * abs(di_plus - di_minus) / (di_plus + di_minus) END"}, {"adx": wilder("dx", 7)}, {"adxr": f"(adx + lag(adx, 6) {BASE}) / 2"}])
ops("trend_sar", [("stop", "SAR", ["high", "low"], {})], None)
#: The stop bar by bar: with the trend's side, its extreme, the pace, and the ranges of two bars before.
ORACLE_SQL["trend_sar"] = f"""WITH RECURSIVE b AS ({BARS_SQL}), r AS (SELECT symbol, ts, high, low, row_number() {BASE} AS n FROM b),
s AS (
  SELECT symbol, ts, n, low AS stop, high AS extreme, 0.02::DOUBLE AS pace, TRUE AS rising, [high] AS highs, [low] AS lows FROM r WHERE n = 1
  UNION ALL
  SELECT symbol, ts, n,
    CASE WHEN turned THEN CASE WHEN rising THEN greatest(extreme, high) ELSE least(extreme, low) END WHEN rising THEN least(moved, list_min(lows)) ELSE greatest(moved, list_max(highs)) END,
    CASE WHEN turned THEN CASE WHEN rising THEN low ELSE high END WHEN rising THEN greatest(extreme, high) ELSE least(extreme, low) END,
    CASE WHEN turned THEN 0.02::DOUBLE WHEN CASE WHEN rising THEN high > extreme ELSE low < extreme END THEN least(pace + 0.02::DOUBLE, 0.2::DOUBLE) ELSE pace END,
    rising <> turned, [highs[-1], high], [lows[-1], low]
  FROM (SELECT *, CASE WHEN rising THEN low < moved ELSE high > moved END AS turned FROM (
    SELECT r.symbol, r.ts, r.n, r.high, r.low, s.extreme, s.pace, s.rising, s.highs, s.lows, s.stop + s.pace * (s.extreme - s.stop) AS moved FROM s JOIN r ON r.symbol = s.symbol AND r.n = s.n + 1)))
SELECT symbol, CAST(epoch(ts) AS BIGINT) AS ts, {shown('stop')} AS stop FROM s"""
ops("momentum_windows", [("bop", "BOP", OHLC, {}), ("mom", "MOM", ["close"], {}), ("roc", "ROC", ["close"], {}), ("rocr", "ROCR", ["close"], {}), ("cmo", "CMO", ["close"], {"period": 10}), ("wad", "WAD", HLC, {}), ("rvi", "RVI", OHLC, {"period": 6}, "rvi", "signal")],
    [{"pc": lag("close"), "c10": lag("close", 10), "c12": lag("close", 12), "a": sma("close - open", 6), "b": sma("high - low", 6)}, {"bop": "CASE WHEN high = low THEN 0 ELSE (close - open) / (high - low) END", "mom": "close - c10", "roc": "CASE WHEN c12 = 0 THEN 0 ELSE 100 * (close - c12) / c12 END", "rocr": "CASE WHEN c12 = 0 THEN 1 ELSE close / c12 END", "up": "greatest(close - pc, 0) + 0 * pc", "dn": "greatest(pc - close, 0) + 0 * pc", "wd": "CASE WHEN close > pc THEN close - least(pc, low) WHEN close < pc THEN close - greatest(pc, high) WHEN pc IS NOT NULL THEN 0 END", "rv": "CASE WHEN b = 0 THEN 0 ELSE a / b END"},
     {"su": roll("sum(up)", "up", 10), "sd": roll("sum(dn)", "dn", 10), "wad": f"CASE WHEN wd IS NOT NULL THEN sum(wd) {UPTO} END", "rvi_signal": sma("rv", 4)}, {"cmo": "CASE WHEN su + sd = 0 THEN 0 ELSE 100 * (su - sd) / (su + sd) END", "rvi_rvi": "CASE WHEN rvi_signal IS NOT NULL THEN rv END"}])
ops("momentum_smoothed", [("rsi", "RSI", ["close"], {}), ("tsi", "TSI", ["close"], {}, "tsi", "signal"), ("power", "BBPOWER", HLC, {}, "bull_power", "bear_power")],
    [{"pc": lag("close"), "em": e("close", 13)}, {"up": "greatest(close - pc, 0) + 0 * pc", "dn": "greatest(pc - close, 0) + 0 * pc", "ch": "close - pc", "ab": "abs(close - pc)"}, {"eu": wilder("up", 14), "ed": wilder("dn", 14), "s1": e("ch", 25), "s2": e("ab", 25)}, {"f1": e("s1", 13), "f2": e("s2", 13)}, {"rsi": "CASE WHEN ed = 0 THEN 100 ELSE 100 - 100 / (1 + eu / ed) END", "tsi_tsi": "CASE WHEN f2 = 0 THEN 0 ELSE 100 * f1 / f2 END", "power_bull_power": "high - em", "power_bear_power": "low - em"}, {"tsi_signal": e("tsi_tsi", 13)}])
ops("oscillator_windows", [("ao", "AO", ["high", "low"], {}), ("dpo", "DPO", ["close"], {}), ("qstick", "QSTICK", ["open", "close"], {}), ("ultosc", "ULTOSC", HLC, {}), ("stoch", "STOCH", HLC, {}, "k", "d"), ("willr", "WILLR", HLC, {})],
    [{"pc": lag("close"), "mid": "(high + low) / 2", "c10": lag("close", 10), "d": "close - open", "hh": roll("max(high)", "high", 14), "ll": roll("min(low)", "low", 14)}, {"ao": f"{sma('mid', 5)} - {sma('mid', 34)}", "dpo": f"c10 - {sma('close', 21)}", "qstick": sma("d", 20), "bp": "close - least(low, pc) + 0 * pc", "tr": "greatest(high, pc) - least(low, pc) + 0 * pc", "raw": "CASE WHEN hh = ll THEN 50 ELSE 100 * (close - ll) / (hh - ll) END", "willr": "CASE WHEN hh = ll THEN 0 ELSE -100 * (hh - close) / (hh - ll) END"},
     {**{f"u{p}": f"CASE WHEN count(bp) {w(p)} = {p} THEN CASE WHEN sum(tr) {w(p)} = 0 THEN 0 ELSE sum(bp) {w(p)} / sum(tr) {w(p)} END END" for p in (7, 14, 28)}, "kk": sma("raw", 3)}, {"ultosc": "100 * (4 * u7 + 2 * u14 + u28) / 7", "stoch_d": sma("kk", 3)}, {"stoch_k": "CASE WHEN stoch_d IS NOT NULL THEN kk END"}])
ops("oscillator_smoothed", [("apo", "APO", ["close"], {}), ("macd", "MACD", ["close"], {}, "macd", "signal", "histogram"), ("ppo", "PPO", ["close"], {}), ("trix", "TRIX", ["close"], {}), ("stochrsi", "STOCHRSI", ["close"], {}), ("fisher", "Fisher", ["high", "low"], {})],
    [{"pc": lag("close"), "f": e("close", 12), "s": e("close", 26), "e1": e("close", 15), "mid": "(high + low) / 2"}, {"apo": "f - s", "macd_macd": "f - s", "ppo": "CASE WHEN s = 0 THEN 0 ELSE 100 * (f - s) / s END", "e2": e("e1", 15), "up": "greatest(close - pc, 0) + 0 * pc", "dn": "greatest(pc - close, 0) + 0 * pc", "hi": roll("max(mid)", "mid", 10), "lo": roll("min(mid)", "mid", 10)}, {"macd_signal": e("macd_macd", 9), "e3": e("e2", 15), "eu": wilder("up", 14), "ed": wilder("dn", 14), "pl": "CASE WHEN hi <> lo THEN 2 * ((mid - lo) / (hi - lo) - 0.5::DOUBLE) END"}, {"macd_histogram": "macd_macd - macd_signal", "p3": lag("e3"), "rs": "CASE WHEN ed = 0 THEN 100 ELSE 100 - 100 / (1 + eu / ed) END", "fv": ema("pl", "0.333", "0")},
     {"trix": "100 * (e3 - p3) / p3", "rs1": "CASE WHEN pc IS NOT NULL THEN rs END", "fc": "greatest(-0.999::DOUBLE, least(0.999::DOUBLE, fv))"}, {"rh": roll("max(rs1)", "rs1", 14), "rl": roll("min(rs1)", "rs1", 14), "fr": "CASE WHEN fv IS NOT NULL THEN 0.5::DOUBLE * ln((1 + fc) / (1 - fc)) END"}, {"stochrsi": "CASE WHEN rh = rl THEN 0 ELSE 100 * (rs1 - rl) / (rh - rl) END", "ff": ema("fr", "0.5", "0")}, {"fisher": f"CASE WHEN hi IS NOT NULL THEN coalesce(last_value(ff IGNORE NULLS) {UPTO}, 0) END"}])
ops("volatility_windows", [("vol", "Volatility", ["close"], {"period": 10}), ("tr", "TR", HLC, {}), ("channel", "PriceChannel", ["high", "low"], {"period": 9}, "upper", "lower"), ("bands", "BBANDS", ["close"], {"period": 10}, "upper", "middle", "lower"), ("kc", "KC", HLC, {"period": 10}, "upper", "lower"), ("dc", "DC", ["high", "low"], {"period": 9}, "middle")],
    [_TR[0], {**_TR[1], "lr": "CASE WHEN close > 0 AND pc > 0 THEN ln(close / pc) END", "channel_upper": roll("max(high)", "high", 9), "channel_lower": roll("min(low)", "low", 9), "bands_middle": sma("close", 10), "sd": roll("stddev_samp(close)", "close", 10)}, {"vol": "CASE WHEN lr IS NOT NULL THEN 100 * sqrt(250 * (" + roll("var_samp(lr)", "lr", 10) + ")) END", "dc_middle": "(channel_upper + channel_lower) / 2", "bands_upper": "bands_middle + 2 * sd", "bands_lower": "bands_middle - 2 * sd", "kc_upper": f"bands_middle + 2 * ({sma('tr', 10)})", "kc_lower": f"bands_middle - 2 * ({sma('tr', 10)})"}])
ops("volatility_smoothed", [("cvi", "CVI", ["high", "low"], {}), ("mass", "MASS", ["high", "low"], {}), ("atr", "ATR", HLC, {}), ("natr", "NATR", HLC, {})],
    [{**_TR[0], "r": "high - low"}, {**_TR[1], "e10": e("r", 10), "e9": e("r", 9)}, {"b": lag("e10", 10), "ee": e("e9", 9), "atr": wilder("tr", 14)}, {"cvi": "CASE WHEN b = 0 THEN 0 ELSE 100 * (e10 - b) / b END", "q": "CASE WHEN ee = 0 THEN 0 ELSE e9 / ee END", "natr": "CASE WHEN close <> 0 THEN 100 * atr / close END"}, {"mass": roll("sum(q)", "q", 25)}])
_FLOW = "CASE WHEN high = low THEN 0 ELSE ((close - low) - (high - close)) / (high - low) * volume END"
ops("volume_windows", [("ad", "AD", HLCV, {}), ("_nvi", "NVI", ["close", "volume"], {}), ("_pvi", "PVI", ["close", "volume"], {}), ("log_nvi", "Log", ["n__nvi"], {}), ("log_pvi", "Log", ["n__pvi"], {}), ("obv", "OBV", ["close", "volume"], {}), ("mfi", "MFI", HLCV, {}), ("_emv", "EMV", ["high", "low", "turnover"], {}), ("_scale", "Const", [], {"value": 1e8}), ("emv", "Div", ["n__emv", "n__scale"], {}), ("mfx", "MarketFI", ["high", "low", "volume"], {}), ("cmf", "CMF", HLCV, {"period": 10}), ("vroc", "VROC", ["turnover"], {}), ("pvt", "PVT", ["close", "volume"], {})],
    [{"pc": lag("close"), "pv": lag("volume"), "t25": lag("turnover", 25), "tp": "(high + low + close) / 3", "fl": _FLOW, "mid": "(high + low) / 2"}, {"pt": lag("tp"), "pm": lag("mid"), "fn": "CASE WHEN volume < pv AND pc <> 0 THEN close / pc ELSE 1 END", "fp": "CASE WHEN volume > pv AND pc <> 0 THEN close / pc ELSE 1 END"}, {"up": "CASE WHEN pt IS NOT NULL THEN CASE WHEN tp >= pt THEN tp * volume ELSE 0 END END", "dn": "CASE WHEN pt IS NOT NULL THEN CASE WHEN tp < pt THEN tp * volume ELSE 0 END END"},
     {"ad": f"sum(fl) {UPTO}", "log_nvi": f"ln(1000 * product(fn) {UPTO})", "log_pvi": f"ln(1000 * product(fp) {UPTO})", "obv": f"sum(coalesce(sign(close - pc) * volume, 0)) {UPTO}", "emv": "CASE WHEN pm IS NOT NULL THEN CASE WHEN turnover = 0 AND high = low THEN 'nan'::DOUBLE WHEN turnover = 0 OR high = low THEN 0 ELSE (mid - pm) / turnover * (high - low) END END", "mfx": "CASE WHEN volume = 0 THEN 0 ELSE (high - low) / volume END", "vroc": "CASE WHEN t25 = 0 THEN 0 ELSE 100 * (turnover - t25) / t25 END", "pvt": f"sum(coalesce(CASE WHEN pc <> 0 THEN (close - pc) / pc * volume END, 0)) {UPTO}", "su": roll("sum(up)", "up", 14), "sd": roll("sum(dn)", "dn", 14), "cf": roll("sum(fl)", "fl", 10), "cv": roll("sum(volume)", "volume", 10)}, {"mfi": "CASE WHEN sd = 0 THEN 100 ELSE 100 - 100 / (1 + su / sd) END", "cmf": "CASE WHEN cv <> 0 THEN cf / cv END"}])
ops("volume_smoothed", [("adosc", "ADOSC", HLCV, {}), ("cho", "CHO", HLCV, {}), ("vosc", "VOSC", ["volume"], {}), ("pvo", "PVO", ["turnover"], {}, "pvo", "signal", "histogram"), ("fi", "FI", ["close", "volume"], {}), ("kvo", "KVO", HLCV, {})],
    [{"pc": lag("close"), "fl": _FLOW, "lev": "high + low + close", "v5": e("volume", 5), "v10": e("volume", 10), "t12": e("turnover", 12), "t26": e("turnover", 26)}, {"line": f"sum(fl) {UPTO}", "vosc": "CASE WHEN v10 = 0 THEN 0 ELSE 100 * (v5 - v10) / v10 END", "pvo_pvo": "CASE WHEN t26 = 0 THEN 0 ELSE 100 * (t12 - t26) / t26 END", "fx": "coalesce((close - pc) * volume, 0)", "tn": f"nullif(sign(lev - lag(lev) {BASE}), 0)"}, {"adosc": f"({e('line', 3)}) - ({e('line', 10)})", "pvo_signal": e("pvo_pvo", 9), "fi": e("fx", 13), "td": f"coalesce(last_value(tn IGNORE NULLS) {UPTO}, 1)"}, {"cho": "adosc", "pvo_histogram": "pvo_pvo - pvo_signal", "fp": f"CASE WHEN td <> lag(td) {BASE} THEN 1 ELSE 0 END"}, {"seg": f"sum(fp) {UPTO}"}, {"cm": "sum(high - low) OVER (PARTITION BY symbol, seg ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"}, {"vf": "CASE WHEN cm > 0 THEN 100 * volume * td * abs(2 * (high - low) / cm - 1) ELSE 0 END"}, {"kvo": f"({e('vf', 34)}) - ({e('vf', 55)})"}])

# Batch series: returns of supplier bars


def returns_of(spark: SparkSession, sf_dir: str) -> Series:
    bars = bars_from_lineitem(spark.read.parquet(f"{sf_dir}/lineitem.parquet")).select("symbol", "ts", "close", "volume")
    made = Series(bars, ("symbol",), "ts", "close").pct_change("ret")
    return Series(made.where(~F.isnan("ret")).withColumn("idx", F.row_number().over(fs.Window.partitionBy("symbol").orderBy("ts")) - 1), ("symbol",), "ts", "ret")


RETURNS_SQL = """SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS idx FROM (
  SELECT symbol, ts, close, volume, (close - lag(close) OVER (PARTITION BY symbol ORDER BY ts)) / lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS ret FROM (
    SELECT CAST(l_suppkey AS VARCHAR) AS symbol, l_shipdate AS ts, sum(l_extendedprice) / sum(l_quantity) AS close, sum(l_quantity) AS volume FROM lineitem WHERE l_quantity <> 0 GROUP BY 1, 2)) WHERE ret IS NOT NULL"""


def _agg(name: str, columns: Callable[[Column, Column, Column], dict[str, Column]], sql: dict[str, str], long: tuple[str, ...] = ()) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(returns_of(spark, sf_dir).df.groupBy("symbol").agg(*[c.alias(a) for a, c in columns(F.col("ret"), F.col("volume"), F.col("idx")).items()]))
    show = lambda a, x: f"CAST({x} AS BIGINT) AS {a}" if a in long else f"{shown(x)} AS {a}"
    ORACLE_SQL[name] = f"WITH r AS ({RETURNS_SQL}) SELECT symbol, {', '.join(show(a, x) for a, x in sql.items())} FROM r GROUP BY symbol"


_agg("series_reduce", lambda R, V, I: {"total": fs.total(R), "least": fs.smallest(R), "most": fs.largest(R), "first_least": fs.argmin(R, I), "first_most": fs.argmax(R, I), "mean": fs.mean(R), "var0": fs.variance(R), "var1": fs.variance(R, 1), "sd1": fs.stddev(R, 1), "skew": fs.skew(R), "kurt": fs.kurt(R), "cov": fs.cov(R, V, 1), "corr": fs.corr(R, V), "median": fs.median(R), "q1": fs.quantile(R, 0.25)},
     {"total": "sum(ret)", "least": "min(ret)", "most": "max(ret)", "first_least": "arg_min(idx, ret)", "first_most": "arg_max(idx, ret)", "mean": "avg(ret)", "var0": "var_pop(ret)", "var1": "var_samp(ret)", "sd1": "stddev_samp(ret)", "skew": "(avg(pow(ret, 3)) - 3 * avg(ret) * avg(ret * ret) + 2 * pow(avg(ret), 3)) / pow(var_pop(ret), 1.5)", "kurt": "kurtosis_pop(ret)", "cov": "covar_samp(ret, volume)", "corr": "corr(ret, volume)", "median": "median(ret)", "q1": "quantile_cont(ret, 0.25)"}, ("first_least", "first_most"))
_agg("series_risk", lambda R, V, I: {"sharpe": fs.sharpe(R), "sortino": fs.sortino(R), "wins": fs.win_rate(R), "payoff": fs.gain_loss(R), "expected": fs.expectancy(R), "factor": fs.profit_factor(R), "cvar": fs.parametric_cvar(R)},
     {"sharpe": "avg(ret) / stddev_samp(ret)", "sortino": "avg(ret) / (stddev_samp(ret) FILTER (WHERE ret < 0))", "wins": "avg(CASE WHEN ret > 0 THEN 1.0::DOUBLE ELSE 0 END)", "payoff": "(avg(ret) FILTER (WHERE ret > 0)) / abs(avg(ret) FILTER (WHERE ret < 0))", "expected": "((sum(ret) FILTER (WHERE ret > 0)) - abs(sum(ret) FILTER (WHERE ret < 0))) / count(*)", "factor": "(sum(ret) FILTER (WHERE ret > 0)) / abs(sum(ret) FILTER (WHERE ret < 0))", "cvar": f"avg(ret) - stddev_samp(ret) * {fs.NormalDist().pdf(fs.NormalDist().inv_cdf(0.05)) / 0.05}::DOUBLE"})


def series_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = returns_of(spark, sf_dir)
    df = s.df
    # those by time first, as the returns are, then those by value: every other order sorts the rows anew
    for make in (Series.sign, Series.coalesce, Series.cumsum, Series.diff, Series.locf):
        df = make(s.on(df))
    df = s.on(df, "close").log_returns()
    df = s.on(s.on(df).lag("lag2", 2)).lead("lead1", 1)
    for make in (Series.argsort, Series.rank, Series.norm, Series.winsorize):
        df = make(s.on(df))
    nulls = [F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in ("diff", "log_returns", "lag2", "lead1")]
    return rounded(df.select("symbol", "ts", "argsort", "rank", "norm", "sign", "cumsum", "winsorize", "locf", "coalesce", *nulls))


QUERIES["series_transform"] = series_transform
_P, _O = "PARTITION BY symbol", "PARTITION BY symbol ORDER BY ts"
ORACLE_SQL["series_transform"] = f"""WITH r AS ({RETURNS_SQL}),
q AS (SELECT symbol, quantile_cont(ret, 0.05) AS lo, quantile_cont(ret, 0.95) AS hi FROM r GROUP BY symbol)
SELECT symbol, CAST(epoch(ts) AS BIGINT) AS ts, row_number() OVER ({_P} ORDER BY ret, ts) - 1 AS argsort,
 round((rank() OVER ({_P} ORDER BY ret) - 1 + (count(*) OVER (PARTITION BY symbol, ret) - 1) / 2.0::DOUBLE) / (count(*) OVER ({_P}) - 1) + {SHIFT}::DOUBLE, {DIGITS}) + 0.0::DOUBLE AS rank,
 round((ret - avg(ret) OVER ({_P})) / stddev_pop(ret) OVER ({_P}) + {SHIFT}::DOUBLE, {DIGITS}) + 0.0::DOUBLE AS norm, sign(ret)::DOUBLE AS sign, round(sum(ret) OVER ({_O}) + {SHIFT}::DOUBLE, {DIGITS}) + 0.0::DOUBLE AS cumsum,
 round(ret - lag(ret) OVER ({_O}) + {SHIFT}::DOUBLE, {DIGITS}) + 0.0::DOUBLE AS diff, round(greatest(lo, least(hi, ret)) + {SHIFT}::DOUBLE, {DIGITS}) + 0.0::DOUBLE AS winsorize, round(ret + {SHIFT}::DOUBLE, {DIGITS}) + 0.0::DOUBLE AS locf, round(ret + {SHIFT}::DOUBLE, {DIGITS}) + 0.0::DOUBLE AS coalesce,
 round(ln(close) - ln(lag(close) OVER ({_O})) + {SHIFT}::DOUBLE, {DIGITS}) + 0.0::DOUBLE AS log_returns, round(lag(ret, 2) OVER ({_O}) + {SHIFT}::DOUBLE, {DIGITS}) + 0.0::DOUBLE AS lag2, round(lead(ret) OVER ({_O}) + {SHIFT}::DOUBLE, {DIGITS}) + 0.0::DOUBLE AS lead1 FROM r JOIN q USING (symbol)"""


def series_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = returns_of(spark, sf_dir)
    return rounded(s.historical_cvar().join(s.exp_weighted_cvar(), "symbol").join(s.spearman("volume"), "symbol").join(s.calmar(250.0), "symbol"))


QUERIES["series_tail"] = series_tail
ORACLE_SQL["series_tail"] = f"""WITH r AS ({RETURNS_SQL}),
a AS (SELECT *, row_number() OVER ({_P} ORDER BY ret, ts) AS rn, count(*) OVER ({_P}) AS n, pow(0.996::DOUBLE, count(*) OVER ({_P}) - 1 - idx) AS w,
  rank() OVER ({_P} ORDER BY ret) + (count(*) OVER (PARTITION BY symbol, ret) - 1) / 2.0::DOUBLE AS rx, rank() OVER ({_P} ORDER BY volume) + (count(*) OVER (PARTITION BY symbol, volume) - 1) / 2.0::DOUBLE AS ry, product(1 + ret) OVER ({_O}) AS g FROM r),
b AS (SELECT *, sum(w * ret) OVER ({_P}) / sum(w) OVER ({_P}) AS wm, greatest(1, max(g) OVER ({_O})) AS p FROM a)
SELECT symbol, round(avg(ret) FILTER (WHERE rn <= ceil(n * 0.05::DOUBLE)) + {SHIFT}::DOUBLE, {DIGITS}) + 0.0::DOUBLE AS historical_cvar,
 round(first(wm) - sqrt(sum(w * (ret - wm) * (ret - wm)) / sum(w)) * {fs.NormalDist().pdf(fs.NormalDist().inv_cdf(0.05)) / 0.05}::DOUBLE + {SHIFT}::DOUBLE, {DIGITS}) + 0.0::DOUBLE AS exp_weighted_cvar,
 round(corr(rx, ry) + {SHIFT}::DOUBLE, {DIGITS}) + 0.0::DOUBLE AS spearman, round(avg(ret) * 250 / max((p - g) / p) + {SHIFT}::DOUBLE, {DIGITS}) + 0.0::DOUBLE AS calmar FROM b GROUP BY symbol"""


def series_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = returns_of(spark, sf_dir)
    s = s.on(s.df, "close")
    out = s.movements(down=(True, False), rel_down=(True, True), up=(False, False), rel_up=(False, True))
    return rounded(out.select("symbol", *[F.col(f"{c}.{f}").alias(f"{c}_{f}") for c in ("down", "rel_down", "up", "rel_up") for f in ("value", "from", "to")]))


QUERIES["series_drawdown"] = series_drawdown
_MOVES = {"down": ("max", "close - e.v"), "rel_down": ("max", "(close - e.v) / e.v"), "up": ("min", "close - e.v"), "rel_up": ("min", "(close - e.v) / e.v")}
ORACLE_SQL["series_drawdown"] = f"WITH r AS ({RETURNS_SQL})" + "".join(
    f", e_{n} AS (SELECT symbol, idx, close, {agg}({{'v': close, 'i': {'-' if agg == 'max' else ''}idx}}) OVER ({_O}) AS e FROM r), m_{n} AS (SELECT symbol, arg_{'min' if agg == 'max' else 'max'}({{'value': {x}, 'from': {'-' if agg == 'max' else ''}e.i, 'to': idx}}, {{'m': {x}, 'i': {'' if agg == 'max' else '-'}idx}}) AS b FROM e_{n} GROUP BY symbol)"
    for n, (agg, x) in _MOVES.items()
) + " SELECT symbol, " + ", ".join(f"round(m_{n}.b['value'] + {SHIFT}::DOUBLE, {DIGITS}) + 0.0::DOUBLE AS {n}_value, CAST(m_{n}.b['from'] AS BIGINT) AS {n}_from, CAST(m_{n}.b['to'] AS BIGINT) AS {n}_to" for n in _MOVES) + " FROM m_down JOIN m_rel_down USING (symbol) JOIN m_up USING (symbol) JOIN m_rel_up USING (symbol)"


def series_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exploded(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), ["vec_id"], "embedding")
    x, i = F.col("value"), F.col("idx")
    return rounded(rows.groupBy("vec_id").agg(fs.mean(x).alias("mean"), fs.stddev(x, 1).alias("sd"), fs.argmax(x, i).alias("top"), fs.median(x).alias("median")))


QUERIES["series_arrays"] = series_arrays
ORACLE_SQL["series_arrays"] = f"WITH r AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) SELECT vec_id, round(avg(x) + {SHIFT}::DOUBLE, {DIGITS}) + 0.0::DOUBLE AS mean, round(stddev_samp(x) + {SHIFT}::DOUBLE, {DIGITS}) + 0.0::DOUBLE AS sd, CAST(arg_max(i, {{'x': x, 'i': -i}}) AS BIGINT) AS top, round(median(x) + {SHIFT}::DOUBLE, {DIGITS}) + 0.0::DOUBLE AS median FROM r GROUP BY vec_id"


def series_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns with every fifth one NaN, carried forward and filled; and the plain returns of the closes."""
    s = returns_of(spark, sf_dir)
    gappy = s.on(s.df.withColumn("gappy", F.when(F.col("idx") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("ret"))), "gappy")
    df = gappy.on(gappy.locf(), "gappy").coalesce(fill=-1.0)
    df = s.on(df, "close").returns()
    nulls = [F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("locf", "returns")]
    return rounded(df.select("symbol", "ts", "coalesce", *nulls))


QUERIES["series_gaps"] = series_gaps
ORACLE_SQL["series_gaps"] = f"""WITH r AS ({RETURNS_SQL}), g AS (SELECT *, CASE WHEN idx % 5 <> 0 THEN ret END AS gappy FROM r),
x AS (SELECT symbol, ts, coalesce(gappy, -1.0::DOUBLE) AS filled, last_value(gappy IGNORE NULLS) OVER ({_O} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS locf, close / lag(close) OVER ({_O}) - 1 AS returns FROM g)
SELECT symbol, CAST(epoch(ts) AS BIGINT) AS ts, {shown('filled')} AS coalesce, {shown('locf')} AS locf, {shown('returns')} AS returns FROM x"""


def execution_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commission and slipped price of line items taken as orders against 5,000 units a day."""
    x = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_quantity <> 0")
    price, side = F.col("l_extendedprice") / F.col("l_quantity"), F.when(F.col("l_returnflag") == "R", F.lit("SELL")).otherwise(F.lit("BUY"))
    costs = Costs(rate=0.0003, per_trade=0.5, minimum=5.0, maximum=12.0, fixed_bps=2.0, market_impact=0.4, max_slip_bps=30.0)
    made = x.select("l_orderkey", "l_linenumber", "l_partkey", commission(price, F.col("l_quantity"), costs).alias("fee"), slipped_price(price, F.col("l_quantity"), F.lit(5000.0), side, costs).alias("price"))
    return rounded(made)


QUERIES["execution_costs"] = execution_costs
ORACLE_SQL["execution_costs"] = f"""WITH x AS (SELECT *, l_extendedprice / l_quantity AS p FROM lineitem WHERE l_quantity <> 0),
y AS (SELECT *, least(12.0::DOUBLE, greatest(5.0::DOUBLE, 0.0003::DOUBLE * l_extendedprice + 0.5::DOUBLE)) AS fee, least(30 / 1e4 * p, 2 / 1e4 * p + l_quantity / 5000 * 0.4::DOUBLE * p) AS slip FROM x),
z AS (SELECT *, CASE WHEN l_returnflag = 'R' THEN p - slip ELSE p + slip END AS price FROM y)
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, {shown('fee')} AS fee, {shown('price')} AS price FROM z"""


def scalar_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_partkey is not null")
    k, s, x = F.col("p_partkey"), F.col("p_size").cast("long"), F.col("p_retailprice") / 1000
    return rounded(p.select("p_partkey", scalars.gcd(k, s).alias("gcd"), scalars.lcm(k, s).alias("lcm"), scalars.midpoint(s, k).alias("mid"), scalars.lerp(x, F.lit(5.0), F.lit(0.25)).alias("lerp"), scalars.remap(x, F.lit(0.0), F.lit(3.0), F.lit(10.0), F.lit(20.0)).alias("remap"), scalars.clamp(x, F.lit(1.0), F.lit(1.5)).alias("clamp"), scalars.normal_pdf(x).alias("pdf")))


QUERIES["scalar_helpers"] = scalar_helpers
ORACLE_SQL["scalar_helpers"] = f"SELECT p_partkey, CAST(gcd(p_partkey, p_size) AS BIGINT) AS gcd, CAST(lcm(p_partkey, p_size) AS BIGINT) AS lcm, CAST(floor((p_partkey + p_size) / 2.0::DOUBLE) AS BIGINT) AS mid, round(x + 0.25::DOUBLE * (5 - x) + {SHIFT}::DOUBLE, {DIGITS}) + 0.0::DOUBLE AS lerp, round(10 + x / 3 * 10 + {SHIFT}::DOUBLE, {DIGITS}) + 0.0::DOUBLE AS remap, round(greatest(1, least(1.5::DOUBLE, x)) + {SHIFT}::DOUBLE, {DIGITS}) + 0.0::DOUBLE AS clamp, round(exp(-x * x / 2) / sqrt(2 * pi()) + {SHIFT}::DOUBLE, {DIGITS}) + 0.0::DOUBLE AS pdf FROM (SELECT *, p_retailprice / 1000 AS x FROM part)"

# Portfolio: scores are the momentum of supplier bars


def scores_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = returns_of(spark, sf_dir)
    return pf.scored(s.df, score="ret")


SCORES_SQL = f"SELECT ts, symbol, ret AS score, row_number() OVER (PARTITION BY ts ORDER BY symbol) - 1 AS u FROM ({RETURNS_SQL})"


def _portfolio(name: str, steps: Callable[[DataFrame], DataFrame], column: str, sql: str | None) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(steps(scores_of(spark, sf_dir)), "ts", "symbol", column)
    if sql:
        ORACLE_SQL[name] = f"WITH s AS ({SCORES_SQL}) " + sql.replace("$", f"SELECT CAST(epoch(ts) AS BIGINT) AS ts, symbol, {shown(column)} AS {column} FROM")


_RANK = "row_number() OVER (PARTITION BY ts ORDER BY score {}, u)"
_portfolio("portfolio_gate", lambda s: pf.filter_gate(s, 0.1), "score", "$ s WHERE score >= 0.1")
_portfolio("portfolio_top", lambda s: pf.filter_top_n(s, 3), "score", f"$ (SELECT *, {_RANK.format('DESC')} AS k FROM s) WHERE k <= 3")
_portfolio("portfolio_bottom", lambda s: pf.filter_bottom_n(s, 2), "score", f"$ (SELECT *, {_RANK.format('ASC')} AS k FROM s) WHERE k <= 2")
_portfolio("portfolio_quantile", lambda s: pf.filter_quantile(s, 0.3), "score", f"$ (SELECT *, {_RANK.format('DESC')} AS k, count(*) OVER (PARTITION BY ts) AS n FROM s) WHERE k <= greatest(1, floor(n * 0.3::DOUBLE + 0.5::DOUBLE))")
_portfolio("portfolio_minmax", pf.norm_min_max, "score", "$ (SELECT ts, symbol, CASE WHEN hi = lo THEN 0.5 ELSE (score - lo) / (hi - lo) END AS score FROM (SELECT *, min(score) OVER (PARTITION BY ts) AS lo, max(score) OVER (PARTITION BY ts) AS hi FROM s))")
_portfolio("portfolio_zscore", pf.norm_z_score, "score", "$ (SELECT ts, symbol, CASE WHEN sd = 0 THEN score ELSE (score - m) / sd END AS score FROM (SELECT *, avg(score) OVER (PARTITION BY ts) AS m, stddev_pop(score) OVER (PARTITION BY ts) AS sd FROM s))")
_portfolio("portfolio_rank", pf.norm_rank, "score", f"$ (SELECT ts, symbol, CASE WHEN n = 1 THEN 0 ELSE (k - 1)::DOUBLE / (n - 1) END AS score FROM (SELECT *, {_RANK.format('ASC')} AS k, count(*) OVER (PARTITION BY ts) AS n FROM s))")
_portfolio("basket_equal", pf.basket_equal, "weight", "$ (SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY ts) AS weight FROM s)")
_portfolio("basket_proportional", lambda s: pf.basket_proportional(pf.filter_gate(s, 0.0)), "weight", "$ (SELECT *, score / sum(score) OVER (PARTITION BY ts) AS weight, sum(score) OVER (PARTITION BY ts) AS t FROM s WHERE score >= 0) WHERE t > 0")
_portfolio("basket_rank", pf.basket_rank, "weight", f"$ (SELECT ts, symbol, (n - k + 1) / (n * (n + 1) / 2.0::DOUBLE) AS weight FROM (SELECT *, {_RANK.format('DESC')} AS k, count(*) OVER (PARTITION BY ts) AS n FROM s))")
_CAP = 0.15
_portfolio("risk_cap_weight", lambda s: pf.cap_weight(pf.basket_proportional(pf.filter_gate(s, 0.0)), _CAP), "weight",
    f""", a AS (SELECT *, score / sum(score) OVER (PARTITION BY ts) AS w FROM s WHERE score >= 0 QUALIFY sum(score) OVER (PARTITION BY ts) > 0),
    b AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY w DESC, u) - 1 AS k, sum(w) OVER (PARTITION BY ts ORDER BY w DESC, u ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, sum(w) OVER (PARTITION BY ts) AS t FROM a),
    c AS (SELECT *, CASE WHEN rest > 0 AND (t - k * {_CAP}) / rest * w <= {_CAP} + 1e-15 THEN k END AS fit FROM b), d AS (SELECT *, min(fit) OVER (PARTITION BY ts) AS f FROM c),
    g AS (SELECT *, max(CASE WHEN k = f THEN (t - k * {_CAP}) / rest END) OVER (PARTITION BY ts) AS scale FROM d)
    $ (SELECT ts, symbol, CASE WHEN f IS NULL THEN CASE WHEN w > 0 THEN {_CAP}::DOUBLE ELSE 0 END ELSE least({_CAP}::DOUBLE, scale * w) END AS weight FROM g)""")  # fmt: skip
_portfolio("risk_limit_deltas", lambda s: pf.limit_deltas(pf.basket_rank(pf.filter_top_n(s, 3)), 0.2), "weight",
    f""", k AS (SELECT ts, symbol, (n - k + 1) / (n * (n + 1) / 2.0::DOUBLE) AS target FROM (SELECT *, count(*) OVER (PARTITION BY ts) AS n FROM (SELECT *, {_RANK.format('DESC')} AS k FROM s) WHERE k <= 3)),
    d AS (SELECT DISTINCT ts FROM k), f AS (SELECT symbol, min(ts) AS first FROM k GROUP BY symbol),
    g AS (SELECT f.symbol, list(d.ts ORDER BY d.ts) AS days, list([coalesce(k.target, 0.0::DOUBLE)] ORDER BY d.ts) AS targets FROM f JOIN d ON d.ts >= f.first LEFT JOIN k ON k.ts = d.ts AND k.symbol = f.symbol GROUP BY f.symbol),
    h AS (SELECT symbol, days, list_reduce(targets, lambda a, x: list_append(a, greatest(0.0::DOUBLE, least(a[-1] + 0.2::DOUBLE, greatest(a[-1] - 0.2::DOUBLE, x[1])))), [0.0::DOUBLE])[2:] AS held FROM g)
    $ (SELECT symbol, unnest(days) AS ts, unnest(held) AS weight FROM h) WHERE weight > 0""")  # fmt: skip
_portfolio("recipe_default", pf.compile_recipe(None), "weight",
    f""", a AS (SELECT *, {_RANK.format('DESC')} AS k FROM s WHERE score >= 0), b AS (SELECT *, count(*) OVER (PARTITION BY ts) AS n FROM a WHERE k <= 20) $ (SELECT ts, symbol, least(0.1::DOUBLE, 1.0::DOUBLE / n) AS weight FROM b)""")

# End to end

MACD_GRAPH = {
    "root": "bar",
    "nodes": [
        {"name": "fast", "type": "EMA", "init": {"period": 12}, "inputs": ["bar.close"]},
        {"name": "slow", "type": "EMA", "init": {"period": 26}, "inputs": ["bar.close"]},
        {"name": "macd", "type": "Sub", "inputs": ["fast", "slow"]},
        {"name": "signal", "type": "EMA", "init": {"period": 9}, "inputs": ["macd"]},
        {"name": "histogram", "type": "Sub", "inputs": ["macd", "signal"]},
    ],
    "output": ["histogram"],
}
MACD_RECIPE = {"scoredTransforms": [{"kind": "filter_gate", "threshold": 0}], "basketCtor": {"kind": "basket_proportional"}}


def macd_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: a graph over hourly bars, gated, weighted in proportion."""
    scores = compile_graph(MACD_GRAPH, event_bars(spark, sf_dir))
    return rounded(pf.compile_recipe(MACD_RECIPE)(pf.scored(scores, score="histogram")), "ts", "symbol", "weight")


QUERIES["macd_weights"] = macd_weights
ORACLE_SQL["macd_weights"] = f"WITH b AS ({BARS_SQL}), m AS (SELECT *, ({e('close', 12)}) - ({e('close', 26)}) AS macd FROM b), g AS (SELECT *, macd - ({e('macd', 9)}) AS h FROM m), k AS (SELECT *, sum(h) OVER (PARTITION BY ts) AS t FROM g WHERE h >= 0) SELECT CAST(epoch(ts) AS BIGINT) AS ts, symbol, round(h / t + {SHIFT}::DOUBLE, {DIGITS}) + 0.0::DOUBLE AS weight FROM k WHERE t > 0"


def macd_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = resample(event_bars(spark, sf_dir), "day")
    ledger = run_backtest(bars, MACD_GRAPH, ["click", "error", "purchase", "signup", "view"], "histogram", MACD_RECIPE, Options(cash=1e6, lot_size=100, costs=Costs(rate=0.0003, minimum=5)))
    return rounded(equity(ledger))


QUERIES["macd_backtest"] = macd_backtest


def bar_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A daily table with factors: date range, universe, factor carried forward, change flags."""
    day = resample(event_bars(spark, sf_dir), "day")
    daily = day.select(F.col("symbol").alias("ts_code"), F.date_format("ts", "yyyyMMdd").alias("trade_date"), "open", "high", "low", "close", F.col("volume").alias("vol"), F.col("turnover").alias("amount"))
    factors = daily.where("pmod(cast(trade_date as int), 7) = 0").select("ts_code", "trade_date", F.col("vol").alias("adj_factor"))
    bars = daily_bars(daily, "20240105", "20240125", universe_frame(spark, ["view", "click"]))
    return rounded(with_adjustment(bars, factors).select("symbol", "ts", "close", "volume", "adj", "adj_changed"))


QUERIES["bar_source"] = bar_source
ORACLE_SQL["bar_source"] = f"""WITH b AS ({BARS_SQL}), d AS (SELECT symbol, date_trunc('day', ts) AS day, arg_max(close, ts) AS close, sum(volume) AS volume FROM b GROUP BY 1, 2),
f AS (SELECT *, CASE WHEN CAST(strftime(day, '%Y%m%d') AS INT) % 7 = 0 THEN volume END AS factor FROM d WHERE symbol IN ('view', 'click') AND strftime(day, '%Y%m%d') BETWEEN '20240105' AND '20240125'),
g AS (SELECT *, last_value(factor IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS adj FROM f)
SELECT symbol, CAST(epoch(day) AS BIGINT) + 34200 AS ts, round(close + {SHIFT}::DOUBLE, {DIGITS}) + 0.0::DOUBLE AS close, round(volume + {SHIFT}::DOUBLE, {DIGITS}) + 0.0::DOUBLE AS volume, round(adj + {SHIFT}::DOUBLE, {DIGITS}) + 0.0::DOUBLE AS adj, adj IS NOT NULL AND adj IS DISTINCT FROM lag(adj) OVER (PARTITION BY symbol ORDER BY day) AS adj_changed FROM g"""


def lineitem_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bars_from_lineitem(spark.read.parquet(f"{sf_dir}/lineitem.parquet")))


QUERIES["lineitem_bars"] = lineitem_bars
ORACLE_SQL["lineitem_bars"] = f"""WITH d AS (SELECT CAST(l_suppkey AS VARCHAR) AS symbol, l_shipdate AS ts, max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low, sum(l_extendedprice) / sum(l_quantity) AS close, sum(l_quantity) AS volume, sum(l_extendedprice) AS turnover FROM lineitem WHERE l_quantity <> 0 GROUP BY 1, 2)
SELECT symbol, CAST(epoch(ts) AS BIGINT) AS ts, round(least(high, greatest(low, coalesce(lag(close) OVER (PARTITION BY symbol ORDER BY ts), close))) + {SHIFT}::DOUBLE, {DIGITS}) + 0.0::DOUBLE AS open, round(high + {SHIFT}::DOUBLE, {DIGITS}) + 0.0::DOUBLE AS high, round(low + {SHIFT}::DOUBLE, {DIGITS}) + 0.0::DOUBLE AS low, round(close + {SHIFT}::DOUBLE, {DIGITS}) + 0.0::DOUBLE AS close, round(volume + {SHIFT}::DOUBLE, {DIGITS}) + 0.0::DOUBLE AS volume, round(turnover + {SHIFT}::DOUBLE, {DIGITS}) + 0.0::DOUBLE AS turnover FROM d"""
