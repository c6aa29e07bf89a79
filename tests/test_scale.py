"""Plans for long symbols, long windows, wide dates and large groups against the plain ones and brute force."""

import datetime as dt
import math
import random
import sys
import time

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from quantloom import queries, session
from quantloom.functions import large
from quantloom.functions.series import Series
from quantloom.operators import ordered, rolling, spec
from quantloom.plans import portfolio as pf
from quantloom.plans import slices as slices_module
from quantloom.plans import wide
from quantloom.plans.graph import compile_graph
from quantloom.plans.ranges import first_of_each, placed, with_totals
from quantloom.plans.slices import HALO, SLICE, Slices, cut

START = dt.datetime(2024, 1, 1)
cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import this module


def bars_of(spark, n, symbols=("a", "b"), nulls=0.0, seed=3):
    r, rows = random.Random(seed), []
    for k, s in enumerate(symbols):
        price = 50.0
        for i in range(n + 7 * k):
            price = max(1.0, price + r.choice((-1, -0.5, 0, 0.5, 1)))
            high, low = price + r.random(), price - r.random() / 2
            rows.append((s, START + dt.timedelta(hours=i), None if r.random() < nulls else price - 0.25, high, low, price, float(r.randrange(1, 9)), price * 3))
    return spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, volume double, turnover double")


def values(df):
    return {(r.symbol, r.ts): r.asDict(True) for r in df.collect()}


def near(x, y):
    if isinstance(x, dict):
        return all(near(x[k], y[k]) for k in x)
    if isinstance(x, list):
        return len(x) == len(y) and all(map(near, x, y))
    if isinstance(x, float) and isinstance(y, float):
        return math.isclose(x, y, rel_tol=1e-7, abs_tol=1e-7) or (x != x and y != y)
    return x == y


def graph_of(nodes):
    return {"root": "bar", "nodes": [{"name": n, "type": t, "inputs": i, "init": p} for n, t, i, p in nodes]}, [n for n, *_ in nodes]


def same(a, b, outputs):
    assert a.keys() == b.keys()
    for k in a:
        for o in outputs:
            assert near(a[k][o], b[k][o]), (k, o, a[k][o], b[k][o])


WINDOWS = [
    ("sma", "SMA", ["bar.close"], {"period": 10}), ("low", "RollingArgMin", ["bar.close"], {"period": 6}), ("z", "RollingZScore", ["sma"], {"period": 5}),
    ("ew", "RollingVarEW", ["bar.close"], {"alpha": 0.3}), ("co", "RollingCorrEW", ["bar.open", "bar.close"], {"alpha": 0.4}), ("macd", "MACD", ["bar.close"], {"period_fast": 2, "period_slow": 4, "period_signal": 3}), ("med", "RollingMedian", ["bar.close"], {"period": 9}),
]
TOTALS = [
    ("cma", "CMA", ["bar.close"], {}), ("kurt", "CuKurt", ["bar.close"], {}), ("corr", "CuCorr", ["bar.open", "bar.close"], {}), ("cov", "CuCov", ["bar.open", "bar.close"], {"ddof": 1}),
    ("sub", "Sub", ["bar.close", "bar.open"], {}), ("sortino", "RunningSortino", ["sub"], {"riskfree": 0.2}), ("win", "RunningProfitFactor", ["sub"], {}), ("obv", "OBV", ["bar.close", "bar.volume"], {}),
]


@pytest.mark.parametrize("nodes", [WINDOWS, TOTALS], ids=["windows", "totals"])
def test_slices_equal_the_plain_plan(spark, nodes):
    bars = bars_of(spark, 260, nulls=0.05)
    graph, outputs = graph_of(nodes)
    same(values(compile_graph(graph, bars, outputs=outputs)), values(compile_graph(graph, bars, outputs=outputs, slices=Slices(40, "day"))), outputs)


def test_one_symbol_is_many_slices_with_whole_halos(spark):
    bars = bars_of(spark, 500, ("a",))
    rows = cut(bars, Slices(60, "day"), 100, F.lit(True), "symbol", "ts")
    own = rows.where(~F.col(HALO)).groupBy(SLICE).agg(F.count("*").alias("n"), F.min("ts").alias("first")).collect()
    assert len(own) > 5 and sum(r.n for r in own) == 500 and max(r.n for r in own) < 60 + 24
    halos = {r[SLICE]: (r.n, r.last) for r in rows.where(HALO).groupBy(SLICE).agg(F.count("*").alias("n"), F.max("ts").alias("last")).collect()}
    for r in own:
        before = round((r.first - START).total_seconds() / 3600)
        n, last = halos.get(r[SLICE], (0, None))
        assert min(before, 100) <= n <= 100 + 24 and (not before or last == r.first - dt.timedelta(hours=1))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be put together again
    try:
        assert cut(bars, Slices(60, "day"), 100, F.lit(True), "symbol", "ts").select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert cut(bars.where("false"), Slices(60, "day"), 10, F.lit(True), "symbol", "ts").count() == 0


def test_a_bucket_with_too_many_rows_is_cut(spark, monkeypatch):
    """Days of one row, and one day with a row a second for 10 minutes: no slice has much more rows than asked for,
    values are those of the plain plan, and partitions follow the number of rows."""
    r = random.Random(2)
    at = [START + dt.timedelta(days=d) for d in range(40)] + [START + dt.timedelta(days=20, hours=3, seconds=i) for i in range(600)]
    bars = spark.createDataFrame([(s, t, 5 + r.random(), 5 + r.random()) for s in "ab" for t in at], "symbol string, ts timestamp, open double, close double")
    rows = cut(bars, Slices(70, "day"), 15, F.lit(True), "symbol", "ts")
    own = rows.where(~F.col(HALO)).groupBy("symbol", SLICE).count().collect()
    assert sum(o["count"] for o in own) == 1280 and max(o["count"] for o in own) < 70 + 60
    monkeypatch.setattr(slices_module, "TASK_ROWS", 100)
    dealt, n = slices_module.cut_into(bars, Slices(70, "day"), 15, F.lit(True), "symbol", "ts")
    assert n > 12 and dealt.rdd.getNumPartitions() == n
    graph, outputs = graph_of([("sma", "SMA", ["bar.close"], {"period": 10}), ("cma", "CMA", ["bar.close"], {}), ("co", "CuCov", ["bar.open", "bar.close"], {})])
    same(values(compile_graph(graph, bars, outputs=outputs)), values(compile_graph(graph, bars, outputs=outputs, slices=Slices(70, "day"))), outputs)


def written_by(monkeypatch):
    """(tag, columns, rows) of what the slices write, as they write it."""
    tables, write = [], slices_module.written

    def recorded(df, tag, **how):
        made = write(df, tag, **how)
        tables.append((tag, sorted(made.columns), made.count()))
        return made

    monkeypatch.setattr(slices_module, "written", recorded)
    return tables


def test_scans_of_slices_write_a_row_per_slice(spark, monkeypatch):
    """The bars are written once, with the columns that are read; what windows and scans add to them is not."""
    bars, tables = bars_of(spark, 260, nulls=0.05), written_by(monkeypatch)
    graph, outputs = graph_of([("ew", "RollingVarEW", ["bar.close"], {"alpha": 0.3}), *TOTALS[:4], ("sma", "SMA", ["bar.close"], {"period": 10}), ("cma_sma", "CMA", ["sma"], {}), ("fisher", "Fisher", ["bar.high", "bar.low"], {"period": 5})])
    got = compile_graph(graph, bars, outputs=outputs, slices=Slices(40, "day"))
    assert [(columns, n) for tag, columns, n in tables if n >= 260] == [(["close", "high", "low", "open", "symbol", "ts"], 527)]
    slices = {n for tag, _, n in tables if tag == "carried"}
    assert len(slices) == 1 and max(slices) < 20
    same(values(compile_graph(graph, bars, outputs=outputs)), values(got), outputs)


def test_a_pass_through_arrow_is_written_once_for_all_scans(spark, monkeypatch):
    bars, tables = bars_of(spark, 260), written_by(monkeypatch)
    graph, outputs = graph_of([("median", "RollingMedian", ["bar.close"], {"period": 70}), ("cma", "CMA", ["median"], {}), ("cu", "CuVar", ["median"], {}), ("obv", "OBV", ["bar.close", "bar.volume"], {})])
    got = compile_graph(graph, bars, outputs=outputs, slices=Slices(90, "day"))
    assert [tag for tag, *_ in tables].count("slid") == 1
    same(values(compile_graph(graph, bars, outputs=outputs)), values(got), outputs)


def test_shuffle_files_behind_a_table_go_at_once(spark):
    """Not when the driver happens to collect garbage; the session's setting stays as it was."""
    manager, before = spark._jsc.sc().env().blockManager().diskBlockManager(), spark.conf.get(session.SHUFFLES_GO, "false")

    def kept():
        files = manager.getAllFiles()
        return {name for name in (files.apply(i).getName() for i in range(files.length())) if name.startswith("shuffle_")}

    counts, earlier = bars_of(spark, 260).groupBy("ts").count(), kept()
    table = session.written(counts, "counts", tidy=True)
    until = time.time() + 20
    while kept() - earlier and time.time() < until:
        time.sleep(0.2)
    assert not kept() - earlier and spark.conf.get(session.SHUFFLES_GO, "false") == before
    assert table.count() == counts.count() == 267


def test_few_partitions_of_slices_are_given_too(spark, monkeypatch):
    """Fewer than Spark's setting: left to Spark, they would be put together."""
    monkeypatch.setattr(slices_module, "TASK_ROWS", 600)
    rows, n = slices_module.cut_into(bars_of(spark, 260), Slices(40, "day"), 10, F.lit(True), "symbol", "ts")
    assert n == 4 and rows.rdd.getNumPartitions() == 4


@pytest.mark.parametrize("node", [("x", "SAR", ["bar.high", "bar.low"], {}), ("x", "KVO", ["bar.high", "bar.low", "bar.close", "bar.volume"], {}), ("x", "NVI", ["bar.close", "bar.volume"], {})])
def test_what_slices_do_not_offer_raises(spark, node):
    with pytest.raises(ValueError):
        compile_graph(graph_of([node])[0], bars_of(spark, 30), outputs=["x"], slices=Slices(10, "day"))


def test_gated_inputs_are_not_sliced(spark):
    graph, _ = graph_of([("up", "GT", ["bar.close", "bar.open"], {}), ("g", "Gate", ["up", "bar.close"], {}), ("m", "SMA", ["g"], {"period": 3})])
    with pytest.raises(ValueError, match="null between values"):
        compile_graph(graph, bars_of(spark, 30), outputs=["m"], slices=Slices(10, "day"))


LONG = [
    ("least", "RollingMin", ["bar.close"]), ("most", "RollingMax", ["bar.open"]), ("at", "RollingArgMax", ["bar.close"]), ("ats", "RollingArgMinMax", ["bar.open"]), ("median", "RollingMedian", ["bar.close"]),
    ("even", "RollingMedian", ["bar.open"]), ("iqr", "IQR", ["bar.close"]), ("mean_away", "MeanAbsDeviation", ["bar.close"]), ("median_away", "MedianAbsDeviation", ["bar.open"]), ("ew", "EWMA", ["bar.close"]), ("total", "RollingSum", ["bar.close"]),
]


@pytest.mark.parametrize("period", [7, 20])
def test_long_windows_equal_short_ones(spark, monkeypatch, period):
    """The same graph with every window taken as a long one, over ties, nulls and more than one block."""
    bars = bars_of(spark, 150, ("a", "b", "c"), nulls=0.05)
    graph, outputs = graph_of([(n, t, i, {"period": period + (n == "even")}) for n, t, i in LONG] + [("q", "RollingQuantile", ["bar.close"], {"period": period, "quantiles": [0.1, 0.5, 1.0]})])
    plain = values(compile_graph(graph, bars, outputs=outputs))
    for module in (spec, rolling):
        monkeypatch.setattr(module, "LONG_WINDOW", 2)
    monkeypatch.setattr(ordered, "BLOCK", 32)
    same(plain, values(compile_graph(graph, bars, outputs=outputs)), outputs)


def test_long_windows_of_an_input_take_one_pass(spark, monkeypatch):
    """However many operators ask for sorted windows, rows go to Python once; and those that take the wavelet
    matrix get the same, with a NaN and a value of another size in one symbol only."""
    bars = bars_of(spark, 150, ("a", "b", "c")).withColumn("close", F.when((F.col("symbol") == "b") & (F.hour("ts") == 3), F.lit(1e15)).otherwise(F.col("close")))
    graph, outputs = graph_of([(n, t, ["bar.close"], {"period": 70}) for n, t, _ in LONG if t != "RollingSum"] + [("q", "RollingQuantile", ["bar.close"], {"period": 70, "quantiles": [0.1, 0.9]})])
    made = compile_graph(graph, bars, outputs=outputs)
    assert made._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    side_by_side = values(made)
    monkeypatch.setattr(ordered, "SIDE_BY_SIDE", 60)
    apart = values(compile_graph(graph, bars, outputs=outputs))
    same({k: v for k, v in side_by_side.items() if k[0] != "b"}, {k: v for k, v in apart.items() if k[0] != "b"}, outputs)
    assert {k: v["median"] for k, v in side_by_side.items()} == {k: v["median"] for k, v in apart.items()}
    with_nan = bars.withColumn("close", F.when((F.col("symbol") == "b") & (F.hour("ts") == 3), F.lit(float("nan"))).otherwise(F.col("close")))
    same({k: v for k, v in values(compile_graph(graph, with_nan, outputs=outputs)).items() if k[0] != "b"}, {k: v for k, v in side_by_side.items() if k[0] != "b"}, outputs)


def test_partitions_follow_the_input(spark, tmp_path, monkeypatch):
    """A task's rows do not grow with the files that are read."""
    rows = spark.range(4000).select((F.col("id") % 97).cast("string").alias("symbol"), F.timestamp_seconds(F.col("id")).alias("ts"), F.rand(3).alias("close"))
    rows.write.parquet(str(tmp_path / "bars"))
    bars = spark.read.parquet(str(tmp_path / "bars"))
    assert session.partitions_for(bars) == 4 == session.partitions_for(rows)
    monkeypatch.setattr(session, "DEALT_BYTES", 2000)
    n = session.partitions_for(bars)
    assert n > 10 and session.dealt(bars, "symbol").rdd.getNumPartitions() == n
    graph, outputs = graph_of([("m", "SMA", ["bar.close"], {"period": 3})])
    assert compile_graph(graph, bars, outputs=outputs).rdd.getNumPartitions() == n


def test_series_of_bars_keep_the_partitions_of_the_input(spark, tmp_path, monkeypatch):
    """Bars and the windows over them are one exchange, into as many partitions as the files call for."""
    items = spark.range(3000).selectExpr("id % 40 as l_suppkey", "timestamp_seconds(86400 * (id % 70)) as l_shipdate", "cast(1 + id % 5 as double) as l_quantity", "rand(5) * 100 as l_extendedprice")
    items.write.parquet(str(tmp_path / "lineitem.parquet"))
    monkeypatch.setattr(session, "DEALT_BYTES", 2000)
    made = queries.series_transform(spark, str(tmp_path))
    n = session.partitions_for(spark.read.parquet(str(tmp_path / "lineitem.parquet")))
    assert n > 10 and made.rdd.getNumPartitions() == n and made.count() == made.select("symbol", "ts").distinct().count() == 240


def test_partitions_of_the_input_are_not_put_together(spark, tmp_path, monkeypatch):
    """Also where more shuffle partitions are set than the files call for, Spark does not merge those it is given,
    and the windows of a series sort a task's rows twice: by time and by value."""
    items = spark.range(3000).selectExpr("id % 40 as l_suppkey", "timestamp_seconds(86400 * (id % 70)) as l_shipdate", "cast(1 + id % 5 as double) as l_quantity", "rand(5) * 100 as l_extendedprice")
    items.write.parquet(str(tmp_path / "lineitem.parquet"))
    monkeypatch.setattr(session, "DEALT_BYTES", 2000)
    n, before = session.partitions_for(spark.read.parquet(str(tmp_path / "lineitem.parquet"))), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 500)
    try:
        made = queries.series_transform(spark, str(tmp_path))
        assert 10 < n < 500 and made.rdd.getNumPartitions() == n
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    plan = queries.series_transform(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert sum(line.strip(" +-:").startswith("Sort [") for line in plan.splitlines()) == 2


def test_rank_of_series_with_ties_and_odd_values(spark):
    """Equal values are peers, also nulls, NaN and zeros of both signs."""
    nan = float("nan")
    series = {"a": [3.0, 1.0, 3.0, 3.0, -2.0, 1.0], "b": [0.0, -0.0, 5.0, 0.0], "c": [nan, 1.0, nan, None, None, 2.0], "d": [7.0]}
    frame = spark.createDataFrame([(k, i, v) for k, vs in series.items() for i, v in enumerate(vs)], "k string, i int, x double").repartition(3)
    key = lambda v: (0, 0) if v is None else (2, 0) if v != v else (1, v)
    made = Series(frame, ("k",), "i", "x").rank().collect()
    for row in made:
        others = [key(v) for v in series[row.k]]
        less, same = sum(o < key(row.x) for o in others), sum(o == key(row.x) for o in others)
        assert near(row["rank"], 1.0 if len(others) == 1 else (less + (same - 1) / 2) / (len(others) - 1)), row
    assert len(made) == sum(map(len, series.values()))


def test_spearman_places_distinct_values_only(spark, monkeypatch):
    """Rows with equal values are one row before they are placed; no variance is null."""
    r = random.Random(6)
    pairs = [("a", float(r.randrange(8)), float(r.randrange(5))) for _ in range(900)] + [("b", 1.0, float(i)) for i in range(4)] + [("c", float(i), -float(i)) for i in range(4)]
    df, seen = spark.createDataFrame([(g, x, y, i) for i, (g, x, y) in enumerate(pairs)], "g string, x double, y double, i int"), []
    monkeypatch.setattr(large, "placed", lambda rows, *a, **k: seen.append(rows.count()) or placed(rows, *a, **k))
    found = {q.g: q.spearman for q in large.spearman(df, ["g"], "x", "y", ["i"]).collect()}
    assert len(seen) == 2 and max(seen) <= 8 + 1 + 4 + 4
    plain = {q.g: q.spearman for q in Series(df.where("g = 'a'"), ("g",), "i", "x").spearman("y").collect()}
    assert near(found["a"], plain["a"]) and found["b"] is None and near(found["c"], -1.0)


def test_movements_read_the_rows_once(spark):
    """All four from one scan, equal to brute force over series with zeros in front, ties and none but zeros."""
    r = random.Random(8)
    series = {"a": [0.0, 0.0, *(float(r.randrange(0, 6)) for _ in range(40))], "b": [1.0, 2.0, 3.0], "c": [0.0, 0.0], "d": [-2.0, -1.0, -4.0, -4.0, 0.0, 5.0]}
    frame = spark.createDataFrame([(k, i, v) for k, vs in series.items() for i, v in enumerate(vs)], "k string, i int, x double").repartition(3)
    wanted = {"down": (True, False), "rel_down": (True, True), "up": (False, False), "rel_up": (False, True)}
    made = Series(frame, ("k",), "i", "x").movements(**wanted)
    assert made._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD") == 1
    for row in made.collect():
        for name, (down, relative) in wanted.items():
            best, end = None, None
            first = next((i for i, v in enumerate(series[row.k]) if v != 0), len(series[row.k])) if relative else 0
            for i, v in enumerate(series[row.k][first:], first):
                if end is None or (v > end[0] if down else v < end[0]):
                    end = (v, i)
                move = (v - end[0]) / (end[0] if relative and end[0] != 0 else 1)
                if (move < 0 if down else move > 0) and (best is None or (move < best[0] if down else move > best[0])):
                    best = (move, end[1], i)
            none = first if first < len(series[row.k]) else 0
            assert tuple(row[name]) == (best or (0.0, none, none)), (row.k, name)


def test_window_order_equals_brute_force():
    r = np.random.default_rng(4)
    for n, p, spread in [(1, 1, 3), (64, 5, 4), (200, 31, 1000), (333, 64, 3), (128, 128, 50)]:
        v = r.integers(-spread, spread, n).astype("f8")
        w, hi = ordered.WindowOrder(v), np.arange(p, n + 1)
        frames = [np.sort(v[h - p : h]) for h in hi]
        for k in {0, p // 2, p - 1}:
            assert w.kth(hi - p, hi, k).tolist() == [f[k] for f in frames]
        assert np.allclose(w.mean_deviation(hi - p, hi), [np.abs(f - f.mean()).mean() for f in frames])
        assert np.allclose(w.middle(hi - p, hi), [np.median(f) for f in frames])
        assert np.allclose(w.middle_deviation(hi - p, hi), [np.median(np.abs(f - np.median(f))) for f in frames])


def scores(spark, seed=5, dates=3, symbols=60):
    r = random.Random(seed)
    rows = [(START + dt.timedelta(days=d), f"s{i:03d}", r.choice([round(r.uniform(-1, 3), 1), r.uniform(-1, 3), None if d else 0.5])) for d in range(dates) for i in range(symbols if d < 2 else 1)]
    return spark.createDataFrame(rows, "ts timestamp, symbol string, score double")


STEPS = [
    (lambda m, s: m.filter_top_n(s, 7), "score"), (lambda m, s: m.filter_bottom_n(s, 5), "score"), (lambda m, s: m.filter_quantile(s, 0.3), "score"), (lambda m, s: m.filter_quantile(s, 0.0, "bottom"), "score"),
    (lambda m, s: m.norm_min_max(s, -1.0, 1.0), "score"), (lambda m, s: m.norm_z_score(s), "score"), (lambda m, s: m.norm_rank(s), "score"), (lambda m, s: m.basket_equal(s), "weight"), (lambda m, s: m.basket_proportional(s), "weight"), (lambda m, s: m.basket_rank(s), "weight"),
    (lambda m, s: m.cap_weight(m.basket_proportional(pf.filter_gate(s, 0.0)), 0.03), "weight"), (lambda m, s: m.cap_weight(m.basket_rank(s), 0.001), "weight"), (lambda m, s: m.cap_weight(m.basket_rank(s), 0.5), "weight"),
]


@pytest.mark.parametrize("i", range(len(STEPS)))
def test_wide_steps_equal_plain_ones(spark, i):
    step, column = STEPS[i]
    s = scores(spark)
    plain, many = ({(r.ts, r.symbol): r[column] for r in step(m, m.scored(s)).collect()} for m in (pf, wide))
    assert plain and plain.keys() == many.keys() and all(near(plain[k], many[k]) for k in plain)


def test_wide_steps_have_no_window_over_a_date(spark):
    s = wide.scored(scores(spark))
    for df in (wide.filter_top_n(s, 3), wide.norm_rank(s), wide.cap_weight(wide.basket_equal(s), 0.1)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        windows = [line for line in plan.splitlines() if "Window [" in line and "row_number" in line]
        assert all("_range" in line or "_salt" in line for line in windows)
    assert "row_number" in wide.norm_rank(s)._jdf.queryExecution().executedPlan().toString()
    assert wide.norm_rank(s.where("false")).count() == 0


def test_wide_recipe(spark):
    recipe = {"scoredTransforms": [{"kind": "filter_gate", "threshold": 0}, "norm_rank", {"kind": "filter_topN", "n": 20}], "basketCtor": "basket_rank", "riskControls": [{"kind": "risk_capWeight", "max": 0.08}]}
    plain, many = ({(r.ts, r.symbol): r.weight for r in pf.compile_recipe(recipe, wide=w)(pf.scored(scores(spark))).collect()} for w in (False, True))
    assert plain.keys() == many.keys() and all(near(plain[k], many[k]) for k in plain)


def test_places_and_heads_of_one_group(spark):
    rows = spark.range(1_000).select(F.lit(None).cast("string").alias("g"), F.pmod(F.xxhash64("id"), F.lit(50)).alias("v"), F.col("id").alias("k"))
    got = placed(rows, ["g"], [F.asc("v"), F.asc("k")], {"rest": "v"}, partitions=7).collect()
    expected = sorted((r.v, r.k) for r in rows.collect())
    assert [(r.v, r.k) for r in sorted(got, key=lambda r: r._place)] == expected and {r._count for r in got} == {1_000} and len({r._range for r in got}) > 1
    left = sum(v for v, _ in expected)
    for r in sorted(got, key=lambda r: r._place):
        assert r.rest == left and r.rest_all == sum(v for v, _ in expected)
        left -= r.v
    assert sorted((r.v, r.k) for r in first_of_each(rows, ["g"], [F.asc("v"), F.asc("k")], 9, "k").collect()) == expected[:9]
    assert {r.n for r in with_totals(rows, ["g"], {"n": F.count("*")}, "k").collect()} == {1_000}


def test_large_groups_equal_series(spark):
    r = random.Random(9)
    rows = [(g, i, float(r.randrange(12)) if g != "c" else 1.0, r.uniform(0, 5)) for g, n in (("a", 200), ("b", 33), ("c", 1), ("d", 2)) for i in range(n)]
    df = spark.createDataFrame(rows, "symbol string, ts long, x double, y double")
    s = Series(df, ("symbol",), "ts", "x")
    for made, plain, column in ((large.ranks(df, ["symbol"], "x", ["ts"]), s.rank(), "rank"), (large.winsorized(df, ["symbol"], "x", ["ts"], 0.1, 0.85, "w"), s.winsorize("w", 0.1, 0.85), "w")):
        a, b = ({(q.symbol, q.ts): q[column] for q in d.collect()} for d in (made, plain))
        assert a.keys() == b.keys() and all(near(a[k], b[k]) for k in a)
    cuts = {"low": 0.05, "mid": 0.5, "top": 1.0}
    got = {q.symbol: [q[c] for c in cuts] for q in large.quantiles(df, ["symbol"], "y", ["ts"], cuts).collect()}
    for q in df.groupBy("symbol").agg(*[F.percentile("y", F.lit(v)).alias(c) for c, v in cuts.items()]).collect():
        assert near([q[c] for c in cuts], got[q.symbol])
    a, b = ({q.symbol: q.spearman for q in d.collect()} for d in (large.spearman(df, ["symbol"], "x", "y", ["ts"]), s.spearman("y")))
    assert near(a["a"], b["a"]) and near(a["b"], b["b"])


def test_large_groups_with_missing_values(spark):
    df = spark.createDataFrame([("a", 1, 3.0), ("a", 2, None), ("a", 3, float("nan")), (None, 1, 2.0), (None, 2, 4.0)], "symbol string, ts long, x double")
    got = {(r.symbol, r.ts): r["rank"] for r in large.ranks(df, ["symbol"], "x", ["ts"]).collect()}
    assert got == {("a", 1): 1.0, ("a", 2): None, ("a", 3): None, (None, 1): 0.0, (None, 2): 1.0}
    assert {r.symbol: r.m for r in large.quantiles(df, ["symbol"], "x", ["ts"], {"m": 0.5}).collect()} == {"a": 3.0, None: 3.0}
    assert large.winsorized(df.where("false"), ["symbol"], "x", ["ts"]).count() == 0


class Crossings:
    """How often two numbers have changed their order, and the last distance."""

    def __init__(self, step):
        self.step, self.above, self.n = step, None, 0

    def update(self, a, b):
        above = a > b
        self.n += self.step * (self.above is not None and above != self.above)
        self.above = above
        return float(self.n), a - b


class Peak:
    """The highest so far."""

    def __init__(self):
        self.best = -math.inf

    def update(self, x):
        self.best = max(self.best, x)
        return self.best


def test_class_operators_equal_their_window_twins(spark):
    """Three classes in one pass, one of them fed by another, between windows before and after."""
    registry = spec.full_registry().register(spec.stateful("Crossings", Crossings, 2, ("n", "apart"), step=1)).register(spec.stateful("Peak", Peak, 1))
    bars = bars_of(spark, 120, ("a", "b", "c"), nulls=0.1)
    graph, outputs = graph_of([
        ("fast", "SMA", ["bar.close"], {"period": 3}), ("x", "Crossings", ["fast", "bar.open"], {}), ("peak", "Peak", ["x.apart"], {}), ("top", "Peak", ["bar.high"], {}), ("stop", "SAR", ["bar.high", "bar.low"], {}),
        ("sub", "Sub", ["fast", "bar.open"], {}), ("after", "RollingMax", ["peak"], {"period": 4}), ("cma", "CMA", ["top"], {}),
    ])
    df = compile_graph(graph, bars, registry, outputs=outputs)
    assert df._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 2  # the stop and the top, which read bars only, and the two that wait for the average
    got = values(df)
    for symbol in ("a", "b", "c"):
        rows = sorted((r for r in bars.where(F.col("symbol") == symbol).collect()), key=lambda r: r.ts)
        n, above, peak, top = 0, None, -math.inf, -math.inf
        for r in rows:
            made = got[symbol, r.ts]
            top = max(top, r.high)
            assert made["top"] == top
            if made["sub"] is None:
                assert made["x"] == {"n": None, "apart": None} and made["peak"] is None
                continue
            n += above is not None and (made["sub"] > 0) != above
            above, peak = made["sub"] > 0, max(peak, made["sub"])
            assert made["x"]["n"] == n and near(made["x"]["apart"], made["sub"]) and near(made["peak"], peak)


def test_undefined_fields_of_class_operators_raise(spark):
    registry = spec.full_registry().register(spec.stateful("Crossings", Crossings, 2, ("n", "apart"), step=1)).register(spec.stateful("Peak", Peak, 1))
    for path in ("x", "x.none"):
        graph, _ = graph_of([("x", "Crossings", ["bar.close", "bar.open"], {}), ("y", "Peak", [path], {})])
        with pytest.raises(ValueError, match="undefined"):
            compile_graph(graph, bars_of(spark, 5), registry, outputs=["y"])
