"""Sources, portfolio steps, backtests, series and streams."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from quantloom.functions import scalars
from quantloom.functions import series as fs
from quantloom.plans import portfolio as pf
from quantloom.plans.backtest import Costs, Options, equity, fills, positions, run_backtest, simulate
from quantloom.sources.bars import adjustment_snapshots, daily_bars, date_text, market_open, random_universe, universe_frame, universe_from_sql, with_adjustment
from quantloom.sources.catalog import describe_table, list_tables, markdown, query_sql
from quantloom.streaming.incremental import bars_from_ticks, running_ema

DAILY = [
    ("000001.SZ", "20100104", 100.0, 102.0, 99.0, 101.0, 1000.0, 101000.0),
    ("000001.SZ", "20100105", 101.0, 103.0, 100.0, 102.0, 1100.0, 112200.0),
    ("000001.SZ", "20100106", 102.0, 104.0, 101.0, 103.0, 1200.0, 123600.0),
    ("600000.SH", "20100104", 200.0, 202.0, 199.0, 201.0, 2000.0, 402000.0),
    ("600000.SH", "20100105", 201.0, 203.0, 200.0, 202.0, 2100.0, 424200.0),
    ("600000.SH", "20100107", 202.0, 204.0, 201.0, 203.0, 2200.0, 446600.0),
]
COLUMNS = "ts_code string, trade_date string, open double, high double, low double, close double, vol double, amount double"
FACTORS = [("000001.SZ", "20100104", 1.0), ("000001.SZ", "20100105", 1.0), ("000001.SZ", "20100106", 1.05), ("600000.SH", "20100104", 1.0), ("600000.SH", "20100105", 1.0), ("600000.SH", "20100107", 1.0)]
CONST = {"root": "bar", "nodes": [{"name": "score", "type": "Const", "init": {"value": 1}}], "output": ["score"]}


def day(n):
    return dt.datetime(2010, 1, n, 9, 30)


@pytest.fixture(scope="module")
def daily(spark):
    return spark.createDataFrame(DAILY, COLUMNS)


def test_daily_bars(spark, daily):
    bars = daily_bars(daily, "20100101", "20101231")
    assert sorted({r.ts for r in bars.collect()}) == [day(4), day(5), day(6), day(7)]
    assert [r.symbol for r in bars.where(F.col("ts") == day(6)).collect()] == ["000001.SZ"]
    one = daily_bars(daily, universe=universe_frame(spark, ["000001.SZ"]))
    assert one.count() == 3 and one.orderBy("ts").first().turnover == 101000.0
    assert daily_bars(daily, universe=universe_frame(spark, [])).count() == 0
    assert daily_bars(daily, "20200101", "20201231").count() == 0


def test_adjustment(spark, daily):
    factors = spark.createDataFrame(FACTORS, "ts_code string, trade_date string, adj_factor double")
    bars = daily_bars(daily)
    got = {}
    for r in adjustment_snapshots(bars, factors).collect():
        got.setdefault(r.ts, {})[r.symbol] = r.adj
    assert got == {day(4): {"000001.SZ": 1.0, "600000.SH": 1.0}, day(6): {"000001.SZ": 1.05, "600000.SH": 1.0}}
    assert with_adjustment(bars, None).where("adj_changed").isEmpty()


def test_dates(spark):
    r = spark.range(1).select(market_open(F.lit("20100104")).alias("a"), market_open(F.lit("2010-01-04"), "yyyy-MM-dd").alias("b"), market_open(F.lit("2025/12/25"), "yyyy/MM/dd", 15, 0).alias("c"), date_text(F.lit(day(4)), "yyyy-MM-dd").alias("d")).first()
    assert (r.a, r.b, r.c, r.d) == (day(4), day(4), dt.datetime(2025, 12, 25, 15), "2010-01-04")


def test_catalog(spark, daily):
    daily.createOrReplaceTempView("daily")
    assert {(r.table, r.rows) for r in list_tables(spark).collect()} >= {("daily", 6)}
    assert describe_table(spark, "daily").first().column == "ts_code"
    with pytest.raises(ValueError, match="Unknown table"):
        describe_table(spark, "nope")
    assert query_sql(spark, "SELECT count(*) AS n FROM daily WHERE close > ?", [150.0]).first().n == 3
    assert markdown(spark.createDataFrame([("a|b", None), ("c", 1), ("d", 2)], "x string, y int"), 2).split("\n") == ["| x | y |", "| --- | --- |", "| a\\|b | NULL |", "| c | 1 |", "... (1 more rows)"]
    assert [r.symbol for r in universe_from_sql(spark, "SELECT DISTINCT ts_code FROM daily WHERE trade_date = ?", "20100107").collect()] == ["600000.SH"]


def flat(spark, days=3, rise=(0, 0)):
    rows = [(s, f"201001{4 + i:02d}", *[p + r * i] * 4, v, 0.0) for s, p, v, r in (("A", 100.0, 1000.0, rise[0]), ("B", 200.0, 2000.0, rise[1])) for i in range(days)]
    return daily_bars(spark.createDataFrame(rows, COLUMNS))


EQUAL = {"scoredTransforms": [], "basketCtor": "basket_equal"}


def test_defaults_and_keys_of_tables(spark, tmp_path):
    spark.sql(f"CREATE TABLE described (a INT DEFAULT 5, b STRING DEFAULT 'x', c DOUBLE) USING parquet LOCATION '{tmp_path}/t' TBLPROPERTIES ('other' = '1', 'primary_key' = 'b, a', 'zone' = 'u')")
    try:
        assert [tuple(r) for r in describe_table(spark, "described").collect()] == [("a", "int", False, "5", 2), ("b", "string", False, "'x'", 1), ("c", "double", False, None, 0)]
    finally:
        spark.sql("DROP TABLE described")
    spark.range(3).createOrReplaceTempView("seen")
    assert [tuple(r) for r in describe_table(spark, "seen").collect()] == [("id", "bigint", True, None, 0)]
    spark.catalog.dropTempView("seen")


def test_backtest_equal_basket(spark):
    ledger = run_backtest(flat(spark), CONST, ["A", "B"], "score", EQUAL, Options(cash=200_000, lot_size=0, threshold=0.05))
    points = equity(ledger).orderBy("ts").collect()
    assert [(p.nav, p.cash) for p in points] == [(200000, 200000), (200000, 0), (200000, 0)]
    assert fills(ledger).count() == 2 and {(p.symbol, p.quant) for p in positions(ledger).collect()} == {("A", 1000), ("B", 500)}


def test_backtest_variants(spark):
    o = Options(cash=100_000, lot_size=0, threshold=0.05)
    one = run_backtest(flat(spark), CONST, ["A"], "score", EQUAL, o)
    assert [(f.symbol, f.quant) for f in fills(one).collect()] == [("A", 1000)]
    by_default = run_backtest(flat(spark), CONST, ["A", "B"], "score", None, Options(cash=200_000, lot_size=0, threshold=0.05))
    assert {(p.symbol, p.quant) for p in positions(by_default).collect()} == {("A", 200), ("B", 100)}
    assert run_backtest(flat(spark), CONST, [], "score", EQUAL, o).count() == 0
    rising = equity(run_backtest(flat(spark, 5, (2, 4)), CONST, ["A", "B"], "score", EQUAL, Options(cash=200_000, lot_size=0, threshold=0.05))).orderBy("ts").collect()
    assert len(rising) == 5 and rising[0].nav == 200_000 and rising[-1].nav > 200_000


def test_backtest_costs_splits_and_missing_bars(spark):
    bars = spark.createDataFrame([("A", day(4), 10.0, 10.0, 100.0, 1.0), ("B", day(4), 5.0, 5.0, 100.0, 1.0), ("A", day(5), 10.0, 10.0, 100.0, 1.0), ("B", day(5), 5.0, 5.0, 100.0, 1.0), ("A", day(6), 5.0, 5.0, 100.0, 2.0), ("A", day(7), 5.0, 5.0, 100.0, 2.0)], "symbol string, ts timestamp, open double, close double, volume double, adj double").withColumn("high", F.col("open")).withColumn("low", F.col("open"))
    weights = spark.createDataFrame([(day(4), "A", 0.5), (day(4), "B", 0.4)], "ts timestamp, symbol string, weight double")
    ledger = simulate(bars, weights, Options(cash=1000, lot_size=1, costs=Costs(per_trade=1)))
    rows = ledger.orderBy("ts").collect()
    assert [r.cash for r in rows] == [1000, 98, 98, 98] and [r.nav for r in rows] == [1000, 998, 998, 998]
    assert {p.symbol: p.quant for p in rows[-1].positions} == {"A": 100, "B": 80} and rows[-1].commission == 2


def scores(spark, rows):
    return spark.createDataFrame([(day(d), s, v, i) for d, s, v, i in rows], "ts timestamp, symbol string, score double, universe_idx int")


def weights_of(df, column="weight"):
    return {(r.ts.day, r.symbol): round(r[column], 10) for r in df.collect()}


def test_steps(spark):
    s = scores(spark, [(4, "a", 3.0, 0), (4, "b", 3.0, 1), (4, "c", 1.0, 2), (4, "d", -1.0, 3), (5, "a", 2.0, 0)])
    assert set(weights_of(pf.filter_top_n(s, 1), "score")) == {(4, "a"), (5, "a")}
    assert set(weights_of(pf.filter_bottom_n(s, 1), "score")) == {(4, "d"), (5, "a")}
    assert set(weights_of(pf.filter_quantile(s, 0.5), "score")) == {(4, "a"), (4, "b"), (5, "a")}
    assert weights_of(pf.norm_min_max(s), "score")[5, "a"] == 0.5 and weights_of(pf.norm_rank(s), "score") == {(4, "d"): 0, (4, "c"): round(1 / 3, 10), (4, "a"): round(2 / 3, 10), (4, "b"): 1, (5, "a"): 0}
    assert weights_of(pf.norm_z_score(s), "score")[5, "a"] == 2.0
    assert weights_of(pf.basket_rank(s))[4, "a"] == 0.4 and weights_of(pf.basket_equal(s))[4, "b"] == 0.25
    assert weights_of(pf.basket_proportional(pf.filter_gate(s, 0)))[4, "c"] == round(1 / 7, 10)
    nothing = scores(spark, [(4, "a", -1.0, 0)])
    assert pf.basket_proportional(nothing).count() == 0


def test_cap_equals_iteration(spark):
    r = random.Random(3)
    cases = [[r.random() ** 3 for _ in range(r.randrange(1, 9))] for _ in range(27)]
    rows = [(1 + i, f"s{j}", w / sum(ws), j) for i, ws in enumerate(cases) for j, w in enumerate(ws)]
    for cap in (0.1, 0.3, 1.0):
        got = weights_of(pf.cap_weight(scores(spark, rows).withColumnRenamed("score", "weight"), cap))
        for i, ws in enumerate(cases):
            w, capped = [x / sum(ws) for x in ws], set()
            while over := [j for j in range(len(w)) if j not in capped and w[j] > cap + 1e-15]:
                excess = sum(w[j] - cap for j in over)
                capped |= set(over)
                for j in over:
                    w[j] = cap
                room = sum(w[j] for j in range(len(w)) if j not in capped)
                for j in range(len(w)):
                    if j not in capped and room > 0:
                        w[j] += excess * w[j] / room
            for j, x in enumerate(w):
                assert got[1 + i, f"s{j}"] == pytest.approx(x, abs=1e-9)


def test_limit_deltas_and_recipes(spark):
    w = scores(spark, [(4, "a", 1.0, 0), (5, "a", 1.0, 0), (6, "b", 1.0, 1), (7, "b", 1.0, 1), (8, "b", 1.0, 1)]).withColumnRenamed("score", "weight")
    assert weights_of(pf.limit_deltas(w, 0.3)) == {(4, "a"): 0.3, (5, "a"): 0.6, (6, "a"): 0.3, (6, "b"): 0.3, (7, "b"): 0.6, (8, "b"): 0.9}
    gaps = scores(spark, [(1, "a", 0.9, 0), (1, "b", 0.1, 1)] + [(d, "b", 1.0, 1) for d in range(2, 12)] + [(12, "a", 0.5, 0)]).withColumnRenamed("score", "weight")
    got = weights_of(pf.limit_deltas(gaps, 0.25))
    assert {k: v for k, v in got.items() if k[1] == "a"} == {(1, "a"): 0.25, (12, "a"): 0.25} and got[11, "b"] == 1.0 and got[12, "b"] == 0.75
    with pytest.raises(ValueError):
        pf.filter_quantile(scores(spark, [(1, "a", 0.9, 0)]), 0.5, "middle")
    assert pf.validate_recipe({"scoredTransforms": [{"kind": "filter_topN", "n": 0}, {"kind": "x"}], "basketCtor": "y", "riskControls": [{"kind": "risk_capWeight", "max": 2}]})
    with pytest.raises(ValueError):
        pf.compile_recipe({"basketCtor": "nope"})
    assert weights_of(pf.compile_recipe(None)(scores(spark, [(4, "a", 1.0, 0), (4, "b", -1.0, 1)]))) == {(4, "a"): 0.1}


def test_series_edges(spark):
    def value(xs, column):
        return spark.createDataFrame([(float(x), i) for i, x in enumerate(xs)], "x double, i int").agg(column.alias("v")).first().v

    x, i = F.col("x"), F.col("i")
    assert value([], fs.total(x)) == 0 and math.isnan(value([], fs.smallest(x))) and value([], fs.argmin(x, i)) == -1
    assert value([2, 1, 1], fs.argmin(x, i)) == 1 and value([1, 3, 3], fs.argmax(x, i)) == 1
    assert math.isnan(value([1], fs.variance(x, 1))) and math.isnan(value([2, 2], fs.skew(x)))
    assert value([], fs.sharpe(x)) == 0 and math.isnan(value([1], fs.sharpe(x))) and value([1, 1], fs.sharpe(x)) == 0
    assert value([1, 2], fs.gain_loss(x)) == 0 and math.isnan(value([-1], fs.gain_loss(x))) and value([1], fs.profit_factor(x)) == 0
    s = fs.Series(spark.createDataFrame([("a", k, float(v)) for k, v in enumerate([0, 5, 4, 6, 3, 7])], "g string, k int, x double"), ("g",), "k", "x")
    assert tuple(s.max_drawdown().first().max_drawdown) == (-3.0, 3, 4) and tuple(s.max_rel_drawdown().first().max_rel_drawdown) == (-0.5, 3, 4)
    assert tuple(s.max_drawup().first().max_drawup) == (7.0, 0, 5)
    ranked = fs.Series(spark.createDataFrame([("a", k, float(v)) for k, v in enumerate([2, 5, 5, 7])], "g string, k int, x double"), ("g",), "k", "x").rank()
    assert [r["rank"] for r in ranked.orderBy("k").collect()] == [0, 0.5, 0.5, 1]


def test_scalars(spark):
    from statistics import NormalDist

    ps = [1e-5, 0.01, 0.3, 0.5, 0.9, 0.999]
    got = spark.createDataFrame([(p,) for p in ps], "p double").select("p", scalars.inv_normal_cdf(F.col("p")).alias("z")).collect()
    assert all(r.z == pytest.approx(NormalDist().inv_cdf(r.p), rel=1e-6, abs=1e-8) for r in got)
    ends = spark.createDataFrame([(0.0,), (1.0,), (-1.0,)], "p double").select(scalars.inv_normal_cdf(F.col("p")).alias("z")).collect()
    assert all(math.isnan(r.z) for r in ends)
    r = spark.range(1).select(scalars.gcd(F.lit(48), F.lit(-18)).alias("g"), scalars.lcm(F.lit(4), F.lit(6)).alias("l"), scalars.lcm(F.lit(0), F.lit(6)).alias("z")).first()
    assert (r.g, r.l, r.z) == (6, 12, 0)


def test_stream_equals_batch(spark, tmp_path):
    rows = [(s, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=7 * i), float((i * 37) % 11), i) for i in range(60) for s in ("a", "b")]
    ticks = spark.createDataFrame(rows, "event_type string, ts timestamp, value double, event_id long")
    ticks.repartition(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(ticks.schema).parquet(f"{tmp_path}/in")
    q = bars_from_ticks(stream).writeStream.format("memory").queryName("made_bars").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    q.awaitTermination(120)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(spark.table("made_bars")) == key(bars_from_ticks(ticks))


def test_running_ema_on_a_stream(spark, tmp_path):
    from quantloom.plans.graph import compile_graph

    rows = [(s, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), float((i * 37) % 11)) for i in range(30) for s in ("a", "b")]
    bars = spark.createDataFrame(rows, "symbol string, ts timestamp, close double")
    bars.coalesce(1).write.parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = running_ema(spark.readStream.schema(bars.schema).parquet(f"{tmp_path}/in"), (0.2,))
    q = stream.writeStream.format("memory").queryName("made_ema").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    q.awaitTermination(120)
    batch = compile_graph({"root": "bar", "nodes": [{"name": "e", "type": "EMA", "init": {"alpha": 0.2}, "inputs": ["bar.close"]}]}, bars, outputs=["e"])
    got = {(r.symbol, r.ts): r.ema0 for r in spark.table("made_ema").collect()}
    assert len(got) == 60 and all(got[r.symbol, r.ts] == pytest.approx(r.e) for r in batch.collect())


def test_random_universe(spark, daily):
    bars = daily_bars(daily)
    assert {r.symbol for r in random_universe(bars, 5).collect()} == {"000001.SZ", "600000.SH"}
    assert random_universe(bars, 1).collect() == random_universe(bars, 1).collect() and random_universe(bars, 2, min_bars=4).count() == 0


def test_written_tables_can_be_cleared(spark):
    from pathlib import Path

    from quantloom.session import clear_written, shared_dir, written

    table = written(spark.range(3).toDF("x"), "numbers")
    assert table.count() == 3
    folder = Path(shared_dir(spark).removeprefix("file://").removeprefix("file:")) / "quantloom" / spark.sparkContext.applicationId
    assert any(p.name.endswith("-numbers") for p in folder.iterdir())
    clear_written(spark)
    assert not folder.exists()


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from quantloom import session

    class Context:
        master, applicationId = "spark://host:7077", "app"
        getConf = staticmethod(lambda: {})
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())
