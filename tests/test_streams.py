"""Graphs on streams against the batch plan."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quantloom.plans.graph import compile_graph
from quantloom.streaming.graphs import GraphStream, stream_graph

START = dt.datetime(2024, 1, 1)
SCHEMA = "symbol string, ts timestamp, open double, close double, volume double"
NODES = [
    ("sma", "SMA", ["bar.close"], {"period": 4}), ("low", "RollingArgMin", ["sma"], {"period": 3}), ("macd", "MACD", ["bar.close"], {"period_fast": 2, "period_slow": 3, "period_signal": 2}), ("sub", "Sub", ["bar.close", "bar.open"], {}),
    ("cma", "CMA", ["bar.close"], {}), ("kurt", "CuKurt", ["bar.close"], {}), ("corr", "CuCorr", ["bar.open", "bar.close"], {}), ("obv", "OBV", ["bar.close", "bar.volume"], {}), ("win", "RunningWinRate", ["sub"], {}),
]
GRAPH = {"root": "bar", "nodes": [{"name": n, "type": t, "inputs": i, "init": p} for n, t, i, p in NODES]}
OUTPUTS = [n for n, *_ in NODES]


def rows_of(n, seed=2):
    r, rows = random.Random(seed), []
    for s in ("a", "b", "c"):
        price = 20.0
        for i in range(n):
            price += r.choice((-1, -0.5, 0.5, 1))
            if not (s == "c" and 10 < i < 35):  # a symbol that is away for some batches
                rows.append((s, START + dt.timedelta(hours=i), None if r.random() < 0.1 else price - 0.2, price, float(r.randrange(5))))
    return rows


def near(x, y):
    if isinstance(x, dict):
        return all(near(x[k], y[k]) for k in x)
    return abs(x - y) < 1e-9 * max(1.0, abs(x)) if isinstance(x, float) and isinstance(y, float) else x == y


def test_a_stream_in_restarts_equals_the_batch(spark, tmp_path):
    rows, (source, out, check) = rows_of(45), (str(tmp_path / d) for d in ("in", "out", "check"))
    expected = {(r.symbol, r.ts): r.asDict(True) for r in compile_graph(GRAPH, spark.createDataFrame(rows, SCHEMA), outputs=OUTPUTS).collect()}
    sink = lambda df, epoch: df.write.mode("overwrite").parquet(f"{out}/{epoch}")
    for at in range(0, 45, 15):  # three starts of the query
        spark.createDataFrame([r for r in rows if at <= (r[1] - START).total_seconds() / 3600 < at + 15], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        bars = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        stream_graph(GRAPH, bars, sink, check, OUTPUTS).trigger(availableNow=True).start().awaitTermination()
    got = {(r.symbol, r.ts): r.asDict(True) for r in spark.read.parquet(*[str(p) for p in sorted((tmp_path / "out").iterdir())]).collect()}
    assert len(list((tmp_path / "out").iterdir())) == 3 and got.keys() == expected.keys()
    for k, e in expected.items():
        assert all(near(e[o], got[k][o]) for o in OUTPUTS), (k, e, got[k])
    assert {p.name for p in (tmp_path / "check" / "graph").iterdir()} == {"1", "2"}


def test_state_does_not_grow(spark, tmp_path):
    short = {"root": "bar", "nodes": [{"name": "s", "type": "SMA", "inputs": ["bar.close"], "init": {"period": 3}}, {"name": "c", "type": "CMA", "inputs": ["bar.close"]}]}
    stream, rows = GraphStream(short, lambda df, epoch: df.write.format("noop").mode("overwrite").save(), str(tmp_path), ["s", "c"]), rows_of(40)
    for epoch in range(3):
        stream.step(spark.createDataFrame([r for r in rows if epoch * 12 <= (r[1] - START).total_seconds() / 3600 < epoch * 12 + 12], SCHEMA), epoch)
    assert spark.read.parquet(f"{tmp_path}/2/bars").groupBy("symbol").count().agg(F.max("count")).first()[0] < 8
    assert spark.read.parquet(f"{tmp_path}/2/totals1").count() == 3


def test_a_batch_again_gives_the_same_rows_and_late_bars_are_told(spark, tmp_path):
    rows, got, late = rows_of(12), {}, []
    stream = GraphStream(GRAPH, lambda df, epoch: got.setdefault(epoch, []).append(sorted(map(str, df.collect()))), str(tmp_path / "state"), OUTPUTS, late=lambda df, epoch: late.extend(df.collect()))
    parts = [spark.createDataFrame([r for r in rows if (r[1] - START).total_seconds() / 3600 < 6], SCHEMA), spark.createDataFrame([r for r in rows if (r[1] - START).total_seconds() / 3600 >= 6], SCHEMA)]
    stream.step(parts[0], 0)
    stream.step(parts[1], 1)
    stream.step(parts[1], 1)
    assert got[1][0] == got[1][1] and not late
    stream.step(parts[0].where("symbol = 'a'"), 2)
    assert len(late) == 6 and got[2] == [[]]
    with pytest.raises(Exception, match="not after the last one"):
        GraphStream(GRAPH, lambda df, epoch: df.collect(), str(tmp_path / "state"), OUTPUTS).step(parts[0], 2)


def test_stateless_graphs_and_machines_on_streams(spark, tmp_path):
    out = []
    bars = spark.createDataFrame(rows_of(3), SCHEMA)
    GraphStream({"root": "bar", "nodes": [{"name": "s", "type": "Add", "inputs": ["bar.close", "bar.volume"]}]}, lambda df, epoch: out.extend(df.collect()), str(tmp_path), ["s"]).step(bars, 0)
    assert {(r.symbol, r.ts): r.s for r in out} == {(r.symbol, r.ts): r.close + r.volume for r in bars.collect()}
    with pytest.raises(ValueError, match="state machine"):
        GraphStream({"root": "bar", "nodes": [{"name": "s", "type": "SAR", "inputs": ["bar.close", "bar.open"]}]}, lambda df, epoch: None, str(tmp_path), ["s"]).step(bars.where(F.lit(True)), 0)
