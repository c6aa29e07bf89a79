"""Dated universes and values of weights against brute force."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quantloom import queries_scale
from quantloom.plans import nav
from quantloom.plans.nav import nav_of_weights
from quantloom.sources import universes

START = dt.datetime(2023, 11, 1)


def month(d, k=0):
    n = d.year * 12 + d.month - 1 + k
    return dt.datetime(n // 12, n % 12 + 1, 1)


def test_trailing_members_and_spans_equal_brute_force(spark):
    r = random.Random(4)
    facts = [(f"s{r.randrange(6)}", START + dt.timedelta(days=r.random() * 420), r.random()) for _ in range(220)] + [(None, START, 1.0), ("s1", None, 1.0)]
    df = spark.createDataFrame(facts, "symbol string, ts timestamp, x double")
    members = universes.trailing_members(df, "symbol", "ts", "month", 2, F.count("*") >= 4)
    expected = set()
    for s in {f[0] for f in facts if f[0]}:
        for k in range(-1, 20):
            period = month(START, k)
            if sum(f[0] == s and f[1] is not None and month(period, -2) <= f[1] < period for f in facts) >= 4:
                expected.add((s, period))
    assert expected and {tuple(m) for m in members.collect()} == expected
    got = sorted(tuple(x) for x in universes.spans(members, "month").collect())
    assert {(s, month(a, k)) for s, a, b in got for k in range(24) if month(a, k) < b} == expected
    assert all(s != t or a_end != b for s, _, a_end in got for t, b, _ in got)
    # bars of all times: members at their month, whichever way spans are dealt
    bars = spark.createDataFrame([(f"s{i % 7}", START + dt.timedelta(hours=13 * i)) for i in range(900)], "symbol string, ts timestamp")
    inside = sorted((b.symbol, b.ts) for b in bars.collect() if (b.symbol, month(b.ts)) in expected)
    for unit in ("week", "month", "year"):
        assert sorted(map(tuple, universes.in_universe(bars, universes.spans(members, "month"), unit).collect())) == inside
    with pytest.raises(ValueError):
        universes.in_universe(bars, universes.spans(members, "month"), "hour")


def test_spans_may_overlap_and_end_within_periods(spark):
    spans = spark.createDataFrame([("a", dt.datetime(2024, 1, 3, 5), dt.datetime(2024, 1, 9)), ("a", dt.datetime(2024, 1, 8), dt.datetime(2024, 2, 2)), ("a", dt.datetime(2024, 3, 1), dt.datetime(2024, 3, 1))], "symbol string, since timestamp, until timestamp")
    bars = spark.createDataFrame([("a", START + dt.timedelta(hours=h)) for h in range(24 * 150)], "symbol string, ts timestamp")
    got = universes.in_universe(bars, spans, "day").agg(F.min("ts"), F.max("ts"), F.count("*")).first()
    assert tuple(got) == (dt.datetime(2024, 1, 3, 5), dt.datetime(2024, 2, 1, 23), 24 * 30 - 5)


def plain_nav(weights, bars, rate):
    dates = sorted({b[1] for b in bars})
    price = {(s, t): (o, c) for s, t, o, c in bars}

    def at(symbol, no):
        if no < len(dates) and price.get((symbol, dates[no]), (None,))[0] is not None:
            return price[symbol, dates[no]][0]
        known = [price[symbol, d][1] for d in dates[:no] if (symbol, d) in price]
        return known[-1] if known else None

    turns = [t for t in sorted({w[0] for w in weights}) if t != dates[-1]]
    nav, old, out = 1.0, {}, {}
    for k, t in enumerate(turns):
        later = [x for x in sorted({w[0] for w in weights}) if x > t]
        bought, sold = dates.index(t) + 1, dates.index(later[0]) + 1 if later else len(dates)
        held = {}
        for d, s, w in weights:
            if d == t and at(s, bought) is not None:
                held[s] = held.get(s, 0) + w
        factor = {s: at(s, sold) / at(s, bought) for s in held}
        growth = 1 + sum(w * (factor[s] - 1) for s, w in held.items())
        turnover = sum(abs(held.get(s, 0) - old.get(s, 0)) for s in {*held, *old})
        nav *= (1 - rate * turnover) * growth
        out[t] = (growth, turnover, nav)
        old = {s: w * factor[s] / growth for s, w in held.items()}
    return out


def test_nav_equals_brute_force(spark):
    r = random.Random(6)
    days = [START + dt.timedelta(days=i) for i in range(30)]
    bars = [(f"s{k}", d, 10 + k + r.random(), 10 + k + r.random()) for k in range(6) for d in days if r.random() > 0.25 or d == days[-1]]
    weights = [(d, f"s{k}", round(r.random() / 6, 3)) for d in days[::4] + days[-1:] for k in range(7) if r.random() > 0.3]
    weights.append((days[4], "s1", 0.05))
    made = nav_of_weights(spark.createDataFrame(weights, "ts timestamp, symbol string, weight double"), spark.createDataFrame(bars, "symbol string, ts timestamp, open double, close double"), 0.002)
    expected = plain_nav(weights, bars, 0.002)
    got = {x.ts: tuple(x)[1:] for x in made.collect()}
    assert got.keys() == expected.keys()
    assert all(abs(a - b) < 1e-9 for t in got for a, b in zip(got[t], expected[t]))
    assert nav_of_weights(spark.createDataFrame([], "ts timestamp, symbol string, weight double"), spark.createDataFrame(bars, "symbol string, ts timestamp, open double, close double")).count() == 0


def test_bars_of_the_monthly_baskets_are_made_once(spark, tmp_path):
    """Weights and prices read one table of bars, and not the line items each."""
    items = spark.range(2000).selectExpr("id % 30 as l_suppkey", "timestamp_seconds(86400 * (id % 77)) as l_shipdate", "cast(1 + id % 5 as double) as l_quantity", "rand(5) * 100 as l_extendedprice")
    items.write.parquet(str(tmp_path / "lineitem.parquet"))
    weights, bars = queries_scale.monthly_weights(spark, str(tmp_path))
    assert not [f for f in weights.inputFiles() + bars.inputFiles() if "lineitem" in f]
    assert queries_scale.monthly_nav(spark, str(tmp_path)).count() > 0


def test_prices_are_opens_or_closes_of_dates_before(spark):
    """A missing or empty open takes the close of an earlier date, never that of its own."""
    bars = spark.createDataFrame([("a", 1, 1.0, 2.0), ("a", 3, None, 5.0), ("a", 4, 7.0, None), ("b", 2, 1.5, 1.0), ("c", 1, 9.0, 9.0)], "symbol string, no int, open double, close double")
    points = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("a", 4), ("a", 5), ("a", 5), ("b", 1), ("b", 9), ("d", 1)], "symbol string, no int")
    found = {(r.symbol, r.no): r.price for r in nav._prices(points, bars).collect()}
    assert found == {("a", 1): 1.0, ("a", 2): 2.0, ("a", 3): 2.0, ("a", 4): 7.0, ("a", 5): 5.0, ("b", 1): None, ("b", 9): 1.0, ("d", 1): None}
