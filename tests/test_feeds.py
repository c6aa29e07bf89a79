"""A feed of one's own as a data source: what is read, and in how many partitions."""

import datetime as dt
import sys

from pyspark import cloudpickle
from pyspark.sql import functions as F

from quantloom.plans.graph import compile_graph
from quantloom.sources.feeds import BarFeed, bars_from_feed

START = dt.datetime(2024, 1, 1)
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Ramp(BarFeed):
    """A bar a day, whose close is its day's number."""

    def __init__(self, n, days):
        self.n, self.days = n, days

    def symbols(self):
        return [f"s{i:02d}" for i in range(self.n)]

    def dates(self):
        return START, START + dt.timedelta(days=self.days)

    def bars(self, symbols, start, end):
        for s in symbols:
            for d in range(self.days):
                ts = START + dt.timedelta(days=d)
                if start <= ts < end:
                    yield s, ts, float(d), d + 1.0, d - 1.0, float(d), 1.0, float(d)


def partitions(df):
    return df._jdf.queryExecution().toRdd().getNumPartitions()


def test_feed_is_read_whole_and_in_parts(spark):
    bars = bars_from_feed(spark, Ramp(25, 60), symbols=10, days=20)
    assert partitions(bars) == 9 and bars.count() == 1_500 and bars.distinct().count() == 1_500
    one = bars.where(F.col("symbol") == "s07")
    assert partitions(one) == 3 and one.count() == 60
    late = bars.where(F.col("symbol").isin("s01", "s24") & (F.col("ts") >= START + dt.timedelta(days=45)))
    assert partitions(late) < partitions(bars) and late.count() == 30
    day = bars.where(F.col("ts") == START + dt.timedelta(days=3))
    assert partitions(day) == 3 and day.count() == 25
    assert bars.where("symbol = 'none'").count() == 0 and bars.where("close > 57").count() == 50


def test_graph_over_a_feed(spark):
    graph = {"root": "bar", "nodes": [{"name": "m", "type": "SMA", "inputs": ["bar.close"], "init": {"period": 3}}]}
    rows = compile_graph(graph, bars_from_feed(spark, Ramp(3, 9), symbols=2, days=4), outputs=["m"]).where("symbol = 's02'").orderBy("ts").collect()
    assert [r.m for r in rows] == [None, None, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0]
