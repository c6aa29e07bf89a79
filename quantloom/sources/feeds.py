"""Bars from a feed that users write, as a Spark data source.

A feed says which symbols and dates it has, and gives the bars of some symbols between two dates. Partitions are
ranges of symbols by ranges of dates, so a large feed is read by all tasks; filters on symbol and ts choose the
partitions before any is read, and bound the dates of those that are. Spark applies the filters again, so a feed may
give more than it is asked for.
"""

from __future__ import annotations

import base64
import datetime as dt
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds

from quantloom.session import ship_package
from quantloom.sources.bars import BAR_SCHEMA

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


class BarFeed:
    """Subclass it; it must be picklable, and open what it reads from in :meth:`bars`."""

    def symbols(self) -> Sequence[str]:
        raise NotImplementedError

    def dates(self) -> tuple[dt.datetime, dt.datetime]:
        """The first moment of the feed and the one after its last."""
        raise NotImplementedError

    def bars(self, symbols: Sequence[str], start: dt.datetime, end: dt.datetime) -> Iterator[tuple]:
        """(symbol, ts, open, high, low, close, volume, turnover) with start <= ts < end."""
        raise NotImplementedError


@dataclass
class _Part(ds.InputPartition):
    symbols: tuple[str, ...]
    start: dt.datetime
    end: dt.datetime


class _Reader(ds.DataSourceReader):
    def __init__(self, feed: BarFeed, symbols: int, days: int):
        self.feed, self.size, self.days = feed, symbols, dt.timedelta(days=days)
        self.only: set[str] | None = None
        self.start, self.end = feed.dates()

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        for f in filters:
            if isinstance(f, (ds.EqualTo, ds.In)) and f.attribute == ("symbol",):
                named = {f.value} if isinstance(f, ds.EqualTo) else set(f.value)
                self.only = named if self.only is None else self.only & named
            elif getattr(f, "attribute", None) == ("ts",) and isinstance(getattr(f, "value", None), dt.datetime):
                at = f.value.replace(tzinfo=None) if f.value.tzinfo is None else f.value.astimezone(dt.timezone.utc).replace(tzinfo=None)
                after = at + dt.timedelta(microseconds=1)
                if isinstance(f, (ds.GreaterThan, ds.GreaterThanOrEqual, ds.EqualTo)):
                    self.start = max(self.start, at)
                if isinstance(f, (ds.LessThan, ds.LessThanOrEqual, ds.EqualTo)):
                    self.end = min(self.end, after)
            yield f  # a bound is not the whole filter: Spark applies it too

    def partitions(self) -> list[ds.InputPartition]:
        names = [s for s in sorted(self.feed.symbols()) if self.only is None or s in self.only]
        out, at = [], self.start
        while at < self.end:
            out += [_Part(tuple(names[i : i + self.size]), at, min(self.end, at + self.days)) for i in range(0, len(names), self.size)]
            at += self.days
        return out or [_Part((), self.start, self.start)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        if partition.symbols:
            yield from self.feed.bars(partition.symbols, partition.start, partition.end)


class BarSource(ds.DataSource):
    """The format ``quantloom_bars``: options ``feed`` (pickled), ``symbols`` and ``days`` of a partition."""

    @classmethod
    def name(cls) -> str:
        return "quantloom_bars"

    def schema(self):
        return BAR_SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(cloudpickle.loads(base64.b64decode(self.options["feed"])), int(self.options["symbols"]), int(self.options["days"]))


def bars_from_feed(spark: SparkSession, feed: BarFeed, symbols: int = 100, days: int = 365) -> DataFrame:
    """The feed's bars, ``symbols`` by ``days`` to a partition. Filters are pushed while the session's
    ``spark.sql.python.filterPushdown.enabled`` is true, which this sets where it is unset."""
    ship_package(spark)
    if spark.conf.get(PUSHDOWN, "false") != "true":
        spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(BarSource)
    pickled = base64.b64encode(cloudpickle.dumps(feed)).decode()
    return spark.read.format("quantloom_bars").option("feed", pickled).option("symbols", str(symbols)).option("days", str(days)).load()
