"""Operators that are state machines: classes with ``update``, run over each symbol's bars in order.

Register one with :func:`quantloom.operators.spec.stateful`. The parabolic stop is one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.operators.spec import Frame
from quantloom.session import ship_package


class ParabolicStop:
    """Stop-and-reverse of one symbol, a bar at a time. It starts long, at the first low.

    Every bar moves the stop towards the trend's extreme by the acceleration. A bar that crosses it
    turns the trend; otherwise the stop stays outside the ranges of the two bars before.
    """

    def __init__(self, acceleration: float, maximum: float):
        self.step, self.maximum = acceleration, maximum
        self.stop: float | None = None
        self.side, self.pace = 1, acceleration
        self.extreme = 0.0
        self.recent: list[tuple[float, float]] = []

    def update(self, high: float, low: float) -> float:
        if self.stop is None:
            self.stop, self.extreme = low, high
        else:
            moved = self.stop + self.pace * (self.extreme - self.stop)
            ahead, behind = (high, low) if self.side > 0 else (low, high)
            if self.side * (moved - behind) > 0:
                outer = max(self.extreme, high) if self.side > 0 else min(self.extreme, low)
                self.stop, self.extreme, self.pace, self.side = outer, behind, self.step, -self.side
            else:
                if self.side * (ahead - self.extreme) > 0:
                    self.extreme, self.pace = ahead, min(self.pace + self.step, self.maximum)
                self.stop = min(moved, *(low_ for _, low_ in self.recent)) if self.side > 0 else max(moved, *(high_ for high_, _ in self.recent))
        self.recent = [*self.recent[-1:], (high, low)]
        return self.stop


@dataclass(frozen=True)
class Step:
    """A machine in a pass: ``make`` gives a fresh one for a symbol, whose ``update`` takes one number for each
    source and returns one number, or ``width`` of them. A source is ("column", its place among the columns), or
    ("step", which one before it, which of its numbers)."""

    make: Callable[[], object]
    sources: tuple[tuple, ...]
    width: int = 1


def run_steps(frame: Frame, columns: list[Column], steps: list[Step]) -> list[list[Column]]:
    """Adds what machines make to the frame, in one pass. Rows stream in order through one task per partition
    of the frame, a batch at a time, with the machines of one symbol held. A machine sees only rows on which all
    its sources are there; on the others its numbers are null. The other columns pass as they are."""
    values = frame.add_many(columns)
    names = [[f"_c{frame._n + 1 + k + sum(s.width for s in steps[:i])}" for k in range(step.width)] for i, step in enumerate(steps)]
    flat = [n for some in names for n in some]
    frame._n += len(flat)
    keys, here = list(frame.keys), frame.df.columns
    key_at, value_at = [here.index(k) for k in keys], [here.index(c) for c in frame.df.select(*values).columns]
    schema = T.StructType([*frame.df.schema.fields, *(T.StructField(n, T.DoubleType()) for n in flat)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, machines = object(), []
        for batch in batches:
            out: list[list] = [[] for _ in flat]
            keys_of = zip(*(batch.column(i).to_pylist() for i in key_at))
            rows = zip(*(batch.column(i).to_pylist() for i in value_at)) if value_at else ((),) * batch.num_rows
            for k, row in zip(keys_of, rows):
                if k != key:
                    key, machines = k, [s.make() for s in steps]
                made: list[tuple] = []
                for step, machine in zip(steps, machines):
                    given = [row[s[1]] if s[0] == "column" else made[s[1]][s[2]] for s in step.sources]
                    got = (None,) * step.width if None in given else machine.update(*given)
                    made.append(got if isinstance(got, tuple) else (got,))
                for place, x in zip(out, (x for got in made for x in got)):
                    place.append(x)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(o, pa.float64()) for o in out)], names=[*batch.schema.names, *flat])

    ship_package(frame.df.sparkSession)
    frame.df = frame.df.repartition(*keys).sortWithinPartitions(*keys, frame.ts).mapInArrow(run, schema)
    return [[F.col(n) for n in some] for some in names]
