"""Operator specifications, the registry, and the frame that operators are lowered into."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Windows from this length on take blocks instead of a frame that is worked out anew for every row.
LONG_WINDOW = 64
#: Weight below which the start of a block of the recurrence is dropped, and blocks carried over.
BLOCK_WEIGHT, CARRIED = 1e-4, 5


@dataclass(frozen=True)
class OpSpec:
    """One operator. ``lower(frame, inputs, params)`` gives a column, or a dict of named columns.

    ``arity`` None is variadic. ``interior_nulls`` marks operators that can be null after values.
    ``kind`` is stateless, window or scan. An operator with a ``machine`` is no expression: it gives, for
    the parameters, an object whose ``update`` takes the inputs of a bar and returns what the bar gets.
    """

    name: str
    group: str
    arity: int | None
    lower: Callable
    init: dict = field(default_factory=dict)
    outputs: tuple[str, ...] = ()
    kind: str = "window"
    required: tuple[str, ...] = ()
    interior_nulls: bool = False
    doc: str = ""
    machine: Callable[[dict], object] | None = None

    def params(self, init: dict | None) -> dict:
        """Defaults, overridden field by field; missing required fields raise."""
        given = dict(init or {})
        merged = {**self.init, **given}
        missing = [r for r in self.required if all(merged.get(a) is None for a in r.split("|"))]
        if missing:
            raise ValueError(f'Operator "{self.name}" needs init {", ".join(missing)}')
        return merged


def stateful(name: str, make: Callable[..., object], arity: int, outputs: tuple[str, ...] = (), group: str = "own", required: tuple[str, ...] = (), doc: str = "", **init) -> OpSpec:
    """An operator that is a class: ``make`` takes the parameters by name, and the object's ``update`` one
    number per input; it returns a number or None, or a tuple of as many as there are outputs. The class must
    be importable by name in Python workers, or be defined where it is pickled by value, as in a main script."""
    return OpSpec(name, group, arity, None, init, outputs, "scan", required, True, doc, lambda p: make(**p))


class OpRegistry:
    """Operators by name."""

    def __init__(self, specs: list[OpSpec] | None = None):
        self._specs: dict[str, OpSpec] = {}
        self.register_all(specs or [])

    def register(self, spec: OpSpec) -> OpRegistry:
        if not spec.name:
            raise ValueError("Operator has no name")
        if spec.name in self._specs:
            raise ValueError(f'Operator "{spec.name}" is already registered')
        self._specs[spec.name] = spec
        return self

    def register_all(self, specs: list[OpSpec]) -> OpRegistry:
        for spec in specs:
            self.register(spec)
        return self

    def has(self, name: str) -> bool:
        return name in self._specs

    def get(self, name: str) -> OpSpec:
        if name not in self._specs:
            raise KeyError(f'Unknown operator "{name}"')
        return self._specs[name]

    def names(self) -> list[str]:
        return list(self._specs)

    def __len__(self) -> int:
        return len(self._specs)

    def catalog_text(self) -> str:
        """One line per operator: name, init with defaults, inputs, outputs."""
        return "\n".join(f"{s.name}({', '.join(f'{k}={v}' for k, v in s.init.items()) or ', '.join(s.required)}) inputs={'any' if s.arity is None else s.arity} -> {', '.join(s.outputs) or 'value'}" + (f": {s.doc}" if s.doc else "") for s in self._specs.values())


#: Aggregates that can run over all rows so far, by name.
AGGREGATES: dict[str, Callable[..., Column]] = {
    "count": F.count, "sum": F.sum, "avg": F.avg, "var_pop": F.var_pop, "stddev_samp": F.stddev_samp, "skewness": F.skewness, "kurtosis": F.kurtosis,
    "covar_pop": F.covar_pop, "min": F.min, "max": F.max, "product": F.product, "last": lambda x: F.last(x, ignorenulls=True),
}


class Frame:
    """A DataFrame of bars that grows by columns while operators are lowered into it.

    Window functions need plain columns as inputs, so intermediate results are added as columns of
    their own; Catalyst merges windows over the same partitions and order into one sort.

    ``keys`` are the columns that rows are partitioned by, the symbol if nothing else. ``reach`` counts how
    many rows back the windows asked for so far see, one after the other.
    """

    def __init__(self, df: DataFrame, symbol: str = "symbol", ts: str = "ts", keys: tuple[str, ...] = ()):
        self.df, self.symbol, self.ts = df, symbol, ts
        self.keys = keys or (symbol,)
        self.reach = 0
        self._n = 0
        self.valid: Column | None = None
        self._names: dict[str, str] = {}
        #: Statistics of sorted windows by input, period, valid rows and what they are; see ``ordered.slide``.
        self.slid: dict[tuple, Column] = {}
        #: Whether the rows are dealt by the keys, and no window has been added since.
        self.dealt = False

    def add(self, expr: Column) -> Column:
        """The expression as a column of the frame."""
        return self.add_many([expr])[0]

    def add_many(self, exprs: list[Column]) -> list[Column]:
        """The expressions as columns. One that the frame has already, under whichever operator, is the
        column it was then: expressions print in full, and the frame's columns never change."""
        names, new = [], {}
        for expr in exprs:
            text = str(expr)
            if text not in self._names:
                self._n += 1
                name = f"_c{self._n}"
                self._names[text], new[name] = name, expr
                self._names[str(F.col(name))] = name
            names.append(self._names[text])
        if new:
            self.df = self.df.withColumns(new)
        return [F.col(n) for n in names]

    def partition(self) -> list[Column]:
        """Keys of windows: those of the frame, and whether inputs are valid, if some are interior nulls."""
        self.dealt = False
        return [F.col(k) for k in self.keys] + ([self.valid] if self.valid is not None else [])

    def _ordered(self) -> WindowSpec:
        return Window.partitionBy(*self.partition()).orderBy(self.ts)

    def over(self) -> WindowSpec:
        """All rows of the symbol (of those with valid inputs, if some are interior nulls), in time order,
        for looking at the row before."""
        self.reach += 1
        return self._ordered()

    def upto(self) -> WindowSpec:
        return self._ordered().rowsBetween(Window.unboundedPreceding, 0)

    def rows_before(self, n: int) -> WindowSpec:
        """All rows but the last ``n``."""
        return self._ordered().rowsBetween(Window.unboundedPreceding, -int(n))

    def last(self, period: int) -> WindowSpec:
        self.reach += int(period) - 1
        return self._ordered().rowsBetween(-(int(period) - 1), 0)

    def ready(self, x: Column, period: int, value: Column) -> Column:
        """The value where all of the last ``period`` inputs are there."""
        p = int(period)
        if p < LONG_WINDOW:
            return F.when(F.count(x).over(self.last(p)) == p, value)
        self.reach += p
        (seen,) = self.add_many([F.count(x).over(self._ordered().rowsBetween(Window.unboundedPreceding, 0))])
        (earlier,) = self.add_many([F.coalesce(F.lag(seen, p).over(self._ordered()), F.lit(0))])
        return F.when(seen - earlier == p, value)

    def rolling(self, agg: Callable[[Column], Column], x: Column, period: int) -> Column:
        return self.add(self.ready(x, period, agg(x).over(self.last(period))))

    def extreme(self, largest: bool, x: Column, period: int) -> Column:
        """The largest or smallest of the last ``period`` rows, once they are all there.

        In a long window the work a row does not grow with it: rows are cut into blocks of its length, and a
        window is the end of one block and the beginning of the next, whose extremes are running ones."""
        agg, pick, p = (F.max, F.greatest, int(period)) if largest else (F.min, F.least, int(period))
        if p < LONG_WINDOW:
            return self.rolling(agg, x, p)
        self.reach += p
        (x,) = self.add_many([x])
        (row,) = self.add_many([F.row_number().over(self._ordered())])
        (block,) = self.add_many([F.floor((row - 1) / p)])
        inside = Window.partitionBy(*self.partition(), block)
        forth, back = (inside.orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in (F.asc(self.ts), F.desc(self.ts)))
        beginning, end = self.add_many([agg(x).over(forth), agg(x).over(back)])
        (before,) = self.add_many([F.lag(end, p - 1).over(self._ordered())])
        return self.add(self.ready(x, p, pick(beginning, before)))

    def cumulative(self, *requests: tuple) -> list[Column]:
        """(name of an aggregate, its columns) over all rows so far, for each request."""
        return self.add_many([AGGREGATES[kind](*cols).over(self.upto()) for kind, *cols in requests])

    def aggregated(self, *requests: tuple, period: int | None = None) -> list[Column]:
        """The same over the last ``period`` rows, once they all have the first request's first column."""
        if period is None:
            return self.cumulative(*requests)
        first = requests[0][1]
        return self.add_many([self.ready(first, period, AGGREGATES[kind](*cols).over(self.last(period))) for kind, *cols in requests])

    def running(self, kind: str, x: Column) -> Column:
        (made,) = self.cumulative((kind, x))
        return self.add(F.when(x.isNotNull(), made))

    def lag(self, x: Column, k: int = 1) -> Column:
        self.reach += int(k)
        return self.add(F.lag(x, int(k)).over(self._ordered()))

    def row(self, x: Column) -> Column:
        """Number of non-null inputs so far, from 1; null inputs have none. Where a symbol is cut into slices
        it counts from the slice's first row, so only differences and small numbers mean something."""
        return self.add(F.when(x.isNotNull(), F.count(x).over(self._ordered().rowsBetween(Window.unboundedPreceding, 0))))

    def sma(self, x: Column, period: int) -> Column:
        return self.rolling(F.avg, x, period)

    def ema(self, x: Column, alpha: float, seed: Column | None = None, first: Column | None = None) -> Column:
        """y = y + alpha (x - y) over the non-null inputs, starting with the first one (or ``seed``).

        The recurrence is linear, so a value is a weighted sum over the rows up to it. Rows are cut
        into blocks that are short enough for weights relative to the block's start to be exact; a
        block adds what the five blocks before it carry over; what is left out weighs less than 1e-20, so
        values are exact to rounding unless inputs that old were that much larger. All is window sums: no state is kept outside the engine, and no row sees more than its block.
        """
        alpha = float(alpha)
        if alpha >= 1:
            return x
        if not alpha > 0:
            raise ValueError("alpha must be in (0, 1]")
        decay = 1 - alpha
        size = max(2, int(math.log(BLOCK_WEIGHT) / math.log(decay)))
        self.reach += (CARRIED + 1) * size
        n = first if first is not None else self.row(x)
        # Before the first input the value is the seed: that input's share is 1 instead of alpha.
        start = x if seed is None else alpha * x + decay * seed
        share = F.when(n == 1, start).otherwise(alpha * x)
        place, block = self.add_many([(n - 1) % size, F.floor((n - 1) / size)])
        (scaled,) = self.add_many([share * F.pow(F.lit(1 / decay), place)])
        symbol = self.partition()
        inside = Window.partitionBy(*symbol, block).orderBy(self.ts).rowsBetween(Window.unboundedPreceding, 0)
        by_block = Window.partitionBy(*symbol).orderBy(block)
        sums = self.add_many([F.sum(scaled).over(inside), *(F.sum(scaled).over(by_block.rangeBetween(-k, -k)) for k in range(1, CARRIED + 1))])
        # A block of an earlier start has decayed by whole blocks more.
        total = reduce(lambda a, k: a + F.coalesce(sums[k], F.lit(0.0)) * decay ** (size * k), range(1, CARRIED + 1), sums[0])
        return self.add(F.when(x.isNotNull(), total * F.pow(F.lit(decay), place)))


def strict(inputs: list[Column], value: Column) -> Column:
    """Null if any input is null."""
    if not inputs:
        return value
    return F.when(reduce(lambda a, b: a & b, [i.isNotNull() for i in inputs]), value)


def ratio(a: Column, b: Column, zero: float | Column = 0.0) -> Column:
    """a / b, or ``zero`` where b is 0."""
    return F.when(b == 0, zero if isinstance(zero, Column) else F.lit(zero)).otherwise(a / b)


def alpha_of(params: dict) -> float:
    """alpha itself, or 2 / (period + 1)."""
    return float(params["alpha"]) if params.get("alpha") is not None else 2.0 / (float(params["period"]) + 1)


def wilders(period: float) -> float:
    return 1.0 / float(period)


def full_registry() -> OpRegistry:
    """All operators."""
    from quantloom.operators import core, indicators, online, rolling

    return OpRegistry([*core.OPS, *rolling.OPS, *online.OPS, *indicators.OPS])


def compact_registry() -> OpRegistry:
    """Core operators and the averages, deviations and statistics: a small catalogue."""
    from quantloom.operators import core, online, rolling

    groups = {"core", "rolling.average", "rolling.stats", "rolling.deviation", "online.average", "online.stats"}
    return OpRegistry([s for s in [*core.OPS, *rolling.OPS, *online.OPS] if s.group in groups])
