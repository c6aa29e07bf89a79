"""Order statistics of long sliding windows: all that a graph asks of its bars in one pass.

Rows stream in order of symbol and time, a block of them at a time, whichever symbols they are of. Up to some
hundreds of rows a window costs least as a row of a matrix that is sorted in one go. For longer ones the work does
not grow with the window: a block of a symbol's rows, with the window's length of rows before it, becomes a wavelet matrix: ranks split bit by bit, with prefix counts at each level. The k-th smallest value of
every window of the block is then found at once, one level after the other, for all rows together; prefix sums
give what lies below a bound. Memory is that of a block: at most some windows or a batch of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.operators.spec import Frame
from quantloom.session import ship_package

#: Rows that are worked on together at least, where there are so many.
BLOCK = 16_384
#: The longest windows that are laid side by side, and numbers in such a matrix.
SIDE_BY_SIDE, CELLS = 512, 60_000


class WindowOrder:
    """Values of a block of rows; windows are ranges [lo, hi) of them, given as arrays."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        order = np.argsort(values, kind="stable")
        rank = np.empty(n, "i8")
        rank[order] = np.arange(n)
        self.sorted = values[order]
        self.center = float(np.nanmean(values)) if n and not np.isnan(values).all() else 0.0
        moved = values - self.center
        self.sums = np.concatenate([[0.0], np.cumsum(moved)])
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        for bit in reversed(range(max(1, (n - 1).bit_length()))):
            zero = (rank >> bit) & 1 == 0
            self.levels.append((bit, np.concatenate([[0], np.cumsum(zero)]), np.concatenate([[0.0], np.cumsum(np.where(zero, moved, 0.0))])))
            rank, moved = np.concatenate([rank[zero], rank[~zero]]), np.concatenate([moved[zero], moved[~zero]])

    def kth(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray | int) -> np.ndarray:
        """The k-th smallest value (from 0) of each window; NaN is the largest."""
        k, found = np.broadcast_to(k, lo.shape), np.zeros(lo.shape, "i8")
        for bit, zeros, _ in self.levels:
            lo0, hi0 = zeros[lo], zeros[hi]
            here = k < hi0 - lo0
            found = np.where(here, found, found | (1 << bit))
            k = np.where(here, k, k - (hi0 - lo0))
            lo, hi = np.where(here, lo0, zeros[-1] + lo - lo0), np.where(here, hi0, zeros[-1] + hi - hi0)
        return self.sorted[found]

    def mean(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return (self.sums[hi] - self.sums[lo]) / (hi - lo) + self.center

    def mean_deviation(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Mean distance from the mean: twice what the values below it lack, over their number."""
        n, mean = hi - lo, self.mean(lo, hi)
        limit = np.searchsorted(self.sorted, mean, side="left")
        count, total = np.zeros(lo.shape, "i8"), np.zeros(lo.shape)
        for bit, zeros, sums in self.levels:
            lo0, hi0 = zeros[lo], zeros[hi]
            ones = (limit >> bit) & 1 == 1
            count += np.where(ones, hi0 - lo0, 0)
            total += np.where(ones, sums[hi] - sums[lo], 0.0)
            lo, hi = np.where(ones, zeros[-1] + lo - lo0, lo0), np.where(ones, zeros[-1] + hi - hi0, hi0)
        # limits beyond the highest rank take everything
        whole = limit >= 1 << len(self.levels)
        return np.where(whole, 0.0, np.maximum(0.0, 2 * (count * (mean - self.center) - total) / n))

    def middle(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        n = int(hi[0] - lo[0]) if len(lo) else 1
        high = self.kth(lo, hi, n // 2)
        return high if n % 2 else (self.kth(lo, hi, n // 2 - 1) + high) / 2

    def _deviation(self, lo: np.ndarray, hi: np.ndarray, middle: np.ndarray, k: int) -> np.ndarray:
        """The k-th smallest distance (from 1) from the middle: the k nearest values lie side by side in
        order, and the first of them is found by bisection."""
        n = int(hi[0] - lo[0])
        first, last = np.zeros(lo.shape, "i8"), np.full(lo.shape, n - k)
        ends = lambda i: (middle - self.kth(lo, hi, i), self.kth(lo, hi, i + k - 1) - middle)
        while (first < last).any():
            at = (first + last) // 2
            below, above = ends(at)
            further = below > above
            first, last = np.where(further & (first < last), at + 1, first), np.where(further, last, np.minimum(last, at))
        best = np.maximum(*ends(first))
        return np.where(first > 0, np.minimum(best, np.maximum(*ends(np.maximum(first - 1, 0)))), best)

    def middle_deviation(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Median distance from the median."""
        if not len(lo):
            return np.zeros(0)
        n, middle = int(hi[0] - lo[0]), self.middle(lo, hi)
        high = self._deviation(lo, hi, middle, n // 2 + 1)
        return high if n % 2 else (self._deviation(lo, hi, middle, n // 2) + high) / 2


class Windows:
    """All windows of one length that end at given places of a row of values, one beside the other: a matrix,
    sorted once for all that is asked of it."""

    def __init__(self, values: np.ndarray, ends: np.ndarray, period: int):
        self.period = period
        self.rows = np.lib.stride_tricks.sliding_window_view(values, period)[ends - period]

    @cached_property
    def sorted(self) -> np.ndarray:
        return np.sort(self.rows, axis=1)

    def kth(self, k: int) -> np.ndarray:
        return self.sorted[:, k]

    @cached_property
    def _mean(self) -> np.ndarray:
        return self.rows.mean(axis=1)

    def mean(self) -> np.ndarray:
        return self._mean

    def mean_deviation(self) -> np.ndarray:
        return np.abs(self.rows - self._mean[:, None]).mean(axis=1)

    def _middle(self, ordered: np.ndarray) -> np.ndarray:
        n = self.period
        return ordered[:, n // 2] if n % 2 else (ordered[:, n // 2 - 1] + ordered[:, n // 2]) / 2

    def middle(self) -> np.ndarray:
        return self._middle(self.sorted)

    def middle_deviation(self) -> np.ndarray:
        return self._middle(np.sort(np.abs(self.rows - self.middle()[:, None]), axis=1))

    def newest(self, k: int) -> np.ndarray:
        """How many rows before a window's end the k-th smallest value was last seen."""
        value, back = self.sorted[:, k, None], self.rows[:, ::-1]
        return ((back == value) | (np.isnan(back) & np.isnan(value))).argmax(axis=1).astype("f8")

    def weighted(self, decay: float) -> np.ndarray:
        """Exponential weights, normalised."""
        weights = decay ** np.arange(self.period - 1, -1, -1.0)
        return (self.rows * weights).sum(axis=1) / weights.sum()


def statistics(values: np.ndarray, ends: np.ndarray, period: int, wanted: list[tuple]) -> list[np.ndarray]:
    """An array per wanted (method, its arguments) for the windows that end before ``ends``. Short windows are
    laid side by side some at a time; for long ones the work is that of the wavelet matrix."""
    if period > SIDE_BY_SIDE:
        order = WindowOrder(values)
        return [getattr(order, name)(ends - period, ends, *args) for name, *args in wanted]
    made = [np.empty(len(ends)) for _ in wanted]
    step = max(1, CELLS // period)
    for at in range(0, len(ends), step):
        windows = Windows(values, ends[at : at + step], period)
        for out, (name, *args) in zip(made, wanted):
            out[at : at + step] = getattr(windows, name)(*args)
    return made


class Sliding:
    """The last values of a symbol, and the statistics of every full window as rows of symbols arrive."""

    def __init__(self, period: int, wanted: list[tuple], gaps_reset: bool):
        self.period, self.wanted, self.gaps_reset = period, wanted, gaps_reset
        self.held = np.zeros(0)

    def update(self, values: np.ndarray, missing: np.ndarray, starts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """One array per statistic, and where there is none. ``starts`` marks the first rows of symbols."""
        run = np.cumsum(starts | missing if self.gaps_reset else starts)
        kept = np.flatnonzero(~missing)
        before = len(self.held)
        whole, runs = np.concatenate([self.held, values[kept]]), np.concatenate([np.zeros(before, run.dtype), run[kept]])
        edges = np.flatnonzero(np.diff(runs, prepend=-1))
        since = np.arange(len(whole)) - np.repeat(edges, np.diff(edges, append=len(whole)))
        since[:before] = 0
        ends = np.flatnonzero(since >= self.period - 1) + 1
        ends = ends[ends > before]
        out, none = [np.zeros(len(values)) for _ in self.wanted], np.ones(len(values), bool)
        if len(ends):
            at = kept[ends - 1 - before]
            none[at] = False
            # a wavelet matrix has running sums: each run gets its own, so that none passes on its size or NaN
            parts = [(whole, ends, at)] if self.period <= SIDE_BY_SIDE else [(whole[a:b], ends[(ends > a) & (ends <= b)] - a, at[(ends > a) & (ends <= b)]) for a, b in zip(edges, [*edges[1:], len(whole)]) if b - a >= self.period]
            for values_, ends_, at_ in parts:
                for made, found in zip(out, statistics(values_, ends_, self.period, self.wanted)):
                    made[at_] = found
        self.held = whole[runs == run[-1]][-(self.period - 1) :] if self.period > 1 else np.zeros(0)
        return out, none


def _starts(table: pa.Table, keys: list[int]) -> np.ndarray:
    """Rows whose keys differ from the row before, without the first."""
    differ = np.zeros(max(0, table.num_rows - 1), bool)
    for i in keys:
        column = table.column(i)
        now, before = column.slice(1), column.slice(0, table.num_rows - 1)
        differ |= pc.fill_null(pc.not_equal(now, before), False).to_numpy() | (now.is_null().to_numpy() != before.is_null().to_numpy())
    return differ


def found(frame: Frame, x: Column, period: int, stat: tuple) -> Column | None:
    """A statistic that a pass has brought to the frame already."""
    made = frame.slid.get((str(x), int(period), str(frame.valid), stat))
    if made is not None:
        frame.reach += int(period) - 1
    return made


def sliding(frame: Frame, x: Column, period: int, wanted: list[tuple]) -> list[Column]:
    """The statistics of the last ``period`` inputs, from a pass of their own if none has brought them."""
    (x,) = frame.add_many([x])
    if any((str(x), int(period), str(frame.valid), stat) not in frame.slid for stat in wanted):
        slide(frame, [(x, int(period), wanted)])
    return [found(frame, x, period, stat) for stat in wanted]


def slide(frame: Frame, requests: list[tuple[Column, int, list[tuple]]]) -> None:
    """Adds to the frame what is asked of (input, period, statistics), in one pass. Rows stream in order through
    one task per partition of the frame, block by block, symbols side by side; the other columns pass as they are."""
    values = frame.add_many([x.cast("double") for x, _, _ in requests])
    requests = [(x, period, list(dict.fromkeys(wanted))) for x, period, wanted in requests]
    names = [f"_c{frame._n + i + 1}" for i in range(sum(len(wanted) for _, _, wanted in requests))]
    frame._n += len(names)
    columns, keys = frame.df.columns, list(frame.keys)
    key_at, value_at = ([columns.index(c) for c in frame.df.select(*some).columns] for some in ([F.col(k) for k in keys], values))
    schema = T.StructType([*frame.df.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names)])
    plans, resets, block = [(period, wanted) for _, period, wanted in requests], frame.valid is None, max(BLOCK, *(period for _, period, _ in requests))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states, key, kept, rows = [Sliding(period, wanted, resets) for period, wanted in plans], None, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal key, kept, rows
            table = pa.Table.from_batches(kept).combine_chunks()
            kept, rows = [], 0
            first, last = (tuple(table.column(i)[at].as_py() for i in key_at) for at in (0, table.num_rows - 1))
            starts = np.concatenate([[first != key], _starts(table, key_at)])
            key = last
            arrays = []
            for state, at in zip(states, value_at):
                column = table.column(at)
                out, none = state.update(column.to_numpy().astype("f8"), column.is_null().to_numpy(), starts)
                arrays += [pa.array(made, pa.float64(), mask=none) for made in out]
            for name, array in zip(names, arrays):
                table = table.append_column(name, array)
            yield from table.to_batches()

        for batch in batches:
            if batch.num_rows:
                kept.append(batch)
                rows += batch.num_rows
            if rows >= block:
                yield from flush()
        if kept:
            yield from flush()

    ship_package(frame.df.sparkSession)
    dealt = frame.df if frame.dealt else frame.df.repartition(*keys)
    frame.dealt, frame.df = False, dealt.sortWithinPartitions(*keys, frame.ts).mapInArrow(run, schema)
    frame.slid |= {(str(x), period, str(frame.valid), stat): F.col(c) for (x, period, stat), c in zip(((x, period, stat) for x, period, wanted in requests for stat in wanted), names)}
