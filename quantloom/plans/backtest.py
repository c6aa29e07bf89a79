"""Backtests: baskets turned into orders, fills, positions and equity.

Scores and baskets are distributed plans. Cash couples all symbols from date to date, so the ledger is
sequential: each run is one ordered stream of dates, a row per date with its bars and its basket, and
runs (a parameter sweep, say) are independent of each other. The ledger keeps holdings and open orders
only, never the history.

A basket made at the close of a date becomes market orders that are filled at the next open of their
symbol, sales first. Buys beyond the free cash at the time of the order are rejected. Fractions of shares
are paid out at each close. Holdings without a bar keep their last close and are not traded.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.plans.graph import compile_graph
from quantloom.plans.portfolio import compile_recipe, scored
from quantloom.session import ship_package
from quantloom.sources.bars import complete_bars, universe_frame

FILL = "struct<symbol:string,side:string,price:double,quant:double,commission:double,pnl:double>"
HELD = "struct<symbol:string,quant:double,gross:double,value:double>"
LEDGER = f"run_id string, ts timestamp, cash double, nav double, commission double, realised double, fills array<{FILL}>, positions array<{HELD}>"


@dataclass(frozen=True)
class Costs:
    """Commission (rate, per trade, bounds) and slippage (basis points, share of volume, bound)."""

    rate: float = 0.0
    per_trade: float = 0.0
    minimum: float | None = None
    maximum: float | None = None
    fixed_bps: float = 0.0
    market_impact: float = 0.0
    max_slip_bps: float | None = None

    def commission(self, price: float, quant: float) -> float:
        fee = self.rate * price * quant + self.per_trade
        fee = fee if self.minimum is None else max(fee, self.minimum)
        return fee if self.maximum is None else min(fee, self.maximum)

    def slipped(self, price: float, quant: float, volume: float, side: str) -> float:
        slip = self.fixed_bps / 1e4 * price + (quant / volume * self.market_impact * price if volume > 0 else 0.0)
        slip = min(slip, self.max_slip_bps / 1e4 * price) if self.max_slip_bps else slip
        return price + slip if side == "BUY" else price - slip


def commission(price: Column, quant: Column, costs: Costs) -> Column:
    """Commission as a column."""
    fee = costs.rate * price * quant + costs.per_trade
    fee = fee if costs.minimum is None else F.greatest(fee, F.lit(costs.minimum))
    return fee if costs.maximum is None else F.least(fee, F.lit(costs.maximum))


def slipped_price(price: Column, quant: Column, volume: Column, side: Column, costs: Costs) -> Column:
    """Execution price as a column."""
    slip = costs.fixed_bps / 1e4 * price + F.when(volume > 0, quant / F.when(volume > 0, volume) * costs.market_impact * price).otherwise(F.lit(0.0))
    slip = F.least(slip, costs.max_slip_bps / 1e4 * price) if costs.max_slip_bps else slip
    return F.when(side == "BUY", price + slip).otherwise(price - slip)


@dataclass(frozen=True)
class Options:
    cash: float = 1_000_000.0
    lot_size: float = 100.0
    threshold: float = 0.1
    costs: Costs = field(default_factory=Costs)


class Bar(NamedTuple):
    open: float
    close: float
    volume: float


class Order(NamedTuple):
    symbol: str
    side: str
    quant: float
    frozen: float


class Ledger:
    """Cash, long holdings at average cost, and open orders of one run."""

    def __init__(self, options: Options):
        self.options = options
        self.cash, self.paid, self.realised = options.cash, 0.0, 0.0
        self.quant: dict[str, float] = {}
        self.gross: dict[str, float] = {}
        self.mark: dict[str, float] = {}
        self.factor: dict[str, float] = {}
        self.orders: list[Order] = []

    def split(self, factors: dict[str, float]) -> None:
        """New adjustment factors scale holdings; a symbol's first factor only starts its series."""
        for s, f in factors.items():
            if s in self.quant and self.factor.get(s, f) != f:
                self.quant[s] *= f / self.factor[s]
            self.factor[s] = f

    def trade(self, order: Order, bar: Bar) -> dict:
        price = self.options.costs.slipped(bar.open, order.quant, bar.volume, order.side)
        fee, pnl = self.options.costs.commission(price, order.quant), 0.0
        held, gross = self.quant.get(order.symbol, 0.0), self.gross.get(order.symbol, 0.0)
        if order.side == "BUY":
            self.cash -= price * order.quant + fee
            self._hold(order.symbol, held + order.quant, gross + price * order.quant + fee)
        else:
            proceeds, basis = price * order.quant - fee, gross * order.quant / held if held else 0.0
            self.cash, pnl = self.cash + proceeds, proceeds - basis
            self._hold(order.symbol, held - order.quant, gross - basis)
        self.paid, self.realised = self.paid + fee, self.realised + pnl
        return {"symbol": order.symbol, "side": order.side, "price": price, "quant": order.quant, "commission": fee, "pnl": pnl}

    def _hold(self, symbol: str, quant: float, gross: float) -> None:
        if quant > 0:
            self.quant[symbol], self.gross[symbol] = quant, gross
        else:
            self.quant.pop(symbol, None)
            self.gross.pop(symbol, None)

    def match(self, bars: dict[str, Bar]) -> list[dict]:
        """Fill the open orders whose symbol trades, sales first; the others stay open."""
        due = sorted((o for o in self.orders if o.symbol in bars), key=lambda o: o.side == "BUY")
        self.orders = [o for o in self.orders if o.symbol not in bars]
        fills = [self.trade(o, bars[o.symbol]) for o in due]
        for s, bar in bars.items():
            self.mark[s] = bar.close
            whole = math.floor(self.quant.get(s, 0.0) + 1e-9)
            part = self.quant.get(s, 0.0) - whole
            if part > 1e-9:
                basis = self.gross[s] * part / self.quant[s]
                self.cash, self.realised = self.cash + part * bar.close, self.realised + part * bar.close - basis
                self._hold(s, whole, self.gross[s] - basis)
        return fills

    def value(self) -> float:
        return self.cash + sum(q * self.mark.get(s, 0.0) for s, q in self.quant.items())

    def rebalance(self, basket: dict[str, float], bars: dict[str, Bar]) -> None:
        """Orders towards the basket, if any weight has drifted or a holding is not in it."""
        total, lot = self.value(), self.options.lot_size
        drift = any(w and abs(self.quant.get(s, 0.0) * self.mark.get(s, 0.0) / total - w) / w > self.options.threshold for s, w in basket.items() if total)
        if not drift and all(s in basket for s in self.quant):
            return
        wanted = []
        for s, w in basket.items():
            if s in bars and bars[s].close > 0:
                gap = w * total / bars[s].close - self.quant.get(s, 0.0)
                n = abs(gap) if lot <= 0 else math.floor(abs(gap) / lot + (0.5 if gap > 0 else 0.0)) * lot
                if n > 0:
                    wanted.append((s, "BUY" if gap > 0 else "SELL", n))
        wanted += [(s, "SELL", q) for s, q in self.quant.items() if s not in basket and s in bars]
        for s, side, n in wanted:
            busy = sum(o.quant for o in self.orders if o.symbol == s and o.side == "SELL")
            cost = n * bars[s].close if side == "BUY" else 0.0
            free = self.cash - sum(o.frozen for o in self.orders)
            if cost <= free + 1e-9 * abs(free) if side == "BUY" else n <= self.quant.get(s, 0.0) - busy + 1e-9:
                self.orders.append(Order(s, side, n, cost))


def simulate(bars: DataFrame, baskets: DataFrame, options: Options = Options(), run_id: str | None = None) -> DataFrame:
    """The ledger after every date: run_id, ts, cash, nav, commission, realised, fills, positions.

    ``bars`` has symbol, ts, open, close, volume and possibly adj; ``baskets`` has ts, symbol, weight and
    possibly universe_idx. With a column ``run_id`` in both, runs are simulated side by side.
    """
    ship_package(bars.sparkSession)
    opts = asdict(options)
    keyed = lambda df: df if run_id is None and "run_id" in df.columns else df.withColumn("run_id", F.lit(run_id or "run"))
    b, w = keyed(complete_bars(bars)), keyed(baskets)
    adj = F.col("adj") if "adj" in b.columns else F.lit(None).cast("double")
    place = F.col("universe_idx") if "universe_idx" in w.columns else F.lit(0)
    dates = b.groupBy("run_id", "ts").agg(F.sort_array(F.collect_list(F.struct("symbol", *[F.col(c).cast("double").alias(c) for c in ("open", "close", "volume")], adj.alias("adj")))).alias("bars"))
    wanted = w.groupBy("run_id", "ts").agg(F.sort_array(F.collect_list(F.struct(place.alias("place"), "symbol", "weight"))).alias("basket"))
    rows = dates.join(wanted, ["run_id", "ts"], "left").repartition("run_id").sortWithinPartitions("run_id", "ts")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        o = Options(**{**opts, "costs": Costs(**opts["costs"])})
        key, ledger = None, Ledger(o)
        for pdf in batches:
            out = []
            for rid, ts, day, basket in zip(pdf["run_id"], pdf["ts"], pdf["bars"], pdf["basket"]):
                if rid != key:
                    key, ledger = rid, Ledger(o)
                today = {x["symbol"]: Bar(x["open"], x["close"], x["volume"]) for x in day}
                ledger.split({x["symbol"]: x["adj"] for x in day if x["adj"] is not None and x["adj"] == x["adj"]})
                fills = ledger.match(today)
                if basket is not None and len(basket):
                    ledger.rebalance({x["symbol"]: x["weight"] for x in basket}, today)
                held = [{"symbol": s, "quant": q, "gross": ledger.gross[s], "value": q * ledger.mark.get(s, 0.0)} for s, q in sorted(ledger.quant.items())]
                out.append((rid, ts, ledger.cash, ledger.value(), ledger.paid, ledger.realised, fills, held))
            yield pd.DataFrame(out, columns=["run_id", "ts", "cash", "nav", "commission", "realised", "fills", "positions"])

    return rows.mapInPandas(run, LEDGER)


def run_backtest(bars: DataFrame, graph: dict, universe: list[str], score: str, recipe: dict | None = None, options: Options = Options(), basket_fn=None) -> DataFrame:
    """Scores by a graph's node, weights by a recipe (or a function of scores), and the ledger of them."""
    members = universe_frame(bars.sparkSession, universe)
    own = bars.join(members.select("symbol"), "symbol", "left_semi")
    scores = compile_graph(graph, own, outputs=[score]).withColumnRenamed(score.replace(".", "_"), "score")
    make = compile_recipe(recipe) if recipe is not None or basket_fn is None else basket_fn
    return simulate(own, make(scored(scores, members)), options)


def equity(ledger: DataFrame) -> DataFrame:
    return ledger.select("run_id", "ts", "nav", "cash")


def fills(ledger: DataFrame) -> DataFrame:
    return ledger.select("run_id", "ts", F.explode("fills").alias("fill")).select("run_id", "ts", "fill.*")


def positions(ledger: DataFrame) -> DataFrame:
    """Holdings after each run's last date."""
    last = ledger.groupBy("run_id").agg(F.max_by("positions", "ts").alias("held"))
    return last.select("run_id", F.explode("held").alias("p")).select("run_id", "p.*")
