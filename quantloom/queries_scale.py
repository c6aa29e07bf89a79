"""Registered queries of the plans for long symbols, long windows, wide dates, large groups, dated universes,
values of weights, and streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quantloom.functions import large
from quantloom.plans import portfolio as pf
from quantloom.plans import wide
from quantloom.plans.graph import compile_graph
from quantloom.plans.nav import nav_of_weights
from quantloom.plans.slices import Slices
from quantloom.queries import bars_from_lineitem, ema, event_bars, layered, roll, rounded, shown, sma, w
from quantloom.session import new_path, written
from quantloom.sources import universes
from quantloom.sources.bars import adjustment_snapshots, daily_bars
from quantloom.streaming.graphs import stream_graph

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# All events as the ticks of one symbol, cut into slices

TICKS_SQL = "SELECT 'all' AS symbol, ts, min(value) AS open, avg(value) AS close FROM events WHERE ts IS NOT NULL AND value IS NOT NULL GROUP BY ts"
SLICED = [
    ("mean", "SMA", ["close"], {"period": 20}), ("total", "RollingSum", ["close"], {"period": 50}), ("spread", "RollingStddev", ["close"], {"period": 20}), ("least", "RollingMin", ["close"], {"period": 100}), ("when_most", "RollingArgMax", ["close"], {"period": 12}),
    ("smooth", "EMA", ["close"], {"alpha": 0.15}), ("ew", "RollingVarEW", ["close"], {"alpha": 0.15}), ("cma", "CMA", ["close"], {}), ("cu", "CuVar", ["close"], {}), ("co", "CuCov", ["open", "close"], {}),
]
_FIELDS = {"spread": "stddev", "when_most": "pos", "ew": "variance", "cu": "variance", "co": "cov"}


def sliced_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = table(spark, sf_dir, "events").where("ts is not null and value is not null").groupBy("ts").agg(F.min("value").alias("open"), F.avg("value").alias("close")).withColumn("symbol", F.lit("all"))
    nodes = [{"name": f"n_{n}", "type": t, "inputs": [f"bar.{i}" for i in ins], "init": p} for n, t, ins, p in SLICED]
    outputs = {n: f"n_{n}.{_FIELDS[n]}" if n in _FIELDS else f"n_{n}" for n, *_ in SLICED}
    made = compile_graph({"root": "bar", "nodes": nodes}, ticks, outputs=list(outputs.values()), slices=Slices(rows=1_000, bucket="day"))
    return rounded(made.withColumnsRenamed({p.replace(".", "_"): n for n, p in outputs.items()}), "symbol", "ts", *outputs)


def _recent(x: str, start: str = "") -> str:
    """The recurrence folded over the last 400 rows, beyond which a weight is below 1e-27."""
    return f"list_reduce(list({x}) {w(400)}, lambda a, v: a + 0.15::DOUBLE * (v - a){start})"


QUERIES["sliced_series"] = sliced_series
_UPTO = "OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
ORACLE_SQL["sliced_series"] = layered(
    [
        {"rn": "row_number() OVER (PARTITION BY symbol ORDER BY ts)", "smooth": _recent("close"), "mean": sma("close", 20), "total": roll("sum(close)", "close", 50), "spread": roll("stddev_pop(close)", "close", 20), "least": roll("min(close)", "close", 100), "cma": f"avg(close) {_UPTO}", "cu": f"var_pop(close) {_UPTO}", "co": f"covar_pop(open, close) {_UPTO}"},
        {"hi": roll("max({'v': close, 'n': rn})", "close", 12), "d": "coalesce(close - lag(smooth) OVER (PARTITION BY symbol ORDER BY ts), 0)"},
        {"when_most": "rn - hi.n", "z": "0.85::DOUBLE * d * d"},
        {"ew_all": _recent("z", ", 0.0::DOUBLE")},
        {"ew": "CASE WHEN rn > 1 THEN ew_all END"},
    ],
    [n for n, *_ in SLICED], {"when_most": "long"}, TICKS_SQL,
).replace("CAST(epoch(ts) AS BIGINT)", "CAST(floor(epoch(ts)) AS BIGINT)")

# Windows of 120 bars of suppliers

_LONG = 120
LONG = [
    ("least", "RollingMin", {}, {"": ""}), ("most", "RollingMax", {}, {"": ""}), ("when_least", "RollingArgMin", {}, {"pos": "pos"}), ("mid", "RollingMedian", {}, {"": ""}), ("quart", "IQR", {}, {"q1": "q1", "q3": "q3"}),
    ("q", "RollingQuantile", {"quantiles": [0.1, 0.9]}, {"0": "low", "1": "high"}), ("mean_away", "MeanAbsDeviation", {}, {"mad": "mad"}), ("median_away", "MedianAbsDeviation", {}, {"mad": "mad"}), ("weighted", "EWMA", {}, {"": ""}),
]


def rolling_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    # in thousands, so that the last bits of a sum don't decide the seventh decimal
    bars = bars_from_lineitem(table(spark, sf_dir, "lineitem")).select("symbol", "ts", (F.col("close") / 1000).alias("close"))
    nodes = [{"name": f"n_{n}", "type": t, "inputs": ["bar.close"], "init": {"period": _LONG, **p}} for n, t, p, _ in LONG]
    outputs = {f"{n}_{alias}" if alias else n: f"n_{n}.{field}" if field else f"n_{n}" for n, _, _, fields in LONG for field, alias in fields.items()}
    made = compile_graph({"root": "bar", "nodes": nodes}, bars, outputs=list(outputs.values()))
    return rounded(made.withColumnsRenamed({p.replace(".", "_"): n for n, p in outputs.items()}), "symbol", "ts", *outputs)


QUERIES["rolling_long"] = rolling_long
_BARS = "SELECT CAST(l_suppkey AS VARCHAR) AS symbol, l_shipdate AS ts, sum(l_extendedprice) / sum(l_quantity) / 1000 AS close FROM lineitem WHERE l_quantity <> 0 GROUP BY 1, 2"
_DECAY = 1 - 2 / (_LONG + 1)
_AT = lambda k: f"s[{k + 1}]"
ORACLE_SQL["rolling_long"] = layered(
    [
        {"rn": "row_number() OVER (PARTITION BY symbol ORDER BY ts)", "l": roll("list(close)", "close", _LONG)},
        {"s": "list_sort(l)", "lo_at": roll("min({'v': close, 'n': -rn})", "close", _LONG), "avg_": sma("close", _LONG)},
        {"mid": f"({_AT(_LONG // 2 - 1)} + {_AT(_LONG // 2)}) / 2", "least": "s[1]", "most": f"s[{_LONG}]", "when_least_pos": "rn + lo_at.n", "quart_q1": _AT(int((_LONG - 1) * 0.25)), "quart_q3": _AT(int((_LONG - 1) * 0.75)), "q_low": _AT(int(_LONG * 0.1 + 0.5)), "q_high": _AT(int(_LONG * 0.9 + 0.5)), "mean_away_mad": "list_avg(list_transform(l, lambda v: abs(v - avg_)))",
         "weighted": f"list_reduce(l, lambda a, v: a * {_DECAY!r}::DOUBLE + v) / {sum(_DECAY**k for k in range(_LONG))!r}::DOUBLE"},
        {"median_away_mad": "list_median(list_transform(l, lambda v: abs(v - mid)))"},
    ],
    ["least", "most", "when_least_pos", "mid", "quart_q1", "quart_q3", "q_low", "q_high", "mean_away_mad", "median_away_mad", "weighted"], {"when_least_pos": "long"}, _BARS,
)

# Every part as a symbol of a date: a year of its sales as the score


def part_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    sold = table(spark, sf_dir, "lineitem").groupBy(F.date_trunc("year", "l_shipdate").alias("ts"), F.col("l_partkey").cast("string").alias("symbol"))
    return wide.scored(sold.agg((F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))) / 100_000 - 1).alias("score")))


PART_SCORES_SQL = "SELECT *, row_number() OVER (PARTITION BY ts ORDER BY symbol) - 1 AS u FROM (SELECT date_trunc('year', l_shipdate) AS ts, CAST(l_partkey AS VARCHAR) AS symbol, sum(l_extendedprice * (1 - l_discount)) / 100000 - 1 AS score FROM lineitem GROUP BY 1, 2) WHERE score IS NOT NULL"


def _wide(name: str, steps: Callable[[DataFrame], DataFrame], column: str, sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(steps(part_scores(spark, sf_dir)), "ts", "symbol", column)
    ORACLE_SQL[name] = f"WITH s AS ({PART_SCORES_SQL}) " + sql.replace("$", f"SELECT CAST(epoch(ts) AS BIGINT) AS ts, symbol, {shown(column)} AS {column} FROM")


_RANK = "row_number() OVER (PARTITION BY ts ORDER BY score {}, u)"
_wide("wide_top", lambda s: wide.filter_top_n(s, 25), "score", f"$ (SELECT *, {_RANK.format('DESC')} AS k FROM s) WHERE k <= 25")
_wide("wide_rank", wide.norm_rank, "score", f"$ (SELECT ts, symbol, CASE WHEN n = 1 THEN 0 ELSE (k - 1)::DOUBLE / (n - 1) END AS score FROM (SELECT *, {_RANK.format('ASC')} AS k, count(*) OVER (PARTITION BY ts) AS n FROM s))")
_wide("wide_zscore", wide.norm_z_score, "score", "$ (SELECT ts, symbol, CASE WHEN sd = 0 THEN score ELSE (score - m) / sd END AS score FROM (SELECT *, avg(score) OVER (PARTITION BY ts) AS m, stddev_pop(score) OVER (PARTITION BY ts) AS sd FROM s))")
_CAP = 0.0015
_wide("wide_cap", lambda s: wide.cap_weight(wide.basket_proportional(pf.filter_gate(s, 0.0)), _CAP), "weight",
    f""", a AS (SELECT *, score / sum(score) OVER (PARTITION BY ts) AS w FROM s WHERE score >= 0 QUALIFY sum(score) OVER (PARTITION BY ts) > 0),
    b AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY w DESC, u) - 1 AS k, sum(w) OVER (PARTITION BY ts ORDER BY w DESC, u ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, sum(w) OVER (PARTITION BY ts) AS t FROM a),
    c AS (SELECT *, CASE WHEN rest > 0 AND (t - k * {_CAP}) / rest * w <= {_CAP} + 1e-15 THEN k END AS fit FROM b), d AS (SELECT *, min(fit) OVER (PARTITION BY ts) AS f FROM c),
    g AS (SELECT *, max(CASE WHEN k = f THEN (t - k * {_CAP}) / rest END) OVER (PARTITION BY ts) AS scale FROM d)
    $ (SELECT ts, symbol, CASE WHEN f IS NULL THEN CASE WHEN w > 0 THEN {_CAP}::DOUBLE ELSE 0 END ELSE least({_CAP}::DOUBLE, scale * w) END AS weight FROM g)""")  # fmt: skip

# All line items as one group


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_extendedprice", "l_quantity").withColumn("all", F.lit(1))


def large_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = ["l_orderkey", "l_linenumber"]
    ranked = large.ranks(_items(spark, sf_dir), ["all"], "l_quantity", order)
    clipped = large.winsorized(ranked, ["all"], "l_extendedprice", order, 0.01, 0.99, "clipped")
    return rounded(clipped.select(*order, "l_quantity", "rank", "clipped"))


QUERIES["large_ranks"] = large_ranks
ORACLE_SQL["large_ranks"] = f"""WITH q AS (SELECT quantile_cont(l_extendedprice, 0.01) AS lo, quantile_cont(l_extendedprice, 0.99) AS hi FROM lineitem),
r AS (SELECT *, (rank() OVER (ORDER BY l_quantity) - 1 + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0::DOUBLE) / (count(*) OVER () - 1) AS rank FROM lineitem)
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, {shown('l_quantity')} AS l_quantity, {shown('rank')} AS rank, {shown('greatest(lo, least(hi, l_extendedprice))')} AS clipped FROM r, q"""


def large_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, order = _items(spark, sf_dir), ["l_orderkey", "l_linenumber"]
    cuts = large.quantiles(items, ["all"], "l_extendedprice", order, {"p01": 0.01, "median": 0.5, "p999": 0.999})
    return rounded(cuts.join(large.spearman(items, ["all"], "l_extendedprice", "l_quantity", order), "all"), "p01", "median", "p999", "spearman")


QUERIES["large_summary"] = large_summary
ORACLE_SQL["large_summary"] = f"""WITH r AS (SELECT l_extendedprice AS x, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0::DOUBLE AS rx, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0::DOUBLE AS ry FROM lineitem)
SELECT {', '.join(f'{shown(f"quantile_cont(x, {q})")} AS {n}' for n, q in (('p01', 0.01), ('median', 0.5), ('p999', 0.999)))}, {shown('corr(rx, ry)')} AS spearman FROM r"""

# Customers that are in the universe of a month by their orders of the three months before


def dated_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("symbol"), F.col("o_orderdate").alias("ts"), "o_totalprice")
    members = universes.trailing_members(orders, "symbol", "ts", "month", 3, (F.count("*") >= 2) & (F.sum("o_totalprice") > 300_000))
    kept = universes.in_universe(orders, universes.spans(members, "month"), "quarter")
    return rounded(kept.select("o_orderkey", "symbol", "ts", "o_totalprice"))


QUERIES["dated_universe"] = dated_universe
_MEMBERS = """m AS (SELECT symbol, period FROM (SELECT o_custkey AS symbol, CAST(date_trunc('month', o_orderdate) + to_months(CAST(k AS INTEGER)) AS TIMESTAMP) AS period, o_totalprice FROM orders, (SELECT unnest([1, 2, 3]) AS k)) GROUP BY 1, 2 HAVING count(*) >= 2 AND sum(o_totalprice) > 300000)"""
ORACLE_SQL["dated_universe"] = f"WITH {_MEMBERS} SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS symbol, CAST(epoch(o_orderdate) AS BIGINT) AS ts, {shown('o_totalprice')} AS o_totalprice FROM orders JOIN m ON m.symbol = o_custkey AND m.period = date_trunc('month', o_orderdate)"


def universe_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("symbol"), F.col("o_orderdate").alias("ts"), "o_totalprice")
    members = universes.trailing_members(orders, "symbol", "ts", "month", 3, (F.count("*") >= 2) & (F.sum("o_totalprice") > 300_000))
    return rounded(universes.spans(members, "month"), "symbol", "since", "until")


QUERIES["universe_spans"] = universe_spans
ORACLE_SQL["universe_spans"] = f"""WITH {_MEMBERS}, g AS (SELECT *, (year(period) * 12 + month(period)) - row_number() OVER (PARTITION BY symbol ORDER BY period) AS run FROM m)
SELECT CAST(symbol AS VARCHAR) AS symbol, CAST(epoch(min(period)) AS BIGINT) AS since, CAST(epoch(max(period) + INTERVAL 1 MONTH) AS BIGINT) AS until FROM g GROUP BY symbol, run"""

# The value of monthly baskets of supplier bars


def monthly_weights(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    # written once: scores, dates, and prices are three readers
    bars = written(bars_from_lineitem(table(spark, sf_dir, "lineitem")).where("open is not null").select("symbol", "ts", "open", "close", "volume"), "bars")
    last = bars.groupBy("symbol", F.date_trunc("month", "ts").alias("month")).agg(F.max_by("close", "ts").alias("score"), F.max("volume").alias("volume"))
    dates = bars.groupBy(F.date_trunc("month", "ts").alias("month")).agg(F.max("ts").alias("ts"))
    scored = last.join(dates, "month").select("ts", "symbol", F.col("score") / 1_000 + F.col("volume") / 100_000)
    return pf.basket_rank(pf.filter_top_n(pf.scored(scored.toDF("ts", "symbol", "score")), 10)), bars


def monthly_nav(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights, bars = monthly_weights(spark, sf_dir)
    return rounded(nav_of_weights(weights, bars, cost_rate=0.001), "ts", "growth", "turnover", "nav")


QUERIES["monthly_nav"] = monthly_nav
ORACLE_SQL["monthly_nav"] = f"""WITH d AS (SELECT CAST(l_suppkey AS VARCHAR) AS symbol, l_shipdate AS ts, max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low, sum(l_extendedprice) / sum(l_quantity) AS close, sum(l_quantity) AS volume FROM lineitem WHERE l_quantity <> 0 GROUP BY 1, 2),
b AS (SELECT symbol, ts, close, volume, least(high, greatest(low, coalesce(lag(close) OVER (PARTITION BY symbol ORDER BY ts), close))) AS open FROM d),
t AS (SELECT ts, row_number() OVER (ORDER BY ts) AS no FROM (SELECT DISTINCT ts FROM b)), n AS (SELECT b.*, t.no FROM b JOIN t USING (ts)),
l AS (SELECT symbol, date_trunc('month', ts) AS month, arg_max(close, ts) / 1000 + max(volume) / 100000 AS score FROM b GROUP BY 1, 2),
e AS (SELECT date_trunc('month', ts) AS month, max(ts) AS ts FROM b GROUP BY 1),
s AS (SELECT e.ts, l.symbol, l.score, row_number() OVER (PARTITION BY e.ts ORDER BY l.score DESC, l.symbol) AS k FROM l JOIN e USING (month)),
w AS (SELECT ts, symbol, (c - k + 1) / (c * (c + 1) / 2.0::DOUBLE) AS weight, t.no FROM (SELECT *, count(*) OVER (PARTITION BY ts) AS c FROM s WHERE k <= 10) JOIN t USING (ts)),
u AS (SELECT ts, no + 1 AS bought, coalesce(lead(no) OVER (ORDER BY no) + 1, (SELECT max(no) FROM t) + 1) AS sold, row_number() OVER (ORDER BY no) AS turn FROM (SELECT DISTINCT ts, no FROM w) WHERE no < (SELECT max(no) FROM t)),
h AS (SELECT w.symbol, w.weight, u.* FROM w JOIN u USING (ts)),
p AS (SELECT h.*, coalesce(nb.open, pb.close) AS price_bought, coalesce(ns.open, ps.close) AS price_sold FROM h
  LEFT JOIN n nb ON nb.symbol = h.symbol AND nb.no = h.bought LEFT JOIN n ns ON ns.symbol = h.symbol AND ns.no = h.sold
  ASOF LEFT JOIN n pb ON pb.symbol = h.symbol AND pb.no < h.bought ASOF LEFT JOIN n ps ON ps.symbol = h.symbol AND ps.no < h.sold),
f AS (SELECT turn, ts, symbol, weight, coalesce(price_sold, price_bought) / price_bought AS factor FROM p WHERE price_bought IS NOT NULL),
g AS (SELECT u.turn, u.ts, 1 + coalesce(sum(weight * (factor - 1)), 0) AS growth FROM u LEFT JOIN f USING (turn) GROUP BY 1, 2),
o AS (SELECT f.turn + 1 AS turn, symbol, weight * factor / growth AS old FROM f JOIN g USING (turn)),
x AS (SELECT coalesce(f.turn, o.turn) AS turn, sum(abs(coalesce(weight, 0) - coalesce(old, 0))) AS turnover FROM f FULL JOIN o ON f.turn = o.turn AND f.symbol = o.symbol GROUP BY 1),
y AS (SELECT g.*, coalesce(turnover, 0) AS turnover FROM g LEFT JOIN x USING (turn)),
z AS (SELECT *, product((1 - 0.001::DOUBLE * turnover) * growth) OVER (ORDER BY turn) AS nav FROM y)
SELECT CAST(epoch(ts) AS BIGINT) AS ts, {shown('growth')} AS growth, {shown('turnover')} AS turnover, {shown('nav')} AS nav FROM z"""

# Hourly bars of events, as a stream of three files


def streamed_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bars in three files in order of time, each a micro-batch; what the sink got."""
    bars, base = event_bars(spark, sf_dir), new_path(spark, "stream")
    placed = written(bars.join(bars.groupBy("ts").count().select("ts", F.ntile(3).over(Window.orderBy("ts")).alias("part")), "ts"), "bars")  # a row per hour
    for part in (1, 2, 3):
        placed.where(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(placed.drop("part").schema).parquet(f"{base}/in")
        sink = lambda df, epoch: df.write.mode("overwrite").parquet(f"{base}/out/{epoch}")
        stream_graph(STREAM_GRAPH, stream, sink, f"{base}/checkpoint", STREAM_OUTPUTS).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(*[f"{base}/out/{epoch}" for epoch in range(3)])
    return rounded(got, "symbol", "ts", *STREAM_OUTPUTS)


STREAM_OUTPUTS = ["mean", "top", "smooth", "cma"]
STREAM_GRAPH = {"root": "bar", "nodes": [{"name": "mean", "type": "SMA", "inputs": ["bar.close"], "init": {"period": 10}}, {"name": "top", "type": "RollingMax", "inputs": ["mean"], "init": {"period": 4}}, {"name": "smooth", "type": "EMA", "inputs": ["bar.close"], "init": {"alpha": 0.2}}, {"name": "cma", "type": "CMA", "inputs": ["bar.close"]}]}
QUERIES["streamed_graph"] = streamed_graph
ORACLE_SQL["streamed_graph"] = layered([{"mean": sma("close", 10), "smooth": ema("close", "0.2"), "cma": f"avg(close) {_UPTO}"}, {"top": roll("max(mean)", "mean", 4)}], STREAM_OUTPUTS, {})

# Factors that change by quarter, as they were known on each date on which any changed


def factor_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").where("l_shipdate is not null")
    day = lambda ts: F.date_format(ts, "yyyyMMdd").alias("trade_date")
    code = F.col("l_suppkey").cast("string").alias("ts_code")
    daily = items.groupBy(code, day(F.col("l_shipdate"))).agg(*[F.max("l_extendedprice").alias(c) for c in ("open", "high", "low", "close", "vol", "amount")])
    first = items.groupBy(code, F.date_trunc("quarter", "l_shipdate").alias("q")).agg(F.min("l_shipdate").alias("first"), F.count("*").alias("n"))
    factors = first.select("ts_code", day(F.col("first")), (1 + F.col("n") % 4 / 10).alias("adj_factor"))
    return rounded(adjustment_snapshots(daily_bars(daily), factors), "ts", "symbol", "adj")


QUERIES["factor_snapshots"] = factor_snapshots
ORACLE_SQL["factor_snapshots"] = f"""WITH f AS (SELECT CAST(l_suppkey AS VARCHAR) AS symbol, min(l_shipdate) AS first, 1 + count(*) % 4 / 10.0::DOUBLE AS adj FROM lineitem WHERE l_shipdate IS NOT NULL GROUP BY 1, date_trunc('quarter', l_shipdate)),
c AS (SELECT symbol, date_trunc('day', first) + INTERVAL '9 hours 30 minutes' AS ts, adj FROM f QUALIFY adj IS DISTINCT FROM lag(adj) OVER (PARTITION BY symbol ORDER BY first)),
d AS (SELECT DISTINCT ts FROM c), s AS (SELECT DISTINCT symbol FROM c), x AS (SELECT d.ts, s.symbol FROM d, s)
SELECT CAST(epoch(x.ts) AS BIGINT) AS ts, x.symbol, {shown('c.adj')} AS adj FROM x ASOF JOIN c ON c.symbol = x.symbol AND c.ts <= x.ts"""
