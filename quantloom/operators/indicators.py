"""Technical indicators as window expressions; averages of unlimited memory are block-wise window sums."""

from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quantloom.operators.kernels import ParabolicStop
from quantloom.operators.rolling import arg_extreme, mean_abs_deviation
from quantloom.operators.spec import Frame, OpSpec, ratio, stateful, strict, wilders


def exp_alpha(period: float) -> float:
    return 2.0 / (float(period) + 1)


def inputs(f: Frame, x: list[Column]) -> list[Column]:
    """All inputs as columns, null where any of them is."""
    return f.add_many([strict(x, c) for c in x])


def true_range(f: Frame, h: Column, low: Column, c: Column) -> Column:
    """max(h - l, |h - previous close|, |l - previous close|); h - l on the first bar."""
    before = f.lag(c)
    return f.add(F.when(before.isNull(), h - low).otherwise(F.greatest(h - low, F.abs(h - before), F.abs(low - before))))


def highest(f: Frame, x: Column, p: int) -> Column:
    return f.extreme(True, x, p)


def lowest(f: Frame, x: Column, p: int) -> Column:
    return f.extreme(False, x, p)


def total(f: Frame, x: Column, p: int) -> Column:
    return f.rolling(F.sum, x, p)


def ema(f: Frame, x: Column, period: float) -> Column:
    return f.ema(x, exp_alpha(period))


# Trend


def aroon(f, x, p):
    h, low = inputs(f, x)
    n = int(p["period"])
    _, up = arg_extreme(f, h, n, True)
    _, down = arg_extreme(f, low, n, False)
    return {"up": 100.0 * (n - up) / n, "down": 100.0 * (n - down) / n}


def aroonosc(f, x, p):
    made = aroon(f, x, p)
    return made["up"] - made["down"]


def cci(f, x, p):
    h, low, c = inputs(f, x)
    tp = f.add((h + low + c) / 3)
    made = mean_abs_deviation(f, [tp], p)
    return ratio(tp - made["mean"], 0.015 * f.add(made["mad"]))


def vhf(f, x, p):
    (c,) = inputs(f, x)
    change = f.add(F.abs(c - f.lag(c)))
    n = int(p["period"])
    later = f.add(F.when(change.isNotNull(), c))
    return ratio(highest(f, later, n) - lowest(f, later, n), total(f, change, n))


def directional(f: Frame, h: Column, low: Column, period: float) -> tuple[Column, Column]:
    """Smoothed plus and minus movements, from the second bar."""
    up, down = f.add_many([h - F.lag(h).over(f.over()), F.lag(low).over(f.over()) - low])
    plus, minus = f.add_many([F.when(up.isNotNull(), F.when((up > down) & (up > 0), up).otherwise(F.lit(0.0))), F.when(up.isNotNull(), F.when((down > up) & (down > 0), down).otherwise(F.lit(0.0)))])
    return f.ema(plus, wilders(period)), f.ema(minus, wilders(period))


def dm(f, x, p):
    plus, minus = directional(f, *inputs(f, x), p["period"])
    return {"plus": plus, "minus": minus}


def di(f, x, p):
    h, low, c = inputs(f, x)
    range_ = f.ema(true_range(f, h, low, c), wilders(p["period"]))
    plus, minus = directional(f, h, low, p["period"])
    over = lambda v: F.when(range_ != 0, 100 * v / F.when(range_ != 0, range_))
    return {"plus": over(plus), "minus": over(minus)}


def dx(f, x, p):
    made = di(f, x, p)
    plus, minus = f.add_many([made["plus"], made["minus"]])
    return ratio(100 * F.abs(plus - minus), plus + minus)


def adx(f, x, p):
    return f.ema(f.add(dx(f, x, p)), wilders(p["period"]))


def adxr(f, x, p):
    now = adx(f, x, p)
    ready = f.add(F.when(now.isNotNull(), now))
    before = f.lag(ready, int(p["period"]) - 1) if int(p["period"]) > 1 else ready
    return (ready + before) / 2


def vi(f, x, p):
    h, low, c = inputs(f, x)
    n = int(p["period"])
    low_before, high_before = f.lag(low), f.lag(h)
    tr = true_range(f, h, low, c)
    plus, minus, later = f.add_many([F.abs(h - low_before), F.abs(low - high_before), F.when(low_before.isNotNull(), tr)])
    a, b, t = total(f, plus, n), total(f, minus, n), total(f, later, n)
    return {"vi_plus": F.when(t != 0, a / F.when(t != 0, t)), "vi_minus": F.when(t != 0, b / F.when(t != 0, t))}


def ichimoku(f, x, p):
    h, low, c = inputs(f, x)
    mid = lambda n: f.add((highest(f, h, int(n)) + lowest(f, low, int(n))) / 2)
    tenkan, kijun, senkou_b = mid(p["tenkan_period"]), mid(p["kijun_period"]), mid(p["senkou_b_period"])
    chikou = F.coalesce(f.lag(c, int(p["displacement"]) - 1), c)
    ready = lambda v: F.when(tenkan.isNotNull() & kijun.isNotNull() & senkou_b.isNotNull(), v)
    return {"tenkan": ready(tenkan), "kijun": ready(kijun), "senkou_a": ready((tenkan + kijun) / 2), "senkou_b": ready(senkou_b), "chikou": ready(chikou)}


# Momentum


def bop(f, x, p):
    o, h, low, c = x
    return strict(x, ratio(c - o, h - low))


def mom(f, x, p):
    (c,) = inputs(f, x)
    return c - f.lag(c, p["period"])


def roc(f, x, p):
    (c,) = inputs(f, x)
    before = f.lag(c, p["period"])
    return F.when(before.isNotNull(), ratio(100 * (c - before), before))


def rocr(f, x, p):
    (c,) = inputs(f, x)
    before = f.lag(c, p["period"])
    return F.when(before.isNotNull(), ratio(c, before, 1.0))


def _changes(f: Frame, c: Column) -> tuple[Column, Column]:
    change = f.add(c - f.lag(c))
    gain, loss = f.add_many([F.when(change.isNotNull(), F.greatest(change, F.lit(0.0))), F.when(change.isNotNull(), F.greatest(-change, F.lit(0.0)))])
    return gain, loss


def rsi(f, x, p):
    gain, loss = _changes(f, *inputs(f, x))
    up, down = f.ema(gain, wilders(p["period"])), f.ema(loss, wilders(p["period"]))
    return F.when(down.isNotNull(), F.when(down == 0, F.lit(100.0)).otherwise(100 - 100 / (1 + up / F.when(down != 0, down))))


def cmo(f, x, p):
    gain, loss = _changes(f, *inputs(f, x))
    n = int(p["period"])
    up, down = total(f, gain, n), total(f, loss, n)
    return ratio(100 * (up - down), up + down)


def wad(f, x, p):
    h, low, c = inputs(f, x)
    before = f.lag(c)
    step = f.add(F.when(c > before, c - F.least(before, low)).when(c < before, c - F.greatest(before, h)).when(before.isNotNull(), F.lit(0.0)))
    return f.running("sum", step)


def rvi(f, x, p):
    o, h, low, c = inputs(f, x)
    n = int(p["period"])
    a, b = f.add_many([c - o, h - low])
    value = f.add(ratio(f.sma(a, n), f.sma(b, n)))
    signal = f.sma(value, 4)
    return {"rvi": F.when(signal.isNotNull(), value), "signal": signal}


def tsi(f, x, p):
    (c,) = inputs(f, x)
    change = f.add(c - f.lag(c))
    twice = lambda v: ema(f, ema(f, v, p["period_slow"]), p["period_fast"])
    value = f.add(ratio(100 * twice(change), twice(f.add(F.abs(change)))))
    return {"tsi": value, "signal": ema(f, value, p["period_signal"])}


def bbpower(f, x, p):
    h, low, c = inputs(f, x)
    base = ema(f, c, p["period"])
    return {"bull_power": h - base, "bear_power": low - base}


# Oscillators


def ao(f, x, p):
    h, low = inputs(f, x)
    mid = f.add((h + low) / 2)
    return f.sma(mid, 5) - f.sma(mid, 34)


def apo(f, x, p):
    (c,) = inputs(f, x)
    return ema(f, c, p["period_fast"]) - ema(f, c, p["period_slow"])


def dpo(f, x, p):
    (c,) = inputs(f, x)
    n = int(p["period"])
    return f.lag(c, n // 2) - f.sma(c, n)


def fisher(f, x, p):
    """The smoothed place in the range is linear in its inputs, and so is the transform's smoothing."""
    h, low = inputs(f, x)
    n = int(p["period"])
    mid = f.add((h + low) / 2)
    top, bottom = highest(f, mid, n), lowest(f, mid, n)
    place = f.add(F.when(top != bottom, 2 * ((mid - bottom) / F.when(top != bottom, top - bottom) - 0.5)))
    # 0.333 and 0.667 are the indicator's fixed weights; they sum to 1.
    value = f.ema(place, 0.333, seed=F.lit(0.0))
    held = F.greatest(F.lit(-0.999), F.least(F.lit(0.999), value))
    raw = f.add(F.when(value.isNotNull(), 0.5 * F.log((1 + held) / (1 - held))))
    smooth = f.ema(raw, 0.5, seed=F.lit(0.0))
    return F.when(top.isNotNull(), F.coalesce(f.cumulative(("last", smooth))[0], F.lit(0.0)))


def macd(f, x, p):
    (c,) = inputs(f, x)
    value = f.add(ema(f, c, p["period_fast"]) - ema(f, c, p["period_slow"]))
    signal = ema(f, value, p["period_signal"])
    return {"macd": value, "signal": signal, "histogram": value - signal}


def _percent(f: Frame, v: Column, fast: float, slow: float) -> Column:
    a, b = ema(f, v, fast), ema(f, v, slow)
    return ratio(100 * (a - b), b)


def ppo(f, x, p):
    return _percent(f, *inputs(f, x), p["period_fast"], p["period_slow"])


def qstick(f, x, p):
    o, c = inputs(f, x)
    return f.sma(f.add(c - o), p["period"])


def trix(f, x, p):
    (c,) = inputs(f, x)
    n = p["period"]
    third = ema(f, ema(f, ema(f, c, n), n), n)
    before = f.lag(third)
    by_zero = F.when(third == before, F.lit(float("nan"))).when(third > before, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(before.isNotNull(), F.when(before == 0, by_zero).otherwise(100 * (third - before) / F.when(before != 0, before)))


def ultosc(f, x, p):
    h, low, c = inputs(f, x)
    before = f.lag(c)
    floor = F.least(low, before)
    bp, tr = f.add_many([F.when(before.isNotNull(), c - floor), F.when(before.isNotNull(), F.greatest(h, before) - floor)])
    part = lambda n: f.add(ratio(total(f, bp, int(n)), total(f, tr, int(n))))
    a, b, c3 = part(p["period_fast"]), part(p["period_med"]), part(p["period_slow"])
    return 100 * (4 * a + 2 * b + c3) / 7


def stoch(f, x, p):
    h, low, c = inputs(f, x)
    n = int(p.get("k_period") or p.get("period") or 14)
    top, bottom = highest(f, h, n), lowest(f, low, n)
    raw = f.add(ratio(100 * (c - bottom), top - bottom, 50.0))
    k = f.sma(f.add(F.when(top.isNotNull(), raw)), p["k_slowing"])
    d = f.sma(k, p["d_period"])
    return {"k": F.when(d.isNotNull(), k), "d": d}


def stochrsi(f, x, p):
    value = f.add(rsi(f, x, p))
    n = int(p["period"])
    top, bottom = highest(f, value, n), lowest(f, value, n)
    return F.when(top.isNotNull(), ratio(100 * (value - bottom), top - bottom))


def willr(f, x, p):
    h, low, c = inputs(f, x)
    top, bottom = highest(f, h, p["period"]), lowest(f, low, p["period"])
    return F.when(top.isNotNull(), ratio(-100 * (top - c), top - bottom))


# Volatility


def volatility(f, x, p):
    (c,) = inputs(f, x)
    before = f.lag(c)
    ok = (c > 0) & (before > 0)
    change = f.add(F.when(ok, F.log(F.when(ok, c / before))))
    n = int(p["period"])
    return 100 * F.sqrt(f.rolling(F.var_samp, change, n) * float(p["annualizedDays"]))


def cvi(f, x, p):
    h, low = inputs(f, x)
    smooth = ema(f, f.add(h - low), p["period_ema"])
    before = f.lag(smooth, p["period"])
    return F.when(before.isNotNull(), ratio(100 * (smooth - before), before))


def mass(f, x, p):
    h, low = inputs(f, x)
    once = ema(f, f.add(h - low), p["period_ema"])
    twice = ema(f, once, p["period_ema"])
    return total(f, f.add(ratio(once, twice)), p["period_sum"])


def tr(f, x, p):
    return true_range(f, *inputs(f, x))


def atr(f, x, p):
    return f.ema(true_range(f, *inputs(f, x)), wilders(p["period"]))


def natr(f, x, p):
    h, low, c = inputs(f, x)
    range_ = f.ema(true_range(f, h, low, c), wilders(p["period"]))
    return F.when(c != 0, 100 * range_ / F.when(c != 0, c))


def price_channel(f, x, p):
    h, low = inputs(f, x)
    return {"upper": highest(f, h, p["period"]), "lower": lowest(f, low, p["period"])}


def bbands(f, x, p):
    (c,) = inputs(f, x)
    n = int(p["period"])
    middle, sd = f.sma(c, n), f.rolling(F.stddev_samp, c, n)
    return {"upper": middle + float(p["Nstddev"]) * sd, "middle": middle, "lower": middle - float(p["Nstddev"]) * sd}


def kc(f, x, p):
    h, low, c = inputs(f, x)
    n, m = int(p["period"]), float(p["multiplier"])
    middle, range_ = f.sma(c, n), f.sma(true_range(f, h, low, c), n)
    return {"upper": middle + m * range_, "middle": middle, "lower": middle - m * range_}


def dc(f, x, p):
    made = price_channel(f, x, p)
    return {"upper": made["upper"], "middle": (made["upper"] + made["lower"]) / 2, "lower": made["lower"]}


# Volume


def _flow(h: Column, low: Column, c: Column, v: Column) -> Column:
    return ratio(((c - low) - (h - c)), h - low) * v


def ad(f, x, p):
    return f.running("sum", f.add(_flow(*inputs(f, x))))


def adosc(f, x, p):
    line = ad(f, x, p)
    return ema(f, line, p["period_fast"]) - ema(f, line, p["period_slow"])


def kvo(f, x, p):
    h, low, c, v = inputs(f, x)
    level = f.add(h + low + c)
    turn = f.add(F.signum(level - f.lag(level)))
    trend = f.add(F.coalesce(F.last(F.when(turn != 0, turn), ignorenulls=True).over(f.upto()), F.when(level.isNotNull(), F.lit(1.0))))
    before = f.lag(trend)
    flips = f.add(F.sum(F.when(before.isNotNull() & (trend != before), 1).otherwise(0)).over(f.upto()))
    range_ = f.add(h - low)
    keys = f.partition()
    cumulative = f.add(F.sum(range_).over(Window.partitionBy(*keys, flips).orderBy(f.ts).rowsBetween(Window.unboundedPreceding, 0)))
    force = f.add(F.when(cumulative > 0, 100 * v * trend * F.abs(2 * range_ / F.when(cumulative > 0, cumulative) - 1)).when(cumulative.isNotNull(), F.lit(0.0)))
    return ema(f, force, p["period_fast"]) - ema(f, force, p["period_slow"])


def _volume_index(f: Frame, x: list[Column], rises: bool) -> Column:
    c, v = inputs(f, x)
    c0, v0 = f.lag(c), f.lag(v)
    counts = (v > v0) if rises else (v < v0)
    factor = f.add(F.when(c.isNotNull(), F.when(counts & (c0 != 0), 1 + (c - c0) / F.when(c0 != 0, c0)).otherwise(F.lit(1.0))))
    return 1000 * f.running("product", factor)


def nvi(f, x, p):
    return _volume_index(f, x, False)


def pvi(f, x, p):
    return _volume_index(f, x, True)


def obv(f, x, p):
    c, v = inputs(f, x)
    return f.running("sum", f.add(F.when(c.isNotNull(), F.coalesce(F.signum(c - f.lag(c)) * v, F.lit(0.0)))))


def mfi(f, x, p):
    h, low, c, v = inputs(f, x)
    tp = f.add((h + low + c) / 3)
    before = f.lag(tp)
    up, down = f.add_many([F.when(before.isNotNull(), F.when(tp >= before, tp * v).otherwise(F.lit(0.0))), F.when(before.isNotNull(), F.when(tp < before, tp * v).otherwise(F.lit(0.0)))])
    pos, neg = total(f, up, p["period"]), total(f, down, p["period"])
    return F.when(neg.isNotNull(), F.when(neg == 0, F.lit(100.0)).otherwise(100 - 100 / (1 + pos / F.when(neg != 0, neg))))


def emv(f, x, p):
    h, low, v = inputs(f, x)
    moved = (h + low) / 2 - f.lag(f.add((h + low) / 2))
    # distance / (volume / 1e8 / range): no range gives 0, no volume gives 0
    return F.when(moved.isNotNull(), F.when((v == 0) & (h == low), F.lit(float("nan"))).when((v == 0) | (h == low), F.lit(0.0)).otherwise(moved / F.when(v != 0, v) * 1e8 * (h - low)))


def market_fi(f, x, p):
    h, low, v = x
    return strict(x, ratio(h - low, v))


def vosc(f, x, p):
    return _percent(f, *inputs(f, x), p["period_fast"], p["period_slow"])


def cmf(f, x, p):
    h, low, c, v = inputs(f, x)
    flow, volume = total(f, f.add(_flow(h, low, c, v)), p["period"]), total(f, v, p["period"])
    return F.when(volume != 0, flow / F.when(volume != 0, volume))


def pvo(f, x, p):
    value = f.add(_percent(f, *inputs(f, x), p["period_fast"], p["period_slow"]))
    signal = ema(f, value, p["period_signal"])
    return {"pvo": value, "signal": signal, "histogram": value - signal}


def fi(f, x, p):
    c, v = inputs(f, x)
    return ema(f, f.add(F.when(c.isNotNull(), F.coalesce((c - f.lag(c)) * v, F.lit(0.0)))), p["period"])


def vroc(f, x, p):
    return roc(f, x, p)


def pvt(f, x, p):
    c, v = inputs(f, x)
    before = f.lag(c)
    return f.running("sum", f.add(F.when(c.isNotNull(), F.coalesce(F.when(before != 0, (c - before) / F.when(before != 0, before) * v), F.lit(0.0)))))


def _op(name: str, group: str, arity: int, lower, outputs: str = "", kind: str = "window", interior: bool = False, required: tuple[str, ...] = (), **init) -> OpSpec:
    return OpSpec(name, f"indicator.{group}", arity, lower, init, tuple(outputs.split()), kind, required, interior)


OPS = [
    _op("AROON", "trend", 2, aroon, "up down", period=25),
    _op("AROONOSC", "trend", 2, aroonosc, period=25),
    _op("CCI", "trend", 3, cci, period=20),
    _op("VHF", "trend", 1, vhf, period=28),
    _op("DM", "trend", 2, dm, "plus minus", "scan", period=14),
    _op("DI", "trend", 3, di, "plus minus", "scan", True, period=14),
    _op("DX", "trend", 3, dx, "", "scan", True, period=14),
    _op("ADX", "trend", 3, adx, "", "scan", True, period=14),
    _op("ADXR", "trend", 3, adxr, "", "scan", True, period=14),
    stateful("SAR", ParabolicStop, 2, (), "indicator.trend", acceleration=0.02, maximum=0.2),
    _op("VI", "trend", 3, vi, "vi_plus vi_minus", interior=True, period=14),
    _op("ICHIMOKU", "trend", 3, ichimoku, "tenkan kijun senkou_a senkou_b chikou", tenkan_period=9, kijun_period=26, senkou_b_period=52, displacement=26),
    _op("BOP", "momentum", 4, bop, "", "stateless"),
    _op("MOM", "momentum", 1, mom, period=10),
    _op("ROC", "momentum", 1, roc, period=12),
    _op("ROCR", "momentum", 1, rocr, period=12),
    _op("RSI", "momentum", 1, rsi, "", "scan", period=14),
    _op("CMO", "momentum", 1, cmo, period=14),
    _op("WAD", "momentum", 3, wad),
    _op("RVI", "momentum", 4, rvi, "rvi signal", period=10),
    _op("TSI", "momentum", 1, tsi, "tsi signal", "scan", period_fast=13, period_slow=25, period_signal=13),
    _op("BBPOWER", "momentum", 3, bbpower, "bull_power bear_power", "scan", period=13),
    _op("AO", "oscillator", 2, ao),
    _op("APO", "oscillator", 1, apo, "", "scan", period_fast=12, period_slow=26),
    _op("DPO", "oscillator", 1, dpo, period=21),
    _op("Fisher", "oscillator", 2, fisher, "", "scan", period=10),
    _op("MACD", "oscillator", 1, macd, "macd signal histogram", "scan", period_fast=12, period_slow=26, period_signal=9),
    _op("PPO", "oscillator", 1, ppo, "", "scan", period_fast=12, period_slow=26),
    _op("QSTICK", "oscillator", 2, qstick, period=20),
    _op("TRIX", "oscillator", 1, trix, "", "scan", period=15),
    _op("ULTOSC", "oscillator", 3, ultosc, period_fast=7, period_med=14, period_slow=28),
    _op("STOCH", "stochastic", 3, stoch, "k d", k_slowing=3, d_period=3),
    _op("STOCHRSI", "stochastic", 1, stochrsi, "", "scan", period=14),
    _op("WILLR", "stochastic", 3, willr, period=14),
    _op("Volatility", "volatility", 1, volatility, period=20, annualizedDays=250),
    _op("CVI", "volatility", 2, cvi, "", "scan", period=10, period_ema=10),
    _op("MASS", "volatility", 2, mass, "", "scan", period_ema=9, period_sum=25),
    _op("TR", "volatility", 3, tr),
    _op("ATR", "volatility", 3, atr, "", "scan", period=14),
    _op("NATR", "volatility", 3, natr, "", "scan", True, period=14),
    _op("PriceChannel", "volatility", 2, price_channel, "upper lower", required=("period",)),
    _op("BBANDS", "volatility", 1, bbands, "upper middle lower", period=20, Nstddev=2),
    _op("KC", "volatility", 3, kc, "upper middle lower", period=20, multiplier=2),
    _op("DC", "volatility", 2, dc, "upper middle lower", period=20),
    _op("AD", "volume", 4, ad),
    _op("ADOSC", "volume", 4, adosc, "", "scan", period_fast=3, period_slow=10),
    _op("KVO", "volume", 4, kvo, "", "scan", period_fast=34, period_slow=55),
    _op("NVI", "volume", 2, nvi),
    _op("OBV", "volume", 2, obv),
    _op("PVI", "volume", 2, pvi),
    _op("MFI", "volume", 4, mfi, period=14),
    _op("EMV", "volume", 3, emv),
    _op("MarketFI", "volume", 3, market_fi, "", "stateless"),
    _op("VOSC", "volume", 1, vosc, "", "scan", period_fast=5, period_slow=10),
    _op("CMF", "volume", 4, cmf, interior=True, period=20),
    _op("CHO", "volume", 4, adosc, "", "scan", period_fast=3, period_slow=10),
    _op("PVO", "volume", 1, pvo, "pvo signal histogram", "scan", period_fast=12, period_slow=26, period_signal=9),
    _op("FI", "volume", 2, fi, "", "scan", period=13),
    _op("VROC", "volume", 1, vroc, period=25),
    _op("PVT", "volume", 2, pvt),
]
