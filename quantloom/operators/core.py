"""Constants, arithmetic and logic: stateless columns under the strict null rule."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quantloom.operators.spec import OpSpec

#: The divisor that stands for zero.
EPSILON = 2.0**-52
INF, NAN = float("inf"), float("nan")


def _op(name: str, arity: int | None, fn, **more) -> OpSpec:
    return OpSpec(name, "core", arity, lambda frame, x, p: fn(*x), kind="stateless", **more)


def _all(fn):
    return lambda *x: reduce(fn, x)


def _mod(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(NAN)).otherwise(a % b)


def _log(x: Column) -> Column:
    return F.when(x > 0, F.log(x)).when(x == 0, F.lit(-INF)).otherwise(F.lit(NAN))


def _log1p(x: Column) -> Column:
    return F.when(x > -1, F.log1p(x)).when(x == -1, F.lit(-INF)).otherwise(F.lit(NAN))


def _inverse_lerp(a: Column, b: Column, v: Column) -> Column:
    by_zero = F.when(v == a, F.lit(NAN)).when(v > a, F.lit(INF)).otherwise(F.lit(-INF))
    return F.when(b == a, by_zero).otherwise((v - a) / (b - a))


ARITHMETIC = [
    _op("Add", 2, lambda a, b: a + b),
    _op("Sub", 2, lambda a, b: a - b),
    _op("Mul", 2, lambda a, b: a * b),
    _op("Div", 2, lambda a, b: F.when(b == 0, a / F.lit(EPSILON)).otherwise(a / b), doc="a zero divisor is 2**-52"),
    _op("Mod", 2, _mod),
    _op("Pow", 2, lambda a, b: F.pow(a, b)),
    _op("Min", 2, lambda a, b: F.least(a, b)),
    _op("Max", 2, lambda a, b: F.greatest(a, b)),
    _op("Negate", 1, lambda x: -x),
    _op("Abs", 1, lambda x: F.abs(x)),
    _op("Sign", 1, lambda x: F.signum(x)),
    _op("Floor", 1, lambda x: F.floor(x).cast("double")),
    _op("Ceil", 1, lambda x: F.ceil(x).cast("double")),
    _op("Round", 1, lambda x: F.floor(x + 0.5).cast("double"), doc="halves go up"),
    _op("Sqrt", 1, lambda x: F.sqrt(x)),
    _op("Log", 1, _log),
    _op("Exp", 1, lambda x: F.exp(x)),
    _op("Log1p", 1, _log1p),
    _op("Expm1", 1, lambda x: F.expm1(x)),
    _op("Reciprocal", 1, lambda x: F.when(x == 0, F.lit(INF)).otherwise(1 / x)),
    _op("Clamp", 3, lambda x, lo, hi: F.greatest(lo, F.least(hi, x))),
    _op("Lerp", 3, lambda a, b, t: a + t * (b - a)),
    _op("InvLerp", 3, _inverse_lerp),
    _op("SumOf", None, _all(lambda a, b: a + b)),
    _op("ProdOf", None, _all(lambda a, b: a * b)),
    _op("AvgOf", None, lambda *x: reduce(lambda a, b: a + b, x) / len(x) if x else F.lit(0.0)),
    _op("MinOf", None, lambda *x: F.least(*x) if len(x) > 1 else x[0]),
    _op("MaxOf", None, lambda *x: F.greatest(*x) if len(x) > 1 else x[0]),
    _op("RelDist", 2, lambda a, b: F.abs(a - b) / (F.abs(b) + EPSILON)),
]

LOGICAL = [
    _op("LT", 2, lambda a, b: a < b),
    _op("GT", 2, lambda a, b: a > b),
    _op("LTE", 2, lambda a, b: a <= b),
    _op("GTE", 2, lambda a, b: a >= b),
    _op("EQ", 2, lambda a, b: a == b),
    _op("NEQ", 2, lambda a, b: a != b),
    _op("Between", 3, lambda x, lo, hi: x.between(lo, hi)),
    _op("Outside", 3, lambda x, lo, hi: (x < lo) | (x > hi)),
    _op("And", 2, lambda a, b: a & b),
    _op("Or", 2, lambda a, b: a | b),
    _op("Not", 1, lambda x: ~x),
    _op("Xor", 2, lambda a, b: a != b),
    _op("AllOf", None, lambda *x: reduce(lambda a, b: a & b, x) if x else F.lit(True)),
    _op("AnyOf", None, lambda *x: reduce(lambda a, b: a | b, x) if x else F.lit(False)),
    _op("NoneOf", None, lambda *x: ~reduce(lambda a, b: a | b, x) if x else F.lit(True)),
    _op("IsNaN", 1, lambda x: F.isnan(x)),
    _op("IsFinite", 1, lambda x: ~F.isnan(x) & (F.abs(x) != INF)),
    _op("IsPositive", 1, lambda x: x > 0),
    _op("IsNegative", 1, lambda x: x < 0),
    _op("IsZero", 1, lambda x: x == 0),
    _op("IfThenElse", 3, lambda c, a, b: F.when(c, a).otherwise(b)),
    _op("Gate", 2, lambda c, x: F.when(c, x), interior_nulls=True, doc="the value where the condition holds"),
    _op("Coalesce", None, lambda *x: x[0], doc="under the strict rule the first input"),
]

CONST = OpSpec("Const", "core", 0, lambda frame, x, p: F.lit(float(p["value"]) if not isinstance(p["value"], bool) else p["value"]), kind="stateless", required=("value",))

OPS = [CONST, *ARITHMETIC, *LOGICAL]
