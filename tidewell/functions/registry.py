"""Scalar functions of the dialect and the registry for more.

A function maps typed arguments to a typed Column, so everything stays in generated code but the normal distribution. Built-ins
can't be replaced; registered names replace each other.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.functions import quant
from tidewell.functions import values as V
from tidewell.sql.tree import DialectError


@dataclass(frozen=True)
class Typed:
    """A column, its kind, and for a JSON node its base text and the steps into it."""

    col: Column
    kind: str
    base: Column | None = None
    steps: tuple = ()


@dataclass(frozen=True)
class Function:
    name: str
    least: int
    most: int | None
    build: Callable[[Sequence[Typed]], Typed]


def as_double(x: Typed) -> Column:
    return V.to_double(x.col, x.kind) if x.kind in (V.STRING, V.JSON) else x.col.cast("double") if x.kind in V.NUMBERS else F.lit(None).cast("double")


def number(x: Typed) -> Typed:
    """A JSON leaf read as a number; other kinds as they are."""
    return Typed(V.json_number(x.col), V.DOUBLE) if x.kind == V.JSON else x


def common_kind(kinds: Sequence[str]) -> str | None:
    known = {V.LONG if k == V.TIMESTAMP and len({*kinds}) > 1 else k for k in kinds if k != V.NULL}
    if not known:
        return V.NULL
    if len(known) == 1:
        return known.pop()
    return V.DOUBLE if known <= {V.LONG, V.DOUBLE} else None


def cast_kind(x: Typed, kind: str) -> Column:
    return x.col if x.kind == kind else x.col.cast(V.SPARK[kind])


def _abs(a):
    x = number(a[0])
    if x.kind not in V.NUMBERS:
        return Typed(F.lit(None).cast("double"), V.DOUBLE)
    return Typed(F.when(x.col >= 0, x.col).otherwise(F.try_subtract(F.lit(0).cast(V.SPARK[x.kind]), x.col)) if x.kind != V.DOUBLE else F.abs(x.col), x.kind)


def _round(a):
    x = number(a[0])
    if x.kind not in V.NUMBERS:
        return Typed(F.lit(None).cast("double"), V.DOUBLE)
    digits = F.greatest(a[1].col.cast("int"), F.lit(0)) if len(a) > 1 else F.lit(0)
    # half away from zero; 10^digits is exact in a double as far as it matters
    scale = F.pow(F.lit(10.0), digits)
    v = x.col.cast("double")
    return Typed(F.when(F.abs(v) < 1e15, F.signum(v) * F.floor(F.abs(v) * scale + 0.5) / scale).otherwise(v), V.DOUBLE)


def _case(change):
    return lambda a: Typed(change(a[0].col) if a[0].kind == V.STRING else F.lit(None).cast("string"), V.STRING)


def _coalesce(a):
    xs = [number(x) if x.kind == V.JSON and any(y.kind in V.NUMBERS for y in a) else x for x in a]
    kind = common_kind([x.kind for x in xs])
    if kind is None:
        kind = next(x.kind for x in xs if x.kind != V.NULL)
        xs = [x for x in xs if x.kind in (kind, V.NULL)]
    return Typed(F.coalesce(*[cast_kind(x, kind) for x in xs]), kind)


def _if(a):
    kind = common_kind([a[1].kind, a[2].kind])
    if kind is None:
        raise DialectError(f"branches have kinds {a[1].kind} and {a[2].kind}")
    return Typed(F.when(a[0].col, cast_kind(a[1], kind)).otherwise(cast_kind(a[2], kind)), kind)


def _to_string(a):
    if a[0].kind == V.TIMESTAMP:
        return Typed(F.date_format(F.timestamp_millis(a[0].col), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), V.STRING)
    return Typed(V.to_string(a[0].col, a[0].kind), V.STRING)


def _convert(how, kind):
    return lambda a: Typed(how(a[0].col, a[0].kind), kind)


BUILT_IN = {
    f.name: f
    for f in (
        Function("ABS", 1, 1, _abs), Function("ROUND", 1, 2, _round), Function("UPPER", 1, 1, _case(F.upper)), Function("LOWER", 1, 1, _case(F.lower)),
        Function("COALESCE", 1, None, _coalesce), Function("IF", 3, 3, _if), Function("TO_LONG", 1, 1, _convert(V.to_long, V.LONG)),
        Function("TO_DOUBLE", 1, 1, _convert(V.to_double, V.DOUBLE)), Function("TO_BOOL", 1, 1, _convert(V.to_bool, V.BOOL)),
        Function("TO_TIMESTAMP", 1, 1, _convert(V.to_timestamp, V.TIMESTAMP)), Function("TO_STRING", 1, 1, _to_string),
    )
}
REGISTERED: dict[str, Function] = {}


def register(name: str, arity: int, build: Callable[..., Column], kind: str = V.DOUBLE) -> None:
    """A scalar function over doubles: build gets Columns and gives a Column that is NULL where it isn't defined."""
    name = name.upper()
    if name in BUILT_IN or name in AGGREGATES:
        raise ValueError(f"{name} is built in and can't be replaced")
    REGISTERED[name] = Function(name, arity, arity, lambda a: Typed(build(*[as_double(x) if x.kind != V.BOOL else x.col.cast("double") for x in a]), kind))


def names() -> list[str]:
    return sorted([*BUILT_IN, *REGISTERED])


#: Aggregates by name, with what they are called by default.
AGGREGATES = {"COUNT", "SUM", "AVG", "MIN", "MAX", "VAR_SAMP", "VARIANCE", "VAR", "VAR_POP", "STDDEV_SAMP", "STDDEV", "STDEV", "STDDEV_POP", "MEDIAN", "PERCENTILE_CONT"}
#: Aggregates that a caller added: name -> (Typed -> Column).
USER_AGGREGATES: dict[str, Callable[[Typed], Column]] = {}


def register_aggregate(name: str, build: Callable[[Column], Column]) -> None:
    name = name.upper()
    if name in AGGREGATES or name in BUILT_IN:
        raise ValueError(f"{name} is built in and can't be replaced")
    USER_AGGREGATES[name] = lambda x: build(x.col)


def aggregate(name: str, args: Sequence[Typed], distinct: bool) -> Typed:
    """An aggregate over already built arguments (COUNT(*) has none)."""
    if name in USER_AGGREGATES:
        return Typed(USER_AGGREGATES[name](args[0]), V.DOUBLE)
    if distinct and name != "COUNT":
        raise DialectError("DISTINCT is for COUNT only")
    if name == "COUNT":
        if not args:
            return Typed(F.count(F.lit(1)), V.LONG)
        return Typed((F.count_distinct if distinct else F.count)(args[0].col), V.LONG)
    if name == "PERCENTILE_CONT":
        p, x = args
        return Typed(F.percentile(as_double(x), p.col), V.DOUBLE)
    x = args[0]
    if name in ("MIN", "MAX"):
        x = number(x)
        return Typed((F.min if name == "MIN" else F.max)(x.col), x.kind)
    # Text never sums, whatever it looks like.
    v = V.json_number(x.col) if x.kind == V.JSON else x.col if x.kind in V.NUMBERS else F.lit(None).cast("double")
    if name == "SUM":
        return Typed(F.try_sum(v), V.LONG) if x.kind in (V.LONG, V.TIMESTAMP) else Typed(F.sum(v.cast("double")), V.DOUBLE)
    v = v.cast("double")
    how = {"AVG": F.avg, "VAR_POP": F.var_pop, "STDDEV_POP": F.stddev_pop, "MEDIAN": F.median}.get(name) or (F.var_samp if name.startswith("VAR") else F.stddev_samp)
    return Typed(how(v), V.DOUBLE)


for _name, (_arity, _build) in quant.FUNCTIONS.items():
    register(_name, _arity, _build)
