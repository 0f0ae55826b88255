"""Kinds of values and total conversions between them: a bad value is NULL, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

STRING, DOUBLE, LONG, BOOL, TIMESTAMP, JSON, NULL = "string", "double", "long", "bool", "timestamp", "json", "null"
NUMBERS = {DOUBLE, LONG, TIMESTAMP}
SPARK = {STRING: "string", DOUBLE: "double", LONG: "bigint", BOOL: "boolean", TIMESTAMP: "bigint", JSON: "string", NULL: "string"}
#: Text that reads as a number: an optional sign, digits with or without commas, a fraction, an exponent.
NUMBER_TEXT = r"^\s*[+-]?(\d[\d,]*(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"


def kind_of(t: T.DataType) -> str:
    match t:
        case T.StringType():
            return STRING
        case T.BooleanType():
            return BOOL
        case T.DoubleType() | T.FloatType() | T.DecimalType():
            return DOUBLE
        case T.ByteType() | T.ShortType() | T.IntegerType() | T.LongType():
            return LONG
        case T.TimestampType() | T.TimestampNTZType() | T.DateType():
            return TIMESTAMP
    return JSON


def narrow(c: Column, t: T.DataType) -> Column:
    """A column of any Spark type in the representation of its kind."""
    kind = kind_of(t)
    if kind == TIMESTAMP:
        return F.unix_millis(c.cast("timestamp"))
    if kind == JSON:
        return F.to_json(c if isinstance(t, (T.ArrayType, T.StructType, T.MapType, T.VariantType)) else F.struct(c))
    return c.cast(SPARK[kind])


def double_text(x: Column) -> Column:
    """The shortest text that reads back as x: plain from 0.0001 up to 1E+15, else with a signed exponent of two digits."""
    raw = F.abs(x).cast("string")
    mantissa = F.regexp_extract(raw, r"^([\d.]+)", 1)
    exponent = F.coalesce(F.regexp_extract(raw, r"E(-?\d+)$", 1).try_cast("int"), F.lit(0))
    whole = F.substring_index(mantissa, ".", 1)
    every = F.concat(whole, F.when(F.instr(mantissa, ".") > 0, F.substring_index(mantissa, ".", -1)).otherwise(""))
    lead = F.length(F.regexp_extract(every, "^(0*)", 1))
    digits = F.regexp_replace(F.regexp_replace(every, "^0+", ""), "0+$", "")
    n = F.length(digits)
    point = F.length(whole) + exponent - lead  # digits before the point
    plain = (
        F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
        .when(point >= n, F.concat(digits, F.repeat(F.lit("0"), point - n)))
        .otherwise(F.concat(F.substr(digits, F.lit(1), point), F.lit("."), F.substr(digits, point + 1, n)))
    )
    e = point - 1
    scientific = F.concat(F.substr(digits, F.lit(1), F.lit(1)), F.when(n > 1, F.concat(F.lit("."), F.substr(digits, F.lit(2), n))).otherwise(""), F.lit("E"), F.when(e < 0, "-").otherwise("+"), F.lpad(F.abs(e).cast("string"), 2, "0"))
    text = F.when(n == 0, F.lit("0")).when((e > -5) & (e < 15), plain).otherwise(scientific)
    return (
        F.when(F.isnan(x), "NaN").when(x == float("inf"), "Infinity").when(x == float("-inf"), "-Infinity").when(x.isNull(), None)
        .otherwise(F.concat(F.when(x.cast("string").startswith("-"), "-").otherwise(""), text))
    )


def to_long(c: Column, kind: str) -> Column:
    if kind == DOUBLE:
        return F.when(~F.isnan(c) & (F.abs(c) < 9.223372036854775e18), c.try_cast("bigint"))
    if kind == JSON:
        return to_long(json_number(c), DOUBLE)
    if kind == STRING:
        return F.when(F.rlike(c, F.lit(r"^\s*[+-]?\d+\s*$")), F.trim(c).try_cast("bigint"))
    return c.try_cast("bigint")


def to_double(c: Column, kind: str) -> Column:
    if kind == STRING:
        return F.when(F.rlike(c, F.lit(NUMBER_TEXT)), F.regexp_replace(F.trim(c), ",", "").try_cast("double"))
    if kind == JSON:
        return json_number(c)
    return c.try_cast("double") if kind != BOOL else c.cast("int").cast("double")


def to_bool(c: Column, kind: str) -> Column:
    if kind in NUMBERS:
        return c != 0
    if kind == BOOL:
        return c
    t = F.lower(c)
    return F.when(t == "true", True).when(t == "false", False).otherwise(~c.isin("", "0"))


def to_timestamp(c: Column, kind: str) -> Column:
    if kind == STRING:
        return F.coalesce(to_long(c, STRING), F.unix_millis(F.try_to_timestamp(F.when(F.rlike(c, F.lit(r"^\s*\d{4}-\d\d")), c))))
    return to_long(c, kind)


def to_string(c: Column, kind: str) -> Column:
    if kind == DOUBLE:
        return double_text(c)
    return c.cast("string")


def variant(text: Column) -> Column:
    return F.try_parse_json(text)


def json_number(text: Column) -> Column:
    """The number that a JSON text is, else NULL: text never counts as a number."""
    return F.regexp_extract(text, r"^\s*(-?\d.*)$", 1).try_cast("double")  # names its argument once, which may be a parse


def json_path(steps: tuple) -> str:
    return "$" + "".join(f"[{s}]" if isinstance(s, int) else "['" + s.replace("\\", "\\\\").replace("'", "\\'") + "']" for s in steps)


def json_get(text: Column, steps: tuple) -> Column:
    """The node as compact JSON text; NULL where it is missing or null."""
    if not steps:
        return text
    node = F.to_json(F.try_variant_get(variant(text), json_path(steps), "variant"))
    return F.when(node != "null", node)


def json_text(text: Column, steps: tuple) -> Column:
    """The node as text: strings without quotes, numbers and composites as compact JSON, null as NULL."""
    return F.get_json_object(text, json_path(steps))


def json_array(text: Column) -> Column:
    """A JSON array's elements as JSON texts, in order; NULL for anything else."""
    nodes = F.try_variant_get(F.when(F.rlike(text, F.lit(r"^\s*\[")), variant(text)), "$", "array<variant>")
    return F.transform(nodes, lambda x: F.to_json(x))
