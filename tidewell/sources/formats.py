"""Text formats as row sources. All parse inside Spark; a bad line is an error that names it, or is skipped and counted."""

from __future__ import annotations

import csv
import io
import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Field separators of the tag=value format: SOH, bar, caret. Fixed by the format.
FIX_DELIMITERS = "\x01|^"
DELIMITERS = ",\t;|"
#: Items that schema inference looks at.
INFER_ITEMS = 100


def ndjson(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """One JSON document per line that isn't blank; malformed lines fail the read."""
    r = spark.read.option("mode", "FAILFAST")
    return (r.schema(schema) if schema else r).json(path)


def ndjson_rows(lines: DataFrame, schema: str, col: str = "value") -> DataFrame:
    """The same over a column of lines; blank ones are skipped, malformed ones give a row of NULLs."""
    return lines.filter(F.length(F.trim(col)) > 0).select(F.from_json(col, schema).alias("__r")).select("__r.*")


def csv_rows(lines: DataFrame, names: list[str], delimiter: str = ",", col: str = "value") -> DataFrame:
    """Cells of delimited lines as text; short lines are padded with ""."""
    schema = ", ".join(f"`{n}` string" for n in names)
    parsed = lines.select(F.from_csv(col, schema, {"sep": delimiter, "quote": '"', "escape": '"'}).alias("__r"))
    return parsed.select(*[F.coalesce(F.col("__r")[n], F.lit("")).alias(n) for n in names])


def json_document(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """Files that hold an array of items, or one object, which counts as one item."""
    r = spark.read.option("multiLine", True).option("mode", "FAILFAST")
    return (r.schema(schema) if schema else r).json(path)


def sniff_delimiter(header: str) -> str:
    """The candidate that cuts the header line into most cells outside quotes; a comma if none does."""
    bare = re.sub(r'"(?:[^"]|"")*"', "", header)
    return max(DELIMITERS, key=lambda d: (bare.count(d), -DELIMITERS.index(d))) if any(d in bare for d in DELIMITERS) else ","


def csv_files(spark: SparkSession, path: str, delimiter: str | None = None) -> DataFrame:
    """CSV with a header row and RFC 4180 quotes, every cell as text.

    The delimiter is sniffed on the first line; of repeated headers the last wins; short rows are padded with "".
    """
    first = spark.read.text(path).limit(1).collect()
    header = first[0].value if first else ""
    delimiter = delimiter or sniff_delimiter(header)
    names = next(csv.reader(io.StringIO(header), delimiter=delimiter), [])
    inner = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    df = spark.read.csv(path, sep=delimiter, header=True, quote='"', escape='"', multiLine=True, schema=inner, enforceSchema=True, nullValue="\x00")
    last = {n: i for i, n in enumerate(names)}
    return df.select(*[F.coalesce(F.col(f"c{i}"), F.lit("")).alias(n) for n, i in last.items()])


def cell_value(text: Column) -> Column:
    """struct(l, d, b, s) with one field set: a cell reads as a long, else a double, else a boolean, else text."""
    n = F.when(F.rlike(text, F.lit(r"^[+-]?\d+$")), text.try_cast("bigint"))
    d = F.when(n.isNull() & F.rlike(text, F.lit(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")), text.try_cast("double"))
    b = F.when(F.lower(text).isin("true", "false"), F.lower(text) == "true")
    s = F.when(n.isNull() & d.isNull() & b.isNull(), text)
    return F.struct(n.alias("l"), d.alias("d"), b.alias("b"), s.alias("s"))


def fix_fields(message: Column) -> Column:
    """map of tag to value of a delimited tag=value message; pieces without '=' are left out, of repeated tags the last wins."""
    parts = F.filter(F.split(message, f"[{re.escape(FIX_DELIMITERS)}]"), lambda p: F.instr(p, "=") > 1)
    entries = F.transform(parts, lambda p: F.struct(F.substring_index(p, "=", 1).alias("key"), F.substr(p, F.instr(p, "=") + 1).alias("value")))
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    value = lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"]
    return F.map_from_arrays(keys, F.transform(keys, value))


def fix_messages(lines: DataFrame, tags: dict[str, str], col: str = "value") -> DataFrame:
    """A row per message with the named tags: {column: tag number}."""
    m = lines.select(fix_fields(F.col(col)).alias("m"))
    return m.select(*[F.col("m")[tag].alias(name) for name, tag in tags.items()])


def infer_kinds(items: list[str], limit: int = INFER_ITEMS) -> list[tuple[str, str]]:
    """Ordered (field, kind) of JSON object texts, by notation: 5 is a long, 5.0 a double, an ISO text a timestamp.

    Long and double make double; any other mixture, and nested values, make json or string.
    """
    kinds: dict[str, str | None] = {}
    iso = re.compile(r"^\d{4}-\d\d-\d\d([T ]\d\d:\d\d(:\d\d(\.\d+)?)?(Z|[+-]\d\d:?\d\d)?)?$")
    for text in items[:limit]:
        value = json.loads(text)
        if not isinstance(value, dict):
            continue
        for name, v in value.items():
            kind = None
            if isinstance(v, bool):
                kind = "bool"
            elif isinstance(v, int):
                kind = "long"
            elif isinstance(v, float):
                kind = "double"
            elif isinstance(v, str):
                kind = "timestamp" if iso.match(v) else "string"
            elif v is not None:
                kind = "json"
            old = kinds.get(name)
            if kind is None or old is None or old == kind:
                kinds[name] = kind or old
            elif {old, kind} <= {"long", "double"}:
                kinds[name] = "double"
            elif "json" in (old, kind):
                kinds[name] = "json"
            else:
                kinds[name] = "string"
    return [(n, k or "string") for n, k in kinds.items()]
