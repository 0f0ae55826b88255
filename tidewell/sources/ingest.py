"""From raw items to rows: JSON paths, mapping, coercion, acceptance, change envelopes, snapshots."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions import values as V

CONVERT = {V.STRING: V.to_string, V.DOUBLE: V.to_double, V.LONG: V.to_long, V.BOOL: V.to_bool, V.TIMESTAMP: V.to_timestamp}


def parse_path(path: str) -> tuple:
    """Steps of $ .name ['name'] [n] [*]; anything else is refused."""
    if not path.startswith("$"):
        raise ValueError(f"a path starts with $: {path}")
    steps, i = [], 1
    step = re.compile(r"\.([A-Za-z_][\w-]*)|\['([^']*)'\]|\[(\d+)\]|\[(\*)\]")
    while i < len(path):
        m = step.match(path, i)
        if not m:
            raise ValueError(f"can't read {path!r} from {path[i:]!r}")
        steps.append("*" if m[4] else int(m[3]) if m[3] is not None else m[1] if m[1] is not None else m[2])
        i = m.end()
    return tuple(steps)


def _getter(steps: tuple):
    return lambda x: V.json_get(x, steps)


def select_path(text: Column, path: str) -> Column:
    """array of JSON texts that the path finds; [*] spreads arrays."""
    steps = parse_path(path)
    found, run = F.array(text), []
    for s in [*steps, None]:
        if s == "*" or s is None:
            if run:
                found = F.filter(F.transform(found, _getter(tuple(run))), lambda x: x.isNotNull())
                run = []
            if s == "*":
                found = F.flatten(F.filter(F.transform(found, V.json_array), lambda x: x.isNotNull()))
        else:
            run.append(s)
    return found


def map_records(df: DataFrame, col: str, items: str, fields: dict[str, tuple[str, str]], ts: str | None = None) -> DataFrame:
    """Rows from documents: items is a path that spreads them; fields is {name: (path, kind)}; ts is the path of the event time."""
    spread = df.select(F.explode(select_path(F.col(col), items)).alias("__item"))

    def one(path: str, kind: str) -> Column:
        steps = parse_path(path)
        if kind == V.JSON:
            return V.json_get(F.col("__item"), steps)
        return CONVERT[kind](V.json_text(F.col("__item"), steps), V.STRING)

    time = [one(ts, V.TIMESTAMP).alias("_ts")] if ts else []
    return spread.select(*[one(p, k).alias(n) for n, (p, k) in fields.items()], *time)


def coerce(df: DataFrame, fields: dict[str, str], policy: str = "null") -> DataFrame:
    """Text columns into declared kinds. A value that doesn't convert is NULL; under "drop" its row goes; under "reject" the batch fails."""
    done = {n: CONVERT[k](F.col(n), V.STRING) for n, k in fields.items()}
    bad = [F.col(n).isNotNull() & c.isNull() for n, c in done.items()]
    failed = bad[0]
    for b in bad[1:]:
        failed = failed | b
    if policy == "drop":
        df = df.filter(~failed)
    elif policy == "reject" and df.filter(failed).limit(1).count():
        raise ValueError("a value doesn't fit its declared kind")
    return df.withColumns(done)


def accept(df: DataFrame, name: str, fields: dict[str, str], ts: str | None, arrival_ms: Column, unknown: str = "drop") -> DataFrame:
    """Pushed rows: coerced, unknown fields dropped (or refused), _ts from ts or the time of arrival, _source overwritten, _retract kept as a flag."""
    extra = [c for c in df.columns if c not in fields and c not in ("_ts", "_source", "_retract")]
    if extra and unknown == "reject":
        raise ValueError(f"unknown fields {extra}")
    rows = coerce(df, fields)
    time = V.to_timestamp(df[ts].cast("string"), V.STRING) if ts else F.lit(None).cast("bigint")
    retract = F.coalesce(F.col("_retract").cast("boolean"), F.lit(False)) if "_retract" in df.columns else F.lit(False)
    return rows.select(*fields, F.coalesce(time, arrival_ms).alias("_ts"), F.lit(name).alias("_source"), retract.alias("_retract"))


def cdc_unwrap(df: DataFrame, col: str) -> DataFrame:
    """Row image (JSON text), _op, _weight and _ts of change envelopes; tombstones (NULL or without an image) are skipped.

    The envelope may be bare, under "payload", or an already flattened row, which counts as a read.
    """
    raw = F.col(col)
    inner = F.coalesce(V.json_get(raw, ("payload",)), raw)
    op = V.json_text(inner, ("op",))
    shaped = op.isNotNull()
    image = F.when(~shaped, inner).when(op == "d", V.json_get(inner, ("before",))).otherwise(V.json_get(inner, ("after",)))
    out = df.withColumns({"__op": F.when(shaped, op).otherwise("r"), "__row": image, "__t": V.to_long(V.json_text(inner, ("ts_ms",)), V.STRING)})
    rest = [c for c in df.columns if c != col]
    return out.filter("__row is not null").select(*rest, F.col("__row").alias("row"), F.col("__op").alias("_op"), F.when(F.col("__op") == "d", -1).otherwise(1).cast("long").alias("_weight"), F.col("__t").alias("_ts"))


def snapshot_diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """What turns one keyed snapshot into the next: creates and updates with the new row, deletions with the key only and _retract."""
    values = [c for c in new.columns if c not in keys]
    a = old.select(*keys, F.struct(*values).alias("__old"))
    b = new.select(*keys, F.struct(*values).alias("__new"))
    both = a.join(b, keys, "full")
    kind = F.when(F.col("__old").isNull(), "create").when(F.col("__new").isNull(), "delete").when(~F.col("__old").eqNullSafe(F.col("__new")), "update")
    out = both.withColumn("_change", kind).filter("_change is not null")
    return out.select(*keys, *[F.col("__new")[v].alias(v) for v in values], "_change", (F.col("_change") == "delete").alias("_retract"))


def db_poll(df: DataFrame, cursor: str, after: Column | None, limit: int, where: Column | None = None, inclusive: bool = False) -> DataFrame:
    """The next page of an incremental poll: rows past the cursor, in its order. Filters and the bound reach the source's scan."""
    rows = df if where is None else df.filter(where)
    if after is not None:
        rows = rows.filter(F.col(cursor) >= after if inclusive else F.col(cursor) > after)
    return rows.orderBy(cursor).limit(limit)


def replay_from(log: DataFrame, seq: int | None = None, ts: int | None = None) -> DataFrame:
    """The part of a replay log from a sequence number or an event time on."""
    return log.filter(F.col("_seq") >= seq) if seq is not None else log.filter(F.col("_ts") >= ts)
