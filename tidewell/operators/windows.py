"""Event-time windows over epoch-millisecond columns, aligned to the epoch (negative times included)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewell.sql.tree import DialectError


def tumbling(df: DataFrame, ts: str, size: int) -> DataFrame:
    """Adds window_start and window_end; arithmetic only, so it stays in the scan's stage."""
    start = F.col(ts) - F.pmod(F.col(ts), F.lit(size))
    return df.withColumns({"window_start": start, "window_end": start + size})


def hopping(df: DataFrame, ts: str, size: int, advance: int) -> DataFrame:
    """One row for every window that holds the row; none where advance > size leaves a gap."""
    into = F.pmod(F.col(ts), F.lit(advance))
    count = F.floor((F.lit(size - 1) - into) / advance) + 1
    steps = F.when(count > 0, F.sequence(F.lit(0).cast("long"), count - 1)).otherwise(F.array().cast("array<bigint>"))
    out = df.withColumn("__hop", F.explode(steps))
    start = F.col(ts) - F.pmod(F.col(ts), F.lit(advance)) - F.col("__hop") * advance
    return out.withColumns({"window_start": start, "window_end": start + size}).drop("__hop")


def session(df: DataFrame, ts: str, gap: int, keys: list[str]) -> DataFrame:
    """Adds window_start and window_end (first and last event time); a row extends a session up to `gap` after its last, inclusively.

    Rows of one key in the same gap-long bucket of time are always in one session. So each bucket comes down to its first and
    last time by a map-side-combined aggregate, only buckets are put in order, and rows meet their session by key and bucket.
    """
    bucket = F.floor(F.col(ts) / max(gap, 1))
    held = df.groupBy(*keys, bucket.alias("__bucket")).agg(F.min(ts).alias("__lo"), F.max(ts).alias("__hi"))
    order = W.partitionBy(*keys).orderBy("__bucket")
    broken = F.when(F.col("__lo") - F.lag("__hi").over(order) <= gap, 0).otherwise(1)
    numbered = held.withColumn("__break", broken).withColumn("__session", F.sum("__break").over(order.rowsBetween(W.unboundedPreceding, 0)))
    whole = W.partitionBy(*keys, "__session")
    bounds = numbered.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__bucket").alias("__b"), F.min("__lo").over(whole).alias("window_start"), F.max("__hi").over(whole).alias("window_end"))
    same = bucket.eqNullSafe(F.col("__b"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return df.join(bounds, same).drop("__b", *[f"__k{i}" for i in range(len(keys))])


def assign(df: DataFrame, ts: str, kind: str, size: int, advance: int | None = None, keys: list = ()) -> DataFrame:
    if kind == "tumbling":
        return tumbling(df, ts, size)
    if kind == "hopping":
        return hopping(df, ts, size, advance)
    return session(df, ts, size, list(keys))


def stream_window(df: DataFrame, time: str, kind: str, size: int, advance: int | None = None) -> DataFrame:
    """Adds __window, Spark's own, over a watermarked time: what closes windows of a stream and frees their state."""
    if kind == "session":  # events exactly the gap apart are in one session, so Spark's exclusive gap gets a millisecond more
        return df.withColumn("__window", F.session_window(time, f"{size + 1} milliseconds"))
    if advance is not None and advance > size:
        raise DialectError("a stream's hopping windows leave no gaps")
    return df.withColumn("__window", F.window(time, f"{size} milliseconds", f"{advance or size} milliseconds"))


def stream_bounds(df: DataFrame, kind: str) -> DataFrame:
    """window_start and window_end of rows grouped by __window, with __first and __last event time for sessions."""
    start, end = ("__first", "__last") if kind == "session" else (F.unix_millis("__window.start"), F.unix_millis("__window.end"))
    return df.withColumns({"window_start": F.col(start) if kind == "session" else start, "window_end": F.col(end) if kind == "session" else end}).drop("__window", "__first", "__last")


def emit_changes(df: DataFrame, ts: str, size: int, keys: list[str], arrival: str, running: dict[str, Column]) -> DataFrame:
    """Tumbling windows that show every step: a row with running values for each event (_final false), and one per window (_final true).

    running maps names to aggregate expressions, which are taken over the events that arrived so far.
    """
    w = tumbling(df, ts, size)
    group = [*keys, "window_start", "window_end"]
    so_far = W.partitionBy(*group).orderBy(arrival).rowsBetween(W.unboundedPreceding, 0)
    steps = w.select(*group, F.col(arrival).alias("_arrival"), *[c.over(so_far).alias(n) for n, c in running.items()], F.lit(False).alias("_final"))
    finals = w.groupBy(*group).agg(*[c.alias(n) for n, c in running.items()]).withColumns({"_final": F.lit(True), "_arrival": F.lit(None).cast("long")})
    return steps.unionByName(finals)
