"""Structured Streaming forms of the operators.

Times are epoch milliseconds in column `_ts`. The watermark trails the greatest event time by a second. With
several inputs the greatest watermark counts: one_watermark() says so to the session. Session.stream() compiles a statement to these forms.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.operators import zset

DELAY = "1 second"


def one_watermark(spark: SparkSession) -> None:
    """One watermark for all inputs of a query, the greatest, as the dialect has it."""
    spark.conf.set("spark.sql.streaming.multipleWatermarkPolicy", "max")


def with_event_time(stream: DataFrame, delay: str = DELAY) -> DataFrame:
    """Adds the event-time column that watermarks need, as a timestamp."""
    return stream.withColumn("_time", F.timestamp_millis("_ts")).withWatermark("_time", delay)


def windowed(stream: DataFrame, size_ms: int, keys: list[str], aggs: dict[str, Column], slide_ms: int | None = None, delay: str = DELAY) -> DataFrame:
    """Tumbling or hopping windows in append mode: one row per window once the watermark reaches its end."""
    span = F.window("_time", f"{size_ms} milliseconds", f"{slide_ms or size_ms} milliseconds")
    out = with_event_time(stream, delay).groupBy(span, *keys).agg(*[c.alias(n) for n, c in aggs.items()])
    return out.select(*keys, *aggs, F.unix_millis("window.start").alias("window_start"), F.unix_millis("window.end").alias("window_end"))


def sessions(stream: DataFrame, gap_ms: int, keys: list[str], aggs: dict[str, Column], delay: str = DELAY) -> DataFrame:
    """Session windows that events exactly gap_ms apart share: Spark's gap is exclusive, so it gets one millisecond more."""
    span = F.session_window("_time", f"{gap_ms + 1} milliseconds")
    out = with_event_time(stream, delay).groupBy(span, *keys).agg(F.min("_ts").alias("window_start"), F.max("_ts").alias("window_end"), *[c.alias(n) for n, c in aggs.items()])
    return out.select(*keys, *aggs, "window_start", "window_end")


def interval_join(left: DataFrame, right: DataFrame, key: str, within_ms: int, how: str = "inner", delay: str = DELAY) -> DataFrame:
    """Stream-stream join on key and |time difference| <= within_ms; both watermarks bound the state and release padded rows."""
    a = with_event_time(left, delay).select(*[F.col(c).alias(f"l_{c}") for c in [*left.columns, "_time"]])
    b = with_event_time(right, delay).select(*[F.col(c).alias(f"r_{c}") for c in [*right.columns, "_time"]])
    d = F.expr(f"interval {within_ms} milliseconds")
    on = (F.col(f"l_{key}") == F.col(f"r_{key}")) & (F.col("r__time") >= F.col("l__time") - d) & (F.col("r__time") <= F.col("l__time") + d)
    return a.join(b, on, {"left": "leftOuter", "right": "rightOuter", "full": "fullOuter"}.get(how, how)).drop("l__time", "r__time")


def dedup(stream: DataFrame, key: str, delay: str = DELAY) -> DataFrame:
    return with_event_time(stream, delay).dropDuplicatesWithinWatermark([key]).drop("_time")


def changelog_writer(path: str, columns: list[str]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: nets each batch's deltas and writes them as one epoch.

    The epoch's folder is replaced as a whole, so a repeated batch id (a retry) leaves one copy.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        zset.consolidate(batch, columns).write.mode("overwrite").parquet(f"{path}/_epoch={epoch}")

    return write


def snapshot(spark: SparkSession, path: str, columns: list[str], upto: int | None = None) -> DataFrame:
    """The table that a changelog describes, now or as of an epoch. Only the epochs needed are read."""
    log = spark.read.parquet(path)
    return zset.snapshot(log if upto is None else log.filter(F.col("_epoch") <= upto), columns)


def deltas_after(spark: SparkSession, path: str, epoch: int) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("_epoch") > epoch)


def latest_by(stream: DataFrame, keys: list[str], order: str = "_ts") -> DataFrame:
    """Every change of the newest row per key, in update mode; ties go to the later row of the stream, and no time is the oldest.

    State is one row per key.
    """
    plain = [f"c{i}" for i in range(len(stream.columns))]  # the state function doesn't take names with dots
    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(plain, stream.schema.fields, strict=True)])
    at = stream.columns.index(order)
    longs = [isinstance(f.dataType, T.IntegralType) for f in schema.fields]

    def advance(k, batches, state):
        import pandas as pd

        best, changed = (state.get if state.exists else None), False
        for b in batches:
            times = b.iloc[:, at]
            i = len(b) - 1 if times.isna().all() else len(b) - 1 - int(times[::-1].reset_index(drop=True).idxmax())
            row = tuple(None if pd.isna(x) else int(x) if whole else x.item() if hasattr(x, "item") else x for x, whole in zip((b.iloc[i, j] for j in range(b.shape[1])), longs, strict=True))
            if best is None or best[at] is None or row[at] is not None and row[at] >= best[at]:
                best, changed = row, True
        if changed:
            state.update(best)
            yield pd.DataFrame([best], columns=plain).astype({n: "Int64" for n, whole in zip(plain, longs, strict=True) if whole})

    named = stream.toDF(*plain)
    out = named.groupBy(*[plain[stream.columns.index(k)] for k in keys]).applyInPandasWithState(advance, schema, schema, "update", "NoTimeout")
    return out.toDF(*stream.columns)


def emit_changes(stream: DataFrame, key: str, value: str, size_ms: int, key_type: str = "string", delay: str = DELAY) -> DataFrame:
    """One row per event with its tumbling window's running count and sum (update mode), and a final one when the watermark passes the window.

    A sum over no values is NULL. A window's state goes with its final row; events of a window that has closed are dropped.
    """
    out = f"{key} {key_type}, window_start bigint, window_end bigint, n bigint, total double, _final boolean"
    names = ["key", "window_start", "window_end", "n", "total", "_final"]

    def advance(k, batches, state):
        import pandas as pd

        start = int(k[1])
        end = start + size_ms
        if state.hasTimedOut:
            n, total = state.get
            state.remove()
            yield pd.DataFrame([(k[0], start, end, n, total, True)], columns=names).rename(columns={"key": key})
            return
        if end <= state.getCurrentWatermarkMs():
            return
        n, total = state.get if state.exists else (0, None)
        rows = []
        for b in batches:
            for v in b[value]:
                n += 1
                total = total if pd.isna(v) else (total or 0.0) + float(v)
                rows.append((k[0], start, end, n, total, False))
        state.update((n, total))
        state.setTimeoutTimestamp(end)
        yield pd.DataFrame(rows, columns=names).rename(columns={"key": key})

    windowed_rows = with_event_time(stream, delay).withColumn("__start", F.col("_ts") - F.pmod(F.col("_ts"), F.lit(size_ms)))
    return windowed_rows.groupBy(key, "__start").applyInPandasWithState(advance, out, "n bigint, total double", "update", "EventTimeTimeout")


class StrictLateness:
    """foreachBatch helper that drops late rows by the dialect's rule, also within a batch and within open windows.

    The greatest time so far is kept by epoch for the last two epochs, so a repeated batch is judged by what came before
    it. With a path it is kept there too and outlives a restart.
    """

    def __init__(self, then: Callable[[DataFrame, int], None], arrival: str, delay_ms: int = 1000, path: str | None = None):
        self.then, self.arrival, self.delay, self.path = then, arrival, delay_ms, path
        self.tops: dict[int, int | None] | None = None if path else {}
        self.late = 0

    def _load(self, spark: SparkSession) -> dict[int, int | None]:
        where = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            return {}
        kept = spark.read.schema("top bigint, _epoch bigint").parquet(self.path).orderBy(F.desc("_epoch")).limit(2).collect()
        return {r["_epoch"]: r.top for r in kept}

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        from tidewell.operators import lateness

        spark = batch.sparkSession
        if self.tops is None:
            self.tops = self._load(spark)
        earlier = [e for e in self.tops if e < epoch]
        before = self.tops[max(earlier)] if earlier else None
        marked = lateness.with_watermark(batch, "_ts", self.arrival, self.delay)
        if before is not None:
            marked = marked.withColumn("_watermark", F.greatest("_watermark", F.lit(before - self.delay)))
        late = F.coalesce(F.col("_ts") < F.col("_watermark"), F.lit(False))
        marked = marked.persist()
        facts = marked.agg(F.max("_ts").alias("top"), F.sum(late.cast("int")).alias("late")).first()
        self.then(marked.filter(~late).drop("_watermark"), epoch)
        marked.unpersist()
        top = max((t for t in (before, facts.top) if t is not None), default=None)
        self.late += facts.late or 0
        self.tops = {e: self.tops[e] for e in sorted(earlier)[-1:]} | {epoch: top}
        if self.path:
            spark.createDataFrame([(top,)], "top bigint").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/_epoch={epoch}")
