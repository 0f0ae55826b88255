"""Watermarks over an explicit arrival order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: How far the watermark trails the greatest event time seen. Fixed by the dialect.
DELAY_MS = 1000
#: Arrivals per block of the running maximum.
BLOCK = 1 << 16


def with_watermark(df: DataFrame, ts: str, arrival: str, delay: int = DELAY_MS, tie: tuple[str, ...] = ()) -> DataFrame:
    """Adds _watermark: the greatest ts of all earlier arrivals less the delay (NULL at first).

    arrival is an integer, and tie orders equal ones. The running maximum goes by blocks of arrivals: a maximum per block, a prefix
    over the blocks (one row for each 65536 events), and a prefix within each, so no task orders the stream.
    """
    blocked = df.withColumn("__block", F.floor(F.coalesce(F.col(arrival), F.lit(0)) / BLOCK))
    tops = blocked.groupBy("__block").agg(F.max(ts).alias("__top"))
    before = W.orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    tops = tops.select("__block", F.max("__top").over(before).alias("__before"))
    inside = W.partitionBy("__block").orderBy(arrival, *tie).rowsBetween(W.unboundedPreceding, -1)
    seen = F.greatest(F.max(ts).over(inside), F.col("__before"))
    return blocked.join(tops, "__block").withColumn("_watermark", seen - delay).drop("__block", "__before")


def drop_late(df: DataFrame, ts: str, arrival: str, delay: int = DELAY_MS) -> DataFrame:
    """Events at or after the watermark they met; a late one goes even if its window were still open. Events without a time are never late."""
    w = with_watermark(df, ts, arrival, delay)
    return w.filter(~F.coalesce(F.col(ts) < F.col("_watermark"), F.lit(False))).drop("_watermark")


def drop_late_among(inputs: list[DataFrame], own: int, ts: str, arrival: str, delay: int = DELAY_MS) -> DataFrame:
    """inputs[own] without the events that were late under the one watermark of all inputs, whose arrivals share one numbering.

    Of equal arrivals those of an earlier input come first. Of the other inputs only time and arrival are read.
    """
    if len(inputs) == 1:
        return drop_late(inputs[0], ts, arrival, delay)
    whole = inputs[own].schema.simpleString()
    parts = [d.select(F.col(ts).alias("__t"), F.col(arrival).alias("__a"), F.lit(i).alias("__i"), (F.struct("*") if i == own else F.lit(None).cast(whole)).alias("__row")) for i, d in enumerate(inputs)]
    w = with_watermark(reduce(DataFrame.union, parts), "__t", "__a", delay, ("__i",))
    return w.filter((F.col("__i") == own) & ~F.coalesce(F.col("__t") < F.col("_watermark"), F.lit(False))).select("__row.*")


def late_count(df: DataFrame, ts: str, arrival: str, delay: int = DELAY_MS) -> DataFrame:
    """One row: events, late_events."""
    late = F.coalesce(F.col(ts) < F.col("_watermark"), F.lit(False))
    return with_watermark(df, ts, arrival, delay).agg(F.count(F.lit(1)).alias("events"), F.coalesce(F.sum(late.cast("long")), F.lit(0)).alias("late_events"))
