"""Joins that Spark has no single operator for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


#: Slots in a block of visible_end().
SLOTS = 4096


def interval_join(left: DataFrame, right: DataFrame, keys: list[tuple[Column, Column]], lts: Column, rts: Column, within: int, how: str = "inner", residual: Column | None = None) -> DataFrame:
    """Rows of both sides with equal keys and times at most `within` apart, inclusively.

    Time buckets as wide as the distance are part of the hash key: one side names its own bucket, the
    other its own and both neighbours, so a hot key meets its near past only. For an outer join
    the side that isn't spread is the one that is padded; FULL is LEFT and what remains of the right.
    """
    if how == "full":
        both = interval_join(left, right, keys, lts, rts, within, "left", residual)
        marked = left.withColumn("__there", F.lit(1))
        rest = interval_join(marked, right, keys, lts, rts, within, "right", residual).filter("__there is null").drop("__there")
        return both.unionByName(rest)
    size = max(within, 1)
    own = lambda ts: F.floor(ts / size)
    near = lambda ts: F.explode(F.array(own(ts) - 1, own(ts), own(ts) + 1))
    spread_right = how != "right"
    a = left.withColumn("__lb", own(lts) if spread_right else near(lts))
    b = right.withColumn("__rb", near(rts) if spread_right else own(rts))
    on = (F.col("__lb") == F.col("__rb")) & (F.abs(lts - rts) <= within)
    for x, y in keys:
        on = on & (x == y)
    if residual is not None:
        on = on & residual
    return a.join(b, on, how).drop("__lb", "__rb")


def stream_interval_join(left: DataFrame, right: DataFrame, keys: list[tuple[Column, Column]], ltime: Column, rtime: Column, within: int, how: str = "inner", residual: Column | None = None) -> DataFrame:
    """interval_join() of streams: the bound on the watermarked times limits the state and releases padded rows."""
    d = F.expr(f"interval {within} milliseconds")
    on = (rtime >= ltime - d) & (rtime <= ltime + d)
    for x, y in keys:
        on = on & (x == y)
    return left.join(right, on if residual is None else on & residual, {"left": "leftOuter", "right": "rightOuter", "full": "fullOuter"}.get(how, how))


def semi(left: DataFrame, value: Column, sub: DataFrame) -> DataFrame:
    """value IN (sub); sub has one column."""
    s = sub.toDF("__in")
    return left.join(s, value == F.col("__in"), "left_semi")


def anti(left: DataFrame, value: Column, sub: DataFrame) -> DataFrame:
    """value NOT IN (sub) with SQL's nulls: all rows if sub is empty, none if it holds a NULL, else non-null values without a match.

    Two facts about sub make one row, which tells; the rest is a plain anti join, hashed or merged at any size.
    """
    s = sub.toDF("__in")
    facts = s.agg(F.count(F.lit(1)).alias("__n"), F.count("__in").alias("__known"))
    allowed = left.withColumn("__v", value).join(F.broadcast(facts)).filter("__n = 0 or (__known = __n and __v is not null)")  # one row
    return allowed.join(s.filter("__in is not null"), F.col("__v") == F.col("__in"), "left_anti").drop("__n", "__known", "__v")


def exists(left: DataFrame, sub: DataFrame, negated: bool = False) -> DataFrame:
    """All rows or none, by whether an uncorrelated sub has rows: one row of it is looked at."""
    n = sub.limit(1).agg(F.count(F.lit(1)).alias("__n"))
    return left.join(F.broadcast(n)).filter("__n = 0" if negated else "__n > 0").drop("__n")  # one row


def snapshot_semi(outer: DataFrame, ots: str, value: Column, inner: DataFrame, end: str, member: str, size: int) -> DataFrame:
    """Outer rows whose value is in the inner query's last non-empty tumbling emission at their time.

    inner has one row per (window end, member).
    """
    seen = visible_end(outer, ots, inner.select(F.col(end).alias("__end")).distinct(), size)
    return seen.join(inner.select(F.col(end).alias("__e2"), F.col(member).alias("__m")).distinct(), (F.col("__visible") == F.col("__e2")) & (value == F.col("__m")), "left_semi").drop("__visible")


def snapshot_scalar(outer: DataFrame, ots: str, inner: DataFrame, end: str, value: str, size: int, name: str) -> DataFrame:
    """Outer rows with the value of the inner query's last emission at their time, NULL where there is none yet."""
    seen = visible_end(outer, ots, inner.select(F.col(end).alias("__end")).distinct(), size)
    return seen.join(inner.select(F.col(end).alias("__visible"), F.col(value).alias(name)), "__visible", "left").drop("__visible")


def visible_end(outer: DataFrame, ots: str, ends: DataFrame, size: int) -> DataFrame:
    """Adds __visible: the greatest of `ends` (multiples of size) at or before the row's time.

    Only slots (times down to a multiple of size) that hold a row or an end are looked at. The greatest end so far is
    carried over blocks of slots, then within each, and rows meet it by slot; no slot between two ends is made up.
    """
    slot = F.col(ots) - F.pmod(F.col(ots), F.lit(size))
    held = outer.select(slot.alias("__slot"), F.lit(None).cast("bigint").alias("__end")).union(ends.select("__end", "__end"))
    slots = held.groupBy("__slot").agg(F.max("__end").alias("__end")).filter("__slot is not null").withColumn("__block", F.floor(F.col("__slot") / (size * SLOTS)))
    blocks = slots.groupBy("__block").agg(F.max("__end").alias("__top"))
    earlier = W.orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select("__block", F.max("__top").over(earlier).alias("__before"))
    inside = W.partitionBy("__block").orderBy("__slot").rowsBetween(W.unboundedPreceding, 0)
    seen = slots.join(blocks, "__block").select("__slot", F.greatest(F.max("__end").over(inside), F.col("__before")).alias("__visible"))
    return outer.withColumn("__slot", slot).join(seen, "__slot", "left").drop("__slot")
