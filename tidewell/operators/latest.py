"""Newest row per key, retention, row history, dedup and paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def latest_by(df: DataFrame, keys: list[str], ts: str, arrival: str | None = None) -> DataFrame:
    """The row with the greatest time per key; of equal times the later arrival. An aggregate, so a hot key combines map-side."""
    order = F.struct(ts, *([arrival] if arrival else []))
    out = df.groupBy(*keys).agg(F.max_by(F.struct("*"), order).alias("__row"))
    return out.select("__row.*")


def latest_by_changes(df: DataFrame, keys: list[str], ts: str, arrival: str, weight: str = "_weight", retract: str | None = None) -> DataFrame:
    """latest_by over a changelog in arrival order.

    The winner is the newest assertion; if the last thing that happened to it is its retraction (weight
    below 0 of the same time), the key is gone: an older row doesn't come back. A row whose `retract` flag is
    true drops its key whatever its time; only what arrives later counts from then on.
    """
    if retract:
        flag = F.coalesce(F.col(retract), F.lit(False))
        last = df.filter(flag).groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(F.max(arrival).alias("__dropped"))
        same = F.lit(True)
        for i, k in enumerate(keys):
            same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
        df = df.filter(~flag).join(last, same, "left").filter(F.col("__dropped").isNull() | (F.col(arrival) > F.col("__dropped"))).select(*df.columns)
    marked = df.withColumn("__gone", F.col(weight) < 0)
    out = marked.groupBy(*keys).agg(F.max_by(F.struct("*"), F.struct(F.col(ts), F.col(arrival))).alias("__row"))
    return out.filter("not __row.__gone").select(*[F.col("__row")[c].alias(c) for c in df.columns])


def retain_newest(df: DataFrame, n: int, ts: str, key: str) -> DataFrame:
    """The n newest rows by (time, key): a bounded top-k, not a global sort."""
    return df.orderBy(F.desc(ts), F.desc(key)).limit(n)


def retain_ttl(df: DataFrame, ttl: int, ts: str) -> DataFrame:
    """Rows no older than ttl before the greatest time seen."""
    top = df.agg(F.max(ts).alias("__top"))
    return df.join(F.broadcast(top)).filter(F.col(ts) >= F.col("__top") - ttl).drop("__top")  # one row


def history(df: DataFrame, keys: list[str], ts: str, arrival: str, mode: str, n: int = 1000, by: str | None = None) -> DataFrame:
    """Versions that a row's history keeps, with _version (1 is the oldest kept).

    mode: all (at most 1000), last, first (n of them), min or max (the extreme of `by` and the latest).
    """
    order = [F.col(ts), F.col(arrival)]
    if mode in ("min", "max"):
        extreme = W.partitionBy(*keys).orderBy(*([F.col(by).asc_nulls_last()] if mode == "min" else [F.col(by).desc_nulls_last()]), *order)
        newest = W.partitionBy(*keys).orderBy(*[c.desc() for c in order])
        kept = df.withColumns({"__e": F.row_number().over(extreme), "__n": F.row_number().over(newest)}).filter("__e = 1 or __n = 1").drop("__e", "__n")
    else:
        way = order if mode == "first" else [c.desc() for c in order]
        kept = df.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*way))).filter(F.col("__n") <= n).drop("__n")
    return kept.withColumn("_version", F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("long"))


def dedup_first(df: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    """The first arrival of every key; rows with a null key are all kept."""
    null = F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()
    first = df.filter(~null).groupBy(*keys).agg(F.min_by(F.struct("*"), arrival).alias("__row")).select("__row.*")
    return first.unionByName(df.filter(null))


def dedup_recent(df: DataFrame, key: str, arrival: str, bound: int) -> DataFrame:
    """Drops a row whose key was remembered when it arrived; the last `bound` distinct keys accepted are, first in first out.

    A single ordered pass by definition (whether a key is remembered depends on all acceptances before it);
    the state is `bound` keys. For bounds that cover the input use dedup_first().
    """
    schema = df.schema

    def run(batches):
        from collections import OrderedDict

        import pandas as pd

        seen: OrderedDict = OrderedDict()
        for b in batches:
            keep = []
            for k in b[key]:
                ok = pd.isna(k) or k not in seen
                keep.append(ok)
                if ok and not pd.isna(k):
                    seen[k] = None
                    if len(seen) > bound:
                        seen.popitem(last=False)
            yield b[keep]

    return df.repartition(1).sortWithinPartitions(arrival).mapInPandas(run, schema)


def page(df: DataFrame, keys: list[str | Column], limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*keys).offset(offset).limit(limit)


def recent(df: DataFrame, arrival: str, n: int = 100) -> DataFrame:
    return df.orderBy(F.desc(arrival)).limit(n)
