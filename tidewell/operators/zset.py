"""Z-sets: rows with signed weights, as changelog DataFrames with a `_weight` column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

WEIGHT = "_weight"


def consolidate(changes: DataFrame, columns: list[str]) -> DataFrame:
    """Net weight of every row, zeros gone: one map-side-combined aggregation."""
    return changes.groupBy(*columns).agg(F.sum(WEIGHT).alias(WEIGHT)).filter(f"{WEIGHT} <> 0")


def snapshot(changes: DataFrame, columns: list[str]) -> DataFrame:
    """Visible rows: net weight above zero. Negative ones are a debt and stay in the changelog only."""
    return consolidate(changes, columns).filter(f"{WEIGHT} > 0").select(*columns)


def negate(changes: DataFrame) -> DataFrame:
    return changes.withColumn(WEIGHT, -F.col(WEIGHT))


def concat(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def distinct(changes: DataFrame, columns: list[str]) -> DataFrame:
    """Weight 1 for every row of positive net weight."""
    return snapshot(changes, columns).withColumn(WEIGHT, F.lit(1).cast("long"))


def join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Bilinear join: weights multiply. Null keys meet nothing.

    With how="left", a left row is padded if the right side holds no row of its key on balance; for that the right side is netted first.
    """
    if how not in ("inner", "left"):
        raise ValueError(how)
    r = (right if how == "inner" else consolidate(right, [c for c in right.columns if c != WEIGHT])).withColumnRenamed(WEIGHT, "__w")
    return left.join(r, on, how).withColumn(WEIGHT, F.col(WEIGHT) * F.coalesce("__w", F.lit(1))).drop("__w")


def difference(after: DataFrame, before: DataFrame, columns: list[str]) -> DataFrame:
    """The deltas that lead from one multiset of rows to another: asserted rows weigh +1 each, retracted ones -1."""
    one = lambda df, w: df.select(*columns, F.lit(w).cast("long").alias(WEIGHT))
    return consolidate(concat(one(after, 1), one(before, -1)), columns)


def aggregate(changes: DataFrame, keys: list[str], sums: dict[str, Column]) -> DataFrame:
    """Counts and sums under weights; groups without net rows are gone.

    sums maps names to values: NULLs count nothing, and a sum over no values is NULL.
    """
    w = F.col(WEIGHT)
    aggs = [F.sum(w).alias("n")]
    for name, value in sums.items():
        aggs.append(F.when(F.sum(F.when(value.isNotNull(), w)) > 0, F.sum(value * w)).alias(name))
    return changes.groupBy(*keys).agg(*aggs).filter("n > 0")


def extreme(changes: DataFrame, keys: list[str], value: str, greatest: bool, name: str) -> DataFrame:
    """MIN or MAX that survives retractions: net the values first, then take the extreme of what is left."""
    left = changes.groupBy(*keys, value).agg(F.sum(WEIGHT).alias("__n")).filter("__n > 0")
    return left.groupBy(*keys).agg((F.max if greatest else F.min)(value).alias(name))


def running_changelog(changes: DataFrame, keys: list[str], value: str, arrival: str) -> DataFrame:
    """Every step of a running COUNT and SUM: the old row with weight -1, the new one with +1.

    A group's first step has no old row and a step to zero rows no new one. Steps that change nothing aren't shown.
    """
    order = W.partitionBy(*keys).orderBy(arrival)
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    w, v = F.col(WEIGHT), F.col(value)
    now = F.struct(F.sum(w).over(upto).alias("n"), F.when(F.sum(F.when(v.isNotNull(), w)).over(upto) > 0, F.sum(v * w).over(upto)).alias("total"))
    steps = changes.select(*keys, F.col(arrival).alias("_arrival"), now.alias("new"))
    steps = steps.withColumn("old", F.lag("new").over(W.partitionBy(*keys).orderBy("_arrival")))
    old = F.when(F.col("old.n") != 0, F.struct(F.lit(-1).cast("long").alias("w"), F.col("old").alias("r")))
    new = F.when(F.col("new.n") != 0, F.struct(F.lit(1).cast("long").alias("w"), F.col("new").alias("r")))
    moved = steps.filter(~F.col("old").eqNullSafe(F.col("new")))
    return moved.select(*keys, "_arrival", F.explode(F.array_compact(F.array(old, new))).alias("x")).select(*keys, "_arrival", "x.r.n", "x.r.total", F.col("x.w").alias(WEIGHT))
