"""Connected components of an edge table by randomised contraction.

Each round every vertex points at the neighbour (or itself) that has the least hash under
that round's salt, and the graph is contracted along those pointers. A constant share of the
vertices is expected to go in every round whatever the graph's shape, so long chains need
O(log n) rounds and a star one or two. Hub vertices only ever meet map-side-combined
minimum aggregates and joins that AQE may split; nothing is gathered on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import cut


def connected_components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(u, v) long edges -> (id, component): one row for each vertex of an edge; component is the least id.

    Null ends and loops are ignored (a vertex with loops only has no row); direction and
    repetition don't matter; no edges give no rows.
    """
    edges = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))
    live = cut(edges.filter("u is not null and v is not null and u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    labels = None
    for salt in range(max_rounds):
        if live.isEmpty():
            break
        both = live.select("u", "v").unionByName(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        rank = lambda c: F.struct(F.xxhash64(F.lit(salt), c).alias("h"), c.alias("id"))
        to = both.groupBy("u").agg(F.min(rank(F.col("v"))).alias("best")).select(F.col("u").alias("id"), F.least("best", rank(F.col("u")))["id"].alias("to"))
        to = cut(to)
        labels = to.withColumnRenamed("to", "rep") if labels is None else labels.join(to.withColumnRenamed("id", "rep"), "rep", "left").select("id", F.coalesce("to", "rep").alias("rep"))
        labels = cut(labels)
        live = live.join(to.select(F.col("id").alias("u"), F.col("to").alias("a")), "u").join(to.select(F.col("id").alias("v"), F.col("to").alias("b")), "v")
        live = cut(live.filter("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    if labels is None:
        return live.select(F.col("u").alias("id"), F.col("v").alias("component"))
    least = labels.groupBy("rep").agg(F.min("id").alias("component"))
    return labels.join(least, "rep").select("id", "component")
