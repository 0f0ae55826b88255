"""Preference formatting: chosen and rejected conversations as one prompt and two masked completions.

The longest common prefix of two conversations' turns (role and text alike) is rendered once, as
the prompt; what is left of either is its completion. A completion's mask says which characters
are learnt from: the text and the end mark of its assistant turns, nothing else.

Turns are put in order by their number (ties by role and text, nulls first), and exact repetitions of a row count
once. A null role or text counts as empty; turns with a null conversation or a null number are no part
of any conversation. If one conversation is a prefix of the other its completion is empty, and so are
both of two equal ones. A conversation without a partner has a null rejected id and completion; all
but its last turn is the prompt.

pair_by_opening() makes pairs where none are given: conversations are ordered by their first turn, then
by id, and those that share a first turn are paired off in that order; the one left over if their number
is odd stays alone. The order is a range partitioning, which cuts through groups of any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewell.llm.common import cut, let, prefix_sums

#: What surrounds a turn. Fixed by the format.
OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"
LEARNT = "assistant"


def conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turns: array of (role, text) in order): a conversation's turns are one row's worth of text."""
    t = turns.select(F.col(id_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("n"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    t = t.filter("conv is not null and n is not null").distinct()
    listed = t.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("n", "role", "text"))).alias("all"))
    return listed.select("conv", F.transform("all", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def pair_by_opening(convs: DataFrame) -> DataFrame:
    """(chosen, rejected) ids, rejected null for one left over."""
    parts = int(convs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = convs.select("conv", F.xxhash64(F.element_at("turns", 1)).alias("a"), F.xxhash64(F.lit("second"), F.element_at("turns", 1)).alias("b"))
    laid = cut(first.repartitionByRange(parts, "a", "b", "conv").sortWithinPartitions("a", "b", "conv"))
    # monotonically_increasing_id holds the partition in its upper bits and counts rows in its lower 33.
    laid = laid.withColumn("m", F.monotonically_increasing_id()).withColumn("p", F.shiftright("m", 33)).withColumn("k", F.col("m").bitwiseAND(F.lit((1 << 33) - 1)))
    # Rows of a group that lie in earlier partitions: at most one row for each group and partition.
    held = laid.groupBy("a", "b", "p").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("k0"))
    before = W.partitionBy("a", "b").orderBy("p").rowsBetween(W.unboundedPreceding, -1)
    held = held.select("a", "b", "p", "k0", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    ranked = laid.join(held, ["a", "b", "p"]).select("a", "b", "conv", (F.col("k") - F.col("k0") + F.col("earlier")).alias("rank"))
    pairs = ranked.groupBy("a", "b", F.floor(F.col("rank") / 2).alias("pair")).agg(F.min("conv").alias("chosen"), F.max("conv").alias("other"))
    return pairs.select("chosen", F.when(F.col("other") > F.col("chosen"), F.col("other")).alias("rejected"))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(MIDDLE), t["text"], F.lit(CLOSE))), "")


def _mask(turns: Column) -> Column:
    """array of (start, end): the characters of _render(turns) that are learnt from."""
    sizes = lambda ts: F.transform(ts, lambda t: F.length(t["role"]) + F.length(t["text"]) + len(OPEN) + len(MIDDLE) + len(CLOSE))
    placed = let(turns, lambda ts: F.zip_with(ts, prefix_sums(sizes(ts)), lambda t, at: F.struct(t.alias("t"), (at.cast("int") + F.length(t["role"]) + len(OPEN) + len(MIDDLE)).alias("at"))))
    learnt = F.filter(placed, lambda x: x["t"]["role"] == LEARNT)
    return F.transform(learnt, lambda x: F.struct(x["at"].alias("start"), (x["at"] + F.length(x["t"]["text"]) + len(CLOSE)).alias("end")))


def format_pairs(convs: DataFrame, pairs: DataFrame) -> DataFrame:
    """chosen_id, rejected_id, n_common, prompt, chosen, chosen_mask, rejected, rejected_mask for each of pairs(chosen, rejected).

    Pairs that name an unknown chosen conversation are left out; an unknown rejected one counts as absent.
    """
    c = convs.select(F.col("conv").alias("chosen"), F.col("turns").alias("x"))
    r = convs.select(F.col("conv").alias("rejected"), F.col("turns").alias("y"))
    both = pairs.select("chosen", "rejected").join(c, "chosen").join(r, "rejected", "left")
    alone = F.col("y").isNull()
    same = F.transform(F.arrays_zip("x", "y"), lambda p: F.coalesce(p["x"] == p["y"], F.lit(False)))
    broken = F.array_position(same, False).cast("int")
    common = F.when(alone, F.size("x") - 1).when(broken > 0, broken - 1).otherwise(F.size("x"))
    b = both.withColumn("n_common", common)
    rest = lambda t: F.slice(t, F.col("n_common") + 1, F.greatest(F.size(t) - F.col("n_common"), F.lit(0)))
    return b.select(
        F.col("chosen").alias("chosen_id"), F.when(~alone, F.col("rejected")).alias("rejected_id"), "n_common", _render(F.slice("x", 1, F.col("n_common"))).alias("prompt"),
        _render(rest("x")).alias("chosen"), _mask(rest("x")).alias("chosen_mask"),
        F.when(~alone, _render(rest("y"))).alias("rejected"), F.when(~alone, _mask(rest("y"))).alias("rejected_mask"),
    )


def report(turns: DataFrame) -> DataFrame:
    """format_pairs() over pair_by_opening(), with the masks as text (start:end, comma-joined)."""
    convs = cut(conversations(turns))
    shown = lambda m: F.array_join(F.transform(m, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    out = format_pairs(convs, pair_by_opening(convs))
    return out.withColumns({"n_common": F.col("n_common").cast("long"), "chosen_mask": shown(F.col("chosen_mask")), "rejected_mask": shown(F.col("rejected_mask"))})


ORACLE = f"""
WITH t AS (SELECT DISTINCT conv_id AS conv, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
c AS (SELECT conv, list({{'role': role, 'text': text}} ORDER BY turn, role, text) AS turns FROM t GROUP BY conv),
k AS (SELECT conv, turns, turns[1] AS opening, (row_number() OVER (PARTITION BY turns[1] ORDER BY conv) - 1) // 2 AS pair FROM c),
p AS (SELECT min(conv) AS a, CASE WHEN count(*) = 2 THEN max(conv) END AS b FROM k GROUP BY opening, pair),
j AS (SELECT a, b, x.turns AS x, y.turns AS y FROM p JOIN c x ON x.conv = a LEFT JOIN c y ON y.conv = b),
n AS (SELECT *, CASE WHEN b IS NULL THEN len(x) - 1 ELSE coalesce(list_min(list_filter(range(1, greatest(len(x), len(y)) + 1), lambda i: i > len(x) OR i > len(y) OR x[i] <> y[i])) - 1, len(x)) END AS n FROM j),
r AS (SELECT *, array_to_string(list_transform(x[1:n], lambda t: '{OPEN}' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), '') AS prompt, x[n + 1:] AS xs, y[n + 1:] AS ys FROM n),
s AS (SELECT a, b, n, prompt, array_to_string(list_transform(xs, lambda t: '{OPEN}' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), '') AS cx, array_to_string(list_transform(ys, lambda t: '{OPEN}' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), '') AS cy,
  list_transform(range(1, len(xs) + 1), lambda i: coalesce(list_sum(list_transform(xs[1:i - 1], lambda t: length(t.role) + length(t.text) + {len(OPEN + MIDDLE + CLOSE)})), 0) + length(xs[i].role) + {len(OPEN + MIDDLE)}) AS sx, xs,
  list_transform(range(1, len(ys) + 1), lambda i: coalesce(list_sum(list_transform(ys[1:i - 1], lambda t: length(t.role) + length(t.text) + {len(OPEN + MIDDLE + CLOSE)})), 0) + length(ys[i].role) + {len(OPEN + MIDDLE)}) AS sy, ys FROM r)
SELECT a AS chosen_id, b AS rejected_id, n::BIGINT AS n_common, prompt, cx AS chosen,
  array_to_string(list_transform(list_filter(range(1, len(xs) + 1), lambda i: xs[i].role = '{LEARNT}'), lambda i: sx[i]::BIGINT || ':' || (sx[i] + length(xs[i].text) + {len(CLOSE)})::BIGINT), ',') AS chosen_mask,
  CASE WHEN b IS NOT NULL THEN cy END AS rejected,
  CASE WHEN b IS NOT NULL THEN array_to_string(list_transform(list_filter(range(1, len(ys) + 1), lambda i: ys[i].role = '{LEARNT}'), lambda i: sy[i]::BIGINT || ':' || (sy[i] + length(ys[i].text) + {len(CLOSE)})::BIGINT), ',') END AS rejected_mask
FROM s
"""
