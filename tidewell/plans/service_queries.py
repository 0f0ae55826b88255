"""Queries over the operators that have no place in the dialect, with oracles where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import values as V
from tidewell.operators import graph, lateness, latest, search, windows, zset
from tidewell.plans.builder import Session
from tidewell.plans.changes import Changelog
from tidewell.sources import formats, generators, ingest

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
T = "(epoch_us(ts) // 1000)"
MINUTE, HOUR, DAY = 60_000, 3_600_000, 86_400_000


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream with its time as epoch milliseconds; event_id is the order of arrival."""
    return read(spark, sf_dir, "events").withColumn("t", F.unix_millis(F.col("ts").cast("timestamp")))


def shaken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with event times out of order by up to 50 minutes."""
    return events(spark, sf_dir).withColumn("t", F.col("t") - F.col("event_id") % 11 * 5 * MINUTE).select("event_id", "user_id", "event_type", "value", "t")


SHAKEN = f"(SELECT event_id, user_id, event_type, value, {T} - event_id % 11 * {5 * MINUTE} AS t FROM events)"


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A changelog: every event is asserted, and every fifth one is retracted 1000 arrivals later."""
    e = events(spark, sf_dir).select("event_id", "user_id", "event_type", F.round("value").alias("v"), "t")
    plus = e.select("*", F.lit(1).cast("long").alias("_weight"), (F.col("event_id") * 2).alias("_arrival"))
    minus = e.filter("event_id % 5 = 0").select("*", F.lit(-1).cast("long").alias("_weight"), (F.col("event_id") * 2 + 2001).alias("_arrival"))
    return plus.unionByName(minus)


CHANGES = f"(SELECT event_id, user_id, event_type, round(value) AS v, {T} AS t, 1 AS _weight, event_id * 2 AS _arrival FROM events UNION ALL SELECT event_id, user_id, event_type, round(value), {T}, -1, event_id * 2 + 2001 FROM events WHERE event_id % 5 = 0)"


# -- watermarks ---------------------------------------------------------------------------------


@query(f"SELECT event_id, t FROM (SELECT *, max(t) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1000 AS w FROM {SHAKEN}) WHERE w IS NULL OR t >= w")
def late_drop(spark, sf_dir):
    return lateness.drop_late(shaken(spark, sf_dir), "t", "event_id").select("event_id", "t")


@query(f"SELECT count(*) AS events, coalesce(sum(CASE WHEN t < w THEN 1 ELSE 0 END), 0)::BIGINT AS late_events FROM (SELECT *, max(t) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1000 AS w FROM {SHAKEN})")
def late_count(spark, sf_dir):
    return lateness.late_count(shaken(spark, sf_dir), "t", "event_id")


def _late(spark, sf_dir, text):
    """A pipeline over the shaken stream and two streams cut from it, all numbered by event_id."""
    all_ = shaken(spark, sf_dir)
    s = Session(spark)
    for name, df in (("shaken", all_), ("clicks", all_.filter("event_type = 'click'")), ("buys", all_.filter("event_type = 'purchase'"))):
        s.register(name, df, ts="t", arrival="event_id")
    return s.sql(text, "pipeline")


ON_TIME = f"(SELECT * FROM (SELECT *, max(t) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1000 AS w FROM {SHAKEN} {{0}}) WHERE w IS NULL OR t >= w)"


@query(f"SELECT event_type, count(*) AS n, max(value) AS high, t - t % {HOUR} AS window_start, t - t % {HOUR} + {HOUR} AS window_end FROM {ON_TIME.format('')} GROUP BY ALL")
def late_sql(spark, sf_dir):
    return _late(spark, sf_dir, "SELECT event_type, COUNT(*) AS n, MAX(value) AS high FROM shaken GROUP BY event_type WINDOW TUMBLING(SIZE 1 HOURS)")


@query(f"""WITH o AS {ON_TIME.format("WHERE event_type IN ('click', 'purchase')")}
SELECT c.event_id AS a, b.event_id AS b FROM o c JOIN o b ON c.event_type = 'click' AND b.event_type = 'purchase' AND c.user_id = b.user_id AND abs(c.t - b.t) <= {6 * HOUR}""")
def late_join_sql(spark, sf_dir):
    """One watermark over both inputs: an event is late if either input was ahead of it."""
    return _late(spark, sf_dir, "SELECT c.event_id AS a, b.event_id AS b FROM clicks c JOIN buys b WITHIN 6 HOURS ON c.user_id = b.user_id")


@query(f"""WITH h AS (SELECT event_type, count(*) AS n, t - t % {HOUR} + {HOUR} AS e FROM {ON_TIME.format('')} GROUP BY ALL)
SELECT event_type, max(n) AS peak, count(*) AS hours, e - e % {DAY} AS window_start, e - e % {DAY} + {DAY} AS window_end FROM h GROUP BY ALL""")
def late_nested_sql(spark, sf_dir):
    return _late(spark, sf_dir, "SELECT h.event_type, MAX(h.n) AS peak, COUNT(*) AS hours FROM (SELECT event_type, COUNT(*) AS n FROM shaken GROUP BY event_type WINDOW TUMBLING(SIZE 1 HOURS)) h GROUP BY h.event_type WINDOW TUMBLING(SIZE 24 HOURS)")


@query(f"SELECT event_id, max(t) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1000 AS watermark FROM {SHAKEN}")
def watermark(spark, sf_dir):
    return lateness.with_watermark(shaken(spark, sf_dir), "t", "event_id").select("event_id", F.col("_watermark").alias("watermark"))


@query(f"""WITH w AS (SELECT *, {T} - {T} % {HOUR} AS s FROM events)
SELECT event_type, s AS window_start, s + {HOUR} AS window_end, event_id AS arrival, count(*) OVER r AS n, max(value) OVER r AS high, false AS final FROM w WINDOW r AS (PARTITION BY event_type, s ORDER BY event_id ROWS UNBOUNDED PRECEDING)
UNION ALL SELECT event_type, s, s + {HOUR}, NULL, count(*), max(value), true FROM w GROUP BY event_type, s""")
def emit_changes(spark, sf_dir):
    out = windows.emit_changes(events(spark, sf_dir), "t", HOUR, ["event_type"], "event_id", {"n": F.count(F.lit(1)), "high": F.max("value")})
    return out.withColumnsRenamed({"_arrival": "arrival", "_final": "final"})


@query(f"""WITH w AS (SELECT event_type, {T} - {T} % {HOUR} + {HOUR} AS window_end, count(*) AS n FROM events GROUP BY ALL), m AS (SELECT max({T}) - 1000 AS w FROM events)
SELECT event_type, window_end, n, window_end <= w AS closed FROM w, m""")
def win_close(spark, sf_dir):
    """Which windows the final watermark has closed."""
    e = events(spark, sf_dir)
    w = windows.tumbling(e, "t", HOUR).groupBy("event_type", "window_end").agg(F.count(F.lit(1)).alias("n"))
    top = e.agg((F.max("t") - lateness.DELAY_MS).alias("w"))
    return w.join(F.broadcast(top)).select("event_type", "window_end", "n", (F.col("window_end") <= F.col("w")).alias("closed"))  # one row


# -- Z-sets -------------------------------------------------------------------------------------


@query(f"SELECT user_id, event_type, v, sum(_weight)::BIGINT AS weight FROM {CHANGES} GROUP BY ALL HAVING sum(_weight) <> 0")
def zset_consolidate(spark, sf_dir):
    return zset.consolidate(changes(spark, sf_dir), ["user_id", "event_type", "v"]).withColumnRenamed("_weight", "weight")


@query(f"SELECT event_id, user_id FROM {CHANGES} GROUP BY ALL HAVING sum(_weight) > 0")
def zset_snapshot(spark, sf_dir):
    return zset.snapshot(changes(spark, sf_dir), ["event_id", "user_id"])


@query("SELECT DISTINCT c_nationkey::BIGINT AS k FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)")
def zset_negate(spark, sf_dir):
    """EXCEPT as a distinct of one side and the other's negation."""
    one = lambda df, c: df.select(F.col(c).cast("long").alias("k")).distinct().withColumn("_weight", F.lit(1).cast("long"))
    a = one(read(spark, sf_dir, "customer"), "c_nationkey")
    b = one(read(spark, sf_dir, "supplier").filter("s_acctbal > 9000"), "s_nationkey")
    return zset.distinct(zset.concat(a, zset.negate(b)), ["k"]).select("k")


@query(f"SELECT a.user_id, a.event_type, b.event_type AS other, sum(a.w * b.w)::BIGINT AS weight FROM (SELECT user_id, event_type, sum(_weight) AS w FROM {CHANGES} WHERE v > 25 GROUP BY ALL) a JOIN (SELECT user_id, event_type, sum(_weight) AS w FROM {CHANGES} WHERE v < 1 GROUP BY ALL) b USING (user_id) GROUP BY ALL HAVING sum(a.w * b.w) <> 0")
def zset_join(spark, sf_dir):
    c = changes(spark, sf_dir)
    left = zset.consolidate(c.filter("v > 25"), ["user_id", "event_type"])
    right = zset.consolidate(c.filter("v < 1"), ["user_id", "event_type"]).withColumnRenamed("event_type", "other")
    return zset.consolidate(zset.join(left, right, ["user_id"]), ["user_id", "event_type", "other"]).withColumnRenamed("_weight", "weight")


@query(f"SELECT user_id, sum(_weight)::BIGINT AS n, sum(v * _weight) AS total FROM {CHANGES} GROUP BY user_id HAVING sum(_weight) > 0")
def zset_aggregate(spark, sf_dir):
    return zset.aggregate(changes(spark, sf_dir), ["user_id"], {"total": F.col("v")})


@query(f"SELECT user_id, max(v) AS high FROM (SELECT user_id, v FROM {CHANGES} GROUP BY user_id, v HAVING sum(_weight) > 0) GROUP BY user_id")
def zset_max(spark, sf_dir):
    return zset.extreme(changes(spark, sf_dir), ["user_id"], "v", True, "high")


@query(f"""WITH s AS (SELECT user_id, _arrival, sum(_weight) OVER w AS n, sum(v * _weight) OVER w AS total FROM {CHANGES} WINDOW w AS (PARTITION BY user_id ORDER BY _arrival ROWS UNBOUNDED PRECEDING)),
o AS (SELECT *, lag(n) OVER w AS n0, lag(total) OVER w AS total0 FROM s WINDOW w AS (PARTITION BY user_id ORDER BY _arrival))
SELECT user_id, _arrival::BIGINT AS arrival, n::BIGINT AS n, CASE WHEN n > 0 THEN total END AS total, 1::BIGINT AS weight FROM o WHERE n <> 0 AND (n, total) IS DISTINCT FROM (n0, total0)
UNION ALL SELECT user_id, _arrival, n0::BIGINT, CASE WHEN n0 > 0 THEN total0 END, -1 FROM o WHERE n0 <> 0 AND (n, total) IS DISTINCT FROM (n0, total0)""")
def running_agg_changelog(spark, sf_dir):
    return zset.running_changelog(changes(spark, sf_dir), ["user_id"], "v", "_arrival").withColumnsRenamed({"_arrival": "arrival", "_weight": "weight"})


@query(f"SELECT event_id, user_id, _weight::BIGINT AS weight FROM {CHANGES} WHERE v > 10")
def filter_changelog(spark, sf_dir):
    """A filter on a changelog passes weights through."""
    return changes(spark, sf_dir).filter("v > 10").select("event_id", "user_id", F.col("_weight").alias("weight"))


@query(f"WITH c AS (SELECT *, _arrival // 4096 AS epoch FROM {CHANGES}) SELECT user_id, event_type, v, sum(_weight)::BIGINT AS weight FROM c WHERE epoch <= 1 GROUP BY ALL HAVING sum(_weight) > 0 UNION ALL SELECT user_id, event_type, v, _weight FROM c WHERE epoch > 1")
def attach_cutoff(spark, sf_dir):
    """A late reader gets the snapshot of an epoch, then only the deltas after it."""
    c = changes(spark, sf_dir).withColumn("epoch", F.floor(F.col("_arrival") / 4096))
    cols = ["user_id", "event_type", "v"]
    base = zset.consolidate(c.filter("epoch <= 1"), cols).filter("_weight > 0")
    return base.unionByName(c.filter("epoch > 1").select(*cols, "_weight")).withColumnRenamed("_weight", "weight")


@query(f"SELECT user_id, event_id, t FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t DESC, _arrival DESC) AS r FROM {CHANGES}) WHERE r = 1 AND _weight > 0")
def latest_by_retract(spark, sf_dir):
    return latest.latest_by_changes(changes(spark, sf_dir), ["user_id"], "t", "_arrival").select("user_id", "event_id", "t")


# -- retention, history, dedup, paging ------------------------------------------------------------


@query("SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 500")
def retention_max_rows(spark, sf_dir):
    return latest.retain_newest(events(spark, sf_dir), 500, "t", "event_id").select("event_id", "user_id")


@query(f"SELECT event_id, user_id FROM events WHERE {T} >= (SELECT max({T}) FROM events) - {3 * DAY}")
def retention_ttl(spark, sf_dir):
    return latest.retain_ttl(events(spark, sf_dir), 3 * DAY, "t").select("event_id", "user_id")


def _history(mode, n=1000, by=None):
    def run(spark, sf_dir):
        out = latest.history(events(spark, sf_dir), ["user_id", "event_type"], "t", "event_id", mode, n, by)
        return out.select("user_id", "event_type", "event_id", F.col("_version").alias("version"))

    return run


def _history_sql(kept: str) -> str:
    return f"SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS version FROM (SELECT * FROM events QUALIFY {kept})"


_P = "PARTITION BY user_id, event_type ORDER BY"
for _name, _args, _sql in (
    ("history_all", ("all",), f"row_number() OVER ({_P} ts DESC, event_id DESC) <= 1000"),
    ("history_last_n", ("last", 3), f"row_number() OVER ({_P} ts DESC, event_id DESC) <= 3"),
    ("history_first_n", ("first", 3), f"row_number() OVER ({_P} ts, event_id) <= 3"),
    ("history_max_by", ("max", 1000, "value"), f"row_number() OVER ({_P} value DESC, ts, event_id) = 1 OR row_number() OVER ({_P} ts DESC, event_id DESC) = 1"),
    ("history_min_by", ("min", 1000, "value"), f"row_number() OVER ({_P} value, ts, event_id) = 1 OR row_number() OVER ({_P} ts DESC, event_id DESC) = 1"),
):
    QUERIES[_name], ORACLE_SQL[_name] = _history(*_args), _history_sql(_sql)


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def dedup_key(spark, sf_dir):
    return latest.dedup_first(events(spark, sf_dir), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id")


@query()
def dedup_fifo(spark, sf_dir):
    return latest.dedup_recent(events(spark, sf_dir).select("event_id", "user_id"), "user_id", "event_id", 40)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100")
def page_rows(spark, sf_dir):
    return latest.page(read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], 50, 100)


@query("SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 100")
def recent_results(spark, sf_dir):
    return latest.recent(events(spark, sf_dir).select("event_id", "event_type"), "event_id")


@query("SELECT event_id, value FROM events WHERE user_id = 42")
def shard_lookup(spark, sf_dir):
    """One key's rows of a table that is dealt by key."""
    return read(spark, sf_dir, "events").filter("user_id = 42").select("event_id", "value")


@query(f"SELECT user_id, max_by(event_id, _arrival) AS event_id, CASE WHEN max_by(_weight, _arrival) > 0 THEN 'upsert' ELSE 'delete' END AS action FROM {CHANGES} GROUP BY user_id")
def upsert_plan(spark, sf_dir):
    """What a keyed sink does with a delta batch: the last delta of each key, rows without a key skipped."""
    c = changes(spark, sf_dir).filter("user_id is not null")
    last = latest.latest_by(c, ["user_id"], "_arrival")
    return last.select("user_id", "event_id", F.when(F.col("_weight") > 0, "upsert").otherwise("delete").alias("action"))


# -- search ---------------------------------------------------------------------------------------


@query("SELECT p_partkey, 1.0::DOUBLE AS score FROM part WHERE contains(lower(p_name || ' ' || p_brand), 'ring') AND contains(lower(p_name || ' ' || p_brand), 'sm') ORDER BY p_partkey LIMIT 100")
def search_exact(spark, sf_dir):
    return search.search_exact(read(spark, sf_dir, "part"), ["p_name", "p_brand"], "sm ring", "p_partkey").select("p_partkey", F.col("_score").alias("score"))


@query("""WITH q AS (SELECT 'widgt' AS w), t AS (SELECT p_partkey, unnest(list_distinct(list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda x: x <> ''))) AS t FROM part),
g AS (SELECT p_partkey, t, w, list_distinct(list_transform(range(1, length(t) + 1), lambda i: substr('$' || t || '$', i, 3))) AS a, list_distinct(list_transform(range(1, length(w) + 1), lambda i: substr('$' || w || '$', i, 3))) AS b FROM t, q),
s AS (SELECT p_partkey, CASE WHEN len(list_intersect(a, b)) = 0 THEN 0 ELSE greatest(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))), 1 - levenshtein(t, w) / greatest(length(t), length(w))) END AS s FROM g)
SELECT p_partkey, round(max(s), 9) AS score FROM s GROUP BY p_partkey HAVING max(s) >= 0.3 ORDER BY max(s) DESC, p_partkey LIMIT 100""")
def search_fuzzy(spark, sf_dir):
    return search.search_fuzzy(read(spark, sf_dir, "part"), ["p_name"], "widgt", "p_partkey").select("p_partkey", F.round("_score", 9).alias("score"))


# -- ingest ---------------------------------------------------------------------------------------


@query("SELECT event_id, props ->> '$.k' AS k FROM events")
def jsonpath(spark, sf_dir):
    doc = F.concat(F.lit('{"items": [{"p": '), F.col("props"), F.lit("}]}"))
    return events(spark, sf_dir).select("event_id", F.explode(ingest.select_path(doc, "$.items[*].p['k']")).alias("k"))


@query(f"SELECT event_id, value, (props ->> '$.k')::BIGINT AS k, event_id * 1000 AS t FROM events")
def map_records(spark, sf_dir):
    doc = F.to_json(F.struct(F.array(F.struct("event_id", "value", F.col("props").alias("raw"), F.struct((F.col("event_id") * 1000).alias("at")).alias("meta"))).alias("rows")))
    e = events(spark, sf_dir).select(doc.alias("doc"))
    out = ingest.map_records(e, "doc", "$.rows[*]", {"event_id": ("$.event_id", V.LONG), "value": ("$.value", V.DOUBLE), "raw": ("$.raw", V.STRING)}, "$.meta.at")
    return out.select("event_id", "value", V.to_long(F.get_json_object("raw", "$.k"), V.STRING).alias("k"), F.col("_ts").alias("t"))


def _envelopes(e: DataFrame) -> DataFrame:
    row = F.struct("event_id", "value")
    kind = F.col("event_id") % 3
    env = F.to_json(F.struct(F.when(kind == 0, "d").when(kind == 1, "c").otherwise("u").alias("op"), F.when(kind != 0, row).alias("after"), F.when(kind == 0, row).alias("before"), (F.col("event_id") * 1000).alias("ts_ms")))
    wrapped = F.when(F.col("event_id") % 2 == 0, env).otherwise(F.concat(F.lit('{"payload":'), env, F.lit("}")))
    return e.select(F.when(F.col("event_id") % 7 == 0, F.lit(None)).otherwise(wrapped).alias("doc"))


@query("SELECT event_id, value, CASE event_id % 3 WHEN 0 THEN 'd' WHEN 1 THEN 'c' ELSE 'u' END AS op, CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END::BIGINT AS weight, event_id * 1000 AS t FROM events WHERE event_id % 7 <> 0")
def cdc_unwrap(spark, sf_dir):
    out = ingest.cdc_unwrap(_envelopes(events(spark, sf_dir)), "doc")
    return out.select(V.to_long(F.get_json_object("row", "$.event_id"), V.STRING).alias("event_id"), V.to_double(F.get_json_object("row", "$.value"), V.STRING).alias("value"), F.col("_op").alias("op"), F.col("_weight").alias("weight"), F.col("_ts").alias("t"))


def _raw(spark, sf_dir):
    return events(spark, sf_dir).select(F.col("event_id").cast("string").alias("event_id"), F.when(F.col("event_id") % 9 == 0, "n/a").otherwise(F.col("user_id").cast("string")).alias("user_id"))


@query("SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN user_id END AS user_id FROM events")
def coerce_null(spark, sf_dir):
    return ingest.coerce(_raw(spark, sf_dir), {"event_id": V.LONG, "user_id": V.LONG})


@query("SELECT event_id, user_id FROM events WHERE event_id % 9 <> 0")
def coerce_drop(spark, sf_dir):
    return ingest.coerce(_raw(spark, sf_dir), {"event_id": V.LONG, "user_id": V.LONG}, "drop")


@query("SELECT event_id, user_id, CASE WHEN event_id % 2 = 0 THEN event_id * 10 ELSE 77 END AS t, 'feed' AS source, event_id % 10 = 0 AS retract FROM events")
def ingest_accept(spark, sf_dir):
    e = events(spark, sf_dir).select(F.col("event_id").cast("string").alias("event_id"), F.col("user_id").cast("string").alias("user_id"), F.when(F.col("event_id") % 2 == 0, (F.col("event_id") * 10).cast("string")).otherwise("never").alias("at"), F.lit("spoofed").alias("_source"), (F.col("event_id") % 10 == 0).alias("_retract"))
    out = ingest.accept(e, "feed", {"event_id": V.LONG, "user_id": V.LONG}, "at", F.lit(77).cast("long"))
    return out.withColumnsRenamed({"_ts": "t", "_source": "source", "_retract": "retract"})


@query("""WITH a AS (SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 10 <> 0), b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 11 <> 0)
SELECT o_orderkey, b.o_totalprice, CASE WHEN a.o_totalprice IS NULL THEN 'create' WHEN b.o_totalprice IS NULL THEN 'delete' ELSE 'update' END AS change, b.o_totalprice IS NULL AS retract FROM a FULL JOIN b USING (o_orderkey) WHERE a.o_totalprice IS DISTINCT FROM b.o_totalprice""")
def snapshot_diff(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    new = o.filter("o_orderkey % 11 <> 0").withColumn("o_totalprice", F.expr("case when o_orderkey % 7 = 0 then o_totalprice + 1 else o_totalprice end"))
    return ingest.snapshot_diff(o.filter("o_orderkey % 10 <> 0"), new, ["o_orderkey"]).withColumnsRenamed({"_change": "change", "_retract": "retract"})


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 500 AND o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 200")
def db_poll(spark, sf_dir):
    return ingest.db_poll(read(spark, sf_dir, "orders"), "o_orderkey", F.lit(500), 200, F.col("o_orderstatus") == "F").select("o_orderkey", "o_totalprice")


@query(f"SELECT event_id AS seq, {T} AS t FROM events WHERE event_id >= 9000")
def replay_from(spark, sf_dir):
    log = events(spark, sf_dir).select(F.col("event_id").alias("_seq"), F.col("t").alias("_ts"))
    return ingest.replay_from(log, seq=9000).withColumnsRenamed({"_seq": "seq", "_ts": "t"})


@query("SELECT event_id, user_id::VARCHAR AS account, event_type AS kind FROM events")
def fmt_fix(spark, sf_dir):
    lines = events(spark, sf_dir).select(F.concat(F.lit("8=FIX.4.4|35="), F.col("event_type"), F.lit("|1=x|junk|34="), F.col("event_id").cast("string"), F.lit("|1="), F.col("user_id").cast("string"), F.lit("|")).alias("value"))
    return formats.fix_messages(lines, {"event_id": "34", "account": "1", "kind": "35"}).withColumn("event_id", F.col("event_id").cast("long"))


@query("SELECT event_id, event_type, value FROM events")
def fmt_ndjson(spark, sf_dir):
    lines = events(spark, sf_dir).select(F.explode(F.array(F.to_json(F.struct("event_id", "event_type", "value")), F.lit("  "))).alias("value"))
    return formats.ndjson_rows(lines, "event_id bigint, event_type string, value double")


@query("SELECT event_id::VARCHAR AS id, 'a \"quoted\"; ' || event_type AS note, '' AS missing FROM events")
def fmt_csv(spark, sf_dir):
    lines = events(spark, sf_dir).select(F.concat(F.col("event_id").cast("string"), F.lit(';"a ""quoted""; '), F.col("event_type"), F.lit('"')).alias("value"))
    return formats.csv_rows(lines, ["id", "note", "missing"], ";")


@query("SELECT * FROM (VALUES ('event_id', 'long'), ('event_type', 'string'), ('value', 'double'), ('when', 'timestamp'), ('raw', 'json')) t(field, kind)")
def infer_schema(spark, sf_dir):
    """Kinds by notation of the first 100 items."""
    e = events(spark, sf_dir).orderBy("event_id").limit(formats.INFER_ITEMS)
    doc = F.to_json(F.struct("event_id", "event_type", "value", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("when"), F.from_json("props", "k int").alias("raw")))
    return spark.createDataFrame(formats.infer_kinds([r[0] for r in e.select(doc).collect()]), "field string, kind string")


# -- statements as changelogs ---------------------------------------------------------------------------

EPOCHS = [0, 1, 2]


def _deltas(spark, sf_dir, text, kinds=(), **retention):
    """Over the changelog in three epochs of 4096 arrivals, 4096 and the rest; kinds make a source of each event type."""
    log = changes(spark, sf_dir).withColumn("_epoch", F.least(F.floor(F.col("_arrival") / 4096), F.lit(2))).drop("_arrival")
    c = Changelog(Session(spark)).register("events", log, ts="t", arrival="event_id")
    for k in kinds:
        c.register(k, log.filter(F.col("event_type") == k), ts="t", arrival="event_id")
    return c.deltas(text, EPOCHS, **retention).withColumnsRenamed({"_weight": "weight", "_epoch": "epoch"})


def _delta_oracle(columns: str, body: str) -> str:
    """body: the statement's rows at every epoch e, over n (the net rows at e)."""
    return f"""
WITH l AS (SELECT event_id, user_id, event_type, v, t, _weight, least(_arrival // 4096, 2) AS epoch FROM {CHANGES}),
n AS (SELECT e, event_id, user_id, event_type, v, t FROM l, (VALUES (0), (1), (2)) x(e) WHERE epoch <= e GROUP BY ALL HAVING sum(_weight) > 0),
s AS ({body}),
d AS (SELECT e AS epoch, {columns}, 1 AS w FROM s UNION ALL SELECT e + 1, {columns}, -1 FROM s WHERE e < 2)
SELECT epoch::BIGINT AS epoch, {columns}, sum(w)::BIGINT AS weight FROM d GROUP BY ALL HAVING sum(w) <> 0"""


@query(_delta_oracle("user_id, n, total", "SELECT e, user_id, count(*) AS n, sum(v) AS total FROM n GROUP BY ALL"))
def changes_group(spark, sf_dir):
    return _deltas(spark, sf_dir, "SELECT user_id, COUNT(*) AS n, SUM(v) AS total FROM events GROUP BY user_id")


@query(_delta_oracle("a, b", "SELECT c.e, c.event_id AS a, p.event_id AS b FROM n c LEFT JOIN n p ON c.e = p.e AND c.user_id = p.user_id AND p.event_type = 'purchase' WHERE c.event_type = 'click'"))
def changes_join(spark, sf_dir):
    """A padded row is retracted once its key has a partner, and comes back when the last partner goes."""
    return _deltas(spark, sf_dir, "SELECT c.event_id AS a, p.event_id AS b FROM click c LEFT JOIN purchase p ON c.user_id = p.user_id", ("click", "purchase"))


@query(_delta_oracle("user_id, event_id, v", "SELECT e, user_id, event_id, v FROM n QUALIFY row_number() OVER (PARTITION BY e, user_id ORDER BY t DESC, event_id DESC) = 1"))
def changes_latest(spark, sf_dir):
    return _deltas(spark, sf_dir, "SELECT user_id, event_id, v FROM events LATEST BY user_id")


@query(_delta_oracle("user_id", "SELECT DISTINCT e, user_id FROM n WHERE event_type IN ('click', 'purchase')"))
def changes_union(spark, sf_dir):
    return _deltas(spark, sf_dir, "SELECT user_id FROM click UNION SELECT user_id FROM purchase", ("click", "purchase"))


@query(_delta_oracle("event_id, user_id", "SELECT e, event_id, user_id FROM n QUALIFY row_number() OVER (PARTITION BY e ORDER BY t DESC, event_id DESC) <= 500"))
def changes_retention(spark, sf_dir):
    """Rows that newer ones push out are retracted."""
    return _deltas(spark, sf_dir, "SELECT event_id, user_id FROM events", max_rows=500)


# -- graphs and generators ----------------------------------------------------------------------------


def _edges(spark, sf_dir):
    """From customer to order over all orders, by their whole numbers: a number may be both, which makes chains and cycles."""
    return read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"))


EDGES = "(SELECT o_custkey AS src, o_orderkey AS dst FROM orders)"


@query(f"WITH RECURSIVE r(node) AS (SELECT 1::BIGINT UNION SELECT e.dst FROM r JOIN {EDGES} e ON r.node = e.src) SELECT node FROM r")
def reachability(spark, sf_dir):
    return graph.reachability(_edges(spark, sf_dir), spark.range(1, 2).withColumnRenamed("id", "node"))


@query(f"WITH RECURSIVE r(src, dst) AS (SELECT DISTINCT src, dst FROM {EDGES} UNION SELECT r.src, e.dst FROM r JOIN {EDGES} e ON r.dst = e.src) SELECT src, dst FROM r")
def closure(spark, sf_dir):
    return graph.transitive_closure(_edges(spark, sf_dir))


# Every node pair of a component is too much for recursive SQL: no oracle, tests/test_graph.py goes by brute force.
@query()
def components(spark, sf_dir):
    return graph.connected_components(_edges(spark, sf_dir))


@query()
def gen_trades(spark, sf_dir):
    return generators.trades(spark, 5000)


@query()
def gen_quotes(spark, sf_dir):
    return generators.quotes(spark, 5000)


@query()
def gen_orders(spark, sf_dir):
    return generators.orders(spark, 5000)


@query()
def gen_app_events(spark, sf_dir):
    return generators.app_events(spark, 5000)


@query()
def gen_structures(spark, sf_dir):
    return generators.structures(spark, 5000)


@query()
def gen_order_events(spark, sf_dir):
    return generators.order_events(spark, 5000)


@query()
def mc_paths(spark, sf_dir):
    book = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("instrument_id"), F.col("p_brand").alias("grp"), F.col("p_retailprice").alias("s0"), F.lit(0.2).alias("vol"))
    return generators.scenario_paths(spark, 200, book, 10, 0.4)
