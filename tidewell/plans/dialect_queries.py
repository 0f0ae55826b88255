"""Queries in the dialect over the test tables, each with the same query for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.plans.builder import Session, references

#: Event time of the tables that have one.
TIMES = {"orders": "o_orderdate", "lineitem": "l_shipdate"}


def session(spark: SparkSession, sf_dir: str, names: list[str]) -> Session:
    """A session over the named sources; only their files are opened."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    s = Session(spark)
    for t in names:
        if t == "events":
            s.register(t, read(t), ts="ts", json=("props",), arrival="event_id")
        elif t == "structures":
            legs = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_returnflag"))), lambda x: F.struct(x["l_linenumber"].alias("leg"), x["l_quantity"].alias("notional"), x["l_returnflag"].alias("ccy")))
            by_order = read("lineitem").groupBy("l_orderkey").agg(legs.alias("legs")).select(F.col("l_orderkey").alias("trade_id"), F.to_json("legs").alias("legs"))
            s.register(t, by_order, json=("legs",))
        else:
            s.register(t, read(t), ts=TIMES.get(t))
    return s


E = "(epoch_us(ts) // 1000)"
HOUR, DAY = 3_600_000, 86_400_000
BUCKET = f"{E} - (({E} % {{0}}) + {{0}}) % {{0}}"
KIND = lambda k: f"(SELECT event_id, user_id, value, (epoch_us(ts) // 1000) AS t FROM events WHERE event_type = '{k}')"
CLICKS = "(SELECT event_id, user_id, value FROM events WHERE event_type = 'click')"
BUYS = "(SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase')"

#: key -> (mode, statement, oracle)
STATEMENTS: dict[str, tuple[str, str, str]] = {
    # -- scans, projections, predicates
    "scan_stream": ("pipeline", "SELECT event_id, event_type, value FROM events", "SELECT event_id, event_type, value FROM events"),
    "project": ("pipeline", "SELECT event_id AS id, user_id uid, value * 2 AS twice, 'it''s' AS label, value + user_id FROM events -- a comment", "SELECT event_id AS id, user_id AS uid, value * 2 AS twice, 'it''s' AS label, value + user_id AS col5 FROM events"),
    "star": ("table", "SELECT * FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey", "SELECT n_nationkey::BIGINT AS n_n_nationkey, n_name AS n_n_name, n_regionkey::BIGINT AS n_n_regionkey, r_regionkey::BIGINT AS r_r_regionkey, r_name AS r_r_name FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "star_alias": ("table", "SELECT c.*, n.n_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey", "SELECT c_custkey AS c_c_custkey, c_name AS c_c_name, c_nationkey::BIGINT AS c_c_nationkey, c_acctbal AS c_c_acctbal, c_mktsegment AS c_c_mktsegment, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey"),
    "filter": ("pipeline", "SELECT event_id, value FROM events WHERE event_type = 'purchase' AND value > 20", "SELECT event_id, value FROM events WHERE event_type = 'purchase' AND value > 20"),
    "predicates": ("table", "SELECT event_id, value >= 10 AS ge, value <= 10 AS le, value != 10 AS ne, user_id < 50 AS lt, event_type > 'login' AS gt, event_type = 5 AS mixed_eq, event_type < 5 AS mixed_lt FROM events",
                   "SELECT event_id, value >= 10 AS ge, value <= 10 AS le, value <> 10 AS ne, user_id < 50 AS lt, event_type > 'login' AS gt, false AS mixed_eq, NULL::BOOLEAN AS mixed_lt FROM events"),
    "three_valued": ("table", "SELECT event_id, (value / user_id > 1) AND TRUE AS a, (value / user_id > 1) OR (event_type = 'view') AS b, NOT (value / user_id > 1) AS c, value = NULL AS d FROM events",
                     "SELECT event_id, (value / nullif(user_id, 0) > 1) AND true AS a, (value / nullif(user_id, 0) > 1) OR (event_type = 'view') AS b, NOT (value / nullif(user_id, 0) > 1) AS c, NULL::BOOLEAN AS d FROM events"),
    "arith": ("table", "SELECT event_id, user_id + 3 AS a, user_id - value AS b, -user_id * 2 AS c, value / user_id AS d, event_id % user_id AS e, event_id / 7 AS f, -event_id % 7 AS g, value % 2.5 AS h FROM events",
              "SELECT event_id, user_id + 3 AS a, user_id - value AS b, -user_id * 2 AS c, value / nullif(user_id, 0) AS d, event_id % nullif(user_id, 0) AS e, event_id / 7 AS f, -event_id % 7 AS g, value % 2.5 AS h FROM events"),
    # -- joins in table mode
    "table_join_inner": ("table", "SELECT o.o_orderkey, c.c_name, o.o_totalprice FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey", "SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey"),
    "table_join_left": ("table", "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_orderstatus = 'P'", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P'"),
    "table_join_right": ("table", "SELECT c.c_custkey, n.n_name FROM (SELECT c_custkey, c_nationkey FROM customer WHERE c_acctbal < 0) c RIGHT JOIN nation n ON c.c_nationkey = n.n_nationkey", "SELECT c_custkey, n_name FROM (SELECT * FROM customer WHERE c_acctbal < 0) RIGHT JOIN nation ON c_nationkey = n_nationkey"),
    "table_join_full": ("table", "SELECT a.c_custkey AS a_key, b.s_suppkey AS b_key FROM (SELECT c_custkey, c_nationkey FROM customer WHERE c_acctbal > 9500) a FULL OUTER JOIN (SELECT s_suppkey, s_nationkey FROM supplier WHERE s_acctbal > 5000) b ON a.c_nationkey = b.s_nationkey",
                        "SELECT c_custkey AS a_key, s_suppkey AS b_key FROM (SELECT * FROM customer WHERE c_acctbal > 9500) FULL JOIN (SELECT * FROM supplier WHERE s_acctbal > 5000) ON c_nationkey = s_nationkey"),
    "table_join_residual": ("table", "SELECT c.c_custkey, s.s_suppkey FROM customer c LEFT JOIN supplier s ON c.c_nationkey = s.s_nationkey AND s.s_acctbal > c.c_acctbal + 3000", "SELECT c_custkey, s_suppkey FROM customer LEFT JOIN supplier ON c_nationkey = s_nationkey AND s_acctbal > c_acctbal + 3000"),
    "table_join_composite": ("table", "SELECT a.l_orderkey, a.l_linenumber, b.l_quantity FROM lineitem a JOIN (SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'R') b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber WHERE a.l_quantity > 40",
                             "SELECT a.l_orderkey, a.l_linenumber::BIGINT AS l_linenumber, b.l_quantity FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber WHERE b.l_returnflag = 'R' AND a.l_quantity > 40"),
    "table_join_cross": ("table", "SELECT a.r_name AS x, b.r_name AS y FROM region a CROSS JOIN region b", "SELECT a.r_name AS x, b.r_name AS y FROM region a CROSS JOIN region b"),
    "self_join": ("table", "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey", "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey"),
    "multiway_join": ("table", "SELECT r.r_name, n.n_name, COUNT(*) AS n FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name, n.n_name",
                      "SELECT r_name, n_name, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL"),
    "semi_in": ("table", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)"),
    "exists": ("table", "SELECT n_name FROM nation WHERE EXISTS (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) AND n_regionkey = 1", "SELECT n_name FROM nation WHERE EXISTS (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) AND n_regionkey = 1"),
    "not_exists": ("table", "SELECT n_name FROM nation WHERE NOT EXISTS (SELECT s_suppkey FROM supplier WHERE s_acctbal < -99999)", "SELECT n_name FROM nation WHERE NOT EXISTS (SELECT s_suppkey FROM supplier WHERE s_acctbal < -99999)"),
    "anti_not_in": ("table", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')"),
    "anti_not_in_nulls": ("table", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey END AS k FROM supplier)", "SELECT n_nationkey::BIGINT AS n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey END FROM supplier)"),
    "anti_not_in_empty": ("table", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey < 0)", "SELECT n_nationkey::BIGINT AS n_nationkey FROM nation"),
    "scalar_uncorr": ("table", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) * 1.9 AS a FROM orders)", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.9 FROM orders)"),
    "scalar_corr": ("table", "SELECT c.c_custkey, (SELECT MAX(o.o_totalprice) AS m FROM orders o WHERE o.o_custkey = c.c_custkey) AS biggest FROM customer c", "SELECT c_custkey, m AS biggest FROM customer JOIN (SELECT o_custkey, max(o_totalprice) AS m FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey"),
    # -- joins in pipeline mode
    "interval_join_inner": ("pipeline", f"SELECT c.event_id AS a, b.event_id AS b FROM {CLICKS} c JOIN {BUYS} b WITHIN 6 HOURS ON c.user_id = b.user_id AND b.value > c.value", f"SELECT c.event_id AS a, b.event_id AS b FROM {KIND('click')} c JOIN {KIND('purchase')} b ON c.user_id = b.user_id AND abs(c.t - b.t) <= {6 * HOUR} AND b.value > c.value"),
    "interval_join_left": ("pipeline", f"SELECT c.event_id AS a, b.event_id AS b FROM {CLICKS} c LEFT JOIN {BUYS} b WITHIN 2 HOURS ON c.user_id = b.user_id", f"SELECT c.event_id AS a, b.event_id AS b FROM {KIND('click')} c LEFT JOIN {KIND('purchase')} b ON c.user_id = b.user_id AND abs(c.t - b.t) <= {2 * HOUR}"),
    "interval_join_right": ("pipeline", f"SELECT c.event_id AS a, b.event_id AS b FROM {CLICKS} c RIGHT JOIN {BUYS} b WITHIN 2 HOURS ON c.user_id = b.user_id", f"SELECT c.event_id AS a, b.event_id AS b FROM {KIND('click')} c RIGHT JOIN {KIND('purchase')} b ON c.user_id = b.user_id AND abs(c.t - b.t) <= {2 * HOUR}"),
    "interval_join_full": ("pipeline", f"SELECT c.event_id AS a, b.event_id AS b FROM {CLICKS} c FULL JOIN {BUYS} b WITHIN 2 HOURS ON c.user_id = b.user_id", f"SELECT c.event_id AS a, b.event_id AS b FROM {KIND('click')} c FULL JOIN {KIND('purchase')} b ON c.user_id = b.user_id AND abs(c.t - b.t) <= {2 * HOUR}"),
    "interval_join_cross": ("pipeline", f"SELECT c.event_id AS a, b.event_id AS b FROM {CLICKS} c CROSS JOIN {BUYS} b WITHIN 2 MINUTES", f"SELECT c.event_id AS a, b.event_id AS b FROM {KIND('click')} c JOIN {KIND('purchase')} b ON abs(c.t - b.t) <= 120000"),
    "json_join_key": ("pipeline", f"SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN {BUYS} b WITHIN 30 MINUTES ON TO_LONG(a.props ->> 'k') = b.user_id", f"SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN {KIND('purchase')} b ON (a.props ->> '$.k')::BIGINT = b.user_id AND abs((epoch_us(a.ts) // 1000) - b.t) <= 1800000"),
    "snapshot_semi": ("pipeline", "WITH hot AS (SELECT user_id, COUNT(*) AS n FROM events GROUP BY user_id WINDOW TUMBLING(SIZE 12 HOURS)) SELECT e.event_id, e.user_id FROM events e WHERE e.user_id IN (SELECT h.user_id FROM (SELECT user_id FROM events WHERE event_type = 'purchase' GROUP BY user_id WINDOW TUMBLING(SIZE 12 HOURS)) h GROUP BY h.user_id WINDOW TUMBLING(SIZE 12 HOURS))",
                      f"WITH i AS (SELECT DISTINCT user_id, {BUCKET.format(12 * HOUR)} + {24 * HOUR} AS e FROM events WHERE event_type = 'purchase'), x AS (SELECT event_id, user_id, (SELECT max(e) FROM i WHERE e <= (epoch_us(ts) // 1000)) AS v FROM events) SELECT event_id, user_id FROM x WHERE EXISTS (SELECT 1 FROM i WHERE i.e = x.v AND i.user_id = x.user_id)"),
    "snapshot_scalar": ("pipeline", "SELECT event_id, value, (SELECT MAX(value) AS m FROM events WINDOW TUMBLING(SIZE 1 HOURS)) AS prior FROM events",
                        f"WITH i AS (SELECT max(value) AS m, {BUCKET.format(HOUR)} + {HOUR} AS e FROM events GROUP BY 2) SELECT x.event_id, x.value, i.m AS prior FROM (SELECT event_id, value, (SELECT max(e) FROM i WHERE e <= (epoch_us(ts) // 1000)) AS v FROM events) x LEFT JOIN i ON i.e = x.v"),
    # -- aggregates
    "agg_count": ("table", "SELECT event_type, COUNT(*), COUNT(value / user_id) AS n FROM events GROUP BY event_type", "SELECT event_type, count(*) AS count_star, count(value / nullif(user_id, 0)) AS n FROM events GROUP BY event_type"),
    "agg_count_distinct": ("table", "SELECT event_type, COUNT(DISTINCT user_id) AS users FROM events GROUP BY event_type", "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type"),
    "agg_sum": ("table", "SELECT event_type, SUM(user_id) AS ids, ROUND(SUM(value), 4) AS total, SUM(event_type) AS text_sum FROM events GROUP BY event_type", "SELECT event_type, sum(user_id)::BIGINT AS ids, round(sum(value), 4) AS total, NULL::DOUBLE AS text_sum FROM events GROUP BY event_type"),
    "agg_avg": ("table", "SELECT event_type, ROUND(AVG(value), 6) AS mean FROM events GROUP BY event_type", "SELECT event_type, round(avg(value), 6) AS mean FROM events GROUP BY event_type"),
    "agg_minmax": ("table", "SELECT user_id, MIN(value) AS low, MAX(value) AS high, MIN(event_type) AS first_type, MAX(value > 5) AS any_big FROM events GROUP BY user_id", "SELECT user_id, min(value) AS low, max(value) AS high, min(event_type) AS first_type, max(value > 5) AS any_big FROM events GROUP BY user_id"),
    "agg_var_samp": ("table", "SELECT user_id, ROUND(VAR_SAMP(value), 5) AS a, ROUND(VARIANCE(value), 5) AS b, ROUND(VAR(value), 5) AS c FROM events GROUP BY user_id", "SELECT user_id, round(var_samp(value), 5) AS a, round(var_samp(value), 5) AS b, round(var_samp(value), 5) AS c FROM events GROUP BY user_id"),
    "agg_var_pop": ("table", "SELECT user_id, ROUND(VAR_POP(value), 5) AS v FROM events GROUP BY user_id", "SELECT user_id, round(var_pop(value), 5) AS v FROM events GROUP BY user_id"),
    "agg_stddev": ("table", "SELECT event_type, ROUND(STDDEV(value), 6) AS a, ROUND(STDDEV_SAMP(value), 6) AS b, ROUND(STDDEV_POP(value), 6) AS c, ROUND(STDEV(value), 6) AS d FROM events GROUP BY event_type", "SELECT event_type, round(stddev_samp(value), 6) AS a, round(stddev_samp(value), 6) AS b, round(stddev_pop(value), 6) AS c, round(stddev_samp(value), 6) AS d FROM events GROUP BY event_type"),
    "agg_median": ("table", "SELECT event_type, ROUND(MEDIAN(value), 6) AS m FROM events GROUP BY event_type", "SELECT event_type, round(median(value), 6) AS m FROM events GROUP BY event_type"),
    "agg_percentile": ("table", "SELECT event_type, ROUND(PERCENTILE_CONT(0.25, value), 6) AS q1, ROUND(PERCENTILE_CONT(0.99, value), 6) AS q99 FROM events GROUP BY event_type", "SELECT event_type, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.99), 6) AS q99 FROM events GROUP BY event_type"),
    "group_by_expr": ("table", "SELECT user_id % 10 AS slot, COUNT(*) AS n, ROUND(SUM(value * user_id) / SUM(user_id), 6) AS vwap FROM events GROUP BY user_id % 10", "SELECT user_id % 10 AS slot, count(*) AS n, round(sum(value * user_id) / nullif(sum(user_id), 0), 6) AS vwap FROM events GROUP BY 1"),
    "group_by_all": ("table", "SELECT event_type, user_id % 3 AS r, COUNT(*) AS n FROM events GROUP BY ALL", "SELECT event_type, user_id % 3 AS r, count(*) AS n FROM events GROUP BY ALL"),
    "group_null_key": ("table", "SELECT CASE WHEN user_id % 4 != 0 THEN event_type END AS k, COUNT(*) AS n FROM events GROUP BY CASE WHEN user_id % 4 != 0 THEN event_type END", "SELECT CASE WHEN user_id % 4 <> 0 THEN event_type END AS k, count(*) AS n FROM events GROUP BY 1"),
    "group_by_json": ("table", "SELECT props ->> 'k' AS k, COUNT(*) AS n FROM events GROUP BY props ->> 'k'", "SELECT props ->> '$.k' AS k, count(*) AS n FROM events GROUP BY 1"),
    "agg_global": ("table", "SELECT COUNT(*) AS n, SUM(user_id) AS s, MAX(value) AS m FROM events", "SELECT count(*) AS n, sum(user_id)::BIGINT AS s, max(value) AS m FROM events"),
    "agg_global_empty": ("table", "SELECT COUNT(*) AS n, SUM(user_id) AS s FROM events WHERE event_type = 'no such type'", "SELECT count(*) AS n, sum(user_id)::BIGINT AS s FROM events WHERE event_type = 'no such type' HAVING count(*) > 0"),
    # -- windows
    "vwap_tumbling": ("pipeline", "SELECT event_type, SUM(value * user_id) / SUM(user_id) AS vwap, COUNT(*) AS n FROM events GROUP BY event_type WINDOW TUMBLING(SIZE 1 HOURS)",
                      f"SELECT event_type, sum(value * user_id) / nullif(sum(user_id), 0) AS vwap, count(*) AS n, {BUCKET.format(HOUR)} AS window_start, {BUCKET.format(HOUR)} + {HOUR} AS window_end FROM events GROUP BY ALL"),
    "win_tumbling": ("pipeline", "SELECT event_type, COUNT(*) AS n, MAX(value) AS high FROM events GROUP BY event_type WINDOW TUMBLING(SIZE 30 MINUTES) EMIT FINAL", f"SELECT event_type, count(*) AS n, max(value) AS high, {BUCKET.format(HOUR // 2)} AS window_start, {BUCKET.format(HOUR // 2)} + {HOUR // 2} AS window_end FROM events GROUP BY ALL"),
    "win_hopping": ("pipeline", "SELECT event_type, COUNT(*) AS n, SUM(user_id) AS s FROM events GROUP BY event_type WINDOW HOPPING(SIZE 6 HOURS, ADVANCE BY 2 HOURS)",
                    f"SELECT event_type, count(*) AS n, sum(user_id)::BIGINT AS s, b AS window_start, b + {6 * HOUR} AS window_end FROM (SELECT *, {BUCKET.format(2 * HOUR)} - k * {2 * HOUR} AS b FROM events, range(3) r(k)) GROUP BY ALL"),
    "win_hopping_gaps": ("pipeline", "SELECT COUNT(*) AS n FROM events WINDOW HOPPING(SIZE 1 HOURS, ADVANCE BY 3 HOURS)", f"SELECT count(*) AS n, {BUCKET.format(3 * HOUR)} AS window_start, {BUCKET.format(3 * HOUR)} + {HOUR} AS window_end FROM events WHERE {E} - ({BUCKET.format(3 * HOUR)}) < {HOUR} GROUP BY ALL"),
    "win_session": ("pipeline", "SELECT user_id, COUNT(*) AS n FROM events GROUP BY user_id WINDOW SESSION(GAP 3 HOURS)",
                    f"SELECT user_id, count(*) AS n, min(t) AS window_start, max(t) AS window_end FROM (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT event_id, user_id, {E} AS t, CASE WHEN {E} - lag({E}) OVER (PARTITION BY user_id ORDER BY {E}, event_id) <= {3 * HOUR} THEN 0 ELSE 1 END AS b FROM events)) GROUP BY user_id, s"),
    "emit_changes_sql": ("pipeline", "SELECT event_type, COUNT(*) AS n, MAX(value) AS high FROM events GROUP BY event_type WINDOW TUMBLING(SIZE 1 HOURS) EMIT CHANGES",
                         f"WITH w AS (SELECT *, {BUCKET.format(HOUR)} AS s FROM events) SELECT event_type, count(*) OVER r AS n, max(value) OVER r AS high, s AS window_start, s + {HOUR} AS window_end, false AS _final FROM w WINDOW r AS (PARTITION BY event_type, s ORDER BY event_id ROWS UNBOUNDED PRECEDING) UNION ALL SELECT event_type, count(*), max(value), s, s + {HOUR}, true FROM w GROUP BY event_type, s"),
    "win_global": ("pipeline", "SELECT COUNT(*) AS n, COUNT(DISTINCT user_id) AS users FROM events WINDOW TUMBLING(SIZE 24 HOURS)", f"SELECT count(*) AS n, count(DISTINCT user_id) AS users, {BUCKET.format(DAY)} AS window_start, {BUCKET.format(DAY)} + {DAY} AS window_end FROM events GROUP BY ALL"),
    "win_nested": ("pipeline", "SELECT h.event_type, MAX(h.n) AS peak, COUNT(*) AS hours FROM (SELECT event_type, COUNT(*) AS n FROM events GROUP BY event_type WINDOW TUMBLING(SIZE 1 HOURS)) h GROUP BY h.event_type WINDOW TUMBLING(SIZE 24 HOURS)",
                   f"WITH h AS (SELECT event_type, count(*) AS n, {BUCKET.format(HOUR)} + {HOUR} AS e FROM events GROUP BY ALL) SELECT event_type, max(n) AS peak, count(*) AS hours, e - e % {DAY} AS window_start, e - e % {DAY} + {DAY} AS window_end FROM h GROUP BY ALL"),
    # -- newest rows, unions, subqueries, arrays
    "latest_by": ("table", "SELECT user_id, event_id, event_type, value FROM events LATEST BY user_id", "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"),
    "latest_by_multi": ("table", "SELECT user_id, event_type, event_id FROM events WHERE value > 5 LATEST BY (user_id, event_type)", "SELECT user_id, event_type, event_id FROM events WHERE value > 5 QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1"),
    "union_all": ("table", "SELECT c_custkey AS k, c_acctbal AS v FROM customer UNION ALL SELECT s_suppkey, s_nationkey FROM supplier", "SELECT c_custkey AS k, c_acctbal AS v FROM customer UNION ALL SELECT s_suppkey, s_nationkey::DOUBLE FROM supplier"),
    "union_distinct": ("table", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier", "SELECT c_nationkey::BIGINT AS k FROM customer UNION SELECT s_nationkey FROM supplier"),
    "cte": ("table", "WITH rich AS (SELECT c_custkey, c_nationkey FROM customer WHERE c_acctbal > 9000) SELECT c_nationkey, COUNT(*) AS n FROM rich GROUP BY c_nationkey", "SELECT c_nationkey::BIGINT AS c_nationkey, count(*) AS n FROM customer WHERE c_acctbal > 9000 GROUP BY ALL"),
    "cte_chain": ("table", "WITH a AS (SELECT o_custkey, SUM(o_totalprice) AS spent FROM orders GROUP BY o_custkey), b AS (SELECT o_custkey, spent FROM a WHERE spent > 2000000) SELECT c.c_name, ROUND(b.spent, 2) AS spent FROM b JOIN customer c ON b.o_custkey = c.c_custkey",
                  "SELECT c_name, round(spent, 2) AS spent FROM (SELECT o_custkey, sum(o_totalprice) AS spent FROM orders GROUP BY o_custkey) JOIN customer ON o_custkey = c_custkey WHERE spent > 2000000"),
    "derived": ("table", "SELECT x.k, x.twice FROM (SELECT event_id AS k, value * 2 AS twice FROM events) x WHERE x.twice > 50", "SELECT event_id AS k, value * 2 AS twice FROM events WHERE value * 2 > 50"),
    "agg_of_agg": ("table", "SELECT d.n AS n, COUNT(*) AS users FROM (SELECT user_id, COUNT(*) AS n FROM events GROUP BY user_id) d GROUP BY d.n", "SELECT n, count(*) AS users FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) GROUP BY n"),
    "derived_union": ("table", "SELECT u.k, COUNT(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey AS k FROM supplier) u GROUP BY u.k", "SELECT k, count(*) AS n FROM (SELECT c_nationkey::BIGINT AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY k"),
    "unnest": ("pipeline", "SELECT s.trade_id, l ->> 'ccy' AS ccy, TO_LONG(l ->> 'leg') AS leg FROM structures s, UNNEST(s.legs) AS l", "SELECT l_orderkey AS trade_id, l_returnflag AS ccy, l_linenumber::BIGINT AS leg FROM lineitem"),
    "unnest_group": ("table", "SELECT l ->> 'ccy' AS ccy, SUM(l -> 'notional') AS notional, COUNT(*) AS legs FROM structures s, UNNEST(s.legs) AS l GROUP BY l ->> 'ccy'", "SELECT l_returnflag AS ccy, sum(l_quantity) AS notional, count(*) AS legs FROM lineitem GROUP BY l_returnflag"),
    "unnest_join": ("table", "SELECT o.o_orderkey, l ->> 'ccy' AS ccy FROM orders o JOIN structures s ON o.o_orderkey = s.trade_id CROSS JOIN UNNEST(s.legs) AS l WHERE o.o_orderstatus = 'P'", "SELECT o_orderkey, l_returnflag AS ccy FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'P'"),
    # -- functions
    "fn_math": ("table", "SELECT event_id, ABS(10 - user_id) AS a, ABS(5.5 - value) AS b, ROUND(value) AS c, ROUND(value, 1) AS d, ROUND(user_id, -2) AS e FROM events", "SELECT event_id, abs(10 - user_id) AS a, abs(5.5 - value) AS b, round(value) AS c, round(value, 1) AS d, user_id::DOUBLE AS e FROM events"),
    "fn_string": ("table", "SELECT p_partkey, UPPER(p_name) AS u, LOWER(p_brand) AS l, UPPER(p_size) AS nothing FROM part", "SELECT p_partkey, upper(p_name) AS u, lower(p_brand) AS l, NULL::VARCHAR AS nothing FROM part"),
    "fn_coalesce": ("table", "SELECT event_id, COALESCE(value / user_id, -1) AS a, COALESCE(NULL, event_type) AS b FROM events", "SELECT event_id, coalesce(value / nullif(user_id, 0), -1) AS a, event_type AS b FROM events"),
    "case_when": ("table", "SELECT event_id, CASE WHEN value > 20 THEN 'high' WHEN value > 5 THEN 'mid' ELSE 'low' END AS band, IF(user_id > 75, 1, 0) AS half, CASE WHEN value / user_id > 1 THEN 1 END AS maybe FROM events", "SELECT event_id, CASE WHEN value > 20 THEN 'high' WHEN value > 5 THEN 'mid' ELSE 'low' END AS band, CASE WHEN user_id > 75 THEN 1 ELSE 0 END::BIGINT AS half, CASE WHEN value / nullif(user_id, 0) > 1 THEN 1 END::BIGINT AS maybe FROM events"),
    "fn_to_long": ("table", "SELECT event_id, TO_LONG(value) AS a, TO_LONG(props ->> 'k') AS b, TO_LONG(value > 5) AS c, TO_LONG(event_type) AS d, TO_LONG('1.5') AS e, TO_LONG(' 12 ') AS f FROM events", "SELECT event_id, trunc(value)::BIGINT AS a, (props ->> '$.k')::BIGINT AS b, (value > 5)::BIGINT AS c, NULL::BIGINT AS d, NULL::BIGINT AS e, 12::BIGINT AS f FROM events"),
    "fn_to_double": ("table", "SELECT event_id, TO_DOUBLE(user_id) AS a, TO_DOUBLE('1,234.5') AS b, TO_DOUBLE('1d') AS c, TO_DOUBLE(props ->> 'k') AS d FROM events", "SELECT event_id, user_id::DOUBLE AS a, 1234.5::DOUBLE AS b, NULL::DOUBLE AS c, (props ->> '$.k')::DOUBLE AS d FROM events"),
    "fn_to_bool": ("table", "SELECT event_id, TO_BOOL(user_id) AS a, TO_BOOL('abc') AS b, TO_BOOL('0') AS c, TO_BOOL('False') AS d, TO_BOOL('') AS e FROM events", "SELECT event_id, user_id <> 0 AS a, true AS b, false AS c, false AS d, false AS e FROM events"),
    "fn_to_timestamp": ("table", "SELECT event_id, TO_LONG(TO_TIMESTAMP('2024-01-02T03:04:05Z')) AS a, TO_LONG(TO_TIMESTAMP('1700000000000')) AS b, TO_LONG(TO_TIMESTAMP('soon')) AS c, TO_STRING(TO_TIMESTAMP(event_id * 1000)) AS d FROM events", "SELECT event_id, 1704164645000::BIGINT AS a, 1700000000000::BIGINT AS b, NULL::BIGINT AS c, strftime(make_timestamp(event_id * 1000000), '%Y-%m-%dT%H:%M:%S.%gZ') AS d FROM events"),
    "fn_to_string": ("table", "SELECT event_id, TO_STRING(user_id) AS a, TO_STRING(value > 5) AS b, TO_STRING(user_id * 1.0) AS c, TO_STRING(0.1) AS d, TO_STRING(1e20) AS e, TO_STRING(0.00001234) AS f FROM events", "SELECT event_id, user_id::VARCHAR AS a, (value > 5)::VARCHAR AS b, user_id::VARCHAR AS c, '0.1' AS d, '1E+20' AS e, '1.234E-05' AS f FROM events"),
    "fn_cast": ("table", "SELECT event_id, CAST(value AS LONG) AS a, CAST(user_id AS STRING) AS b, CAST(user_id AS DOUBLE PRECISION) AS c, CAST('x' AS INT) AS d, CAST(user_id AS BOOL) AS e FROM events", "SELECT event_id, trunc(value)::BIGINT AS a, user_id::VARCHAR AS b, user_id::DOUBLE AS c, NULL::BIGINT AS d, user_id <> 0 AS e FROM events"),
    "json_arrow": ("table", "SELECT trade_id, legs -> 0 -> 'leg' AS first_leg, TO_STRING(legs -> 0 -> 'ccy') AS ccy_json, legs -> 99 AS none FROM structures", "WITH f AS (SELECT l_orderkey, min({'n': l_linenumber, 'q': l_quantity, 'c': l_returnflag}) AS x FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey AS trade_id, x.n::VARCHAR AS first_leg, '\"' || x.c || '\"' AS ccy_json, NULL::VARCHAR AS none FROM f"),
    "json_text": ("table", "SELECT event_id, props ->> 'k' AS k, props ->> 'missing' AS missing FROM events", "SELECT event_id, props ->> '$.k' AS k, NULL::VARCHAR AS missing FROM events"),
    "json_sum": ("table", "SELECT event_type, SUM(props -> 'k') AS total, SUM(props ->> 'k') AS text_total FROM events GROUP BY event_type", "SELECT event_type, sum((props ->> '$.k')::DOUBLE) AS total, NULL::DOUBLE AS text_total FROM events GROUP BY event_type"),
    "quant_fx": ("table", "SELECT p_partkey, ROUND(FX_FWD(p_retailprice, 0.05, 0.02, p_size), 6) AS f, FX_FWD(-1, 0.1, 0.1, 1) AS none FROM part", "SELECT p_partkey, round(p_retailprice * exp((0.05::DOUBLE - 0.02::DOUBLE) * p_size), 6) AS f, NULL::DOUBLE AS none FROM part"),
    "quant_bond": ("table", "SELECT p_partkey, ROUND(BOND_PRICE(100, 0.05, p_size, 0.04, 2), 6) AS price, ROUND(BOND_DURATION(100, 0.05, p_size, 0.04, 2), 6) AS duration, ROUND(BOND_DV01(100, 0.05, p_size, 0.04, 2), 6) AS dv01 FROM part",
                   "WITH f AS (SELECT p_partkey, p_size, unnest(range(1, p_size * 2 + 1)) AS i FROM part), c AS (SELECT p_partkey, i, (2.5::DOUBLE + CASE WHEN i = p_size * 2 THEN 100 ELSE 0 END) / pow(1.02::DOUBLE, i) AS pv FROM f), s AS (SELECT p_partkey, sum(pv) AS price, sum(pv * i / 2) / sum(pv) / 1.02::DOUBLE AS d FROM c GROUP BY p_partkey) SELECT p_partkey, round(price, 6) AS price, round(d, 6) AS duration, round(price * d * 0.0001::DOUBLE, 6) AS dv01 FROM part LEFT JOIN s USING (p_partkey)"),
    "quant_irs": ("table", "SELECT p_partkey, ROUND(IRS_NPV(1000000, 0.03, p_size, 0.04, TRUE), 4) AS npv, ROUND(IRS_DV01(1000000, 0.03, p_size, 0.04, FALSE), 4) AS dv01 FROM part",
                  "WITH v AS (SELECT p_partkey, (1e6::DOUBLE * (1 - pow(1.04::DOUBLE, -p_size)) - 1e6::DOUBLE * 0.03::DOUBLE * (1 - pow(1.04::DOUBLE, -p_size)) / 0.04::DOUBLE) AS a, (1e6::DOUBLE * (1 - pow(1.0401::DOUBLE, -p_size)) - 1e6::DOUBLE * 0.03::DOUBLE * (1 - pow(1.0401::DOUBLE, -p_size)) / 0.0401::DOUBLE) AS b FROM part WHERE p_size > 0) SELECT p_partkey, round(a, 4) AS npv, round(abs(b - a), 4) AS dv01 FROM part LEFT JOIN v USING (p_partkey)"),
    "quant_bs": ("table", "SELECT p_partkey, ROUND(BS_PRICE(p_retailprice, 1000, 0.5, 0.03, 0.01, 0.2, TRUE), 6) AS call, ROUND(BS_PRICE(p_retailprice, 1000, 0.5, 0.03, 0.01, 0.2, FALSE), 6) AS put, ROUND(BS_DELTA(p_retailprice, 1000, 0.5, 0.03, 0.01, 0.2, TRUE), 8) AS delta, ROUND(BS_GAMMA(p_retailprice, 1000, 0.5, 0.03, 0.01, 0.2, TRUE), 8) AS gamma, ROUND(BS_VEGA(p_retailprice, 1000, 0.5, 0.03, 0.01, 0.2, TRUE), 6) AS vega, ROUND(BS_THETA(p_retailprice, 1000, 0.5, 0.03, 0.01, 0.2, TRUE), 6) AS theta FROM part", ""),
}


def _query(mode: str, text: str):
    names = references(text)
    return lambda spark, sf_dir: session(spark, sf_dir, names).sql(text, mode)


def table_over_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = session(spark, sf_dir, ["events"]).define("positions", "SELECT user_id, COUNT(*) AS trades, AVG(value) AS avg_value FROM events GROUP BY user_id")
    return s.sql("SELECT p.user_id, p.trades, ROUND(p.avg_value, 6) AS avg_value FROM positions p WHERE p.trades > 60")


def pipeline_as_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = session(spark, sf_dir, ["events"]).define("hourly", "SELECT event_type, COUNT(*) AS n FROM events GROUP BY event_type WINDOW TUMBLING(SIZE 1 HOURS)", "pipeline")
    return s.sql("SELECT event_type, COUNT(*) AS windows, MAX(n) AS peak, MIN(window_start) AS first_start FROM hourly GROUP BY event_type")


QUERIES = {key: _query(mode, text) for key, (mode, text, _) in STATEMENTS.items()} | {"table_over_table": table_over_table, "pipeline_as_input": pipeline_as_input}
ORACLE_SQL = {key: oracle for key, (_, _, oracle) in STATEMENTS.items() if oracle} | {
    "table_over_table": "SELECT user_id, count(*) AS trades, round(avg(value), 6) AS avg_value FROM events GROUP BY user_id HAVING count(*) > 60",
    "pipeline_as_input": f"SELECT event_type, count(*) AS windows, max(n) AS peak, min(w) AS first_start FROM (SELECT event_type, count(*) AS n, {BUCKET.format(HOUR)} AS w FROM events GROUP BY ALL) GROUP BY event_type",
}
