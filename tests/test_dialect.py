import pytest
from pyspark.sql import functions as F

from tidewell.functions import registry
from tidewell.plans.builder import Session, references, summary
from tidewell.sql import DialectError, parse
from tidewell.sql.lexer import tokenize
from tidewell.sql.tree import Binary, Call, Literal, Name

TRADES = [("A", 10.0, 1, True, 100), ("A", 11.0, 2, False, 1500), ("B", None, 3, True, 2000), (None, 5.0, None, None, 2500), ("B", 7.5, 0, True, 4100)]


@pytest.fixture(scope="module")
def s(spark):
    out = Session(spark)
    out.register("trades", spark.createDataFrame(TRADES, "symbol string, price double, qty long, active boolean, _ts long"))
    out.register("ref", spark.createDataFrame([("A", "x", 0), ("C", "y", 0), (None, "z", 0)], "symbol string, tag string, _ts long"))
    out.register("docs", spark.createDataFrame([(1, '{"a": {"b": [1, 2.5, "t"]}, "n": null, "s": "q"}', 0), (2, "[1, 2]", 0), (3, None, 0), (4, "not json", 0)], "id long, payload string, _ts long"), json=("payload",))
    return out


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_tokens_carry_positions():
    t = tokenize("SELECT a -- note\n  FROM 'it''s' 1.5e3 99999999999999999999 ->>")
    assert [x.pos for x in t[:3]] == [(1, 1), (1, 8), (2, 3)]
    assert t[3].value == "it's" and t[4].value == 1500.0 and isinstance(t[5].value, float) and t[6].text == "->>"


def test_precedence_and_sugar():
    item = parse("SELECT NOT a = 1 AND b OR -c * 2 % 3 + 1 < 5 AS x FROM t").items[0].expr
    assert item.op == "OR" and item.left.op == "AND" and item.right.op == "<"
    case = parse("SELECT CASE WHEN a THEN 1 WHEN b THEN 2 END FROM t").items[0].expr
    assert case == Call("IF", (Name(None, "a"), Literal(1), Call("IF", (Name(None, "b"), Literal(2), Literal(None)))))
    assert parse("SELECT CAST(a AS DOUBLE PRECISION) FROM t").items[0].expr == Call("TO_DOUBLE", (Name(None, "a"),))
    assert parse("SELECT a <> 1 FROM t").items[0].expr == Binary("!=", Name(None, "a"), Literal(1))


@pytest.mark.parametrize(
    ("text", "mode", "what"),
    [
        ("UPDATE t", "table", "starts with"), ("SELECT FROM trades", "table", "identifier"), ("SELECT a FROM nowhere", "table", "unknown source"), ("SELECT nope FROM trades", "table", "unknown column"),
        ("SELECT t.symbol FROM trades x", "table", "unknown alias"), ("SELECT symbol FROM trades t JOIN ref r ON t.symbol = r.symbol", "table", "ambiguous"), ("SELECT t.qty FROM trades t JOIN ref r ON t.qty > 1", "table", "equality"),
        ("SELECT COUNT(*) FROM trades", "pipeline", "WINDOW"), ("SELECT COUNT(*) FROM trades WINDOW TUMBLING(SIZE 1 SECONDS)", "table", "pipelines"), ("SELECT symbol, COUNT(*) FROM trades GROUP BY qty", "table", "neither grouped"),
        ("SELECT SUM(COUNT(*)) FROM trades", "table", "nest"), ("SELECT AVG(DISTINCT qty) FROM trades", "table", "DISTINCT"), ("SELECT symbol FROM trades UNION SELECT symbol FROM ref", "pipeline", "UNION"),
        ("SELECT symbol FROM trades UNION SELECT qty FROM trades", "table", "kind"), ("SELECT symbol FROM trades UNION SELECT symbol FROM ref UNION ALL SELECT tag FROM ref", "table", "mixed"), ("SELECT payload > 1 FROM docs", "table", "JSON"),
        ("SELECT 1 < 2 < 3 FROM trades", "table", "chain"), ("SELECT t.* AS x FROM trades t", "table", "renamed"), ("SELECT a FROM (SELECT symbol FROM trades)", "table", "alias"), ("WITH a AS (SELECT symbol FROM a) SELECT symbol FROM a", "table", "unknown source"),
        ("SELECT symbol FROM trades t JOIN ref r ON t.symbol = r.symbol", "pipeline", "WITHIN"), ("SELECT symbol FROM trades GROUP BY symbol LATEST BY symbol", "table", "unexpected"), ("SELECT PERCENTILE_CONT(2, price) FROM trades", "table", "share"),
        ("SELECT symbol FROM trades LEFT JOIN UNNEST(symbol) AS l", "table", "UNNEST"), ("SELECT UPPER() FROM trades", "table", "arguments"), ("SELECT NOPE(1) FROM trades", "table", "unknown function"), ("SELECT qty AS a, price AS a FROM trades", "table", "share a name"),
        ("SELECT 'open FROM trades", "table", "unterminated"), ("SELECT symbol FROM trades WHERE qty", "table", "condition"), ("SELECT qty FROM trades WHERE qty IN (1, 2)", "table", "subquery"),
        ("SELECT SUM() FROM trades", "table", "SUM takes 1 argument"), ("SELECT MIN(qty, price) FROM trades", "table", "MIN takes 1 argument"), ("SELECT PERCENTILE_CONT(price) FROM trades", "table", "takes 2 arguments"), ("SELECT SUM(*) FROM trades", "table", "COUNT only"),
        ("SELECT symbol AS window_start, COUNT(*) AS n FROM trades GROUP BY symbol WINDOW TUMBLING(SIZE 1 SECONDS)", "pipeline", "another name"),
    ],
)
def test_diagnostics(s, text, mode, what):
    with pytest.raises(DialectError, match=what):
        s.sql(text, mode)


def test_nulls_and_kinds(s):
    got = rows(s.sql("SELECT symbol = 'A' AS eq, qty = '1' AS mixed, qty < 'x' AS less, price / qty AS d, qty % 0 AS m, qty + NULL AS n FROM trades"))
    assert (True, False, None, 10.0, None, None) in got and (None, None, None, None, None, None) in got
    assert rows(s.sql("SELECT qty FROM trades WHERE price > 6 OR active")) == [(0,), (1,), (2,), (3,)]


def test_output_names(s):
    df = s.sql("SELECT symbol, qty + 1, UPPER(symbol), price AS p FROM trades")
    assert df.columns == ["symbol", "col2", "upper", "p"]
    assert s.sql("SELECT COUNT(*), payload ->> 's' FROM docs GROUP BY payload ->> 's'").columns == ["count_star", "s"]
    assert s.sql("SELECT * FROM trades t JOIN ref r ON t.symbol = r.symbol").columns == ["t_symbol", "t_price", "t_qty", "t_active", "r_symbol", "r_tag"]


def test_joins_and_null_keys(s):
    assert rows(s.sql("SELECT t.qty, r.tag FROM trades t FULL JOIN ref r ON t.symbol = r.symbol")) == sorted([(1, "x"), (2, "x"), (3, None), (None, None), (0, None), (None, "y"), (None, "z")], key=str)
    assert rows(s.sql("SELECT qty FROM trades WHERE symbol NOT IN (SELECT symbol FROM ref)")) == []
    assert rows(s.sql("SELECT qty FROM trades WHERE symbol NOT IN (SELECT symbol FROM ref WHERE tag != 'z')")) == [(0,), (3,)]
    assert len(rows(s.sql("SELECT qty FROM trades WHERE symbol NOT IN (SELECT symbol FROM ref WHERE tag = 'none')"))) == 5


def test_interval_join_is_inclusive_and_pads(spark):
    s = Session(spark)
    s.register("a", spark.createDataFrame([("k", 1000), ("k", -700), ("n", 0)], "x string, _ts long"))
    s.register("b", spark.createDataFrame([("k", 2000, 1), ("k", 2001, 2), ("z", 0, 3), ("k", -1700, 4)], "x string, _ts long, i long"))
    assert rows(s.sql("SELECT a._ts AS at, b.i FROM a JOIN b WITHIN 1 SECONDS ON a.x = b.x", "pipeline")) == [(-700, 4), (1000, 1)]
    assert rows(s.sql("SELECT a._ts AS at, b.i FROM a FULL JOIN b WITHIN 1 SECONDS ON a.x = b.x", "pipeline")) == sorted([(-700, 4), (1000, 1), (0, None), (None, 2), (None, 3)], key=str)


def test_json(s):
    got = rows(s.sql("SELECT id, payload -> 'a' -> 'b' AS arr, payload -> 'a' -> 'b' -> 1 AS num, payload ->> 's' AS txt, payload -> 'n' AS nul, payload -> 's' AS quoted FROM docs"))
    assert got[0] == (1, '[1,2.5,"t"]', "2.5", "q", None, '"q"')
    assert all(r[1:] == (None,) * 5 for r in got[1:])
    assert rows(s.sql("SELECT d.id, e FROM docs d, UNNEST(d.payload -> 'a' -> 'b') AS e")) == [(1, '"t"'), (1, "1"), (1, "2.5")]
    assert rows(s.sql("SELECT SUM(e) AS t, COUNT(*) AS n FROM docs d, UNNEST(d.payload -> 'a' -> 'b') AS e")) == [(3.5, 3)]


def test_windows(spark):
    s = Session(spark)
    s.register("e", spark.createDataFrame([("a", t) for t in (-1, 0, 999, 1000, 4000, 7000, 7001)] + [("b", 10_001)], "k string, _ts long"))
    assert rows(s.sql("SELECT k, COUNT(*) AS n FROM e GROUP BY k WINDOW TUMBLING(SIZE 1 SECONDS)", "pipeline"))[0] == ("a", 1, -1000, 0)
    hop = rows(s.sql("SELECT COUNT(*) AS n FROM e WINDOW HOPPING(SIZE 500 MILLISECONDS, ADVANCE BY 2 SECONDS)", "pipeline"))
    assert sorted((r[1], r[0]) for r in hop) == [(0, 1), (4000, 1), (10000, 1)]
    session = rows(s.sql("SELECT k, COUNT(*) AS n FROM e GROUP BY k WINDOW SESSION(GAP 3 SECONDS)", "pipeline"))
    assert session == [("a", 7, -1, 7001), ("b", 1, 10001, 10001)]  # 3 s apart still extends


def test_latest_by_ties_go_to_the_later_arrival(spark):
    s = Session(spark)
    s.register("o", spark.createDataFrame([("x", "NEW", 5, 1), ("x", "ACK", 5, 2), ("x", "OLD", 4, 3), ("y", "NEW", 1, 4)], "id string, stage string, _ts long, n long"), arrival="n")
    assert rows(s.sql("SELECT id, stage FROM o LATEST BY id")) == [("x", "ACK"), ("y", "NEW")]
    assert rows(s.sql("SELECT id, stage FROM o WHERE stage != 'ACK' LATEST BY (id)")) == [("x", "NEW"), ("y", "NEW")]


def test_global_aggregate_over_nothing_has_no_row(s):
    assert rows(s.sql("SELECT COUNT(*) AS n FROM trades WHERE qty > 99")) == []


def test_functions_are_total(s):
    got = rows(s.sql("SELECT ROUND(2.5) AS a, ROUND(-2.5) AS b, ROUND(1234.5, -2) AS c, ABS(-9223372036854775807 - 1) AS d, 9223372036854775807 + 1 AS e, TO_LONG('x') AS f, TO_STRING(1.0) AS g, TO_STRING(-0.00001) AS h, TO_STRING(123456789012345678.0) AS i, TO_BOOL('no') AS j FROM ref WHERE tag = 'x'"))
    assert got == [(3.0, -3.0, 1235.0, None, None, None, "1", "-1E-05", "1.2345678901234568E+17", True)]


def test_registry(s):
    registry.register("TWICE", 1, lambda x: x * 2)
    assert ("A", 20.0) in rows(s.sql("SELECT symbol, TWICE(price) AS p FROM trades"))
    registry.register_aggregate("SPREAD", lambda c: F.max(c) - F.min(c))
    assert ("A", 1.0) in rows(s.sql("SELECT symbol, SPREAD(price) AS p FROM trades GROUP BY symbol"))
    for name in ("ABS", "sum"):
        with pytest.raises(ValueError):
            registry.register(name, 1, lambda x: x)


def test_references_and_summary():
    text = "WITH c AS (SELECT k FROM b) SELECT a.k FROM a JOIN c ON a.k = c.k WHERE a.k IN (SELECT k FROM d) AND a.v > (SELECT MAX(v) AS m FROM a)"
    assert references(text) == ["a", "b", "d"]
    assert summary("SELECT k, COUNT(*) FROM a JOIN b WITHIN 5 SECONDS ON a.k = b.k WHERE v > 1 GROUP BY k WINDOW TUMBLING(SIZE 1 SECONDS)") == "scan a -> inner join scan b within 5000 ms -> filter -> tumbling window 1000 ms -> aggregate -> project"


def test_filters_and_columns_reach_the_scan(spark):
    s = Session(spark).register("events", spark.read.parquet("/root/testdata/sf0.001/events.parquet"), ts="ts")
    plan = s.sql("SELECT event_id FROM events WHERE value > 10", "pipeline")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(value,10.0)" in plan and "props" not in plan


def test_pipelines_drop_late_events(spark):
    """An event behind the watermark goes, though its window is still open to others; one watermark serves all inputs."""
    s = Session(spark)
    s.register("e", spark.createDataFrame([(100, 1), (9000, 2), (200, 3), (9500, 4)], "ts long, seq long"), ts="ts", arrival="seq")
    got = rows(s.sql("SELECT COUNT(*) AS n FROM e WINDOW TUMBLING(SIZE 1 SECONDS)", "pipeline"))
    assert got == [(1, 0, 1000), (2, 9000, 10000)]
    assert rows(s.sql("SELECT ts FROM e", "pipeline")) == [(100,), (9000,), (9500,)]
    assert rows(s.sql("SELECT ts FROM e")) == [(100,), (200,), (9000,), (9500,)]  # tables never drop
    s.register("f", spark.createDataFrame([(8500, 5, "in"), (8499, 6, "late"), (None, 7, "no time")], "ts long, seq long, k string"), ts="ts", arrival="seq")
    assert rows(s.sql("SELECT f.k FROM e JOIN f WITHIN 1 SECONDS ON e.ts = f.ts + 500", "pipeline")) == [("in",)]
    assert rows(s.sql("SELECT k FROM f", "pipeline")) == [("in",), ("late",), ("no time",)]  # of itself, f is late nowhere
    union = "SELECT ts AS x FROM e UNION ALL SELECT ts AS x FROM f"
    assert rows(s.sql(union, "pipeline")) == [(100,), (8500,), (9000,), (9500,), (None,)]
    nested = "SELECT MAX(h.n) AS n FROM (SELECT COUNT(*) AS n FROM e WINDOW TUMBLING(SIZE 1 SECONDS)) h WINDOW TUMBLING(SIZE 1 MINUTES)"
    assert rows(s.sql(nested, "pipeline")) == [(2, 0, 60000)]


def test_far_off_times(spark):
    """An event thousands of years away makes no slots in between."""
    far = 253_370_764_800_000
    s = Session(spark)
    s.register("e", spark.createDataFrame([(0, "a", 1), (1500, "b", 2), (2500, "a", 3), (far, "b", 4), (-5000, "a", 5)], "ts long, k string, v long"), ts="ts")
    got = rows(s.sql("SELECT e.ts, (SELECT MAX(v) AS m FROM e WINDOW TUMBLING(SIZE 1 SECONDS)) AS prior FROM e", "pipeline"))
    assert got == sorted([(-5000, None), (0, 5), (1500, 1), (2500, 2), (far, 3)], key=str)
    got = rows(s.sql("SELECT ts FROM e WHERE k IN (SELECT k FROM e GROUP BY k WINDOW TUMBLING(SIZE 1 SECONDS))", "pipeline"))
    assert got == [(0,)]


@pytest.mark.parametrize("gap", [1, 7, 1000])
def test_sessions_against_a_plain_pass(spark, gap):
    import random

    rng = random.Random(gap)
    data = [(rng.choice(["a", "b", None]), rng.randrange(-40 * gap, 40 * gap)) for _ in range(60)] + [("a", 0), ("a", gap), ("a", 0)]
    s = Session(spark)
    s.register("e", spark.createDataFrame(data, "k string, ts long"), ts="ts")

    def brute(times):
        out = []
        for t in sorted(times):
            if out and t - out[-1][2] <= gap:
                out[-1] = [out[-1][0] + 1, out[-1][1], t]
            else:
                out.append([1, t, t])
        return [tuple(x) for x in out]

    got = rows(s.sql(f"SELECT COUNT(*) AS n FROM e WINDOW SESSION(GAP {gap} MILLISECONDS)", "pipeline"))
    assert got == sorted(brute([t for _, t in data]), key=str)
    got = rows(s.sql(f"SELECT k, COUNT(*) AS n FROM e GROUP BY k WINDOW SESSION(GAP {gap} MILLISECONDS)", "pipeline"))
    assert got == sorted([(k, *x) for k in ("a", "b", None) for x in brute([t for j, t in data if j == k])], key=str)
