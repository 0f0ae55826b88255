import math
import random

import pytest
from pyspark.sql import functions as F

from tidewell.functions import quant
from tidewell.operators import lateness, latest, zset
from tidewell.sources import formats, generators, ingest, policies
from tidewell.streaming import sinks


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def changelog(spark, seed):
    """Random assertions and retractions in shuffled order; values are multiples of 0.25, so sums are exact."""
    rng = random.Random(seed)
    live, log = [], []
    for n in range(200):
        if live and rng.random() < 0.35:
            log.append((*live.pop(rng.randrange(len(live))), -1, n))
        else:
            row = (rng.choice(["A", "B", "C", None]), rng.choice([None, *(x / 4 for x in range(8))]))
            live.append(row)
            log.append((*row, 1, n))
    shuffled = log[:]
    rng.shuffle(shuffled)
    return spark.createDataFrame(shuffled, "k string, v double, _weight long, _arrival long"), live, log


@pytest.mark.parametrize("seed", range(4))
def test_changelog_equals_batch(spark, seed):
    c, live, log = changelog(spark, seed)
    by = {}
    for k, v in live:
        by.setdefault(k, []).append(v)
    assert rows(zset.aggregate(c, ["k"], {"s": F.col("v")})) == sorted(((k, len(vs), sum(known) if (known := [v for v in vs if v is not None]) else None) for k, vs in by.items()), key=str)
    assert rows(zset.extreme(c.filter("v is not null"), ["k"], "v", False, "low")) == sorted(((k, min(v for v in vs if v is not None)) for k, vs in by.items() if any(v is not None for v in vs)), key=str)
    assert rows(zset.snapshot(c, ["k", "v"])) == sorted(set(live), key=str)
    # the changelog of the running aggregate nets to the final aggregate
    steps = zset.running_changelog(c, ["k"], "v", "_arrival")
    assert rows(zset.consolidate(steps, ["k", "n", "total"]).drop("_weight")) == rows(zset.aggregate(c, ["k"], {"total": F.col("v")}))


def test_distinct_and_negate(spark):
    c = spark.createDataFrame([("a", 2), ("a", -1), ("b", 1), ("b", -1), ("c", -1)], "k string, _weight long")
    assert rows(zset.distinct(c, ["k"])) == [("a", 1)]
    assert rows(zset.consolidate(zset.concat(c, zset.negate(c)), ["k"])) == []


def test_watermark_over_blocks(spark, monkeypatch):
    rng = random.Random(1)
    data = [(i, rng.randrange(20_000)) for i in range(300)]
    df = spark.createDataFrame(data, "a long, t long")
    want, top = [], None
    for a, t in data:
        if top is None or t >= top - 1000:
            want.append((a, t))
        top = max(t, top or 0)
    for block in (1 << 16, 7):
        monkeypatch.setattr(lateness, "BLOCK", block)
        assert sorted(rows(lateness.drop_late(df, "t", "a"))) == want
    assert rows(lateness.late_count(df, "t", "a")) == [(300, 300 - len(want))]
    assert rows(lateness.late_count(df.limit(0), "t", "a")) == [(0, 0)]


def test_latest_by_changes(spark):
    df = spark.createDataFrame([("a", 1, 1, 1, False), ("a", 5, 1, 2, False), ("a", 5, -1, 3, False), ("b", 2, 1, 4, False), ("b", 2, 1, 5, True), ("c", 3, 1, 6, False), ("c", 2, -1, 7, False), ("d", 9, 1, 8, False), ("d", 1, 1, 9, True), ("d", 2, 1, 10, False)], "k string, t long, _weight long, n long, r boolean")
    assert [r[:2] for r in rows(latest.latest_by_changes(df, ["k"], "t", "n", retract="r"))] == [("c", 3), ("d", 2)]


def test_dedup_is_first_in_first_out(spark):
    df = spark.createDataFrame([(i, k) for i, k in enumerate("abacadaba")], "i long, k string")
    got = [r[0] for r in latest.dedup_recent(df, "k", "i", 2).orderBy("i").collect()]
    assert got == [0, 1, 3, 4, 5, 7, 8]
    assert rows(latest.dedup_first(spark.createDataFrame([(1, None), (2, None), (3, "x"), (4, "x")], "i long, k string"), ["k"], "i")) == [(1, None), (2, None), (3, "x")]


def test_formats(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id;note;id\n1;"x;""y""";7\n2;z\n')
    assert rows(formats.csv_files(spark, str(tmp_path / "a.csv"))) == [("", "z"), ("7", 'x;"y"')]
    cells = spark.createDataFrame([("1",), ("1.5",), ("true",), ("x",)], "c string").select(formats.cell_value(F.col("c")).alias("v")).select("v.*")
    assert rows(cells) == sorted([(1, None, None, None), (None, 1.5, None, None), (None, None, True, None), (None, None, None, "x")], key=str)
    (tmp_path / "a.json").write_text('[{"a": 1}, {"a": 2}]')
    assert rows(formats.json_document(spark, str(tmp_path / "a.json"))) == [(1,), (2,)]
    (tmp_path / "b.json").write_text('{"a": 1}\n\n{"a": 3}\n')
    assert rows(formats.ndjson(spark, str(tmp_path / "b.json"), "a long")) == [(1,), (3,)]
    m = spark.createDataFrame([("35=D\x0111=a=b\x0155=X\x0155=Y\x01bad",)], "value string")
    assert rows(formats.fix_messages(m, {"kind": "35", "id": "11", "sym": "55", "none": "99"})) == [("D", "a=b", "Y", None)]
    assert formats.infer_kinds(['{"a": 1, "b": 5.0, "c": "2024-01-02T00:00:00Z", "d": {"x": 1}, "e": null, "f": 1}', '{"a": 2.5, "f": "x", "g": true}']) == [("a", "double"), ("b", "double"), ("c", "timestamp"), ("d", "json"), ("e", "string"), ("f", "string"), ("g", "bool")]


def test_paths(spark):
    df = spark.createDataFrame([('{"a": [{"b": 1}, {"b": "x"}, {}], "c d": [[1], [2, 3]]}',), (None,)], "j string")
    got = lambda p: [r[0] for r in df.select(ingest.select_path(F.col("j"), p)).collect()]
    assert got("$.a[*].b")[0] == ["1", '"x"'] and got("$['c d'][*][*]")[0] == ["1", "2", "3"] and got("$.a[1].b")[0] == ['"x"'] and got("$.zz[*]")[0] == []
    for bad in ("a", "$..a", "$.a[", "$[?]"):
        with pytest.raises(ValueError):
            ingest.parse_path(bad)
    with pytest.raises(ValueError):
        ingest.coerce(spark.createDataFrame([("x",)], "a string"), {"a": "long"}, "reject")


def test_policies():
    assert policies.admit(8, 10, 5, "reject")["rejected"] == 5
    assert policies.admit(8, 10, 5, "block") == {"accepted": 2, "dropped_new": 0, "dropped_old": 0, "rejected": 0, "blocked": 3}
    assert policies.admit(8, 10, 5, "drop_newest")["dropped_new"] == 3
    assert policies.admit(8, 10, 5, "drop_oldest") == {"accepted": 5, "dropped_new": 0, "dropped_old": 3, "rejected": 0, "blocked": 0}
    assert policies.admit(8, 10, 50, "inline")["accepted"] == 50
    cache = policies.BoundedCache(1)
    assert [cache.get_or_run(k, lambda k=k: k * 2) for k in "aab"] == ["aa", "aa", "bb"] and list(cache.held) == ["b"]
    ledger = policies.FileLedger(2)
    assert [ledger.due("f", 1), ledger.due("f", 1), ledger.due("f", 2)] == [True, False, True]
    assert policies.schedule_ms("every 30s") == 30_000
    with pytest.raises(ValueError):
        policies.schedule_ms("5ms")
    assert policies.cron_matches("*/15 9-17 * * 1-5", 0, 30, 9, 3, 6, 2) and not policies.cron_matches("*/15 9-17 * * 1-5", 0, 31, 9, 3, 6, 2)
    assert policies.cron_matches("10 0 0 1 * 7", 10, 0, 0, 1, 5, 0)


def test_quant_against_closed_forms(spark):
    phi = lambda x: 0.5 * math.erfc(-x / math.sqrt(2))
    xs = [-38.0, -10.0, -5.0, -4.0, -3.99, -1.5, -1e-9, 0.0, 0.3, 2.0, 4.0, 6.5, 12.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").coalesce(1).select(quant.normal_cdf(F.col("x"))).collect()]
    assert all(abs(a - phi(x)) < 1e-14 for a, x in zip(got, xs, strict=True))
    lit = lambda *v: [F.lit(float(x)) for x in v]
    one = lambda c: spark.range(1).select(c).first()[0]
    call, put = one(quant.bs_price(*lit(100, 95, 0.75, 0.03, 0.01, 0.25, 1))), one(quant.bs_price(*lit(100, 95, 0.75, 0.03, 0.01, 0.25, 0)))
    assert call - put == pytest.approx(100 * math.exp(-0.0075) - 95 * math.exp(-0.0225))
    up, down = (one(quant.bs_price(*lit(100 + h, 95, 0.75, 0.03, 0.01, 0.25, 1))) for h in (1e-3, -1e-3))
    assert one(quant.bs_delta(*lit(100, 95, 0.75, 0.03, 0.01, 0.25, 1))) == pytest.approx((up - down) / 2e-3, rel=1e-6)
    later = one(quant.bs_price(*lit(100, 95, 0.75 - 1e-5, 0.03, 0.01, 0.25, 1)))
    assert one(quant.bs_theta(*lit(100, 95, 0.75, 0.03, 0.01, 0.25, 1))) == pytest.approx((later - call) / 1e-5, rel=1e-3)
    assert one(quant.bs_price(*lit(-1, 95, 0.75, 0.03, 0.01, 0.25, 1))) is None
    assert one(quant.bond_price(*lit(100, 0.05, 3, 0.05, 1))) == pytest.approx(100) and one(quant.bond_price(*lit(100, 0.05, 0, 0.05, 1))) is None
    assert one(quant.irs_npv(*lit(1e6, 0.04, 5, 0.04, 1))) == pytest.approx(0, abs=1e-6)


def test_generators_are_reproducible(spark):
    a, b = generators.trades(spark, 500), generators.trades(spark.newSession(), 500).repartition(3)
    assert rows(a) == rows(b)
    book = spark.createDataFrame([("i", "g", 100.0, 0.2), ("j", "g", 50.0, 0.3)], "instrument_id string, grp string, s0 double, vol double")
    p = generators.scenario_paths(spark, 3000, book, 1, 0.5)
    wide = p.groupBy("path_id").pivot("instrument_id", ["i", "j"]).agg(F.first("shock"))
    assert wide.agg(F.corr("i", "j")).first()[0] == pytest.approx(0.5, abs=0.06)
    assert p.agg(F.stddev("shock")).first()[0] == pytest.approx(1.0, abs=0.05)


def test_generators_columns_and_lives(spark, monkeypatch):
    import json

    want = {
        "trades": "symbol price qty side venue", "quotes": "symbol bid ask bidSize askSize venue", "orders": "symbol orderId side qty limitPrice status", "app_events": "eventType payload",
        "structures": "trade_id product notional_ccy legs", "order_events": "order_id symbol side stage stage_rank stage_ts qty filled_qty px",
    }
    made = {k: getattr(generators, k)(spark, 400) for k in want}
    for k, columns in want.items():
        assert made[k].columns == [*columns.split(), "_ts", "_source"]
    assert made["quotes"].filter("bid >= ask").count() == 0 and made["orders"].filter("limitPrice is null").count() == 0
    assert all(json.loads(r.payload)["tags"] for r in made["app_events"].collect())
    for r in made["structures"].collect():
        legs = json.loads(r.legs)
        assert (r.product == "IRS") == all("rate" in x and "strike" not in x for x in legs) and len(legs) in ((3, 4) if r.product == "FLY" else (2,))
    lives = {}
    for r in made["order_events"].orderBy("_ts").collect():
        lives.setdefault(r.order_id, []).append(r)
    ended = [x for x in lives.values() if x[-1].stage_rank > 3]
    for x in ended:
        ranks = [r.stage_rank for r in x]
        assert ranks[:2] == [1, 2] and set(ranks[2:-1]) <= {3} and len({(r.symbol, r.side, r.qty) for r in x}) == 1
        assert [r.filled_qty for r in x] == sorted(r.filled_qty for r in x) and (x[-1].filled_qty == x[-1].qty) == (ranks[-1] == 4)
    assert len(ended) > 50
    plain = {r["_ts"]: r.price for r in made["trades"].collect()}
    monkeypatch.setattr(generators, "BLOCK", 16)  # however it is cut, the walk is the same
    assert {r["_ts"]: r.price for r in generators.trades(spark, 400).collect()} == pytest.approx(plain, abs=0.011)


def test_insert_sugar():
    assert sinks.split_insert("insert into out SELECT a FROM t") == ("out", "SELECT a FROM t")
    assert sinks.split_insert("SELECT a FROM t") == (None, "SELECT a FROM t")


def test_normal_distribution_goes_by_batches(spark):
    """A fold in the plan runs uncompiled, some hundred steps a row: a part of 20,000 rows did not end in a minute."""
    from tidewell.plans import catalog

    df = catalog.QUERIES["quant_bs"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and "aggregate(" not in plan
    phi = lambda x: 0.5 * math.erfc(-x / math.sqrt(2))
    for r in df.join(spark.read.parquet("/root/testdata/sf0.001/part.parquet"), "p_partkey").collect():
        s, sd = r.p_retailprice, 0.2 * math.sqrt(0.5)
        d1 = (math.log(s / 1000) + 0.01) / sd + sd / 2
        assert r.call == pytest.approx(s * math.exp(-0.005) * phi(d1) - 1000 * math.exp(-0.015) * phi(d1 - sd), abs=6e-7)
        assert r.delta == pytest.approx(math.exp(-0.005) * phi(d1), abs=6e-9)
    xs = [i / 37 for i in range(-1370, 1371)]
    odd = [(None,), (math.nan,), (math.inf,), (-math.inf,)]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs] + odd, "x double").coalesce(1).select(quant.normal_cdf(F.col("x"))).collect()]
    assert all(a == pytest.approx(phi(x), rel=1e-14) for a, x in zip(got, xs))
    assert got[-4] is None and math.isnan(got[-3]) and got[-2:] == [1.0, 0.0]
    at = lambda *v: [F.col("z") + F.lit(float(x)) for x in v]
    row = spark.createDataFrame([(0.0,)], "z double").select(*[f(*at(*v)) for f in (quant.bs_price, quant.bs_delta, quant.bs_theta) for v in ((100, 0, 1, 0, 0, 1, 1), (0, 95, 1, 0, 0, 1, 1), (100, 95, 0, 0, 0, 1, 1), (100, 95, 1, 0, 0, 0, 1))]).first()
    assert set(row) == {None}
