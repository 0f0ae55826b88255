"""Changelogs of table statements net to the batch result."""

import random

import pytest

from tidewell.operators import zset
from tidewell.plans.builder import Session
from tidewell.plans.changes import Changelog, supports_retention
from tidewell.sql import DialectError

STATEMENTS = [
    "SELECT k, COUNT(*) AS n, SUM(v) AS s, MIN(v) AS low FROM t GROUP BY k", "SELECT COUNT(*) AS n FROM t", "SELECT k, v FROM t WHERE v > 1", "SELECT k, ts FROM t LATEST BY k",
    "SELECT a.k AS x, b.v AS y FROM t a JOIN u b ON a.k = b.k", "SELECT a.k AS x, b.v AS y FROM t a LEFT JOIN u b ON a.k = b.k", "SELECT a.k AS x, b.k AS y FROM t a FULL JOIN u b ON a.k = b.k",
    "SELECT k FROM t UNION SELECT k FROM u", "SELECT k FROM t UNION ALL SELECT k FROM u", "SELECT k FROM t WHERE k NOT IN (SELECT k FROM u)", "SELECT k + v AS z, COUNT(*) AS n FROM t GROUP BY k + v",
]


def log(spark, seed):
    rng = random.Random(seed)
    live, out = [], []
    for epoch in range(4):
        for _ in range(rng.randrange(7)):
            if live and rng.random() < 0.4:
                out.append((*live.pop(rng.randrange(len(live))), -1, epoch))
            else:
                row = (rng.choice([1, 2, 3, None]), rng.choice([None, 0.25, 1.5, 2.0]), rng.randrange(5))
                live.append(row)
                out.append((*row, 1, epoch))
    schema = "k long, v double, ts long, _weight long, _epoch long"
    return spark.createDataFrame(out, schema), spark.createDataFrame(live, "k long, v double, ts long"), out


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("text", STATEMENTS)
def test_deltas_net_to_the_batch_result(spark, text):
    (a, live_a, _), (b, live_b, _) = log(spark, len(text)), log(spark, len(text) + 1)
    c = Changelog(Session(spark)).register("t", a, ts="ts").register("u", b, ts="ts")
    d = c.deltas(text, [0, 1, 2, 3]).cache()
    names = [x for x in d.columns if x not in ("_weight", "_epoch")]
    final = Session(spark).register("t", live_a, ts="ts").register("u", live_b, ts="ts").sql(text)
    got = [x for r in zset.consolidate(d, names).collect() for x in [tuple(r)[:-1]] * r["_weight"]]
    assert sorted(got, key=str) == rows(final)
    upto = zset.consolidate(d.filter("_epoch <= 1"), names)
    assert upto.filter("_weight < 0").count() == 0


def test_evictions_are_retractions(spark):
    log = spark.createDataFrame([(i, i, 1, i // 2) for i in range(6)], "k long, ts long, _weight long, _epoch long")
    c = Changelog(Session(spark)).register("t", log, ts="ts")
    assert rows(c.deltas("SELECT k FROM t", [0, 1, 2], max_rows=3)) == sorted([(0, 1, 0), (1, 1, 0), (2, 1, 1), (3, 1, 1), (0, -1, 1), (4, 1, 2), (5, 1, 2), (1, -1, 2), (2, -1, 2)], key=str)
    assert rows(c.deltas("SELECT k FROM t", [0, 2], ttl_ms=1)) == sorted([(0, 1, 0), (1, 1, 0), (4, 1, 2), (5, 1, 2), (0, -1, 2), (1, -1, 2)], key=str)


def test_shapes_that_retention_takes(spark):
    assert supports_retention("SELECT k FROM t WHERE k > 1") and supports_retention("SELECT k FROM t LATEST BY k")
    for text in ("SELECT COUNT(*) FROM t", "SELECT k FROM t GROUP BY k", "SELECT a.k FROM t a JOIN u b ON a.k = b.k", "SELECT k FROM t UNION ALL SELECT k FROM u", "SELECT x.k FROM (SELECT k FROM t) x"):
        assert not supports_retention(text)
    c = Changelog(Session(spark)).register("t", spark.createDataFrame([(1, 1, 0)], "k long, _weight long, _epoch long"))
    with pytest.raises(DialectError, match="retention"):
        c.deltas("SELECT COUNT(*) AS n FROM t", [0], max_rows=3)
