"""The graph queries over all orders and the paths of all parts, by brute force on the smallest tables."""

import math

import pytest

from tidewell.operators import graph
from tidewell.plans import catalog
from tidewell.sources import generators

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def edges(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/orders.parquet").select("o_custkey", "o_orderkey").collect()]


def reached(out, start):
    seen, todo = set(), list(start)
    while todo:
        for n in out.get(todo.pop(), ()):
            if n not in seen:
                seen.add(n)
                todo.append(n)
    return seen


def neighbours(edges):
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    return out


def rows(spark, name):
    return sorted(tuple(r) for r in catalog.QUERIES[name](spark, SF).collect())


def test_reachability_over_all_orders(spark, edges):
    assert rows(spark, "reachability") == sorted((n,) for n in {1} | reached(neighbours(edges), [1]))


def test_closure_over_all_orders(spark, edges):
    out = neighbours(edges)
    assert rows(spark, "closure") == sorted((a, b) for a in out for b in reached(out, [a]))


def test_components_over_all_orders(spark, edges):
    both = neighbours(edges + [(b, a) for a, b in edges])
    assert rows(spark, "components") == sorted((n, min({n} | reached(both, [n]))) for n in both)


def test_paths_of_all_parts(spark):
    parts = {r[0] for r in spark.read.parquet(f"{SF}/part.parquet").select("p_partkey").collect()}
    got = catalog.QUERIES["mc_paths"](spark, SF)
    assert got.columns == ["run_id", "path_id", "instrument_id", "day", "factor", "shock", "value"]
    assert {r[0] for r in got.select("instrument_id").distinct().collect()} == parts
    assert got.count() == len(parts) * 200 * 10


def test_long_chains_cycles_and_null_ends(spark):
    chain = [(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1002), (1002, 1000), (5, None), (None, 6), (7, 7), (2000, 2000)]
    edges = spark.createDataFrame(chain, "src long, dst long")
    got = sorted(tuple(r) for r in graph.connected_components(edges).collect())
    assert got == [(i, 0) for i in range(301)] + [(1000, 1000), (1001, 1000), (1002, 1000), (2000, 2000)]
    cycle = spark.createDataFrame(chain[300:], "src long, dst long")
    assert graph.transitive_closure(cycle).count() == 9 + 2
    assert sorted(r.node for r in graph.reachability(cycle, spark.createDataFrame([(1001,), (None,), (5,)], "node long")).collect()) == [5, 1000, 1001, 1002]


def test_closure_meets_a_pair_once_for_each_middle(spark, monkeypatch):
    """Joined wherever they can be cut, the paths of a chain of 200 edges give over 300,000 rows to drop."""
    before = []
    cut = graph._cut

    def counting(df):
        plan = df._jdf.queryExecution().optimizedPlan()
        joins = [plan] if plan.nodeName() == "Join" else []
        todo = [plan]
        while todo:
            at = todo.pop()
            joins += [at] if at.nodeName() == "Join" and "Inner" in at.toString().split("\n")[0] else []
            todo += [at.children().apply(i) for i in range(at.children().size())]
        java = spark._jvm.org.apache.spark.sql.classic.Dataset
        before.append(sum(java.ofRows(spark._jsparkSession, j).count() for j in joins))
        return cut(df)

    monkeypatch.setattr(graph, "_cut", counting)
    chain = [(i, i + 1) for i in range(200)] + [(200, 197), (0, 200), (None, 1)]
    edges = spark.createDataFrame(chain, "src long, dst long")
    got = sorted(tuple(r) for r in graph.transitive_closure(edges).collect())
    out = neighbours([e for e in chain if None not in e])
    assert got == sorted((a, b) for a in out for b in reached(out, [a]))
    assert 0 < sum(before) < 2 * len(got)


def test_paths_are_neither_shuffled_nor_sorted(spark):
    """Only the book is dealt out: the paths went through a shuffle and a sort for their running sums."""
    book = spark.createDataFrame([(1, "a", 100.0, 0.2), (2, "b", 50.0, 0.3), (3, None, 10.0, 0.1)], "instrument_id long, grp string, s0 double, vol double")
    for model, paths, days in (("gaussian", 1100, 2), ("lognormal", 3, 40), ("student_t", 2, 16)):
        got = generators.scenario_paths(spark, paths, book, days, 0.4, model=model)
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and "Sort" not in plan and plan.index("RepartitionByExpression") > plan.rindex("path_id")
        walk, s0, seen = {}, {1: 100.0, 2: 50.0, 3: 10.0}, set()
        for r in sorted(got.collect(), key=lambda r: (r.instrument_id, r.path_id, r.day)):
            key, daily = (r.instrument_id, r.path_id), {1: 0.2, 2: 0.3, 3: 0.1}[r.instrument_id] / 252**0.5
            seen.add((*key, r.day))
            walk[key] = walk.get(key, 0.0) + daily * r.shock - (daily * daily / 2 if model == "lognormal" else 0)
            assert r.value == pytest.approx(s0[r.instrument_id] * (math.exp(walk[key]) if model == "lognormal" else 1 + walk[key]), rel=1e-12)
        assert seen == {(i, p, d) for i in (1, 2, 3) for p in range(paths) for d in range(1, days + 1)}
