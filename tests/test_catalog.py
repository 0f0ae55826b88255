"""Every registered query against its oracle, on the smallest tables."""

import math

import duckdb
import pytest

from tidewell.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def shown(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query(spark, oracle, name):
    df = catalog.QUERIES[name](spark, SF)
    want = oracle.sql(catalog.ORACLE_SQL[name])
    names = list(want.columns)
    assert sorted(names) == sorted(df.columns)
    got = sorted(tuple(shown(r[c]) for c in names) for r in df.collect())
    assert got == sorted(tuple(map(shown, r)) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_without_oracle_has_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0
