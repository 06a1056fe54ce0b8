"""Every query of the catalog against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from ravelin import catalog

DATA = os.environ.get("RAVELIN_TESTDATA", "/root/testdata/sf0.001")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(frame):
    def plain(v):
        if v is None or v != v:
            return "null"
        return f"{v:.5g}" if isinstance(v, float) else str(v)

    names = sorted(frame.columns)
    return names, sorted(tuple(plain(v) for v in r) for r in frame[names].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, DATA).toPandas()
    want = duck.execute(catalog.ORACLE_SQL[name]).df()
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_without_sql_is_repeatable(spark, name):
    first = catalog.QUERIES[name](spark, DATA).toPandas()
    assert rows(first) == rows(catalog.QUERIES[name](spark, DATA).toPandas()) and len(first)


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.QUERIES) <= set(entry.queries())
    assert entry.entry(spark).columns == ["region", "recent_alerts", "previous_alerts", "change", "direction"]
