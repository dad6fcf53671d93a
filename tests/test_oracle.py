import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from siftql.plans import catalog_queries
from tests.conftest import SF

ALL = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in ALL:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if hasattr(v, "tzinfo"):
        return v.replace(tzinfo=None)
    return tuple(map(plain, v)) if isinstance(v, list) else v


@pytest.mark.parametrize("name", sorted(catalog_queries.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    got = catalog_queries.QUERIES[name](spark, SF)
    cur = duck.execute(catalog_queries.ORACLE_SQL[name].replace('"-"', "'-'"))
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(got.columns)
    want = Counter(tuple(map(plain, r)) for r in cur.fetchall())
    assert Counter(tuple(plain(r[c]) for c in cols) for r in got.collect()) == want


def test_entry_points(spark):
    assert entry.entry(spark).count() == 25
    assert set(entry.oracle_sql()) <= set(entry.queries())
