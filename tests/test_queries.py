"""Every flight query against its SQL in DuckDB, at the smallest size, or that of TEST_SF_DIR."""

import os

import duckdb
import pytest

from skylane.plans import feed_queries, more_queries  # noqa: F401  register more
from skylane.plans.queries import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("events", "part", "supplier", "customer", "orders", "nation", "region")


def _text(v):
    return repr(v) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = sorted(tuple(_text(r[c]) for c in sorted(df.columns)) for r in df.collect())
    if name not in ORACLE_SQL:
        return
    found = duck.sql(ORACLE_SQL[name])
    columns = found.columns
    assert sorted(columns) == sorted(df.columns)
    order = [columns.index(c) for c in sorted(columns)]
    assert rows == sorted(tuple(_text(r[i]) for i in order) for r in found.fetchall())


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
