"""Every query that has SQL gives the same rows as DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from tessera import plans

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return round(v, 5)
    return v.replace(tzinfo=None).isoformat() if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = plans.queries()[name](spark, DIR)
    want = duck.execute(plans.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    want_rows = sorted((tuple(map(plain, r)) for r in want.fetchall()), key=str)
    got_rows = sorted((tuple(map(plain, r)) for r in got.select(*[f"`{c}`" for c in columns]).collect()), key=str)
    assert got_rows == want_rows


def test_every_query_is_named_after_its_operator():
    assert all(n[0].isalpha() and n[1:3].isdigit() for n in plans.queries())
    assert set(plans.oracle_sql()) <= set(plans.queries())
