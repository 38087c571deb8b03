"""Every registered query against its SQL, over whole small tables."""

import os
from decimal import Decimal

import pytest

from simgate.plans.queries import QUERIES
from simgate.plans.sql import SQL

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(value):
    return round(float(value), 8) if isinstance(value, float | Decimal) else value


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    want = duck.execute(SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    order = [names.index(c) for c in got.columns]
    rows = sorted((tuple(plain(r[i]) for i in order) for r in want.fetchall()), key=str)
    assert sorted((tuple(map(plain, r)) for r in got.collect()), key=str) == rows


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["name", "kind", "role", "score", "best_match"]
    assert set(SQL) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
