import os

import duckdb
import pytest

import __spark_entry__ as entry
from postlens.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(rows, names):
    at = sorted(range(len(names)), key=names.__getitem__)
    tidy = lambda v: round(v, 9) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(tidy(r[i]) for i in at) for r in rows), key=str)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, DATA)
    found = duck.sql(catalogue.oracle_sql()[name])
    columns = list(found.columns)
    assert sorted(df.columns) == sorted(columns)
    got, want = plain(df.collect(), df.columns), plain(found.fetchall(), columns)
    del found  # else a failure would spell it out, which runs it again
    assert got == want
