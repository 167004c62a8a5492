"""The registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

pytest.importorskip("public_tokenizers")

from postlens.llm.queries import QUERIES, SQL  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df, found = QUERIES[name](spark, DATA), con.sql(SQL[name])
    at = [found.columns.index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect()), key=str) == sorted((tuple(r[i] for i in at) for r in found.fetchall()), key=str)
