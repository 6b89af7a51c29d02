"""Registered queries against their SQL, on whole tables."""

import duckdb
import pytest

from streamloom.llm.queries import ORACLE, QUERIES

TABLES = ("documents", "embeddings", "pages", "conversations")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, name, sf_dir="/root/testdata/sf0.01"):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    relation = con.execute(ORACLE[name])
    columns = [d[0] for d in relation.description]
    want = sorted(map(repr, relation.fetchall()))
    got = QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(repr(tuple(r)) for r in got.select(*columns).collect()) == want
