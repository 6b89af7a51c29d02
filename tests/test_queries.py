"""Every registered stream query against its SQL on the smallest tables."""

import duckdb
import pytest

from streamloom.plans.queries import ORACLE, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("events", "documents"):
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    relation = con.execute(ORACLE[name])
    columns = [d[0] for d in relation.description]
    want = sorted(map(repr, relation.fetchall()))
    got = QUERIES[name](spark, DIR)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(repr(tuple(r)) for r in got.select(*columns).collect()) == want
