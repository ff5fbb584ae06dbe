"""Every query against its SQL on the same tables."""

import math

import duckdb
import pytest

from quillgraph.plans import queries as plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    return round(x, 9) if isinstance(x, float) and math.isfinite(x) else x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, sf, name):
    got = plans.QUERIES[name](spark, sf)
    data = [tuple(r) for r in got.collect()]
    if name not in plans.ORACLE_SQL:
        assert got.columns
        return
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = db.execute(plans.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, data) == rows(columns, want.fetchall())
