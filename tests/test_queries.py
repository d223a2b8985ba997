"""Every query with oracle SQL against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from parchment.plans import documents, registry, relational, vectors  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(registry.all_oracles()))
def test_query_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got = registry.all_queries()[name](spark, sf_dir)
    want = con.sql(registry.all_oracles()[name])
    kinds = dict(zip(want.columns, map(str, want.types), strict=True))
    assert {n: KINDS[t] for n, t in got.dtypes} == kinds
    cols = sorted(got.columns)
    order = [want.columns.index(c) for c in cols]
    a = sorted((tuple(plain(r[c]) for c in cols) for r in got.collect()), key=repr)
    b = sorted((tuple(plain(r[i]) for i in order) for r in want.fetchall()), key=repr)
    assert a == b
