"""Every registered query with SQL gives the rows that DuckDB gives."""

import os

import duckdb
import pytest

from noteloom import registry


def same(v):
    return round(float(v), 7) if isinstance(v, float) or hasattr(v, "as_tuple") else v


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf, name):
    df = registry.queries()[name](spark, sf)
    rows = df.collect()
    if name not in registry.oracle_sql():
        assert rows
        return
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    got = con.sql(registry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(df.columns)
    key = lambda r: tuple((v is None, str(v)) for v in r)
    want = sorted((tuple(map(same, r)) for r in got.fetchall()), key=key)
    assert sorted((tuple(same(r[c]) for c in got.columns) for r in rows), key=key) == want
