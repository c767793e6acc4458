"""Every core query runs at the smallest size and agrees with its SQL."""

import math
import os

import duckdb
import pytest

from fulcrum.plans import registry


def norm(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else round(v, 9)
    return tuple(map(norm, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{data}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(name, spark, data, duck):
    df = registry.QUERIES[name](spark, data)
    cols = sorted(df.columns)
    rows = sorted(repr([norm(r[c]) for c in cols]) for r in df.collect())
    if name in registry.SQL:
        got = duck.execute(registry.SQL[name])
        names = [d[0] for d in got.description]
        assert sorted(names) == cols
        assert rows == sorted(repr([norm(r[names.index(c)]) for c in cols]) for r in got.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 15
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
