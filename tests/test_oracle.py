"""Every core query against its SQL, on the smallest tables."""

import math

import pytest

from loomspark import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


@pytest.mark.parametrize("key", sorted(catalog.queries()))
def test_query(spark, duck, key):
    df = catalog.queries()[key](spark, DATA)
    rows = df.collect()
    sql = catalog.oracle_sql().get(key)
    if sql is None:
        return
    out = duck.execute(sql)
    names = [x[0] for x in out.description]
    want = sorted(plain([r[names.index(c)] for c in sorted(names)]) for r in out.fetchall())
    assert sorted(df.columns) == sorted(names)
    assert sorted(plain([r[c] for c in sorted(names)]) for r in rows) == want
