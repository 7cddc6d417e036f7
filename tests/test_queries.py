"""Every registered query of the notice engine against its SQL on the smallest tables."""

import os

import pytest

from tidewatch import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    return round(x, 6) if isinstance(x, float) else x


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    q = duck.execute(registry.ORACLES[name])
    columns = [d[0] for d in q.description]
    want = sorted([str(tuple(plain(dict(zip(columns, r, strict=True))[c]) for c in sorted(columns))) for r in q.fetchall()])
    assert sorted(df.columns) == sorted(columns)
    assert sorted(str(tuple(plain(r[c]) for c in sorted(columns))) for r in df.collect()) == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0 and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
