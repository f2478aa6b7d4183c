"""Every query of the catalogue against its SQL on the smallest tables; those without SQL run."""

import math

import duckdb
import pytest

from lumbung.plans import catalog

D = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations events"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if type(v).__name__ == "Decimal":
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else int(v) if v == int(v) else v
    return v


@pytest.mark.parametrize("name", catalog.QUERIES)
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, D)
    columns = sorted(df.columns)
    own = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    if name not in catalog.ORACLES:
        assert own
        return
    cur = con.execute(catalog.ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert own == sorted(repr(tuple(plain(r[k]) for k in at)) for r in cur.fetchall())


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.QUERIES) <= set(entry.queries())
