"""Every registered query of the main library runs, and agrees with its oracle on the smallest tables."""

import os

import duckdb
import pytest

from skein.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the provided tables are absent")


def plain(x):
    if isinstance(x, float):
        return round(x, 9)
    return tuple(map(plain, x)) if isinstance(x, list | tuple) else x


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    if name not in catalog.ORACLES:
        assert got
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cursor = con.execute(catalog.ORACLES[name])
    at = [[c[0] for c in cursor.description].index(c) for c in columns]
    assert len(at) == len(cursor.description)
    assert got == sorted(repr(tuple(plain(r[i]) for i in at)) for r in cursor.fetchall())
