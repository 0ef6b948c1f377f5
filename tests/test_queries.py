"""Every registered query against its SQL."""

import os

import duckdb
import pytest

from rollcall.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(sf_dir, t)}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = registry.QUERIES[name](spark, sf_dir)
    rows = sorted(repr(tuple(r[c] for c in sorted(df.columns))) for r in df.collect())
    if name not in registry.ORACLES:
        assert rows
        return
    found = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in found.description]
    order = [names.index(c) for c in sorted(names)]
    expected = sorted(repr(tuple(r[i] for i in order)) for r in found.fetchall())
    assert sorted(names) == sorted(df.columns)
    assert rows == expected


def test_flagship(spark, sf_dir):
    assert registry.flagship(spark, sf_dir).count() == 20
