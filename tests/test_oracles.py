"""Every query with SQL gives DuckDB's rows over the driver's tables."""

import os

import duckdb
import pytest

from codeloom.plans import catalog

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return c


def shown(v):
    return f"{v:.5g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, db, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    got = sorted(tuple(map(shown, r)) for r in df.collect())
    assert len(set(df.columns)) == len(df.columns)
    if name in catalog.ORACLES:
        want = db.execute(catalog.ORACLES[name])
        assert [d[0] for d in want.description] == df.columns
        rows = sorted(tuple(map(shown, r)) for r in want.fetchall())
        assert len(got) == len(rows)
        assert [x for x in zip(got, rows) if x[0] != x[1]][:3] == []
