"""Every registered query of the reference's own operators against its SQL."""

import os

import duckdb
import pytest

from loopweave.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    found = duck.execute(registry.SQL[name])
    names = [d[0] for d in found.description]
    want = sorted((tuple(r[names.index(c)] for c in columns) for r in found.fetchall()), key=str)
    assert sorted(names) == columns and got == want
