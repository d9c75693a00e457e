"""Every registered query of the library against its SQL on the smallest tables."""

import duckdb
import pytest

from casebook.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def db(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(rows, columns):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    tidy = lambda x: "" if x is None else f"{x:.5f}".rstrip("0").rstrip(".") if isinstance(x, float) else str(x)
    return sorted(tuple(tidy(r[i]) for i in at) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf_dir, db, name):
    df = registry.QUERIES[name](spark, sf_dir)
    found = df.collect()
    if name not in registry.ORACLES:
        assert found
        return
    want = db.sql(registry.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert plain(found, df.columns) == plain(want.fetchall(), want.columns)
