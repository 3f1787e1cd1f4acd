"""Every query with SQL gives the same rows in Spark and in DuckDB."""

import duckdb
import pytest

from shoebox.plans.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf_dir):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return db


def plain(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, (int, float)):
        return "None" if value != value else f"{value:.5f}"
    return str(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    found = QUERIES[name](spark, sf_dir)
    rows = found.collect()
    assert rows
    if name in ORACLES:
        wanted = duck.execute(ORACLES[name])
        columns = [d[0] for d in wanted.description]
        assert sorted(columns) == sorted(found.columns)
        order = sorted(columns)
        left = sorted(tuple(plain(r[columns.index(n)]) for n in order) for r in wanted.fetchall())
        right = sorted(tuple(plain(r[n]) for n in order) for r in rows)
        assert left == right
