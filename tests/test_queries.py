"""Each query with SQL gives the rows of its SQL on the smallest tables; all have a stable schema."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from cladewright import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


def rows(it):
    return sorted((tuple(plain(v) for v in r) for r in it), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.oracles()))
def test_query_equals_its_sql(spark, db, name):
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = rows(df.select(*cols).collect())
    want = rows(db.execute(f"select {', '.join(cols)} from ({catalog.oracles()[name]}) q").fetchall())
    assert got == want


def test_every_query_without_sql_has_a_test_of_its_own():
    """These are tested against brute force in test_whole_queries.py, test_dating.py, test_trees.py, test_neighbours.py and test_pairings.py."""
    assert set(catalog.queries()) - set(catalog.oracles()) == {"collapsed_patterns", "split_axis", "dated_nodes", "midpoint_rooted", "forest_neighbours", "pairing_test", "mutual_nn", "adjacency_test"}


def test_entry(spark):
    assert entry.entry(spark).count() > 0
