import duckdb
import pytest

import __spark_entry__
from threadloom.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation pages lineitem"


def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).columns == ["id1", "id2", "dist"]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_oracle(spark, name):
    db = duckdb.connect()
    for t in TABLES.split():
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = db.sql(ORACLES[name])
    columns = sorted(want.columns)
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == columns
    rows = lambda found: sorted(map(repr, found))
    assert rows(tuple(r[c] for c in columns) for r in got.collect()) == rows(want.select(*columns).fetchall())


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


def test_two_levels_equal_their_oracle(spark):
    """On a table with more rows than a chunk, which the smallest is not."""
    db = duckdb.connect()
    sf = "/root/testdata/sf0.01"
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    want = sorted(db.sql(ORACLES["two_level_cluster"]).fetchall())
    got = sorted(tuple(r) for r in QUERIES["two_level_cluster"](spark, sf).select("label", "consensus", "points", "reads").collect())
    assert got == want and len(got) > 1
