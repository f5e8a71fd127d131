"""The driver contract: every query of the sequencing part equals its SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
from phredlens.plans import queries, round_trips

QUERIES, ORACLES = queries.QUERIES | round_trips.QUERIES, queries.ORACLES | round_trips.ORACLES
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, duck, sf_dir, name):
    got, want = QUERIES[name](spark, sf_dir), duck.sql(ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    flat = lambda v: round(v, 6) if isinstance(v, float) else v
    at = [want.columns.index(c) for c in columns]
    assert sorted((tuple(flat(r[c]) for c in columns) for r in got.collect()), key=str) == sorted((tuple(flat(r[k]) for k in at) for r in want.fetchall()), key=str)


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
