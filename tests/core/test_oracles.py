"""Queries on the smallest tables against their SQL in DuckDB."""

import os

import duckdb
import pytest

from coppice import evidence_queries, scan_queries  # noqa: F401
from coppice.queries import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Many-round queries have tests of their own, on graphs that brute force can walk.
LOOPS = ("cycles", "impact_", "slice_", "who_", "transitive", "blast", "reach", "components", "refactor", "health", "focus", "chains", "dead_", "zombies", "defects", "slice", "power")


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def ordered(columns, rows):
    place = sorted(range(len(columns)), key=columns.__getitem__)
    plain = lambda v: "" if v is None else str(round(v, 6) if isinstance(v, float) else v)
    return sorted(tuple(plain(r[i]) for i in place) for r in rows)


@pytest.mark.parametrize("name", [n for n in ORACLES if not any(x in n for x in LOOPS)])
def test_query_equals_its_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF), duck.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert ordered(got.columns, got.collect()) == ordered(want.columns, want.fetchall())


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
