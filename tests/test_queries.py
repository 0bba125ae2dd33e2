"""Every registered query against its SQL on the smallest test data."""

import pytest

from checks.compare import compare, database
from checks.duckdb_sql import oracle_sql
from checks.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return database(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, con, name):
    same, count, note = compare(spark, con, SF_DIR, name)
    assert same, note
    assert count > 0


def test_every_query_has_sql():
    assert set(QUERIES) == set(oracle_sql())


# Expected numbers of relations on this data, worked out beforehand in SQL.
EXPECTED = {
    "relations_any": 182,
    "relations_tolerant": 183,
    "relations_unique": 70,
    "relations_ascii": 70,
    "relations_mysql_types": 10,
    "relations_default_params": 70,
    "pk_candidates": 26,
    "pk_candidates_ascii": 23,
    "fk_candidates_any": 62,
    "fk_candidates_unique": 26,
    "fk_candidates_ascii": 36,
}


@pytest.mark.parametrize("name", list(EXPECTED))
def test_known_totals(con, name):
    assert len(con.execute(oracle_sql()[name]).fetchall()) == EXPECTED[name]


def test_entry(spark):
    import __spark_entry__

    frame = __spark_entry__.entry(spark)
    assert frame.count() == 10
    assert "matching_degree" in frame.columns
