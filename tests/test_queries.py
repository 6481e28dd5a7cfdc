"""Every registered query against its independent SQL on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import pytest

from __spark_entry__ import entry
from perigee.oracles import ORACLES
from perigee.queries import QUERIES

duckdb = pytest.importorskip("duckdb")
TABLES = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not TABLES.exists(), reason="test tables are not mounted")


@pytest.fixture(scope="module")
def other_engine():
    connection = duckdb.connect()
    for file in TABLES.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_its_sql(spark, other_engine, name):
    df = QUERIES[name](spark, str(TABLES))
    columns = sorted(df.columns)
    found = sorted(repr(tuple(row[c] for c in columns)) for row in df.collect())
    result = other_engine.execute(ORACLES[name])
    theirs = [d[0] for d in result.description]
    assert sorted(theirs) == columns
    order = [theirs.index(c) for c in columns]
    expected = sorted(repr(tuple(row[i] for i in order)) for row in result.fetchall())
    assert found == expected
    assert found


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_expected_sizes(spark):
    gold = {(r["freshness_status"], r["quality_status"]): r["satellite_count"] for r in entry(spark).collect()}
    assert gold == {
        ("fresh", "valid"): 56,
        ("fresh", "invalid_missing_norad_cat_id"): 3,
        ("stale", "valid"): 802,
        ("stale", "invalid_missing_norad_cat_id"): 38,
        ("unknown", "invalid_missing_epoch"): 16,
    }
    assert QUERIES["contact_windows"](spark, str(TABLES)).count() == 115
