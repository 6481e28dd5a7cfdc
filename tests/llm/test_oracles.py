"""Queries of this folder against their own SQL on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from perigee.llm.oracles import ORACLES
from perigee.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op1_warc_captures", "op8_fm_index"])
def test_query_equals_its_sql(spark, name):
    base = duckdb.connect()
    for table in ("documents", "pages", "benchmark"):
        base.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    found = base.execute(ORACLES[name])
    columns = sorted(c[0] for c in found.description)
    want = found.fetchall()
    order = [[c[0] for c in found.description].index(c) for c in columns]
    got = QUERIES[name](spark, FOLDER).select(*columns).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(str(tuple(r[k] for k in order)) for r in want)
