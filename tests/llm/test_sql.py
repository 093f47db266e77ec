"""Queries with SQL against DuckDB on the smallest tables."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest

from termgrid.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    tidy = lambda rows: Counter(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows)
    assert tidy(QUERIES[name](spark, SF).select(*columns).collect()) == tidy(want.fetchall())
