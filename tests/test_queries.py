"""Every registered query with SQL against DuckDB on the smallest tables; the others by their rows."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest

from termgrid import queries as Q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Fits need more rows than the smallest tables have.
LONG = {"gmm_select", "fit_regimes", "label_stability", "algorithm_agreement", "split_stability", "walk_forward_labels", "gbt_walk_forward", "adf_by_contract", "coint_by_contract"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def normal(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]

    def value(x):
        if x is None or x is pd.NaT or (isinstance(x, float) and x != x):
            return "null"
        if hasattr(x, "isoformat"):
            return x.isoformat()[:10]
        return f"{x:.4f}" if isinstance(x, float) else str(x)

    return sorted(tuple(value(x) for x in row) for row in df.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_matches_sql(spark, duck, name):
    got, want = Q.QUERIES[name](spark, SF).toPandas(), duck.execute(Q.ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    a, b = normal(got), normal(want)
    if a != b:  # a rounded last digit may differ
        for x, y in zip(a, b, strict=True):
            for p, q in zip(x, y, strict=True):
                assert p == q or abs(float(p) - float(q)) <= 2e-4 * max(1, abs(float(q)))


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", ["adf_by_contract", "autoregression", "hac_regression", "split_stability", "correlogram", "assignment_confidence", "regime_centres", "gbt_fold_table"])
def test_fitted_queries_have_rows(spark, name):
    assert Q.QUERIES[name](spark, SF.replace("0.001", "0.01")).count() > 0


@pytest.mark.parametrize(("name", "rows"), [("gmm_select", 8 * 4), ("label_stability", 15 + 25)])
def test_fits_are_as_many_as_in_the_reference(spark, name, rows):
    assert Q.QUERIES[name](spark, SF.replace("0.001", "0.01")).count() == rows
