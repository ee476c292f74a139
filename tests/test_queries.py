"""Every sensor query against its SQL on the smallest tables."""

import duckdb
import pytest

from brontide.plans import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in ("supplier", "events"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def as_text(df):
    columns = sorted(df.columns)
    return df[columns].astype(str).replace({"None": "nan", "<NA>": "nan"}).sort_values(columns).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_matches_sql(spark, tables, name):
    got, want = as_text(catalogue.QUERIES[name](spark, DATA).toPandas()), as_text(tables.execute(catalogue.ORACLES[name]).df())
    assert list(got.columns) == list(want.columns)
    assert got.equals(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_without_sql_has_rows(spark, name):
    assert catalogue.QUERIES[name](spark, DATA).count() > 0
