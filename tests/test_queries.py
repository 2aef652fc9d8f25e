"""All registered queries against their SQL on the smallest scale."""


import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
QUERIES, SQL = entry.queries(), entry.oracle_sql()
NAMES = list(SQL)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def tidy(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].astype("datetime64[us]").astype(str)
        elif df[c].dtype == object:
            df[c] = df[c].map(lambda v: "" if v is None or v != v else str(v))
        else:
            df[c] = df[c].astype("float64")
    return df.sort_values(list(df.columns), ignore_index=True)


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_sql(spark, duck, name):
    got = tidy(QUERIES[name](spark, SF).toPandas())
    want = tidy(duck.execute(SQL[name]).df())
    pd.testing.assert_frame_equal(got, want, check_exact=True)


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert set(df.columns) == {"symbol", "target_class", "n", "percent"} and df.count() > 0


def test_every_sql_has_its_query():
    assert set(SQL) <= set(QUERIES)
