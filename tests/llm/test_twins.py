"""Registered text queries against their SQL on the smallest scale, also with null and repeated rows."""

import duckdb
import pandas as pd
import pytest

from candlewake.llm.queries import R
from tests.test_queries import tidy

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(R.sql))
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = tidy(R.queries[name](spark, SF).toPandas()), tidy(con.execute(R.sql[name]).df())
    pd.testing.assert_frame_equal(got, want, check_exact=True)


ODD = [
    (1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, "one two", "b"), (4, "one two", "b"), (5, "Wort " * 30000 + ".", "b"),
    (6, "a b c a b c a b c.\n" * 40, ""), (7, "x | y | z\n" * 30, "é"), (8, "\n".join(["Same line here."] * 20), None),
]


@pytest.fixture
def odd(spark, tmp_path):
    docs = pd.DataFrame(ODD, columns=["doc_id", "text", "source"])
    docs["doc_id"] = docs["doc_id"].astype("Int64")
    docs = docs.assign(lang="en", n_chars=1, n_words=7, size=3, kept="x", bucket=1)
    docs.to_parquet(tmp_path / "documents.parquet")
    pd.DataFrame({"item_id": [1, 2, 3, 3], "text": ["a b c a b c a b c.", None, "", "one two"]}).to_parquet(tmp_path / "benchmark.parquet")
    html = ["p" * 150, "p" * 150, None, "short", "short", "p" * 150, "é" * 60, "é" * 60]
    pages = pd.DataFrame({"page_id": [5, 3, 1, 2, 4, 9, 7, 8], "url": ["http://a/é b\r\nX: 1", None, "", "u", "u", "u", "u", "u"], "html": html})
    pages.to_parquet(tmp_path / "pages.parquet")
    turns = [(0, 1, "user", "hi"), (0, None, None, "first"), (0, 2, "user", None), (1, 1, "user", "hi"), (1, 0, "", "first"), (1, 2, "user", "")]
    turns += [(5, None, "user", None)] * 3 + [(None, 1, "user", "lost")] + [(c, k, "user", "same " * k) for c in (10, 11, 12, 13, 20, 21) for k in range(12)]
    turns = pd.DataFrame(turns, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    turns.assign(conv=1, pos="x", f=2).to_parquet(tmp_path / "conversations.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", list(R.sql))
@pytest.mark.parametrize("empty", [False, True])
def test_odd_rows_agree_with_sql(spark, odd, tmp_path, name, empty):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        if empty:
            con.execute(f"CREATE TABLE none AS SELECT * FROM '{odd}/{t}.parquet' LIMIT 0")
            con.execute(f"COPY none TO '{odd}/{t}.parquet' (FORMAT parquet)")
            con.execute("DROP TABLE none")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{odd}/{t}.parquet'")
    got, want = R.queries[name](spark, odd).toPandas(), con.execute(R.sql[name]).df()
    assert set(got.columns) == set(want.columns) and len(got) == len(want)
    if not empty:
        pd.testing.assert_frame_equal(tidy(got), tidy(want), check_exact=True)
