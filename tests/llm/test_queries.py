"""Queries with SQL on the fixture: nulls, ties, repeated rows, hot groups; and on empty tables."""

import glob
from collections import Counter

import duckdb
import pytest

from kgweave.llm.queries import ORACLE, QUERIES

EMPTY = {"documents": "doc_id long, text string, lang string, source string, n_chars long",
         "benchmark": "item_id string, text string", "pages": "page_id long, url string, html string"}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, saved, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet({glob.glob(f'{saved}/{table}.parquet/*.parquet')})")
    df = QUERIES[name](spark, saved)
    columns = sorted(df.columns)
    got = Counter(tuple(map(str, r)) for r in df.select(*columns).collect())
    want = Counter(tuple(map(str, r)) for r in con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE[name]})").fetchall())
    assert got == want


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for table, schema in EMPTY.items():
        spark.createDataFrame([], schema).write.parquet(f"{folder}/{table}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables_give_no_rows(spark, empty, name):
    assert QUERIES[name](spark, empty).collect() == []
