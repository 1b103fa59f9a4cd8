"""Queries against their SQL on rows that the given tables don't hold: texts null, empty or without a word; equal and null dates."""

import duckdb
import pytest

from lexwright.plans import registry

TEXTS = [(1, None), (2, ""), (3, " \n"), (4, "§§ — !?"), (5, "漢字"), (6, "one"), (7, " two  words. ")]


@pytest.fixture(scope="module")
def odd_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame([(k, t, "en", "src0", len(t or "")) for k, t in TEXTS], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    return d


@pytest.mark.parametrize("name", ["moved_paragraphs", "redesignated", "shown_edits"])
def test_texts_without_words(spark, odd_dir, name):
    df = registry.queries()[name](spark, odd_dir)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{odd_dir}/documents.parquet/*.parquet'")
    want = con.sql(registry.oracle_sql()[name])
    assert df.columns == want.columns
    assert sorted(tuple(r) for r in df.collect()) == sorted(want.fetchall())


def test_first_attempts_of_one_date(spark, tmp_path):
    """Lines of one date and number: the one that stands first in the table; nulls come last, as in the SQL."""
    lines = [(1, 10, 1, "2020-01-02"), (1, 11, 1, "2020-01-02"), (2, 20, 1, None), (2, 21, 3, "2021-01-01"), (2, 22, None, "2021-01-01"), (3, 30, 2, "2020-01-01"), (3, 31, 1, "2020-01-01")]
    rows = spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int, day string").selectExpr("l_orderkey", "l_partkey", "l_linenumber", "'R' AS l_returnflag", "to_timestamp(day) AS l_shipdate")
    rows.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(1, 5).withColumnRenamed("id", "o_orderkey").write.parquet(f"{tmp_path}/orders.parquet")
    assert sorted(tuple(r) for r in registry.queries()["first_attempts"](spark, str(tmp_path)).collect()) == [(1, 10), (2, 21), (3, 31), (4, None)]


@pytest.mark.parametrize("name", ["moved_paragraphs", "redesignated", "shown_edits"])
def test_repeated_ids(spark, tmp_path, name):
    """Documents of one id, alike or not: each is amended once, by one instruction."""
    rows = [(1, "a b"), (1, "a b"), (2, "c"), (2, "d"), (2, None), (3, "e")]
    spark.createDataFrame([(k, t, "en", "src0", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(tuple(r) for r in registry.queries()[name](spark, str(tmp_path)).collect()) == sorted(con.sql(registry.oracle_sql()[name]).fetchall())
