"""Every registered core query against its SQL, and the functions' edge cases."""

import duckdb
import pytest

from lexwright.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def con(sf_dir):
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 9)
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_sql(spark, sf_dir, con, name):
    df = registry.queries()[name](spark, sf_dir)
    rows = df.collect()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        return
    want = con.sql(sql)
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    key = lambda rs: sorted((str([plain(x) for x in r]) for r in rs))
    assert key([[r[c] for c in cols] for r in rows]) == key([[r[want.columns.index(c)] for c in cols] for r in want.fetchall()])


def one(spark, column, **values):
    from pyspark.sql import functions as F

    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).first()[0]


def test_text_functions(spark):
    from pyspark.sql import functions as F

    from lexwright.functions import designators as D
    from lexwright.functions import text as T

    x = F.col("x")
    assert one(spark, T.collapse_whitespace(x), x="  a\t b\n ") == "a b"
    assert one(spark, T.truncate_chars(x, 4), x="abc def") == "abc..."
    assert one(spark, T.chunks(x, 3), x="ab  cd ef") == ["ab", "cd", "ef"]
    assert one(spark, T.chunks(x, 3), x="") == []
    assert one(spark, T.extract_json(x), x='say {"a": 1} now') == '{"a": 1}'
    assert one(spark, T.extract_json(x), x="} {") is None
    assert one(spark, T.normalize_body(x), x="Section 7A. One \r\n\r\n\r\n two x") == "One\n\ntwo x"
    for mark, order in (("1", 100000), ("12a", 1200001), ("7AB", 700029), ("", 2**31 - 1), ("a1", 2**31 - 1), ("99999999", 2**31 - 1), ("99999999999999", 2**31 - 1)):
        assert one(spark, D.sort_order(x), x=mark) == order
    for roman, value in (("XIV", 14), ("MCMXCIX", 1999), ("", 0), ("IIX", 8), ("A", 0)):
        assert one(spark, D.roman_value(x), x=roman) == value
    assert one(spark, D.usc_title_key(x), x="5a") == 5.01 and one(spark, D.usc_title_key(x), x="x") == float("inf")
    assert one(spark, D.strip_zeros(x), x="007b") == "7b" and one(spark, D.padded(x, 3), x="07B") == "007b"
