"""Version differences, content deduplication, inserts and upserts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexwright.operators import store
from lexwright.plans import standins as S


def docs_v1(spark, d):
    return S.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.md5(F.col("text").cast("binary")).alias("blob_hash"))


def docs_v2(spark, d):
    """The next version: every 11th gone, every 7th changed, every 5th also under a new id."""
    t = S.table(spark, d, "documents")
    kept = t.where("doc_id % 11 <> 0").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("+"))).otherwise(F.col("text")).alias("text"))
    fresh = t.where("doc_id % 5 = 0").select((F.col("doc_id") + 1000000000).alias("id"), "text")
    return kept.unionAll(fresh).select("id", F.md5(F.col("text").cast("binary")).alias("blob_hash"))


V1 = "(SELECT doc_id AS id, md5(text) AS blob_hash FROM documents)"
V2 = """(SELECT doc_id AS id, md5(CASE WHEN doc_id % 7 = 0 THEN text || '+' ELSE text END) AS blob_hash FROM documents WHERE doc_id % 11 <> 0
  UNION ALL SELECT doc_id + 1000000000, md5(text) FROM documents WHERE doc_id % 5 = 0)"""


def diff_by_id(spark, d):
    return store.diff(docs_v1(spark, d), docs_v2(spark, d))


def diff_by_key(spark, d):
    n = store.relative_key(S.nodes(spark, d), S.versions(spark, d))
    old, new = n.where("source_version_id = 'asia-2023'"), n.where("source_version_id = 'asia-2024'")
    return store.diff(old, new, "key")


def nodes_diff_by_id(spark, d):
    """The literal form: ids hold their version, so all is added or removed."""
    n = S.nodes(spark, d)
    return store.diff(n.where("source_version_id = 'asia-2023'"), n.where("source_version_id = 'asia-2024'")).groupBy("change").agg(F.count("*").alias("n"))


def blob_dedupe(spark, d):
    t = S.table(spark, d, "documents").select(F.col("doc_id").alias("position"), "source", F.md5(F.col("text").cast("binary")).alias("hash"), F.octet_length("text").alias("size"))
    known = t.where("position % 9 = 0").select("hash")
    return store.new_blobs(t, known).select("hash", "position", "source", "size")


def blob_lookups(spark, d):
    """Hashes stored for one source and asked for by another: found by hash alone, missed by (source, hash)."""
    t = S.table(spark, d, "documents").select("doc_id", "source", F.md5(F.col("text").cast("binary")).alias("hash"))
    index = store.first_rows(t.select("hash", "source", "doc_id"), ["hash"], ["doc_id"]).select("hash", F.col("source").alias("stored_by"))
    return t.join(index, "hash").groupBy("source").agg(F.count("*").alias("asked"), F.count_if(F.col("source") == F.col("stored_by")).alias("found_scoped"))


def insert_ignore(spark, d):
    t = S.table(spark, d, "customer").select((F.col("c_custkey") % 400).alias("id"), F.col("c_name").alias("name"), F.col("c_custkey").alias("position"))
    held = t.where("position < 200 AND position = id")
    return store.insert_or_ignore(held, t, "id", ["position"])


def upsert_versions(spark, d):
    v = S.versions(spark, d).select("id", "root_node_id").withColumn("at", F.lit(0).cast("long"))
    fresh = S.table(spark, d, "orders").select(F.concat(F.element_at(F.array(*[F.lit(x) for x in ("asia", "europe", "mars")]), (F.col("o_orderkey") % 3 + 1).cast("int")), F.lit("-2024")).alias("id"), F.concat(F.lit("root/"), F.col("o_orderkey").cast("string")).alias("root_node_id"), F.col("o_orderkey").alias("at"))
    return store.upsert(v, fresh, ["id"], ["at"])


def upsert_classifications(spark, d):
    rows = S.table(spark, d, "lineitem").select((F.col("l_orderkey") % 7 + 110).alias("congress"), F.col("l_partkey").cast("string").alias("public_law_number"), F.concat("l_returnflag", "l_linestatus").alias("usc_section"), F.struct("l_orderkey", "l_linenumber").alias("at"))
    return store.last_rows(rows, ["congress", "public_law_number", "usc_section"], ["at"]).select("congress", "public_law_number", "usc_section", F.col("at.l_orderkey").alias("from_order"), F.col("at.l_linenumber").alias("from_line"))


def ordinal_keys(spark, d):
    t = S.table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("/section/"), (F.col("o_custkey") % 500).cast("string")).alias("path"))
    return store.ordinal_suffix(t, "path", "o_orderkey", "unique_path").select("o_orderkey", "unique_path")


def first_seen(spark, d):
    t = S.table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey")
    return store.first_rows(t, ["l_suppkey"], ["l_orderkey", "l_linenumber"])


def id_sets(spark, d):
    """Distinct ids of one version that the other lacks, both ways, as sets."""
    a, b = docs_v1(spark, d).select("id"), docs_v2(spark, d).select("id")
    return a.exceptAll(b).select("id", F.lit("old").alias("side")).unionByName(b.exceptAll(a).select("id", F.lit("new").alias("side")))


def source_registry(spark, d):
    return S.sources(spark, d).orderBy("name")


_LAW = "l_orderkey % 7 + 110 AS congress, CAST(l_partkey AS VARCHAR) AS public_law_number, l_returnflag || l_linestatus AS usc_section"
QUERIES = {
    "diff_by_id": (diff_by_id, f"""SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'modified' END AS change
        FROM {V1} a FULL JOIN {V2} b USING (id) WHERE a.blob_hash IS DISTINCT FROM b.blob_hash"""),
    "diff_by_key": (diff_by_key, f"""WITH n AS (SELECT n.*, substr(n.id, len(root_node_id) + 1) AS key FROM {S.NODES_SQL} n JOIN {S.VERSIONS_SQL} v ON v.id = source_version_id),
        a AS (SELECT * FROM n WHERE source_version_id = 'asia-2023'), b AS (SELECT * FROM n WHERE source_version_id = 'asia-2024')
        SELECT coalesce(a.key, b.key) AS key, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'modified' END AS change FROM a FULL JOIN b ON a.key = b.key
        WHERE a.id IS NULL OR b.id IS NULL OR a.blob_hash IS DISTINCT FROM b.blob_hash"""),
    "diff_literal": (nodes_diff_by_id, f"""SELECT CASE WHEN source_version_id = 'asia-2023' THEN 'removed' ELSE 'added' END AS change, count(*) AS n FROM {S.NODES_SQL}
        WHERE source_version_id IN ('asia-2023', 'asia-2024') GROUP BY 1"""),
    "blob_dedupe": (blob_dedupe, """WITH t AS (SELECT doc_id AS position, source, md5(text) AS hash, strlen(text) AS size FROM documents)
        SELECT hash, position, source, CAST(size AS INTEGER) AS size FROM t WHERE hash NOT IN (SELECT hash FROM t WHERE position % 9 = 0) QUALIFY row_number() OVER (PARTITION BY hash ORDER BY position) = 1"""),
    "blob_lookups": (blob_lookups, """WITH t AS (SELECT doc_id, source, md5(text) AS hash FROM documents), i AS (SELECT hash, arg_min(source, doc_id) AS stored_by FROM t GROUP BY 1)
        SELECT source, count(*) AS asked, count(*) FILTER (source = stored_by) AS found_scoped FROM t JOIN i USING (hash) GROUP BY 1"""),
    "insert_or_ignore": (insert_ignore, """WITH t AS (SELECT c_custkey % 400 AS id, c_name AS name, c_custkey AS position FROM customer), h AS (SELECT * FROM t WHERE position < 200 AND position = id)
        SELECT id, name, position FROM h UNION ALL SELECT id, name, position FROM (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY id ORDER BY position) = 1) WHERE id NOT IN (SELECT id FROM h)"""),
    "upsert_versions": (upsert_versions, f"""WITH b AS (SELECT id, root_node_id, CAST(0 AS BIGINT) AS "at", 0 AS fresh FROM {S.VERSIONS_SQL} UNION ALL
        SELECT ['asia', 'europe', 'mars'][o_orderkey % 3 + 1] || '-2024', 'root/' || o_orderkey, o_orderkey, 1 FROM orders)
        SELECT id, root_node_id, "at" FROM b QUALIFY row_number() OVER (PARTITION BY id ORDER BY fresh DESC, "at" DESC) = 1"""),
    "upsert_classifications": (upsert_classifications, f"""SELECT {_LAW}, l_orderkey AS from_order, l_linenumber AS from_line FROM lineitem
        QUALIFY row_number() OVER (PARTITION BY l_orderkey % 7, l_partkey, l_returnflag || l_linestatus ORDER BY l_orderkey DESC, l_linenumber DESC) = 1"""),
    "ordinal_keys": (ordinal_keys, """SELECT o_orderkey, CASE WHEN k = 1 THEN p ELSE p || '-' || k END AS unique_path FROM
        (SELECT o_orderkey, '/section/' || (o_custkey % 500) AS p, row_number() OVER (PARTITION BY o_custkey % 500 ORDER BY o_orderkey) AS k FROM orders)"""),
    "first_seen": (first_seen, "SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) = 1"),
    "id_sets": (id_sets, f"SELECT id, 'old' AS side FROM (SELECT id FROM {V1} EXCEPT SELECT id FROM {V2}) UNION ALL SELECT id, 'new' FROM (SELECT id FROM {V2} EXCEPT SELECT id FROM {V1})"),
    "source_registry": (source_registry, f"SELECT * FROM {S.SOURCES_SQL}"),
}
