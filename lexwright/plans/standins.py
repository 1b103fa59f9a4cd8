"""Stand-in tables: the library's store schema expressed over the test tables.

Every function has a twin in SQL (the ``*_SQL`` constants), so a query and its
check start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source per region: id, name, jurisdiction, region, doc_type."""
    return table(spark, sf_dir, "region").select(
        F.lower(F.translate("r_name", " ", "-")).alias("id"),
        F.col("r_name").alias("name"),
        F.lit("state").alias("jurisdiction"),
        F.lit("US").alias("region"),
        F.lit("statute").alias("doc_type"),
    )


SOURCES_SQL = """(SELECT lower(replace(r_name, ' ', '-')) AS id, r_name AS name, 'state' AS jurisdiction,
  'US' AS region, 'statute' AS doc_type FROM region)"""


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region > nation > customer as a versioned tree; two versions, the later without every 11th customer.

    Levels: 0 root, 1 title (nation), 2 section (customer).  Columns: id,
    source_version_id, parent_id, level_name, level_index, sort_order, name, path, blob_hash.
    """
    region = table(spark, sf_dir, "region").select("r_regionkey", F.lower(F.translate("r_name", " ", "-")).alias("src"), "r_name")
    nation = table(spark, sf_dir, "nation")
    customer = table(spark, sf_dir, "customer")
    versions = F.explode(F.array(F.lit("2023"), F.lit("2024"))).alias("v")
    svid = F.concat("src", F.lit("-"), "v")
    root = F.concat("src", F.lit("/"), "v", F.lit("/root"))
    null = F.lit(None).cast("string")
    roots = region.select("src", "r_name", versions).select(
        root.alias("id"), svid.alias("source_version_id"), null.alias("parent_id"), F.lit("root").alias("level_name"),
        F.lit(0).alias("level_index"), F.lit(0).alias("sort_order"), F.col("r_name").alias("name"), F.lit("/").alias("path"), null.alias("blob_hash"),
    )
    # region and nation have a fixed number of rows (5 and 25), so the hint has a proven bound
    titled = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    title_id = F.concat(root, F.lit("/title-"), F.col("n_nationkey").cast("string"))
    titles = titled.select("src", "n_nationkey", "n_name", versions).select(
        title_id.alias("id"), svid.alias("source_version_id"), root.alias("parent_id"), F.lit("title").alias("level_name"),
        F.lit(1).alias("level_index"), F.col("n_nationkey").alias("sort_order"), F.col("n_name").alias("name"),
        F.concat(F.lit("/title/"), F.col("n_nationkey").cast("string")).alias("path"), null.alias("blob_hash"),
    )
    body = F.when(F.col("v") == "2024", F.concat("c_mktsegment", F.when(F.col("c_custkey") % 7 == 0, "+").otherwise(""))).otherwise(F.col("c_mktsegment"))
    sections = (
        customer.join(F.broadcast(titled), F.col("c_nationkey") == F.col("n_nationkey"))
        .select("src", "n_nationkey", "c_custkey", "c_name", "c_mktsegment", versions)
        .where((F.col("v") != "2024") | (F.col("c_custkey") % 11 != 0))
        .select(
            F.concat(title_id, F.lit("/section-"), F.col("c_custkey").cast("string")).alias("id"), svid.alias("source_version_id"), title_id.alias("parent_id"),
            F.lit("section").alias("level_name"), F.lit(2).alias("level_index"), (F.col("c_custkey") % 1000).cast("int").alias("sort_order"), F.col("c_name").alias("name"),
            F.concat(F.lit("/section/"), F.col("n_nationkey").cast("string"), F.lit("/"), F.col("c_custkey").cast("string")).alias("path"), F.md5(body.cast("binary")).alias("blob_hash"),
        )
    )
    return roots.unionAll(titles).unionAll(sections)


NODES_SQL = """(
  WITH v(v) AS (VALUES ('2023'), ('2024')), r AS (SELECT *, lower(replace(r_name, ' ', '-')) AS src FROM region),
  t AS (SELECT * FROM nation JOIN r ON n_regionkey = r_regionkey)
  SELECT src || '/' || v || '/root' AS id, src || '-' || v AS source_version_id, CAST(NULL AS VARCHAR) AS parent_id, 'root' AS level_name,
    0 AS level_index, 0 AS sort_order, r_name AS name, '/' AS path, CAST(NULL AS VARCHAR) AS blob_hash FROM r, v
  UNION ALL
  SELECT src || '/' || v || '/root/title-' || n_nationkey, src || '-' || v, src || '/' || v || '/root', 'title', 1, n_nationkey, n_name, '/title/' || n_nationkey, NULL FROM t, v
  UNION ALL
  SELECT src || '/' || v || '/root/title-' || n_nationkey || '/section-' || c_custkey, src || '-' || v, src || '/' || v || '/root/title-' || n_nationkey, 'section', 2,
    CAST(c_custkey % 1000 AS INTEGER), c_name, '/section/' || n_nationkey || '/' || c_custkey,
    md5(CASE WHEN v = '2024' AND c_custkey % 7 = 0 THEN c_mktsegment || '+' ELSE c_mktsegment END)
  FROM customer JOIN t ON c_nationkey = n_nationkey, v WHERE v <> '2024' OR c_custkey % 11 <> 0)"""


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, source_id, version_date, root_node_id."""
    src = sources(spark, sf_dir).select(F.col("id").alias("source_id"))
    return src.select("source_id", F.explode(F.array(F.lit("2023"), F.lit("2024"))).alias("version_date")).select(
        F.concat("source_id", F.lit("-"), "version_date").alias("id"), "source_id", "version_date", F.concat("source_id", F.lit("/"), "version_date", F.lit("/root")).alias("root_node_id")
    )


VERSIONS_SQL = f"""(SELECT id || '-' || v AS id, id AS source_id, v AS version_date, id || '/' || v || '/root' AS root_node_id
  FROM {SOURCES_SQL}, (VALUES ('2023'), ('2024')) v(v))"""


def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hash, content: the distinct section bodies; every body that ends in '+' is missing, as after a failed flush."""
    seg = table(spark, sf_dir, "customer").select("c_mktsegment").distinct()
    return seg.select(F.md5(F.col("c_mktsegment").cast("binary")).alias("hash"), F.col("c_mktsegment").alias("content"))


BLOBS_SQL = "(SELECT DISTINCT md5(c_mktsegment) AS hash, c_mktsegment AS content FROM customer)"
