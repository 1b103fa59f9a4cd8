"""Tree navigation and version listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexwright.operators import retrieval, store
from lexwright.plans import standins as S

COLS = ["id", "parent_id", "level_name", "sort_order", "name", "path"]


def node_by_path(spark, d):
    return S.nodes(spark, d).where((F.col("source_version_id") == "asia-2024") & (F.col("path") == "/title/12")).select(*COLS).limit(1)


def root_node(spark, d):
    return S.nodes(spark, d).where((F.col("source_version_id") == "europe-2023") & F.col("parent_id").isNull()).select(*COLS)


def top_level(spark, d):
    return S.nodes(spark, d).where((F.col("source_version_id") == "asia-2024") & (F.col("level_index") == 1)).select(*COLS).orderBy("sort_order", "id")


def children(spark, d):
    return S.nodes(spark, d).where(F.col("parent_id") == "asia/2024/root/title-12").select(*COLS).orderBy("sort_order", "id")


def ancestors(spark, d):
    n = S.nodes(spark, d)
    return store.ancestors(n).groupBy("id").agg(F.max("distance").alias("depth"), F.max_by("ancestor_id", "distance").alias("root_id"))


def siblings(spark, d):
    return retrieval.siblings(S.nodes(spark, d))


def sections_with_body(spark, d):
    """Sections that have a body, counted by version."""
    n = S.nodes(spark, d).where((F.col("level_name") == "section") & F.col("blob_hash").isNotNull())
    return n.groupBy("source_version_id").agg(F.count("*").alias("sections"))


def latest_versions(spark, d):
    return retrieval.latest_versions(S.versions(spark, d))


def newest_versions(spark, d):
    v = S.versions(spark, d)
    s = S.sources(spark, d).select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    # orders by month stand in for a long list of versions
    return v.join(s, "source_id").orderBy(F.desc("version_date"), "id").limit(50).select("id", "source_id", "source_name", "version_date")


def keyset_page(spark, d):
    """A page of sections after a cursor id."""
    n = S.nodes(spark, d).where((F.col("source_version_id") == "asia-2024") & (F.col("level_name") == "section") & (F.col("id") > "asia/2024/root/title-12"))
    return n.orderBy("id").limit(10).select("id", "name")


def node_by_id(spark, d):
    """Point lookups: by id, and by version and id."""
    n = S.nodes(spark, d)
    one = n.where(F.col("id") == "asia/2024/root/title-12").select(F.lit("id").alias("by"), *COLS)
    two = n.where((F.col("source_version_id") == "asia-2023") & (F.col("id") == "asia/2023/root/title-17")).select(F.lit("version and id").alias("by"), *COLS)
    return one.unionAll(two)


def node_metadata(spark, d):
    """The metadata of nodes as maps without their null values."""
    n = S.nodes(spark, d)
    kept = store.compact_metadata({"level": F.col("level_name"), "parent": F.col("parent_id"), "blob": F.col("blob_hash"), "name": F.col("name")})
    return n.select("id", F.array_join(F.array_sort(F.map_keys(kept)), ",").alias("keys"), F.size(kept).alias("n_keys"), F.element_at(kept, "name").alias("name"))


N = S.NODES_SQL
_C = ", ".join(COLS)
QUERIES = {
    "node_by_id": (
        node_by_id,
        f"""SELECT 'id' AS by, {_C} FROM {N} WHERE id = 'asia/2024/root/title-12'
        UNION ALL SELECT 'version and id', {_C} FROM {N} WHERE source_version_id = 'asia-2023' AND id = 'asia/2023/root/title-17'""",
    ),
    "node_metadata": (
        node_metadata,
        f"""SELECT id, CASE WHEN blob_hash IS NOT NULL THEN 'blob,' ELSE '' END || 'level,name' || CASE WHEN parent_id IS NOT NULL THEN ',parent' ELSE '' END AS keys,
        CAST(2 + (blob_hash IS NOT NULL)::INT + (parent_id IS NOT NULL)::INT AS INTEGER) AS n_keys, name FROM {N}""",
    ),
    "node_by_path": (node_by_path, f"SELECT {_C} FROM {N} WHERE source_version_id = 'asia-2024' AND path = '/title/12' LIMIT 1"),
    "root_node": (root_node, f"SELECT {_C} FROM {N} WHERE source_version_id = 'europe-2023' AND parent_id IS NULL"),
    "top_level_nodes": (top_level, f"SELECT {_C} FROM {N} WHERE source_version_id = 'asia-2024' AND level_index = 1"),
    "child_nodes": (children, f"SELECT {_C} FROM {N} WHERE parent_id = 'asia/2024/root/title-12'"),
    "ancestors": (
        ancestors,
        f"""WITH RECURSIVE n AS MATERIALIZED (SELECT * FROM {N}), up(id, ancestor_id, parent_id, distance) AS (
          SELECT id, id, parent_id, 0 FROM n UNION ALL SELECT up.id, n.id, n.parent_id, distance + 1 FROM up JOIN n ON n.id = up.parent_id)
        SELECT id, max(distance) AS depth, arg_max(ancestor_id, distance) AS root_id FROM up GROUP BY id""",
    ),
    "siblings": (
        siblings,
        f"""WITH n AS MATERIALIZED (SELECT * FROM {N} WHERE parent_id IS NOT NULL),
        o AS (SELECT parent_id, sort_order, min(id) AS lo, max(id) AS hi FROM n GROUP BY 1, 2),
        s AS (SELECT *, lag(hi) OVER w AS prev_id, lead(lo) OVER w AS next_id FROM o WINDOW w AS (PARTITION BY parent_id ORDER BY sort_order))
        SELECT n.id, prev_id, next_id FROM n JOIN s USING (parent_id, sort_order)""",
    ),
    "sections_with_body": (sections_with_body, f"SELECT source_version_id, count(*) AS sections FROM {N} WHERE level_name = 'section' AND blob_hash IS NOT NULL GROUP BY 1"),
    "latest_versions": (latest_versions, f"SELECT source_id, id, version_date, root_node_id FROM {S.VERSIONS_SQL} QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY version_date DESC, id DESC) = 1"),
    "newest_versions": (newest_versions, f"SELECT v.id, source_id, s.name AS source_name, version_date FROM {S.VERSIONS_SQL} v JOIN {S.SOURCES_SQL} s ON s.id = source_id ORDER BY version_date DESC, v.id LIMIT 50"),
    "keyset_page": (keyset_page, f"SELECT id, name FROM {N} WHERE source_version_id = 'asia-2024' AND level_name = 'section' AND id > 'asia/2024/root/title-12' ORDER BY id LIMIT 10"),
}
