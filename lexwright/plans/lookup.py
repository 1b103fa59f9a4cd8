"""Batch section lookup: requested paths -> source -> version -> node -> content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexwright.functions.routes import parse_statute_route
from lexwright.operators.retrieval import lookup_sections
from lexwright.plans import standins as S


def section_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer asks for its own section: some pinned to a version, some with unknown sources or repeated."""
    asked = S.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("position"),
        F.concat(
            F.lit("/statutes/"),
            F.when(F.col("c_custkey") % 13 == 0, "nowhere").otherwise("asia"),
            F.when(F.col("c_custkey") % 5 == 0, "@2023").otherwise(""),
            F.lit("/section/"), F.col("c_nationkey").cast("string"), F.lit("/"), (F.col("c_custkey") - F.col("c_custkey") % 2).cast("string"),
        ).alias("path"),
    )
    found = lookup_sections(asked, parse_statute_route, S.sources(spark, sf_dir), S.versions(spark, sf_dir), S.nodes(spark, sf_dir), S.blobs(spark, sf_dir))
    return found.select("position", F.col("path").alias("requested"), "source_version_id", "status", "content")


def _sql() -> str:
    return f"""
WITH asked AS (SELECT c_custkey AS position, '/statutes/' || CASE WHEN c_custkey % 13 = 0 THEN 'nowhere' ELSE 'asia' END
    || CASE WHEN c_custkey % 5 = 0 THEN '@2023' ELSE '' END || '/section/' || c_nationkey || '/' || (c_custkey - c_custkey % 2) AS path FROM customer),
p AS (SELECT *, regexp_extract(path, '^/statutes/([^/@]+)', 1) AS code, nullif(regexp_extract(path, '^/statutes/[^/@]+@([^/]+)', 1), '') AS pin,
    regexp_extract(path, '^/statutes/[^/]+(/.*)$', 1) AS rest FROM asked),
latest AS (SELECT source_id, max(version_date) AS version_date FROM {S.VERSIONS_SQL} GROUP BY source_id)
SELECT p.position, p.path AS requested, v.id AS source_version_id,
  CASE WHEN v.id IS NULL OR n.id IS NULL THEN 'not_found' WHEN b.hash IS NULL THEN 'error' ELSE 'ok' END AS status, b.content
FROM p LEFT JOIN latest l ON l.source_id = p.code
LEFT JOIN {S.VERSIONS_SQL} v ON v.source_id = p.code AND v.version_date = coalesce(p.pin, l.version_date)
LEFT JOIN {S.NODES_SQL} n ON n.source_version_id = v.id AND n.path = p.rest
LEFT JOIN {S.BLOBS_SQL} b ON b.hash = n.blob_hash"""


QUERIES = {"section_lookup": (section_lookup, _sql())}
