"""Reads over the versioned node store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_versions(versions: DataFrame) -> DataFrame:
    """Newest version of each source by version_date, then id."""
    newest = versions.groupBy("source_id").agg(F.max(F.struct("version_date", "id", "root_node_id")).alias("v"))
    return newest.select("source_id", "v.id", "v.version_date", "v.root_node_id")


def lookup_sections(asked: DataFrame, route: Callable[[Column], Column], sources: DataFrame, versions: DataFrame, nodes: DataFrame, blobs: DataFrame) -> DataFrame:
    """Resolve (position, path) requests to section content.

    Each distinct path is resolved once and joined back, so repeats cost one lookup.
    Status: ``not_found`` without version or node, ``error`` where the body's blob is
    missing, else ``ok``.  A pinned version beats the newest one.
    """
    wanted = asked.select("path").distinct().withColumn("r", route(F.col("path"))).select("path", F.col("r.code").alias("code"), F.col("r.pin").alias("pin"), F.col("r.node_path").alias("node_path"))
    known = versions.join(sources.select(F.col("id").alias("source_id")), "source_id", "left_semi")
    newest = latest_versions(known).select(F.col("source_id").alias("code"), F.col("version_date").alias("newest"))
    pinned = known.select(F.col("source_id").alias("code"), F.col("version_date").alias("pin"), F.col("id").alias("source_version_id"))
    at = wanted.join(newest, "code", "left").withColumn("pin", F.coalesce("pin", "newest")).join(pinned, ["code", "pin"], "left")
    leaf = nodes.select("source_version_id", F.col("path").alias("node_path"), F.col("id").alias("node_id"), "blob_hash")
    body = blobs.select(F.col("hash").alias("blob_hash"), "content")
    full = at.join(leaf, ["source_version_id", "node_path"], "left").join(body, "blob_hash", "left")
    status = F.when(F.col("source_version_id").isNull() | F.col("node_id").isNull(), "not_found").when(F.col("content").isNull(), "error").otherwise("ok")
    return asked.join(full.select("path", "source_version_id", status.alias("status"), "content"), "path", "left")


def siblings(nodes: DataFrame) -> DataFrame:
    """Previous and next sibling id by sort_order; equal sort_orders are skipped over (strict order), ids break ties."""
    w = Window.partitionBy("parent_id").orderBy("sort_order")
    before = w.rangeBetween(Window.unboundedPreceding, -1)
    after = w.rangeBetween(1, Window.unboundedFollowing)
    key = F.struct(F.col("sort_order"), F.col("id"))
    return nodes.where(F.col("parent_id").isNotNull()).select("id", F.max(key).over(before)["id"].alias("prev_id"), F.min(key).over(after)["id"].alias("next_id"))
