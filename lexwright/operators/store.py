"""The versioned, content-addressed store: differences, deduplication, inserts and upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexwright.operators.scratch import written


def first_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row per key: a partial aggregate, so repeats of a hot key never meet in one task."""
    rest = [c for c in df.columns if c not in keys]
    low = df.groupBy(*keys).agg(F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("__r"))
    return low.select(*[F.col(c) if c in keys else F.col(f"__r.{c}").alias(c) for c in df.columns])


def last_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    high = df.groupBy(*keys).agg(F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("__r"))
    return high.select(*[F.col(c) if c in keys else F.col(f"__r.{c}").alias(c) for c in df.columns])


def diff(old: DataFrame, new: DataFrame, key: str = "id", value: str = "blob_hash") -> DataFrame:
    """(key, change): added, removed, or modified where the value differs, null counting as a value."""
    a = old.select(key, F.col(value).alias("__a"), F.lit(True).alias("__in_a"))
    b = new.select(key, F.col(value).alias("__b"), F.lit(True).alias("__in_b"))
    change = F.when(F.col("__in_a").isNull(), "added").when(F.col("__in_b").isNull(), "removed").when(~F.col("__a").eqNullSafe(F.col("__b")), "modified")
    return a.join(b, key, "full_outer").select(key, change.alias("change")).where("change IS NOT NULL")


def relative_key(nodes: DataFrame, versions: DataFrame) -> DataFrame:
    """nodes with ``key``: the id without its version's root prefix, which makes versions comparable."""
    roots = versions.select(F.col("id").alias("source_version_id"), "root_node_id")
    tail = F.substring(F.col("id"), F.length("root_node_id") + 1, F.length("id"))
    return nodes.join(roots, "source_version_id").withColumn("key", F.when(F.col("id").startswith(F.col("root_node_id")), tail).otherwise(F.col("id"))).drop("root_node_id")


def insert_or_ignore(table: DataFrame, rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """table with those rows whose key it lacks; of rows with one key the first in order."""
    fresh = first_rows(rows, [key], order).join(table.select(key), key, "left_anti")
    return table.unionByName(fresh.select(table.columns))


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Newest row per key over table and rows; rows beat the table."""
    both = table.withColumn("__new", F.lit(0)).unionByName(rows.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    return last_rows(both, keys, ["__new", *order]).drop("__new")


def new_blobs(items: DataFrame, known: DataFrame, hash_col: str = "hash", order: str = "position") -> DataFrame:
    """Items whose content hash is not stored yet, once each, the first one winning."""
    return first_rows(items, [hash_col], [order]).join(known.select(hash_col), hash_col, "left_anti")


def ordinal_suffix(df: DataFrame, key: str, order: str, out: str) -> DataFrame:
    """Repeated keys get -2, -3, ... in order; the first keeps its name."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return df.withColumn(out, F.when(n == 1, F.col(key)).otherwise(F.concat(F.col(key), F.lit("-"), n.cast("string"))))


def ancestors(nodes: DataFrame) -> DataFrame:
    """(id, ancestor_id, distance): the node itself at 0, its parent at 1, up to the root.

    The levels of statutes are few, so the walk is a loop of joins over the level's rows, each written to the
    scratch folder for the next; it ends when no row has a parent left.  A node among its own ancestors is an error.
    """
    parent = nodes.select(F.col("id").alias("ancestor_id"), F.col("parent_id").alias("up"))
    level = nodes.select("id", F.col("id").alias("ancestor_id"), F.lit(0).alias("distance"), F.col("parent_id").alias("up"))
    out, k = level.drop("up"), 0
    while True:
        k += 1
        above = level.where("up IS NOT NULL").select("id", F.col("up").alias("ancestor_id")).join(parent, "ancestor_id")
        level = written(above.select("id", "ancestor_id", F.lit(k).alias("distance"), "up"), "ancestors")
        left, around = level.agg(F.count("*"), F.count(F.when(F.col("id") == F.col("ancestor_id"), 1))).first()
        if around:
            raise ValueError(f"{around} nodes are their own ancestors, {k} levels up")
        if not left:
            return out
        out = out.unionAll(level.drop("up"))


def compact_metadata(fields: dict[str, Column]) -> Column:
    """A map of the fields that aren't null."""
    return F.map_filter(F.create_map(*[x for k, c in fields.items() for x in (F.lit(k), c.cast("string"))]), lambda _, v: v.isNotNull())
