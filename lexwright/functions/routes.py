"""Statute routes: ``/statutes/<source>[@<version>]/<node path>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_statute_route(path: Column) -> Column:
    """Struct (code, pin, node_path); null for a path that is no statute route. An absent version gives a null pin."""
    code = F.regexp_extract(path, r"^/statutes/([^/@]+)", 1)
    pin = F.regexp_extract(path, r"^/statutes/[^/@]+@([^/]+)", 1)
    rest = F.regexp_extract(path, r"^/statutes/[^/]+(/.*)$", 1)
    route = F.struct(code.alias("code"), F.when(pin != "", pin).alias("pin"), F.when(rest != "", rest).otherwise("/").alias("node_path"))
    return F.when(code != "", route)


def to_statute_route(prefix: Column, node_path: Column) -> Column:
    """Route of a node; null stays null, the root path adds nothing."""
    return F.when(node_path.isNull(), None).when(node_path == "/", prefix).otherwise(F.concat(prefix, node_path))


def is_document_route(path: Column) -> Column:
    return F.coalesce(path.startswith("/statutes/") | (path == "/statutes"), F.lit(False))
