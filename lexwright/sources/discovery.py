"""What there is to ingest: versions and units read off landing pages and listings. All native."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexwright.functions.designators import usc_title_key

#: Title archives of the federal code (fixed value): title number and release point.
USC_ARCHIVE = r"xml_usc([0-9]+[A-Za-z]?)@([0-9A-Za-z-]+)\.zip"


def usc_units(pages: DataFrame) -> DataFrame:
    """(title, release, href) of the download links in (url, html) pages, titles in order; one row per title."""
    m = F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(rf'href="([^"]*{USC_ARCHIVE})"'), F.lit(1)))).alias("href")
    t = F.regexp_replace(F.regexp_extract("href", USC_ARCHIVE, 1), "^0+", "")
    links = pages.select(m).select(t.alias("title"), F.regexp_extract("href", USC_ARCHIVE, 2).alias("release"), "href")
    return links.groupBy("title", "release").agg(F.min("href").alias("href")).orderBy(usc_title_key(F.col("title")), "title")


def one_release(units: DataFrame) -> str:
    """The release point that all units share; an error if there is none or more than one."""
    r = units.agg(F.min("release").alias("a"), F.max("release").alias("b")).first()
    if r.a is None or r.a != r.b:
        raise ValueError(f"expected one release point, found {r.a} to {r.b}")
    return r.a


def law_packages(listing: DataFrame, first_congress: int = 106) -> DataFrame:
    """Packages of congresses from ``first_congress`` on, with the listing's version: the day of the latest change."""
    kept = listing.where(F.col("congress") >= first_congress)
    day = kept.agg(F.substring(F.max("last_modified"), 1, 10).alias("version"))
    return kept.crossJoin(F.broadcast(day)).orderBy("congress", "package_id")  # the other side is one row


def mgl_version(html: DataFrame) -> DataFrame:
    """Version of a landing page: its amendment date, else its copyright year, else null."""
    a = F.regexp_extract("html", r"(?i)amended\s+(?:through|as\s+of)\s+([A-Za-z]+\s+[0-9]{1,2},\s+[0-9]{4})", 1)
    c = F.regexp_extract("html", r"(?i)(?:copyright|&copy;|©)\D{0,20}([0-9]{4})", 1)
    return html.select("url", F.when(a != "", a).when(c != "", c).alias("version"))


def missing_objects(wanted: DataFrame, present: DataFrame, key: str = "url") -> DataFrame:
    """Wanted objects that the landing folder lacks, once each."""
    return wanted.dropDuplicates([key]).join(present.select(key), key, "left_anti")


def archives_only(objects: DataFrame) -> DataFrame:
    """binaryFile rows without web pages that were sent in an archive's place."""
    head = F.lower(F.decode(F.substring("content", 1, 200), "ISO-8859-1"))
    return objects.where(~(head.contains("<!doctype html") | head.contains("<html")))
