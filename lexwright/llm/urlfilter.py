"""URL filters: expand URLs into host-suffix and path-prefix expressions, join on short hash prefixes.

No Python runs on the executors.  Shape of the plan: the distinct (host, head of
path) pairs are expanded, equi-joined with the rules on the first 32 bits of
SHA-256, confirmed on the whole digest, reduced to the winning rule, and joined
back.  Only as much of the path as the longest rule can see takes part, so the
expansion grows with the number of distinct hosts and not with the number of URLs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexwright.llm.common import ascii_lower, written

#: Rules are broadcast only below this many rows; beyond it the join is shuffled.
BROADCAST_RULES = 100_000


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or where there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], url: str = "url", default: str = "allow", prefix_hex: int = 8) -> DataFrame:
    """Add host, path, rule and verdict to every row of pages; no row is lost or doubled.

    rules: (verdict, host, path).  A rule fits its host and all subdomains if the path
    starts with its path; the longest host+path wins, and of equally long ones "block".
    A row that no rule fits gets a null rule and the default verdict.  Null and
    malformed URLs have an empty host and path and get the default.  Repeated rows stay
    repeated; columns of pages named host, path, rule or verdict are replaced.
    """
    spark = pages.sparkSession
    host, path = url_parts(F.col(f"`{url}`"))
    base = pages.drop(*[c for c in ("rule", "verdict") if c != url]).withColumns({"__host": host, "__path": path})
    heads = sorted({len(p) for _, _, p in rules}) or [0]
    base = base.withColumn("__head", F.substring("__path", 1, heads[-1]))

    listed = spark.createDataFrame([(v, h + p, len(h + p), v == "block") for v, h, p in rules], "verdict string, rule string, size int, hard boolean")
    digest = F.sha2(F.col("rule"), 256)
    listed = listed.withColumn("digest", digest).withColumn("short", F.substring("digest", 1, prefix_hex))
    if len(rules) <= BROADCAST_RULES:
        listed = F.broadcast(listed)

    labels = F.split("__host", r"\.")
    n = F.size("labels")
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice("labels", i, n), "."))
    lengths = F.filter(F.array(*[F.lit(k) for k in heads]), lambda k: k <= F.length("__head"))
    pairs = F.flatten(F.transform("suffixes", lambda s: F.transform(lengths, lambda k: F.concat(s, F.substring(F.col("__head"), F.lit(1), k)))))
    keys = base.where("__host <> ''").select("__host", "__head").distinct().withColumn("labels", labels).withColumn("suffixes", suffixes)
    found = (
        keys.select("__host", "__head", F.explode(pairs).alias("text"))
        .withColumn("full", F.sha2("text", 256))
        .withColumn("short", F.substring("full", 1, prefix_hex))
        .join(listed, "short")
        .where(F.col("full") == F.col("digest"))
        .groupBy("__host", "__head")
        .agg(F.max(F.struct("size", "hard", "rule", "verdict")).alias("__won"))
    )
    # read from a table, so that Spark can split the pages of a very common host over tasks
    found = written(found, "rules")
    out = base.join(found, ["__host", "__head"], "left")
    kept = [F.col(f"`{c}`") for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    return out.select(*kept, F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__won.rule").alias("rule"), F.coalesce("__won.verdict", F.lit(default)).alias("verdict"))
