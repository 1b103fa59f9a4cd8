"""Exact vector retrieval over an embeddings DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexwright.functions.text import quick_text, tool_chunks


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where a vector is zero."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def top_k(vectors: DataFrame, query: list[float], k: int, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """The k best by cosine with a query vector, ties by key. Each task keeps its own k best (TakeOrderedAndProject)."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.withColumn("score", F.round(cosine(F.col(vector), q), 4)).orderBy(F.desc("score"), key).limit(k)


def best_per(hits: DataFrame, by: str, score: str = "score", tie: str = "vec_id") -> DataFrame:
    """Best hit per ``by``: largest score, then smallest ``tie``; a partial aggregate."""
    rest = [c for c in hits.columns if c not in (by, score, tie)]
    best = hits.groupBy(by).agg(F.max(F.struct(F.col(score).alias("s"), (-F.col(tie)).alias("t"), *rest)).alias("b"))
    return best.select(by, F.col("b.s").alias(score), (-F.col("b.t")).alias(tie), *[F.col(f"b.{c}").alias(c) for c in rest])


def section_vectors(sections: DataFrame, quick: int = 1400, size: int = 1200, most: int = 3) -> DataFrame:
    """Texts to embed for (id, heading_citation, name, body): ``#quick`` and up to three ``#tool-n`` a section.

    Sections without a body are left out.  Columns: id, vector_id, kind, text.
    """
    full = sections.where(F.length(F.coalesce("body", F.lit(""))) > 0)
    texts = F.concat(
        F.array(F.struct(F.concat("id", F.lit("#quick")).alias("vector_id"), F.lit("quick").alias("kind"), quick_text(F.col("heading_citation"), F.col("name"), F.col("body"), quick).alias("text"))),
        F.transform(
            tool_chunks(F.col("heading_citation"), F.col("name"), F.col("body"), size, most),
            lambda t, i: F.struct(F.concat(F.col("id"), F.lit("#tool-"), (i + 1).cast("string")).alias("vector_id"), F.lit("tool").alias("kind"), t.alias("text")),
        ),
    )
    return full.select("id", F.explode(texts).alias("v")).select("id", "v.*")


def top_k_distinct(vectors: DataFrame, query: list[float], k: int, by: str, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """The k best groups by their best vector: as many as asked for, unlike deduplication after a cut at k."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.select(by, key, F.round(cosine(F.col(vector), q), 4).alias("score"))
    return best_per(scored, by, tie=key).orderBy(F.desc("score"), key).limit(k)


def merged_hits(searches: list[DataFrame], key: str = "vec_id") -> DataFrame:
    """Hits of several searches, the best score of each."""
    out = searches[0].select(key, "score")
    for s in searches[1:]:
        out = out.unionByName(s.select(key, "score"))
    return out.groupBy(key).agg(F.max("score").alias("score"), F.count("*").alias("n_searches"))


def compact_matches(hits: DataFrame, most: int = 160) -> DataFrame:
    """(id, label, snippet, score) of hits with citation, name and text: what a model is shown."""
    label = F.concat_ws(" - ", F.when(F.col("heading_citation") != "", F.col("heading_citation")), F.when(F.col("name") != "", F.col("name")))
    return hits.select("id", F.when(label == "", F.col("id")).otherwise(label).alias("label"), F.substring("text", 1, most).alias("snippet"), F.round("score", 4).alias("score"))


def first_known(read: DataFrame, matches: DataFrame, fetched: DataFrame, key: str = "id") -> DataFrame:
    """Ids that were read, with the text of an earlier match, else of what was fetched."""
    a, b = matches.select(key, F.col("text").alias("__a")), fetched.select(key, F.col("text").alias("__b"))
    return read.join(a, key, "left").join(b, key, "left").select(key, F.coalesce("__a", "__b").alias("text"))


def citations(hits: DataFrame, k: int, key: str = "vec_id") -> DataFrame:
    """What an answer may cite: the best hits, eight at least."""
    return hits.orderBy(F.desc("score"), key).limit(max(8, k))
