"""Corpus pipeline: quality, near duplicates, benchmark passages, personal data, packing.

Each stage is (name, function); a function takes (spark, docs, sf_dir), works on all rows
that its predecessor kept, and returns a DataFrame.  run() writes each result as Parquet
in the shared scratch folder and hands the reread table to the next stage.  All stages but
the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexwright.llm import classifier, near
from lexwright.llm.common import free_name, table, written
from lexwright.llm.decontam import decontaminate
from lexwright.llm.packing import best_fit
from lexwright.llm.pii import pseudonymise
from lexwright.llm.queries import pii_key, vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fit on the labels, grade every text, and drop what is likelier below the top grade."""
    model = classifier.fit(docs, classifier.grades_of(table(spark, sf_dir, "labels")), classifier.GRADES)
    return classifier.accepted(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of each group of similar texts (five words, 0.8).

    Rows without a doc_id all stay; of rows with one doc_id in common that are kept, all stay.
    """
    gone = near.classify(docs, near.Settings(percent=80)).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts that contain a benchmark item (five words, 0.8 of its shingles; shorter items as a whole), row by row."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), short=True)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in the texts; n_chars follows where a text changed."""
    before = free_name("before", docs.columns)
    out = pseudonymise(docs.withColumn(before, F.col("text")), pii_key(spark), prefix=None)
    if "n_chars" in docs.columns:
        changed = ~F.col(before).eqNullSafe(F.col("text"))
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.drop(before)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the texts into sequences of at most 1024 tokens."""
    # the stages before leave executors little memory, so workers remember fewer words than by default
    return best_fit(docs, vocabulary(), capacity=1024, end_id=2, remember=(200_000, 250_000))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("benchmark_passages", benchmark_passages), ("personal_data", personal_data), ("packing", packing)]

#: A fitted classifier and MinHash classes can't be expressed in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
