"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from lexwright.llm import classifier, near, sql
from lexwright.llm.common import table
from lexwright.llm.decontam import contained
from lexwright.llm.licenses import scan_licenses
from lexwright.llm.packing import best_fit
from lexwright.llm.pii import pseudonymise
from lexwright.llm.quality import judge_quality
from lexwright.llm.suffixes import dedup_bytes
from lexwright.llm.tokens import read_tokens, write_tokens
from lexwright.llm.urlfilter import judge_urls

#: The rules of the output contract: (verdict, host, path).
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op1_suffix_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_bytes(docs)


def op2_license_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan_licenses(docs).drop("text")


def vocabulary() -> str:
    """Place of the byte-level vocabulary that the contracts name."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3_token_ids(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return read_tokens(write_tokens(docs, vocabulary(), end_id=0))


def op6_best_fit(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return best_fit(docs, vocabulary(), capacity=1024, end_id=2)


def op4_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, URL_RULES).drop("url")


def op5_decontaminate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return contained(docs, table(spark, sf_dir, "benchmark"), short=True)


def op7_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = classifier.fit(docs, classifier.grades_of(table(spark, sf_dir, "labels")), classifier.GRADES)
    return classifier.grade(docs, model).drop("text")


def op8_near_duplicates(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near.classify(docs, near.Settings(percent=85))


def op9_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge_quality(docs)


#: A key for the test tables, known to everyone; a real run sets its own in spark.lexwright.pii.key.
PII_KEY = "lexwright-demo-key"


def pii_key(spark) -> str:
    return spark.conf.get("spark.lexwright.pii.key", PII_KEY)


def op10_pii(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymise(docs, pii_key(spark))


def queries() -> dict:
    return {name: fn for name, fn in globals().items() if name.startswith("op")}


def oracle_sql() -> dict:
    return {"op2_license_scan": sql.license_scan(), "op4_url_filter": sql.urls(URL_RULES), "op5_decontaminate": sql.containment(), "op10_pii": sql.pseudonyms(PII_KEY)}
