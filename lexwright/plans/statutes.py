"""Citations, amendments, packs and page links over stand-in statutes."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexwright.functions.citations import cgs_references, explode_citations, inline_usc, usc_references
from lexwright.operators import packs, redline
from lexwright.plans import standins as S


def _cited(spark, d, *more):
    """A made-up sentence for each document, followed by more."""
    i = F.col("doc_id").cast("string")
    text = F.concat(F.lit("See 42 U.S.C. "), i, F.lit(" and sections "), i, F.lit("a to "), i, F.lit("c, inclusive, of title 7; paragraph (2) of section 9. Under section "), i, F.lit("-5b and 1-2."))
    return S.table(spark, d, "documents").select("doc_id", F.concat_ws(" ", text, *more).alias("body"))


def usc_citations(spark, d):
    t = _cited(spark, d, "text").withColumn("title", F.lit("5"))
    return explode_citations(t.withColumn("rs", usc_references("body", "title")), "doc_id", F.col("rs")).select("doc_id", "section", "title", "link", "length")


def cgs_citations(spark, d):
    return explode_citations(_cited(spark, d).withColumn("rs", cgs_references("body")), "doc_id", F.col("rs")).select("doc_id", "section", "link", "length")


def linked_bodies(spark, d):
    t = S.table(spark, d, "documents").select("doc_id", F.concat(F.lit("By section "), F.col("doc_id").cast("string"), F.lit(" of title 5 and 18 U.S.C. 7.")).alias("body"))
    return t.select("doc_id", inline_usc("body", F.lit("1")).alias("body"))


def citation_graph(spark, d):
    """Citation edges resolved against the sections that exist; how many are found and missed."""
    refs = usc_citations(spark, d)
    known = S.table(spark, d, "documents").where("doc_id % 2 = 0").select(F.concat(F.lit("/statutes/section/7/"), F.col("doc_id").cast("string"), F.lit("a")).alias("link"))
    return refs.join(known.withColumn("hit", F.lit(1)), "link", "left").groupBy("title").agg(F.count("*").alias("refs"), F.count("hit").alias("resolved"))


def _bill(spark, d):
    i = F.col("doc_id").cast("string")
    t = S.table(spark, d, "documents")
    head = F.concat(F.lit("Section "), i, F.lit("(a) of the Act (7 U.S.C. "), i, F.lit("(a)) is amended "))
    one = F.concat(head, F.lit("by striking “"), i, F.lit(" percent” and inserting “"), (F.col("doc_id") + 1).cast("string"), F.lit(" percent”."))
    two = F.concat(head, F.lit("by inserting after paragraph (1) the following:\n“(2) also.”."))
    three = F.concat(head, F.lit("by striking “absent words”."))
    ins = t.select((F.col("doc_id") % 10).alias("bill_id"), F.posexplode(F.array(one, two, three)).alias("position", "text"))
    sec = t.select(F.concat(F.lit("/section/7/"), i).alias("path"), F.concat(F.lit("**(a)** The rate is "), i, F.lit(" percent.\n\n> **(1)** of "), F.col("source"), F.lit(";\n\n**(b)** End.")).alias("body"))
    return ins, sec


def amended_sections(spark, d):
    ins, sec = _bill(spark, d)
    out = redline.amend_sections(redline.parse_instructions(ins), sec)
    return out.select("bill_id", "section_path", "after", "n_edits", "n_applied", F.array_join(F.transform("issues", lambda x: x["reason"]), ",").alias("reasons"))


def failure_report(spark, d):
    """Edits that did nothing, by reason."""
    ins, sec = _bill(spark, d)
    out = redline.amend_sections(redline.parse_instructions(ins), sec.where(~F.col("path").endswith("3")))
    return out.select(F.explode("issues").alias("i")).groupBy(F.col("i.reason").alias("reason")).agg(F.count("*").alias("n"))


def pack_round_trip(spark, d):
    """Distinct bodies packed by source and read back through their hashes."""
    t = S.table(spark, d, "documents").select(F.col("source").alias("source_id"), F.col("doc_id").alias("position"), "text")
    first = t.groupBy("source_id", "text").agg(F.min("position").alias("position")).withColumnRenamed("text", "content").withColumn("hash", packs.content_hash("content"))
    index = packs.write_packs(first, limit=1_000_000)
    files = index.where("payload IS NOT NULL").select("packfile_key", "payload")
    return packs.read_blobs(index, files).select("source_id", F.md5(F.col("content").cast("binary")).alias("body_md5"))


_I = "CAST(doc_id AS VARCHAR)"
_CITED = f"""SELECT doc_id, {_I} AS section, '42' AS title FROM documents UNION ALL SELECT doc_id, doc_id || 'a', '7' FROM documents UNION ALL SELECT doc_id, doc_id || 'c', '7' FROM documents UNION ALL SELECT doc_id, '9', '5' FROM documents"""
_LINKED = f"SELECT *, '/statutes/section/' || title || '/' || section AS link, CAST(len(section) AS INTEGER) AS length FROM ({_CITED})"
QUERIES = {
    "usc_citations": (usc_citations, f"SELECT doc_id, section, title, link, length FROM ({_LINKED})"),
    "cgs_citations": (cgs_citations, f"SELECT doc_id, section, '/statutes/section/' || section AS link, CAST(len(section) AS INTEGER) AS length FROM (SELECT doc_id, doc_id || '-5b' AS section FROM documents UNION ALL SELECT doc_id, '1-2' FROM documents)"),
    "linked_bodies": (linked_bodies, "SELECT doc_id, 'By section [' || doc_id || '](/statutes/section/5/' || doc_id || ') of title 5 and 18 U.S.C. [7](/statutes/section/18/7).' AS body FROM documents"),
    "citation_graph": (citation_graph, f"SELECT title, count(*) AS refs, count(k) AS resolved FROM ({_LINKED}) LEFT JOIN (SELECT '/statutes/section/7/' || doc_id || 'a' AS link, 1 AS k FROM documents WHERE doc_id % 2 = 0) USING (link) GROUP BY title"),
    "amended_sections": (amended_sections, f"""SELECT CAST(doc_id % 10 AS VARCHAR) AS bill_id, '/section/7/' || doc_id AS section_path,
        '(a) The rate is ' || (doc_id + 1) || ' percent.' || chr(10) || chr(10) || '(1) of ' || source || ';' || chr(10) || chr(10) || '(2) also.' || chr(10) || '(b) End.' AS "after", 3 AS n_edits, 2 AS n_applied, 'text_not_found' AS reasons FROM documents"""),
    "failure_report": (failure_report, "SELECT CASE WHEN doc_id % 10 = 3 THEN 'section_not_found' ELSE 'text_not_found' END AS reason, sum(CASE WHEN doc_id % 10 = 3 THEN 3 ELSE 1 END)::BIGINT AS n FROM documents GROUP BY 1"),
    "pack_round_trip": (pack_round_trip, "SELECT DISTINCT source AS source_id, md5(text) AS body_md5 FROM documents"),
}
