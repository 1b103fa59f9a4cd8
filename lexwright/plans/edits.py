"""Grammar, moves, what is shown of an edit, fallback searches, counts, and the model's glue."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexwright.functions import grammar, patches
from lexwright.functions import text as texts
from lexwright.functions.citations import inline_chapters
from lexwright.operators import packs, redline, vectors
from lexwright.plans import standins as S


def _docs(spark, d):
    # the SQL's [^A-Za-z0-9]+ (Alnum is ASCII alone); Java takes six times as long over a negated list of ranges
    words = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\P{Alnum}+", " "))
    return S.table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("i"), "source", "lang", words.alias("words"))


_D = "(SELECT doc_id, CAST(doc_id AS VARCHAR) AS i, source, lang, trim(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9]+', ' ', 'g')) AS words FROM documents)"

PARSE = "doc_id long, start int, length int, places int, operations string, ids string"


def grammar_parses(spark, d):
    """An amendment sentence behind the whole text of each document: where its longest parse stands, and what it says."""
    x = _docs(spark, d)
    sentence = F.concat(F.lit("Section "), "i", F.lit("(a)(2) of title 7, United States Code, is amended by striking “"), "words", F.lit("” each place it appears and inserting “y”, by inserting “z” after “w”, and by moving paragraph (3) to appear before paragraph ("), "i", F.lit(")."))

    def parse(batches):
        for b in batches:
            rows = []
            for k, t in zip(b["doc_id"], b["text"]):
                tree = grammar.longest(grammar.AMENDMENT, "instruction", t, grammar.starts_of(t))
                if tree:
                    edits = tree.all("edit")
                    rows.append((k, tree.start, tree.end - tree.start, len(tree.all("place")), ",".join(c.rule for e in edits for c in e.children), ",".join(t[x.start : x.end] for x in tree.all("id"))))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PARSE.split(", ")])

    return x.select("doc_id", F.concat(F.lit("So "), "words", F.lit(". "), sentence).alias("text")).mapInPandas(parse, PARSE)


def _sections(spark, d):
    x = _docs(spark, d)
    # a text without words (null, empty, signs alone) leaves no blank behind "one"
    body = F.concat(F.lit("**(a)** The rate is "), "i", F.lit(".\n\n> "), F.trim(F.concat(F.lit("**(1)** one "), "words")), F.lit(";\n\n> **(2)** two;\n\n> **(3)** three.\n\n**(b)** End."))
    return x, x.select(F.concat(F.lit("/section/7/"), "i").alias("path"), body.alias("body"))


def _amended(spark, d, clause):
    x, sections = _sections(spark, d)
    text = F.concat(F.lit("Section "), "i", F.lit("(a) of the Act (7 U.S.C. "), "i", F.lit("(a)) is amended "), clause)
    bill = x.select((F.col("doc_id") % 10).alias("bill_id"), F.lit(0).alias("position"), text.alias("text"))
    return redline.amend_sections(redline.parse_instructions(bill), sections)


def moved_paragraphs(spark, d):
    return _amended(spark, d, F.lit("by moving paragraph (3) to appear before paragraph (1).")).select("section_path", "after", "n_applied")


def redesignated(spark, d):
    """Two redesignations that would meet if the second saw the first."""
    return _amended(spark, d, F.lit("by redesignating paragraph (2) as paragraph (3), and by redesignating paragraph (3) as paragraph (4).")).select("section_path", "after", "n_edits")


def shown_edits(spark, d):
    """What was struck and inserted, and what stayed."""
    out = _amended(spark, d, F.concat(F.lit("by striking “rate is "), "i", F.lit("” and inserting “sum”.")))
    part = lambda kind: F.array_join(F.transform(F.filter("shown", lambda p: p["kind"] == kind), lambda p: p["text"]), "|")
    return out.select("section_path", part("struck").alias("struck"), part("inserted").alias("inserted"), F.md5(part("same").cast("binary")).alias("same_md5"))


def instructions_per_section(spark, d):
    """Instructions and their edits by section path."""
    x, _ = _sections(spark, d)
    text = F.concat(F.lit("Section "), (F.col("doc_id") % 50).cast("string"), F.lit(" of title 5, United States Code, is amended by striking “x” and inserting “y”, and by striking “z”."))
    p = redline.parse_instructions(x.select((F.col("doc_id") % 10).alias("bill_id"), F.col("doc_id").cast("int").alias("position"), text.alias("text")))
    n = F.size(F.from_json("edits", "array<string>"))
    return p.groupBy("section_path").agg(F.count("*").alias("instructions"), F.sum(n).alias("edits"))


def patches_per_operation(spark, d):
    p = S.table(spark, d, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("operation"))
    return p.groupBy("l_orderkey", "operation").agg(F.count("*").alias("patches"))


def first_attempts(spark, d):
    """Orders as issues, each with the first line that was shipped as its attempt; those without one stay."""
    o = S.table(spark, d, "orders").select(F.col("o_orderkey").alias("issue"))
    # of lines with one date and number the one that stands first in the table; as in SQL, nulls come last
    place = F.struct(F.col("l_shipdate").isNull(), "l_shipdate", F.col("l_linenumber").isNull(), "l_linenumber", "_metadata.file_name", "_metadata.row_index")
    a = S.table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("issue")).agg(F.min_by("l_partkey", place).alias("attempt"))
    return o.join(a, "issue", "left")


def labelled_codes(spark, d):
    """Section labels with the first classification that a table has for them."""
    c = S.table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("label")).agg(F.min_by(F.struct("l_suppkey", "l_orderkey"), F.struct("l_orderkey", "l_linenumber")).alias("c"))
    return S.table(spark, d, "part").select(F.col("p_partkey").alias("label")).join(c, "label", "left").select("label", F.col("c.l_suppkey").alias("title"), F.col("c.l_orderkey").alias("section"))


def default_codes(spark, d):
    """The title that last stood above a paragraph gives its default code; paragraphs are turns of conversations."""
    t = S.table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, (F.col("conv_id") + F.col("turn")) % 25).alias("bill_title"))
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    nation = S.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("bill_title"), F.col("n_name").alias("code"))
    # nation has a fixed number of rows
    return t.withColumn("bill_title", F.last("bill_title", True).over(w)).join(F.broadcast(nation), "bill_title", "left").select("conv_id", "turn", "code")


def latency_percentiles(spark, d):
    """Least, median, 95th percentile, largest and mean of a measure, by kind."""
    e = S.table(spark, d, "events").groupBy("event_type")
    return e.agg(F.min("value").alias("least"), F.round(F.percentile("value", F.lit(0.5)), 6).alias("p50"), F.round(F.percentile("value", F.lit(0.95)), 6).alias("p95"), F.max("value").alias("most"), F.round(F.avg("value"), 6).alias("mean"))


def agent_actions(spark, d):
    x = _docs(spark, d)
    k = F.col("doc_id") % 4
    raw = (
        F.when(k == 0, F.concat(F.lit('I say {"type": "final", "answer": "'), "words", F.lit('"} so.')))
        .when(k == 1, F.concat(F.lit('{"type": "tool", "tool": "search", "args": {"q": "'), "source", F.lit('"}}')))
        .when(k == 2, F.concat(F.lit('{"type": "other", "answer": "'), "lang", F.lit('"}'))).otherwise(F.col("words"))
    )
    return x.select("doc_id", texts.agent_action(raw).alias("a")).select("doc_id", "a.type", "a.answer", "a.tool", "a.args")


def volume_rows(spark, d):
    o = S.table(spark, d, "orders")
    packed = F.concat_ws("|", F.concat(F.lit("PKG-"), "o_orderkey"), (F.col("o_orderkey") % 130).cast("string"), F.when(F.col("o_orderkey") % 7 == 0, "x").otherwise((F.col("o_orderkey") % 119).cast("string")), F.when(F.col("o_orderkey") % 3 == 0, "").otherwise("2"), F.lit("2020-01-01"), F.when(F.col("o_orderkey") % 11 > 0, "2021"))
    return o.select("o_orderkey", texts.volume_metadata(packed).alias("m")).select("o_orderkey", "m.*")


def citable_hits(spark, d):
    q = [1.0 if k % 2 else -0.5 for k in range(len(S.table(spark, d, "embeddings").first().embedding))]
    e = S.table(spark, d, "embeddings")
    scored = e.select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.array(*[F.lit(x) for x in q])), 4).alias("score"))
    return vectors.citations(scored, 5)


def listed_objects(spark, d):
    o = S.table(spark, d, "customer").select(F.concat(F.lit("packs/"), F.lower("c_mktsegment"), F.lit("/"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("key"), F.length("c_name").alias("size"))
    return packs.list_objects(o, "packs/building/", "packs/building/000000100", 20)


def blob_values(spark, d):
    """Bodies stored as JSON, packed, read back through their hashes and decoded."""
    t = S.table(spark, d, "documents").select("doc_id", F.col("source").alias("source_id"), F.col("doc_id").alias("position"), F.to_json(F.struct("doc_id", "text", "lang")).alias("content")).withColumn("hash", packs.content_hash("content"))
    index = packs.write_packs(t, limit=1_000_000, shard_bytes=300_000)
    back = packs.read_blobs(index, index.where("payload IS NOT NULL").select("packfile_key", "payload"))
    return packs.blob_json(back, "doc_id long, text string, lang string").select("source_id", "value.doc_id", F.md5(F.col("value.text").cast("binary")).alias("text_md5"), "value.lang")


@F.pandas_udf(T.StructType([T.StructField("exact", T.StringType()), T.StructField("open", T.StringType()), T.StructField("last_mark", T.IntegerType()), T.StructField("translated", T.StringType()), T.StructField("ranges", T.StringType())]))
def _searched(text: pd.Series, i: pd.Series) -> pd.DataFrame:
    out = []
    for t, k in zip(text, i):
        at = lambda x: None if x is None else f"{x[0]}-{x[1]}"
        codes = lambda s, k=k: ("7", f"{s}00") if int(s) % 2 == 0 else None
        first, other = t.index("under"), "under section 0 of it"
        found = patches.find_loosely(t, other)
        out.append((at(patches.find_loosely(t, "UNDER SECTION " + k)), t[found[0] : found[1]] if found and found[0] >= first else None, patches.mark_at_end(t, "."), patches.translate(t[first:], codes), ";".join(at(r) or "-" for r in patches.inserted_ranges("ab " + k + " ab", ["ab", "ab", "ab", k]))))
    return pd.DataFrame(out, columns=["exact", "open", "last_mark", "translated", "ranges"])


def fallback_searches(spark, d):
    """Texts found in any case, with the section number left open, by their last mark; references translated; ranges of insertions."""
    t = _docs(spark, d).withColumn("body", F.concat(F.lit("Q "), F.upper("words"), F.lit(" and under section "), "i", F.lit(" of it.” ")))
    return t.select("doc_id", _searched("body", "i").alias("f")).select("doc_id", "f.*")


def chapter_links(spark, d):
    return _docs(spark, d).select("doc_id", inline_chapters(F.concat(F.lit("Under section "), "i", F.lit("-5b-1 and no other, "), "lang")).alias("body"))


_N = "chr(10)"
_SENT = "'Section ' || i || '(a)(2) of title 7, United States Code, is amended by striking “' || words || '” each place it appears and inserting “y”, by inserting “z” after “w”, and by moving paragraph (3) to appear before paragraph (' || i || ').'"
_LINES = "'(1) one ' || words || ';'"
QUERIES = {
    "grammar_parses": (grammar_parses, f"SELECT doc_id, CAST(length('So ' || words || '. ') AS INTEGER) AS start, CAST(length({_SENT}) AS INTEGER) AS length, 1 AS places, 'strike,insert,move' AS operations, '(a),(2),(3),(' || i || ')' AS ids FROM {_D}"),
    "moved_paragraphs": (moved_paragraphs, f"SELECT '/section/7/' || i AS section_path, '(a) The rate is ' || i || '.' || {_N} || {_N} || '(3) three.' || {_N} || {_N} || trim('(1) one ' || words) || ';' || {_N} || {_N} || '(2) two;' || {_N} || {_N} || '(b) End.' AS \"after\", 1 AS n_applied FROM {_D}"),
    "redesignated": (redesignated, f"SELECT '/section/7/' || i AS section_path, '(a) The rate is ' || i || '.' || {_N} || {_N} || trim('(1) one ' || words) || ';' || {_N} || {_N} || '(3) two;' || {_N} || {_N} || '(4) three.' || {_N} || {_N} || '(b) End.' AS \"after\", 1 AS n_edits FROM {_D}"),
    "shown_edits": (shown_edits, f"""SELECT '/section/7/' || i AS section_path, 'rate is ' || i AS struck, 'sum' AS inserted,
        md5('(a) The |.' || {_N} || {_N} || trim('(1) one ' || words) || ';' || {_N} || {_N} || '(2) two;' || {_N} || {_N} || '(3) three.' || {_N} || {_N} || '(b) End.') AS same_md5 FROM {_D}"""),
    "instructions_per_section": (instructions_per_section, "SELECT '/section/5/' || (doc_id % 50) AS section_path, count(*) AS instructions, count(*) * 2 AS edits FROM documents GROUP BY 1"),
    "patches_per_operation": (patches_per_operation, "SELECT l_orderkey, l_returnflag AS operation, count(*) AS patches FROM lineitem GROUP BY 1, 2"),
    "first_attempts": (first_attempts, "SELECT o_orderkey AS issue, (SELECT l_partkey FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R' ORDER BY l_shipdate, l_linenumber LIMIT 1) AS attempt FROM orders"),
    "labelled_codes": (labelled_codes, """SELECT p_partkey AS label, l_suppkey AS title, l_orderkey AS section FROM part LEFT JOIN
        (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) = 1) ON l_partkey = p_partkey"""),
    "default_codes": (default_codes, """SELECT conv_id, turn, n_name AS code FROM (SELECT conv_id, turn, last_value(CASE WHEN turn % 3 = 0 THEN (conv_id + turn) % 25 END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations)
        LEFT JOIN nation ON n_nationkey = k"""),
    "latency_percentiles": (latency_percentiles, "SELECT event_type, min(value) AS least, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, max(value) AS most, round(avg(value), 6) AS mean FROM events GROUP BY 1"),
    "agent_actions": (agent_actions, f"""SELECT doc_id, ['final', 'tool'][doc_id % 4 + 1] AS type, CASE doc_id % 4 WHEN 0 THEN words END AS answer, CASE doc_id % 4 WHEN 1 THEN 'search' END AS tool, CASE doc_id % 4 WHEN 1 THEN '{{"q":"' || source || '"}}' END AS args FROM {_D}"""),
    "volume_rows": (volume_rows, """SELECT o_orderkey, CASE WHEN ok THEN 'PKG-' || o_orderkey END AS package_id, CASE WHEN ok THEN CAST(o_orderkey % 130 AS INTEGER) END AS volume, CASE WHEN ok THEN CAST(CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE o_orderkey % 119 END AS INTEGER) END AS congress,
        CASE WHEN ok THEN CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 2 END END AS session, CASE WHEN ok THEN '2020-01-01' END AS date_issued, CASE WHEN ok THEN '2021' END AS last_modified FROM (SELECT o_orderkey, o_orderkey % 11 > 0 AS ok FROM orders)"""),
    "citable_hits": (citable_hits, """WITH q AS (SELECT list_transform(range(len(embedding)), lambda k: CASE WHEN k % 2 = 1 THEN 1.0 ELSE -0.5 END)::DOUBLE[] AS v FROM embeddings LIMIT 1)
        SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), v), 4) AS score FROM embeddings, q ORDER BY score DESC, vec_id LIMIT 8"""),
    "listed_objects": (listed_objects, "SELECT * FROM (SELECT 'packs/' || lower(c_mktsegment) || '/' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS key, CAST(length(c_name) AS INTEGER) AS size FROM customer) WHERE starts_with(key, 'packs/building/') AND key > 'packs/building/000000100' ORDER BY key LIMIT 20"),
    "blob_values": (blob_values, "SELECT source AS source_id, doc_id, md5(text) AS text_md5, lang FROM documents"),
    "fallback_searches": (fallback_searches, f"""SELECT doc_id, CAST(p0 AS VARCHAR) || '-' || (p0 + length('under section ' || i)) AS exact, 'under section ' || i || ' of it' AS "open", CAST(p0 + length('under section ' || i || ' of it') AS INTEGER) AS last_mark,
        CASE WHEN doc_id % 2 = 0 THEN 'under section ' || i || '00 of title 7 of it.” ' ELSE 'under section ' || i || ' of it.” ' END AS translated, '0-2;' || (4 + length(i)) || '-' || (6 + length(i)) || ';-;3-' || (3 + length(i)) AS ranges FROM (SELECT *, length('Q ' || words || ' and ') AS p0 FROM {_D})"""),
    "chapter_links": (chapter_links, f"SELECT doc_id, 'Under section [' || i || '-5b-1](/title/' || i || '/chapter/' || i || '-5b/section/' || i || '-5b-1) and no other, ' || lang AS body FROM {_D}"),
}
