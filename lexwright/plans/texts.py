"""Text functions, designators and cross references over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexwright.functions import designators as D
from lexwright.functions import links as L
from lexwright.functions import text as T
from lexwright.operators import vectors
from lexwright.plans import standins as S

WS = r"[\s\v\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def _collapse(x: str) -> str:
    return _strip(f"regexp_replace({x}, '{WS}+', ' ', 'g')")


def _cut(x: str, n: int) -> str:
    return f"CASE WHEN len({x}) <= {n} THEN {x} ELSE {_strip(f'substr({x}, 1, {n})')} || '...' END"


def _docs(spark, d):
    return S.table(spark, d, "documents").select("doc_id", "text", F.concat(F.lit("7 USC "), F.col("doc_id").cast("string")).alias("citation"), F.when(F.col("doc_id") % 3 == 0, None).otherwise(F.initcap("source")).alias("name"))


_DOCS = "(SELECT doc_id, text, '7 USC ' || doc_id AS citation, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE upper(source[1]) || lower(source[2:]) END AS name FROM documents)"


def shaping(spark, d):
    t = S.table(spark, d, "documents")
    c = T.collapse_whitespace(F.col("text"))
    return t.select(
        "doc_id", T.truncate_chars(c, 260).alias("snippet"), T.limit_tokens(F.col("text"), 25).alias("limited"), T.capitalize_first(F.col("source")).alias("source_name"),
        T.capitalize_words(F.concat_ws(" ", "lang", F.upper("source"), F.lit("oF tHe"))).alias("title_case"), T.pluralize(F.col("doc_id") % 3, "section").alias("unit"), T.congress_years((F.col("doc_id") % 120).cast("int")).alias("years"),
    )


def quick_texts(spark, d):
    return _docs(spark, d).select("doc_id", T.quick_text(F.col("citation"), F.col("name"), F.col("text")).alias("quick"))


def tool_chunks(spark, d):
    """Up to three chunks a section, with index and count."""
    ch = _docs(spark, d).select("doc_id", T.tool_chunks(F.col("citation"), F.col("name"), F.col("text")).alias("cs"))
    return ch.select("doc_id", F.size("cs").alias("n_chunks"), F.posexplode("cs").alias("chunk", "body"))


def seed_chunks(spark, d):
    """Unlimited chunks of 2048; only their number and sizes."""
    ch = S.table(spark, d, "documents").select("doc_id", T.chunks(T.collapse_whitespace(F.col("text")), 2048).alias("cs"))
    return ch.select("doc_id", F.size("cs").alias("n_chunks"), F.aggregate("cs", F.lit(0), lambda a, x: a + F.length(x)).alias("chars"))


def planned_vectors(spark, d):
    s = _docs(spark, d).select(F.col("doc_id").cast("string").alias("id"), F.col("citation").alias("heading_citation"), "name", F.col("text").alias("body"))
    return vectors.section_vectors(s).groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


def block_texts(spark, d):
    """Turns of a conversation as blocks: roles are labels for all but the assistant."""
    t = S.table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.when(F.col("role") != "assistant", F.col("role")).alias("label"), F.col("text").alias("content")))).alias("blocks"))
    return t.select("conv_id", T.block_text(F.col("blocks")).alias("body"))


def page_text(spark, d):
    t = S.table(spark, d, "pages")
    return t.select("page_id", F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1).alias("title"), F.size(F.regexp_extract_all("html", F.lit(r'(?i)href="([^"]*)"'), F.lit(1))).alias("n_links"), F.length(T.normalize_html_text(T.strip_tags(F.col("html")))).alias("visible_chars"))


def page_links(spark, d):
    t = S.table(spark, d, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r'(?i)href="([^"]*)"'), F.lit(1))).alias("position", "href"))
    return t


def _marks(spark, d):
    """Designators of every shape, made from order keys."""
    k = F.col("o_orderkey")
    letters = F.element_at(F.array(*[F.lit(x) for x in ("", "A", "b", "AA", "z", "Bc", "ZZZZZZZ")]), (k % 7 + 1).cast("int"))
    return S.table(spark, d, "orders").select(k, F.concat(F.when(k % 4 == 0, "00").otherwise(""), (k % 30000).cast("string"), letters).alias("mark"), F.concat((k % 90).cast("string"), F.when(k % 3 == 0, "A").otherwise(""), F.lit(":"), (k % 17).cast("string"), F.when(k % 5 == 0, "-b").otherwise("")).alias("ref"), (k % 3999 + 1).cast("int").alias("n"))


_MARKS = """(SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN '00' ELSE '' END || (o_orderkey % 30000) || ['', 'A', 'b', 'AA', 'z', 'Bc', 'ZZZZZZZ'][o_orderkey % 7 + 1] AS mark,
  (o_orderkey % 90) || CASE WHEN o_orderkey % 3 = 0 THEN 'A' ELSE '' END || ':' || (o_orderkey % 17) || CASE WHEN o_orderkey % 5 = 0 THEN '-b' ELSE '' END AS ref, CAST(o_orderkey % 3999 + 1 AS INTEGER) AS n FROM orders)"""


def designators(spark, d):
    m = F.col("mark")
    return _marks(spark, d).select(
        "o_orderkey", D.sort_order(m).alias("sort_order"), D.strip_zeros(m).alias("plain"), D.padded(m, 4).alias("padded"), D.display(m).alias("display"), D.trim_zeros_for_display(m).alias("trimmed"),
        D.normalize_compact(F.concat(F.lit(" "), m, F.lit(" x "))).alias("compact"), D.slug(F.concat(m, F.lit(" & Co.")), True).alias("dotted_slug"), D.slug(F.concat(m, F.lit(" & Co."))).alias("slug"), D.usc_title_key(m).alias("title_key"),
    )


def designator_order(spark, d):
    """Rank of distinct references by their token key."""
    t = _marks(spark, d).select("ref").distinct()
    from pyspark.sql import Window

    # the number of distinct references is bounded by their pattern
    return t.select("ref", F.array_join(D.token_key(F.col("ref")), "|").alias("sort_key"), F.row_number().over(Window.orderBy(D.token_key(F.col("ref")), "ref")).alias("place"))


def numerals(spark, d):
    r = D.int_to_roman(F.col("n"))
    return _marks(spark, d).select("o_orderkey", D.roman_value(r).alias("back"), (D.roman_value(r) == F.col("n")).alias("same"), D.alpha_value(F.regexp_extract("mark", "[A-Za-z]*$", 0)).alias("alpha"), D.small_roman(r).alias("small"))


def labels(spark, d):
    k = F.col("o_orderkey").cast("string")
    t = S.table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("Secs. "), k, F.lit("-1 to "), k, F.lit("-9. Reserved."))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("Sec. "), k, F.lit("a. Of things."))).otherwise(F.concat(F.lit("Part "), k)).alias("label"))
    return t.select("o_orderkey", D.parse_label(F.col("label")).alias("p")).select("o_orderkey", "p.*")


def _statutes(spark, d):
    i = F.col("doc_id").cast("string")
    text = F.concat(F.lit("See chapter "), i, F.lit("A, section 7 and section "), i, F.lit("b of chapter 12. RSA "), i, F.lit("-A:3-b or rsa 5:6; Section 44c, § 9. "), "text")
    return S.table(spark, d, "documents").select("doc_id", text.alias("body"))


_STATUTES = "(SELECT doc_id, 'See chapter ' || doc_id || 'A, section 7 and section ' || doc_id || 'b of chapter 12. RSA ' || doc_id || '-A:3-b or rsa 5:6; Section 44c, § 9. ' || text AS body FROM documents)"


def chapter_references(spark, d):
    return L.explode_references(_statutes(spark, d), "doc_id", "body")


def inline_links(spark, d):
    return _statutes(spark, d).select("doc_id", L.inline_rsa(F.col("body"), F.lit("I-A")).alias("rsa"), L.inline_sections(F.col("body"), "10A", "5").alias("sections"))


def hrefs(spark, d):
    k = F.col("o_orderkey").cast("string")
    h = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("/us/usc/t42/s"), k, F.lit("/a/1"))).when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("/us/usc/t7/ch3/s"), k)).when(F.col("o_orderkey") % 4 == 2, F.concat(F.lit("/us/pl/"), k)).otherwise(F.concat(F.lit("/us/usc/t"), k))
    return S.table(spark, d, "orders").select("o_orderkey", L.usc_link(h).alias("link"), L.uslm_path(h).alias("path"))


_PLAIN = "CASE WHEN regexp_extract(mark, '^0*([0-9]+)([A-Za-z]*)$', 1) <> '' THEN regexp_extract(mark, '^0*([0-9]+)([A-Za-z]*)$', 1) END"
_TAIL = "regexp_extract(mark, '^0*([0-9]+)([A-Za-z]*)$', 2)"
_BASE27 = "list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(list_filter(string_split(lower(regexp_extract(mark, '[A-Za-z]*$')), ''), lambda x: x <> ''), lambda x: CAST(ord(x) - 96 AS BIGINT))), lambda a, x: least(a * 27 + x, 2147483647))"
_BASE26 = _BASE27.replace("least(a * 27 + x, 2147483647)", "a * 26 + x")
_PARTS = "list_transform(list_filter(regexp_split_to_array(lower(ref), '[-:]'), lambda x: trim(x) <> ''), lambda x: CASE WHEN regexp_full_match(x, '[0-9]{1,18}') THEN '0' || lpad(x, 19, '0') ELSE '1' || x END)"


def _slug(x: str, dot: str) -> str:
    out = f"regexp_replace(regexp_replace(lower(trim({x})), '[^a-z0-9{dot}\\-]+', '-', 'g'), '^-+|-+$', '', 'g')"
    return f"replace({out}, '--', '-')" if dot else out


_HEAD = "concat_ws('{}', nullif(citation, ''), nullif(name, ''))"
_QUICK = _collapse("CASE WHEN " + _HEAD.format(" - ") + " <> '' THEN " + _HEAD.format(" - ") + " || chr(10) || chr(10) || text ELSE text END")
_TOOL = _collapse("CASE WHEN " + _HEAD.format("\n") + " <> '' THEN " + _HEAD.format("\n") + " || chr(10) || chr(10) || text ELSE text END")


def _chunks(n: str, size: int) -> str:
    return f"list_filter(list_transform(range({n}), lambda i: {_strip(f'substr(c, i * {size} + 1, {size})')}), lambda x: x <> '')"


_TOOLS = f"(SELECT doc_id, {_chunks('least(3, CAST(ceil(len(c) / 1200) AS BIGINT))', 1200)} AS cs FROM (SELECT doc_id, {_TOOL} AS c FROM {_DOCS}))"
QUERIES = {
    "text_shaping": (shaping, f"""SELECT doc_id, {_cut('c', 260)} AS snippet, array_to_string(list_filter(regexp_split_to_array(text, '{WS}+'), lambda x: x <> '')[1:25], ' ') AS limited,
        upper(source[1]) || source[2:] AS source_name, array_to_string(list_transform(string_split(lang || ' ' || upper(source) || ' oF tHe', ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS title_case,
        CASE WHEN doc_id % 3 = 1 THEN 'section' ELSE 'sections' END AS unit, (1787 + 2 * (doc_id % 120)) || '–' || (1788 + 2 * (doc_id % 120)) AS years FROM (SELECT *, {_collapse('text')} AS c FROM documents)"""),
    "quick_texts": (quick_texts, f"SELECT doc_id, {_cut('c', 1400)} AS quick FROM (SELECT doc_id, {_QUICK} AS c FROM {_DOCS})"),
    "tool_chunks": (tool_chunks, f"SELECT doc_id, CAST(len(cs) AS INTEGER) AS n_chunks, CAST(generate_subscripts(cs, 1) - 1 AS INTEGER) AS chunk, unnest(cs) AS body FROM {_TOOLS}"),
    "seed_chunks": (seed_chunks, f"SELECT doc_id, CAST(len(cs) AS INTEGER) AS n_chunks, CAST(coalesce(list_sum(list_transform(cs, lambda x: len(x))), 0) AS INTEGER) AS chars FROM (SELECT doc_id, {_chunks('CAST(ceil(len(c) / 2048) AS BIGINT)', 2048)} AS cs FROM (SELECT doc_id, {_collapse('text')} AS c FROM documents))"),
    "planned_vectors": (planned_vectors, f"""SELECT 'quick' AS kind, count(*) AS n, CAST(sum(len({_cut('c', 1400)})) AS BIGINT) AS chars FROM (SELECT {_QUICK} AS c FROM {_DOCS} WHERE len(text) > 0)
        UNION ALL SELECT 'tool', count(*), CAST(sum(len(x)) AS BIGINT) FROM (SELECT unnest(cs) AS x FROM {_TOOLS} JOIN documents USING (doc_id) WHERE len(text) > 0)"""),
    "block_texts": (block_texts, """SELECT conv_id, coalesce(string_agg(CASE WHEN role <> 'assistant' AND role <> '' THEN role || ': ' || text ELSE text END, chr(10) || chr(10) ORDER BY turn) FILTER (coalesce(text, '') <> ''), '') AS body FROM conversations GROUP BY conv_id"""),
    "page_text": (page_text, f"""SELECT page_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title, CAST(len(regexp_extract_all(html, '(?i)href="([^"]*)"', 1)) AS INTEGER) AS n_links,
        CAST(len({_collapse("replace(replace(replace(replace(replace(replace(regexp_replace(html, '(?is)<[^>]+>', ' ', 'g'), '&nbsp;', ' '), chr(160), ' '), '&amp;', '&'), '&#150;', '-'), '&mdash;', '-'), '&ndash;', '-')")}) AS INTEGER) AS visible_chars FROM pages"""),
    "page_links": (page_links, """SELECT page_id, CAST(generate_subscripts(h, 1) - 1 AS INTEGER) AS position, unnest(h) AS href FROM (SELECT page_id, regexp_extract_all(html, '(?i)href="([^"]*)"', 1) AS h FROM pages)"""),
    "designators": (designators, f"""SELECT o_orderkey, CAST(least(CAST(regexp_extract(mark, '^[0-9]+') AS BIGINT) * 100000, 2147483647) + {_BASE27} AS BIGINT) AS s0, {_PLAIN} || {_TAIL} AS plain,
        lpad({_PLAIN}, CAST(greatest(4, len({_PLAIN})) AS INTEGER), '0') || lower({_TAIL}) AS padded, {_PLAIN} || lower({_TAIL}) AS display, CASE WHEN ltrim(mark, '0') = '' THEN '0' ELSE ltrim(mark, '0') END AS trimmed,
        upper(replace(mark || ' x', ' ', '')) AS compact, {_slug("mark || ' & Co.'", '.')} AS dotted_slug, {_slug("mark || ' & Co.'", '')} AS slug,
        CASE WHEN regexp_full_match(mark, '[0-9]+') THEN CAST(mark AS DOUBLE) ELSE CAST(regexp_extract(mark, '^[0-9]+') AS DOUBLE) + (ord(lower(regexp_extract(mark, '[A-Za-z]')[1])) - 96) / 100.0 END AS title_key FROM {_MARKS}"""),
    "designator_order": (designator_order, f"SELECT ref, array_to_string({_PARTS}, '|') AS sort_key, CAST(row_number() OVER (ORDER BY {_PARTS}, ref) AS INTEGER) AS place FROM (SELECT DISTINCT ref FROM {_MARKS})"),
    "numerals": (numerals, f"""SELECT o_orderkey, n AS back, true AS same, CASE WHEN regexp_full_match(regexp_extract(mark, '[A-Za-z]*$'), '[A-Za-z]{{1,6}}') THEN CAST({_BASE26} AS INTEGER) END AS alpha, CASE WHEN n <= 5 THEN n ELSE 2147483647 END AS small FROM {_MARKS}"""),
    "labels": (labels, """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN k || '-1 to ' || k || '-9' WHEN 1 THEN k || 'a' END AS number, CASE o_orderkey % 3 WHEN 0 THEN 'Reserved.' WHEN 1 THEN 'Of things.' END AS title,
        CASE o_orderkey % 3 WHEN 0 THEN k || '-1' WHEN 1 THEN k || 'a' END AS range_start, CASE o_orderkey % 3 WHEN 0 THEN k || '-9' WHEN 1 THEN k || 'a' END AS range_end FROM (SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS k FROM orders)"""),
    "chapter_references": (chapter_references, f"""SELECT doc_id, CAST(i - 1 AS INTEGER) AS ordinal, upper(c) AS chapter, upper(s) AS section, m AS matched, '/statutes/chapter/' || lower(c) || '/section/' || lower(s) AS link FROM (
        SELECT doc_id, unnest(a1 || b1) AS m, unnest(a2 || b3) AS c, unnest(a3 || b2) AS s, generate_subscripts(a1 || b1, 1) AS i FROM (SELECT doc_id, """
        + ", ".join(f"regexp_extract_all(body, '{p}', {g}) AS {n}{g + 1}" for n, p in (("a", L.CHAPTER_SECTION), ("b", L.SECTION_OF_CHAPTER)) for g in (0, 1, 2)) + f" FROM {_STATUTES}))"),
    "inline_links": (inline_links, f"""SELECT doc_id, replace(replace(body, 'RSA ' || doc_id || '-A:3-b', 'RSA [' || doc_id || '-A:3-b](/title/i-a/chapter/' || doc_id || '-a/section/' || doc_id || '-a-3-b)'), 'rsa 5:6', 'rsa [5:6](/title/i-a/chapter/5/section/5-6)') AS rsa,
        regexp_replace(replace(body, 'Section 44c', 'Section [44c](/statutes/section/10a/5/44c)'), '(?i)(section\\s+|§§?\\s*)([0-9]+[a-z]?)', '\\1[\\2](/statutes/section/10a/5/\\2)', 'g') AS sections FROM {_STATUTES}"""),
    "hrefs": (hrefs, """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '/statutes/section/42/' || o_orderkey WHEN 1 THEN '/statutes/section/7/' || o_orderkey END AS link, CASE o_orderkey % 4 WHEN 0 THEN '/usc/title-42/section-' || o_orderkey END AS path FROM orders"""),
}
QUERIES["designators"] = (designators, f"SELECT * REPLACE (s0 AS s0) FROM ({QUERIES['designators'][1]})".replace("SELECT * REPLACE (s0 AS s0)", "SELECT * EXCLUDE (s0), CAST(least(s0, 2147483647) AS INTEGER) AS sort_order"))
