"""Readers of statute files over pages that are made of the test tables, whole texts included."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexwright.operators import pages as geometry
from lexwright.operators import redline
from lexwright.plans import standins as S
from lexwright.sources import discovery, html, uslm


def _docs(spark, d):
    """doc_id as i, source, lang, and the whole text as plain words."""
    words = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z0-9]+", " "))
    return S.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("i"), "source", "lang", words.alias("words"))


_D = "(SELECT CAST(doc_id AS VARCHAR) AS i, source, lang, trim(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9]+', ' ', 'g')) AS words FROM documents)"


def _made(template: str):
    """A column from a template with {i}, {source}, {lang} and {words}."""
    parts, rest = [], template
    while rest:
        head, brace, tail = rest.partition("{")
        if head:
            parts.append(F.lit(head))
        if brace:
            name, _, rest = tail.partition("}")
            parts.append(F.col(name))
        else:
            rest = ""
    return F.concat(*parts)


def _page(spark, d, template):
    return _docs(spark, d).select("i", F.concat(F.lit("https://x.org/"), "i", F.lit("/")).alias("url"), _made(template).alias("html"))


def _sections(pages, source):
    out = html.parse_pages(pages, source)
    return out.select("url", "number", "name", "body", F.array_join(F.transform("blocks", lambda b: F.concat_ws("=", b["type"], b["content"])), "|").alias("blocks"))


CATCH = (
    '<html><head><meta name="Number" content="{i}"/><title>Chapter {i}</title></head><body><h2 class="chap-no">CHAPTER {i}</h2><p class="toc_catchln"><a href="#sec_{i}-1">Sec. {i}-1. Of {source}.</a></p>'
    '<p class="toc_catchln"><a href="#sec_{i}-2">Secs. {i}-2 to {i}-4. Reserved.</a></p><p><span class="catchln" id="sec_{i}-1">Sec. {i}-1. Of {source}.</span> (a) Text {words} &amp; end.</p>'
    '<p class="source-first">(P.A. {i}.)</p><p class="history-first">History: {lang}.</p><table class="nav_tbl"><tr><td>(Return)</td></tr></table>'
    '<p><span class="catchln" id="sec_{i}-2">Secs. {i}-2 to {i}-4. Reserved.</span></p></body></html>'
)
CODE = "<html><body><center><h1>TITLE I</h1></center><b> {i}-A:1 Of {source}. &#150;</b><codesect>Rivers run.<br><b>Banks.</b> Text {words}</codesect><sourcenote><p><b>Source.</b> {lang}, 1:1.</p></sourcenote></body></html>"
SIGNED = "<html><body><h2>Title 2</h2><p>§ {i}. Of {source}</p><b>§ {i}. Of {source}</b><p>Text {words}</p><p>Added {lang}, No. 1.</p><p>§ {i}a. Repealed.</p></body></html>"
NOTED = "<html><body><h3>§ {i}-1-1. Of {source}.</h3><p>§ {i}-1-1. Of {source}.</p><p><b>(a)</b> Text {words}</p><p>History of Section.<br>P.L. {i}, {lang}</p></body></html>"
INDEX = '<html><body><a href="t{i}.htm#top">TITLE {i}: Of {source}</a><a href="t{i}.htm">TITLE {i}: Again</a><a href="c/{i}">Chapter {i}-A {words}</a><a href="/s/{i}.htm">Section {i}:1 Of {lang}</a><a href="about">About</a></body></html>'
LANDING = "<html><body><p>{words}</p><p>Current through {year} of {source}</p></body></html>"


def chapter_pages(spark, d):
    return _sections(_page(spark, d, CATCH), "cgs")


def codesect_pages(spark, d):
    return _sections(_page(spark, d, CODE), "nh")


def sign_pages(spark, d):
    return _sections(_page(spark, d, SIGNED), "vt")


def history_pages(spark, d):
    return _sections(_page(spark, d, NOTED), "rigl")


def toc_entries(spark, d):
    return html.parse_toc(_page(spark, d, CATCH))


def index_pages(spark, d):
    return html.parse_links(_page(spark, d, INDEX))


def page_versions(spark, d):
    """Version markers of landing pages."""
    x = _docs(spark, d).withColumn("year", F.lpad((F.col("i").cast("long") % 9000 + 1000).cast("string"), 4, "0"))
    return html.parse_versions(x.select(F.col("i").alias("url"), _made(LANDING).alias("html")))


def section_range(spark, d):
    """The second to third section of each chapter page."""
    return html.section_range(html.parse_pages(_page(spark, d, CATCH), "cgs"), 1, 3).select("url", "position", "number")


TITLE = (
    '<uscDoc xmlns="x"><main><title identifier="/us/usc/t{i}"><num value="{i}">Title {i}</num><heading>OF {source}</heading><chapter identifier="/us/usc/t{i}/ch6"><num value="6">CHAPTER 6</num><heading>RULES</heading>'
    '<section identifier="/us/usc/t{i}/s302"><num value="302">§ 302.</num><heading>Plans</heading><subsection><num value="a">(a)</num><heading>Contents</heading><chapeau>A plan must</chapeau>'
    '<paragraph><num value="1">(1)</num><content>be so {words} and see <ref href="/us/usc/t5/s552">section 552</ref> ;</content></paragraph><paragraph><num value="2">(2)</num><subparagraph><num value="A">(A)</num><content>fair.</content></subparagraph></paragraph></subsection>'
    '<sourceCredit>({lang}, 1.)</sourceCredit></section><section identifier="/us/usc/t{i}/s302"><num value="302">§ 302.</num><heading>Again</heading><content>Twice.</content></section></chapter></title></main></uscDoc>'
)
VOLUME = (
    "<statutesAtLarge><collection><component><publicLaws><component><pLaw><meta><publicPrivate>public</publicPrivate><congress>117</congress><docNumber>{i}</docNumber><citableAs>135 Stat. {i}</citableAs></meta>"
    "<main><section><num>SECTION 1.</num><heading>OF {source}.</heading><content>Text {words}</content></section></main></pLaw></component>"
    "<component><pLaw><meta><publicPrivate>private</publicPrivate><congress>117</congress><docNumber>{i}</docNumber></meta><main/></pLaw></component></publicLaws></component></collection></statutesAtLarge>"
)


def _files(spark, d, template):
    """Every second file in an archive, every eleventh a web page in an archive's place."""
    x = _docs(spark, d).where("i <> '0'")
    xml = F.when(F.col("i").cast("long") % 11 == 0, F.lit("<!DOCTYPE html><html><p>not found</p></html>")).otherwise(_made(template))
    files = x.select(F.concat("i", F.lit(".xml")).alias("path"), F.encode(xml, "UTF-8").alias("content"))
    return files.withColumn("content", F.when(F.col("path").rlike("[02468][.]xml$"), uslm.zipped("content")).otherwise(F.col("content")))


def usc_titles(spark, d):
    return uslm.read_titles(_files(spark, d, TITLE)).select("file", "level", "number", "name", "path", "citation", "parent_identifier", "body", F.array_join(F.transform("blocks", lambda b: b["type"]), ",").alias("blocks"))


def law_volumes(spark, d):
    return uslm.read_titles(_files(spark, d, VOLUME), volumes=True).select("file", "number", "path", "citation", "body")


def archives(spark, d):
    """Objects that are what their name says, counted."""
    return discovery.archives_only(_files(spark, d, TITLE)).agg(F.count("*").alias("n"))


def usc_release_units(spark, d):
    """Download links of title archives, one row a title in the titles' order; the page names each twice."""
    link = F.concat(F.lit('<a href="a/xml_usc'), F.lpad(F.col("i"), 2, "0"), F.lit('@119-73.zip">x</a>'))
    p = _docs(spark, d).where("length(i) <= 2").select(F.concat(F.lit("https://x.org/"), "i").alias("url"), F.concat(link, F.col("words"), link).alias("html"))
    return discovery.usc_units(p)


def release_point(spark, d):
    units = usc_release_units(spark, d)
    return spark.createDataFrame([(discovery.one_release(units),)], "release string")


def law_listing(spark, d):
    o = S.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("package_id"), (F.col("o_orderkey") % 20 + 100).cast("int").alias("congress"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("last_modified"))
    return discovery.law_packages(o)


def general_law_versions(spark, d):
    p = _docs(spark, d).select("i", F.when(F.col("i").cast("long") % 3 == 0, F.concat(F.lit("Amended through May "), F.col("i").cast("long") % 28 + 1, F.lit(", 2024 "), "words")).when(F.col("i").cast("long") % 3 == 1, F.lit("&copy; 2020")).otherwise(F.lit("none")).alias("html"))
    return discovery.mgl_version(p.withColumnRenamed("i", "url"))


def general_laws(spark, d):
    """Chapters in JSON with the JSON of the sections that they list; the third has none."""
    x = _docs(spark, d)
    chapters = x.select(F.concat(F.lit('{"Code":"'), "i", F.lit('","Part":{"Code":"II"},"Sections":[{"Code":"1 A"},{"Code":"2"}]}')).alias("json"))
    sections = x.select(F.concat(F.lit('{"Code":"1 A","Name":" Of  '), "source", F.lit(' ","Text":"Section 1A. Text '), "words", F.lit('","Chapter":{"Code":"'), "i", F.lit('"}}')).alias("json"))
    return uslm.mgl_sections(chapters, sections)


def page_lines(spark, d):
    """Text items of bill pages, gathered to lines; a column of at least three line numbers in the margin is taken off."""
    x = _docs(spark, d).select("i", F.split(F.concat(F.lit("The "), F.substring("source", 1, 8), F.lit(" shall "), "words"), " ").alias("ws"))
    # a line of a page holds eight words, a page twenty lines
    rows = x.select("i", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.size("ws") - 1) / 8)), lambda k: F.slice("ws", (k * 8 + 1).cast("int"), 8))).alias("k", "line"))
    at = rows.select("i", "k", F.floor(F.col("k") / 20 + 1).cast("int").alias("page"), (700.0 - 20 * (F.col("k") % 20)).alias("y"), F.array_join(F.slice("line", 1, 4), " ").alias("left"), F.array_join(F.slice("line", 5, 4), " ").alias("right"))
    left = F.struct(F.lit(171.0).alias("x"), F.col("y").alias("y"), (5.0 * F.length("left")).alias("width"), F.col("left").alias("text"))
    number = F.struct(F.lit(140.0).alias("x"), (F.col("y") + 1.0).alias("y"), F.lit(5.0).alias("width"), (F.col("k") % 20 + 1).cast("string").alias("text"))
    right = F.struct((F.lit(171.0) + 5 * F.length("left") + 5).alias("x"), F.col("y").alias("y"), (5.0 * F.length("right")).alias("width"), F.col("right").alias("text"))
    items = at.select("i", "page", F.explode(F.array(number, left, right)).alias("t")).where("t.text <> ''")
    items = items.select(F.col("i").alias("doc_id"), "page", "t.x", "t.y", "t.width", F.lit(10.0).alias("height"), F.lit(False).alias("bold"), "t.text")
    return geometry.extract_lines(items).select("doc_id", "page", "line", "text")


def bill_instructions(spark, d):
    """The paragraphs of ten bills, of which every second one is an instruction with its verb far behind; those found."""
    i, n = F.col("i"), F.col("i").cast("long")
    act = F.concat(F.lit("Section "), i, F.lit(" of title 5, United States Code, is amended by striking “"), F.col("source"), F.lit("” and inserting “"), F.col("lang"), F.lit("”."))
    x = _docs(spark, d).select((n % 10).cast("string").alias("bill_id"), n.cast("int").alias("paragraph"), F.when(n % 2 == 0, act).otherwise(F.concat(F.lit("Words "), "words")).alias("text"))
    found = redline.discover_instructions(x)
    return redline.parse_instructions(found).select("bill_id", "position", "section_path", F.get_json_object("edits", "$[0].op").alias("op"), F.get_json_object("edits", "$[0].text").alias("struck"), F.get_json_object("edits", "$[0].insert").alias("insert"), "unread")


_URL = "'https://x.org/' || i || '/'"
_TEXT = "trim(regexp_replace('Text ' || words, ' +', ' ', 'g'))"
_CATCH_BODY = "regexp_replace('(a) Text ' || words || ' & end.', ' +', ' ', 'g')"
_TITLED = "(SELECT *, '/us/usc/t' || i AS id FROM " + _D + " WHERE i <> '0' AND CAST(i AS BIGINT) % 11 <> 0)"
_USC_BODY = "'**(a)** **Contents** A plan must' || chr(10) || chr(10) || '> **(1)** ' || regexp_replace('be so ' || words || ' and see', ' +', ' ', 'g') || ' [section 552](/statutes/section/5/552);' || chr(10) || chr(10) || '> **(2)** **(A)** fair.'"
QUERIES = {
    "chapter_pages": (chapter_pages, f"""SELECT {_URL} AS url, i || '-1' AS number, 'Of ' || source AS name, {_CATCH_BODY} AS body, 'body=' || {_CATCH_BODY} || '|history_short=(P.A. ' || i || '.)|history_long=History: ' || lang || '.' AS blocks FROM {_D}
        UNION ALL SELECT {_URL}, i || '-2 to ' || i || '-4', 'Reserved', '', '' FROM {_D}"""),
    "codesect_pages": (codesect_pages, f"""SELECT {_URL} AS url, i || '-A:1' AS number, 'Of ' || source AS name, 'Rivers run.' || chr(10) || trim('**Banks.** ' || {_TEXT}) AS body,
        'body=Rivers run.' || chr(10) || trim('**Banks.** ' || {_TEXT}) || '|note=' || lang || ', 1:1.' AS blocks FROM {_D}"""),
    "sign_pages": (sign_pages, f"""SELECT {_URL} AS url, i AS number, 'Of ' || source AS name, {_TEXT} AS body, 'body=' || {_TEXT} || '|note=Added ' || lang || ', No. 1.' AS blocks FROM {_D}
        UNION ALL SELECT {_URL}, i || 'a', 'Repealed', '', '' FROM {_D}"""),
    "history_pages": (history_pages, f"SELECT {_URL} AS url, i || '-1-1' AS number, 'Of ' || source AS name, '**(a)** ' || {_TEXT} AS body, 'body=**(a)** ' || {_TEXT} || '|note=P.L. ' || i || ', ' || lang AS blocks FROM {_D}"),
    "toc_entries": (toc_entries, f"SELECT {_URL} AS url, 'sec_' || i || '-1' AS target, i || '-1' AS number, 'Of ' || source AS name FROM {_D} UNION ALL SELECT {_URL}, 'sec_' || i || '-2', i || '-2 to ' || i || '-4', 'Reserved' FROM {_D}"),
    "index_pages": (index_pages, f"""SELECT {_URL} AS url, 'title' AS kind, i AS number, 'Of ' || source AS name, {_URL} || 't' || i || '.htm' AS href FROM {_D}
        UNION ALL SELECT {_URL}, 'chapter', i || '-A', words, {_URL} || 'c/' || i FROM {_D} UNION ALL SELECT {_URL}, 'section', i || ':1', 'Of ' || lang, 'https://x.org/s/' || i || '.htm' FROM {_D}"""),
    "page_versions": (page_versions, f"SELECT i AS url, CAST(CAST(i AS BIGINT) % 9000 + 1000 AS VARCHAR) AS version FROM {_D}"),
    "section_range": (section_range, f"SELECT {_URL} AS url, 1 AS position, i || '-2 to ' || i || '-4' AS number FROM {_D}"),
    "usc_titles": (usc_titles, f"""SELECT i || '.xml' AS file, 'section' AS level, '302' AS number, 'Plans' AS name, '/section/' || i || '/302' AS path, i || ' USC 302' AS citation, id || '/ch6' AS parent_identifier, {_USC_BODY} AS body, 'body,source_credit' AS blocks FROM {_TITLED}
        UNION ALL SELECT i || '.xml', 'section', '302', 'Again', '/section/' || i || '/302-2', i || ' USC 302', id || '/ch6', 'Twice.', 'body' FROM {_TITLED}
        UNION ALL SELECT i || '.xml', 'chapter', '6', 'RULES', NULL, NULL, id, NULL, '' FROM {_TITLED}
        UNION ALL SELECT i || '.xml', 'title', i, 'OF ' || source, '/title/' || i, 'Title ' || i, NULL, NULL, '' FROM {_TITLED}"""),
    "law_volumes": (law_volumes, f"""SELECT i || '.xml' AS file, i AS number, '/117/' || i AS path, 'Pub. L. 117-' || i || ', 135 Stat. ' || i AS citation,
        '**SECTION 1.** **OF ' || source || '.**' || chr(10) || chr(10) || {_TEXT} AS body FROM {_TITLED}"""),
    "archives": (archives, f"SELECT count(*) AS n FROM {_D} WHERE i <> '0' AND (CAST(i AS BIGINT) % 11 <> 0 OR CAST(i AS BIGINT) % 2 = 0)"),
    "usc_release_units": (usc_release_units, f"SELECT i AS title, '119-73' AS release, 'a/xml_usc' || lpad(i, 2, '0') || '@119-73.zip' AS href FROM {_D} WHERE length(i) <= 2 AND i <> '0' UNION ALL SELECT '', '119-73', 'a/xml_usc00@119-73.zip'"),
    "release_point": (release_point, "SELECT '119-73' AS release"),
    "law_listing": (law_listing, """WITH l AS (SELECT CAST(o_orderkey AS VARCHAR) AS package_id, CAST(o_orderkey % 20 + 100 AS INTEGER) AS congress, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS last_modified FROM orders)
        SELECT *, left((SELECT max(last_modified) FROM l WHERE congress >= 106), 10) AS version FROM l WHERE congress >= 106"""),
    "general_law_versions": (general_law_versions, f"SELECT i AS url, CASE CAST(i AS BIGINT) % 3 WHEN 0 THEN 'May ' || (CAST(i AS BIGINT) % 28 + 1) || ', 2024' WHEN 1 THEN '2020' END AS version FROM {_D}"),
    "general_laws": (general_laws, f"""SELECT i AS chapter, '1A' AS number, 'Of ' || source AS name, {_TEXT} AS body, '/part/ii/chapter/' || i || '/section/1a' AS path, 'MGL c.' || i || ' §1A' AS citation, 0 AS position FROM {_D}
        UNION ALL SELECT i, '2', '', '', '/part/ii/chapter/' || i || '/section/2', 'MGL c.' || i || ' §2', 1 FROM {_D}"""),
    "page_lines": (page_lines, f"""WITH w AS (SELECT i, string_split('The ' || left(source, 8) || ' shall ' || words, ' ') AS ws FROM {_D}), l AS (SELECT i, ws, unnest(range(0, (len(ws) - 1) // 8 + 1)) AS k FROM w)
        SELECT i AS doc_id, CAST(k // 20 + 1 AS INTEGER) AS page, CAST(k AS INTEGER) AS line, CASE WHEN len(ws) <= 16 THEN (k + 1) || ' ' ELSE '' END || trim(array_to_string(ws[k * 8 + 1 : k * 8 + 8], ' ')) AS text FROM l"""),
    "bill_instructions": (bill_instructions, f"""SELECT CAST(CAST(i AS BIGINT) % 10 AS VARCHAR) AS bill_id, CAST(row_number() OVER (PARTITION BY CAST(i AS BIGINT) % 10 ORDER BY CAST(i AS BIGINT)) - 1 AS INTEGER) AS position, '/section/5/' || i AS section_path,
        'strike' AS op, source AS struck, lang AS "insert", 0 AS unread FROM {_D} WHERE CAST(i AS BIGINT) % 2 = 0"""),
}
