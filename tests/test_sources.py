import io
import zipfile

from lexwright.sources import html, uslm

CHAPTER = """<html><head><meta name="Number" content="9"/><title>Chapter 9</title></head><body><h2 class="chap-no">CHAPTER 9</h2>
<p class="toc_catchln"><a href="#sec_9-1">Sec. 9-1. Of boats.</a></p>
<p><span class="catchln" id="sec_9-1">Sec. 9-1. Of boats.</span> (a) A boat floats &amp; sails.</p><p>(b) It may sink.</p>
<p class="source-first">(P.A. 1-2.)</p><p class="history-first">History: new.</p>
<table class="nav_tbl"><tr><td>(Return)</td></tr></table>
<p><span class="catchln" id="sec_9-2">Secs. 9-2 to 9-4. Reserved.</span></p></body></html>"""
CODE = """<html><body><center><h1>TITLE I</h1></center><b> 61-C:4 Of rivers. &#150;</b><codesect>Rivers run.<br><b>Banks.</b> They hold.</codesect>
<sourcenote><p><b>Source.</b> 2031, 9:9.</p></sourcenote></body></html>"""
SIGNED = """<html><body><h2>Title 2</h2><p>§ 1. Of halls</p><b>§ 1. Of halls</b><p>A hall is long.</p><p>Added 2015, No. 1.</p><p>§ 2. Repealed.</p>
<p>§&nbsp;3-1. Of doors.</p><p><b>(a)</b> A door.</p><p>History of Section.<br>P.L. 1, ch. 2</p></body></html>"""
TITLE = """<uscDoc xmlns="x"><main><title identifier="/us/usc/t77"><num value="77">Title 77</num><heading>HEALTH</heading><chapter identifier="/us/usc/t77/ch6"><num value="6">CHAPTER 6</num><heading>CHILDREN</heading>
<section identifier="/us/usc/t77/s4410"><num value="4410">§ 4410.</num><heading>Plans</heading><subsection><num value="a">(a)</num><heading>Contents</heading><chapeau>A plan must</chapeau>
<paragraph><num value="1">(1)</num><content>be good, see <ref href="/us/usc/t5/s552">section 552</ref> ;</content></paragraph><paragraph><num value="2">(2)</num><subparagraph><num value="A">(A)</num><content>fair.</content></subparagraph></paragraph></subsection>
<sourceCredit>(Aug. 14, 1935.)</sourceCredit><notes><note topic="amendments"><heading>Amendments</heading><p>1990-changed.</p></note><note><section identifier="/us/usc/t77/s9"><num value="9"/></section></note></notes></section>
<section identifier="/us/usc/t77/s4410"><num value="4410">§ 4410.</num><heading>Again</heading><content>Twice.</content></section></chapter></title></main></uscDoc>"""
VOLUME = """<statutesAtLarge><collection><component><publicLaws><component><pLaw><meta><publicPrivate>public</publicPrivate><congress>117</congress><docNumber>5</docNumber><citableAs>135 Stat. 4</citableAs></meta>
<main><section><num>SECTION 1.</num><heading>SHORT TITLE.</heading><content>This is it.</content></section></main></pLaw></component>
<component><pLaw><meta><publicPrivate>private</publicPrivate><congress>117</congress><docNumber>6</docNumber></meta><main/></pLaw></component></publicLaws></component></collection></statutesAtLarge>"""


def test_catchlines():
    one, two = html.catchline_sections("u", CHAPTER)
    assert (one["number"], one["name"], one["body"]) == ("9-1", "Of boats", "(a) A boat floats & sails.\n\n(b) It may sink.")
    assert [b["type"] for b in one["blocks"]] == ["body", "history_short", "history_long"] and "Return" not in str(one)
    assert two["number"] == "9-2 to 9-4" and two["body"] == "" and two["blocks"] == []


def test_codesect_and_signs():
    (r,) = html.codesect_sections("u", CODE)
    assert (r["number"], r["name"]) == ("61-C:4", "Of rivers") and r["body"].startswith("Rivers run.\n**Banks.**") and r["blocks"][1]["content"] == "2031, 9:9."
    a, b, c = html.sign_sections("u", SIGNED)
    assert (a["number"], a["name"], a["body"]) == ("1", "Of halls", "A hall is long.") and a["blocks"][1]["content"] == "Added 2015, No. 1."
    assert b["number"] == "2" and c["body"].startswith("**(a)** A door.") and c["blocks"][1]["content"] == "P.L. 1, ch. 2"
    links = list(html.index_links("https://x.org/a/", '<a href="b.htm#t">TITLE I: Of things</a><a href="b.htm">TITLE I: Again</a><a href="c">other</a>'))
    assert links == [{"url": "https://x.org/a/", "kind": "title", "number": "I", "name": "Of things", "href": "https://x.org/a/b.htm"}]
    assert html.version_of("<p>Current through 2024 laws</p>") == "2024" and html.version_of("x").startswith("undated-") and html.fnv1a64(b"a") == 0xAF63DC4C8601EC8C


def test_uslm():
    rows = list(uslm.parse_title(TITLE))
    assert [(r["level"], r["path"]) for r in rows] == [("section", "/section/77/4410"), ("section", "/section/77/4410-2"), ("chapter", None), ("title", "/title/77")]
    assert rows[0]["body"] == "**(a)** **Contents** A plan must\n\n> **(1)** be good, see [section 552](/statutes/section/5/552);\n\n> **(2)** **(A)** fair."
    assert [b["type"] for b in rows[0]["blocks"]] == ["body", "source_credit", "amendments"] and rows[0]["parent_identifier"] == "/us/usc/t77/ch6" and rows[0]["citation"] == "77 USC 4410"
    (law,) = uslm.parse_volume(VOLUME)
    assert law["path"] == "/117/5" and law["citation"] == "Pub. L. 117-5, 135 Stat. 4" and law["body"] == "**SECTION 1.** **SHORT TITLE.**\n\nThis is it."


def test_on_spark(spark):
    pages = spark.createDataFrame([("u", CHAPTER), ("v", None), ("w", "")], "url string, html string")
    assert [r.number for r in html.parse_pages(pages, "cgs").collect()] == ["9-1", "9-2 to 9-4"]
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a.xml", TITLE)
    files = spark.createDataFrame([("a.zip", bytearray(z.getvalue())), ("b.zip", bytearray(b"<html>no</html>")), ("c.xml", bytearray(TITLE.encode()))], "path string, content binary")
    assert uslm.read_titles(files).count() == 8
    ch = spark.createDataFrame([('{"Code":"1","Part":{"Code":"I"},"Sections":[{"Code":"1 A"},{"Code":"2"}]}',)], "json string")
    se = spark.createDataFrame([('{"Code":"1 A","Name":" Of  x ","Text":"Section 1A. Text.","Chapter":{"Code":"1"}}',)], "json string")
    got = uslm.mgl_sections(ch, se).orderBy("position").collect()
    assert [(r.number, r.name, r.body, r.path, r.citation) for r in got] == [("1A", "Of x", "Text.", "/part/i/chapter/1/section/1a", "MGL c.1 §1A"), ("2", "", "", "/part/i/chapter/1/section/2", "MGL c.1 §2")]
