from lexwright.functions.citations import cgs_rows, inline, usc_rows


def sections(rows):
    return [(r[0], r[1]) for r in rows]


def test_usc_forms():
    text = "See 42 U.S.C. 1983 and 18 U.S.C. 1001."
    rows = usc_rows(text, "42")
    assert sections(rows) == [("1983", "42"), ("1001", "18")] and rows[0][2:4] == (text.index("1983"), 4)
    assert sections(usc_rows("Section 552 of title 5 applies.", "1")) == [("552", "5")]
    assert sections(usc_rows("Sections 101 to 103, inclusive, are reserved.", "12")) == [("101", "12"), ("103", "12")]
    assert sections(usc_rows("sections 1, 2a, and 3 of title 7", "9")) == [("1", "7"), ("2a", "7"), ("3", "7")]
    assert sections(usc_rows("paragraphs (1) and (2) of subsection (a) of section 1395x(b) or 5", "42")) == [("1395x", "42")]
    assert sections(usc_rows("subsection (a) of sections 4 and 6", "2")) == [("4", "2"), ("6", "2")]
    assert usc_rows("nothing 12 here", "1") == [] and usc_rows(None, "1") == []


def test_cgs_forms():
    assert [r[0] for r in cgs_rows("sections 17a-101 to 17a-103, inclusive, and 46b-1; also 4-5")] == ["17a-101", "17a-103", "46b-1", "4-5"]
    t = "Under section 1-2, see 3-4a."
    assert inline(t, cgs_rows(t)) == "Under section [1-2](/statutes/section/1-2), see [3-4a](/statutes/section/3-4a)."


def test_on_spark(spark):
    from pyspark.sql import functions as F

    from lexwright.functions.citations import explode_citations, inline_usc, usc_references

    d = spark.createDataFrame([(1, "section 5 of title 2", "9"), (2, None, "9"), (3, "", None)], "id long, text string, title string")
    got = explode_citations(d, "id", usc_references("text", "title")).collect()
    assert [(r.id, r.section, r.title, r.link) for r in got] == [(1, "5", "2", "/statutes/section/2/5")]
    assert [r[0] for r in d.select(inline_usc(F.col("text"), F.col("title"))).collect()] == ["section [5](/statutes/section/2/5) of title 2", None, ""]
