"""Queries over documents read each text to its end."""

from lexwright.plans import statutes, texts

LATE = "word " * 100 + "chapter 31B, section 4c and RSA 7-A:2 and section 88D end."


def tables(spark, tmp_path):
    spark.createDataFrame([(1, LATE), (2, None), (3, "short")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_references_after_character_200(spark, tmp_path):
    rows = texts.chapter_references(spark, tables(spark, tmp_path)).collect()
    assert [(r.chapter, r.section) for r in rows if r.doc_id == 1] == [("1A", "7"), ("31B", "4C"), ("12", "1B")]


def test_links_after_character_200(spark, tmp_path):
    by = {r.doc_id: r for r in texts.inline_links(spark, tables(spark, tmp_path)).collect()}
    assert by[1].rsa.endswith("word chapter 31B, section 4c and RSA [7-A:2](/title/i-a/chapter/7-a/section/7-a-2) and section 88D end.")
    assert by[1].sections.endswith("section [4c](/statutes/section/10a/5/4c) and RSA 7-A:2 and section [88D](/statutes/section/10a/5/88d) end.")


def test_hyphenated_citations_in_the_text(spark, tmp_path):
    spark.createDataFrame([(1, "word " * 100 + "under section 78o-4 of title 15."), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = {(r.doc_id, r.section, r.title) for r in statutes.usc_citations(spark, str(tmp_path)).collect()}
    assert rows == {(1, "1", "42"), (1, "1a", "7"), (1, "1c", "7"), (1, "9", "5"), (1, "78o-4", "15"), (2, "2", "42"), (2, "2a", "7"), (2, "2c", "7"), (2, "9", "5")}
