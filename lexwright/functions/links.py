"""Cross references that are regular: links from hrefs, and reference rows and inline links by pattern."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexwright.functions.designators import slug

#: Patterns of the state codes' references (fixed values).
CHAPTER_SECTION = r"\bchapter\s+(\d+[a-zA-Z]?)\s*,\s*section\s+(\d+[a-zA-Z]?)\b"
SECTION_OF_CHAPTER = r"\bsection\s+(\d+[a-zA-Z]?)\s+of\s+chapter\s+(\d+[a-zA-Z]?)\b"
RSA = r"(?i)\bRSA\s+([0-9A-Z-]+:[0-9A-Z-]+)\b"
SECTION_SIGN = r"(?i)(section\s+|§§?\s*)([0-9]+[A-Za-z]?)"


def usc_link(href: Column) -> Column:
    """/statutes/section/T/S of /us/usc/tT/.../sS; null where either is missing."""
    title, section = F.regexp_extract(href, r"^/us/usc/(?:[^/]+/)*?t([^/]+)", 1), F.regexp_extract(href, r"^/us/usc/(?:[^/]+/)*?s([^/]+)", 1)
    section = F.translate(section, "‐‑‒–—−", "------")
    return F.when((title != "") & (section != ""), F.concat(F.lit("/statutes/section/"), title, F.lit("/"), section))


def uslm_path(href: Column) -> Column:
    """/usc/title-T/section-S of /us/usc/tT/sS[/...]; null for other hrefs."""
    title, section = F.regexp_extract(href, r"^/us/usc/t([^/]*)/s([^/]*)", 1), F.regexp_extract(href, r"^/us/usc/t([^/]*)/s([^/]*)", 2)
    return F.when(href.rlike(r"^/us/usc/t[^/]*/s"), F.concat(F.lit("/usc/title-"), title, F.lit("/section-"), section))


def chapter_references(text: Column) -> Column:
    """Array of (chapter, section, matched, link) of both phrase forms, "chapter X, section Y" first."""

    def rows(pattern: str, chapter: int, section: int) -> Column:
        def row(m: Column) -> Column:
            c, s = F.regexp_extract(m, pattern, chapter), F.regexp_extract(m, pattern, section)
            return F.struct(F.upper(c).alias("chapter"), F.upper(s).alias("section"), m.alias("matched"), F.concat(F.lit("/statutes/chapter/"), F.lower(c), F.lit("/section/"), F.lower(s)).alias("link"))

        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), row)

    return F.concat(rows(CHAPTER_SECTION, 1, 2), rows(SECTION_OF_CHAPTER, 2, 1))


def explode_references(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row per chapter reference with its ordinal in the text's list."""
    return docs.select(key, F.posexplode(chapter_references(F.col(text))).alias("ordinal", "r")).select(key, "ordinal", "r.*")


def inline_rsa(text: Column, title: Column) -> Column:
    """``RSA c:s`` references as markdown links into the title's chapter."""
    pieces, found = F.split(text, RSA, -1), F.regexp_extract_all(text, F.lit(RSA), F.lit(0))

    def link(m: Column) -> Column:
        name = F.regexp_extract(m, RSA, 1)
        path = F.concat(F.lit("](/title/"), slug(title), F.lit("/chapter/"), slug(F.substring_index(name, ":", 1)), F.lit("/section/"), slug(name), F.lit(")"))
        return F.concat(F.substring(m, F.lit(1), F.length(m) - F.length(name)), F.lit("["), name, path)

    return F.array_join(F.zip_with(pieces, F.array_append(F.transform(found, link), ""), lambda a, b: F.concat(a, b)), "")


def inline_sections(text: Column, title: str, chapter: str) -> Column:
    """``section n`` and section-sign references as markdown links; the number's letter in lower case in the link."""
    pieces, found = F.split(text, SECTION_SIGN, -1), F.regexp_extract_all(text, F.lit(SECTION_SIGN), F.lit(0))

    def link(m: Column) -> Column:
        number = F.regexp_extract(m, SECTION_SIGN, 2)
        return F.concat(F.regexp_extract(m, SECTION_SIGN, 1), F.lit("["), number, F.lit(f"](/statutes/section/{title.lower()}/{chapter.lower()}/"), F.lower(number), F.lit(")"))

    return F.array_join(F.zip_with(pieces, F.array_append(F.transform(found, link), ""), lambda a, b: F.concat(a, b)), "")
