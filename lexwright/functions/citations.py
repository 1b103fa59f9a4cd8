"""Cross-reference extraction: citation lists in statute text as rows.

A citation is a head (``42 U.S.C.``, ``section``, ``paragraph (2) of sections``) and a
list of section numbers and ranges.  The whole grammar is regular, so one compiled
pattern finds heads with their lists, and a second one walks the list; each text is
scanned once.  Offsets are code points.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

REFERENCES = T.ArrayType(
    T.StructType([T.StructField("section", T.StringType()), T.StructField("title", T.StringType()), T.StructField("offset", T.IntegerType()), T.StructField("length", T.IntegerType()), T.StructField("link", T.StringType())])
)

#: Words of the grammar (fixed values).
QUALIFIERS = "subsections?|subdivisions?|paragraphs?|subparagraphs?|clauses?"
SECTION_WORDS = "sections|section|secs|sec"
SEPARATORS = r"(?:\s*,\s*(?:and/or\b|and\b|or\b)?\s*|\s+(?:and/or|and|or)\s+)"
RANGE_WORDS = "to|through"

_USC = r"U\.?S\.?C\.?"
_DESIGNATORS = r"(?:\s*\([A-Za-z0-9]+\))"


class Grammar:
    """A citation grammar over one form of section number."""

    def __init__(self, number: str, usc: bool):
        n = rf"(?<![\w.-]){number}(?![\w-])"
        item = rf"{n}{_DESIGNATORS}*(?:\s+(?:{RANGE_WORDS})\s+{n}(?:,?\s+inclusive)?)?"
        many = rf"{item}(?:{SEPARATORS}{item}(?!\s*{_USC}))*"
        chain = rf"(?:{QUALIFIERS}){_DESIGNATORS}+(?:{SEPARATORS}{_DESIGNATORS}+)*"
        heads = [
            rf"(?P<chain>\b{chain}(?:(?:\s+of\s+|{SEPARATORS}){chain})*\s+of\s+(?P<word>{SECTION_WORDS})\b\.?\s*)(?P<chained>{many})",
            rf"(?P<head>\b(?:{SECTION_WORDS})\b\.?\s*|§§?\s*)(?P<listed>{many})",
        ]
        if usc:
            heads.insert(0, rf"(?<![\w.-])(?P<title>\d+)\s+{_USC}\s*(?:(?:{SECTION_WORDS})\b\.?|§§?)?\s*(?P<coded>{many})")
        else:
            heads.append(rf"(?P<bare>{many})")
        self.find = re.compile("|".join(heads), re.I)
        self.item = re.compile(rf"({n}){_DESIGNATORS}*(?:\s+(?:{RANGE_WORDS})\s+({n}))?", re.I)
        self.of_title = re.compile(r"\s*,?\s*(?:of\s+)?(?:this\s+)?title\s+(\d+[A-Za-z]?)\b", re.I)

    def references(self, text: str, title: str | None) -> Iterator[tuple[str, str | None, int, int]]:
        """(section, title, offset, length); a range gives its two ends. Repeats at one place are left out."""
        at = 0
        while m := self.find.search(text, at):
            kind = m.lastgroup if m.lastgroup in ("chained", "listed", "coded", "bare") else next(k for k in ("coded", "chained", "listed", "bare") if k in m.groupdict() and m[k])
            start, end = m.span(kind)
            named = m["title"] if kind == "coded" else None
            if kind in ("chained", "listed") and (t := self.of_title.match(text, end)) and "this" not in t[0].lower():
                named = t[1]
            first_only = kind == "chained" and m["word"].lower() in ("section", "sec")
            for k, i in enumerate(self.item.finditer(text, start, end)):
                if first_only and k:
                    end = i.start()
                    break
                for g in (1, 2):
                    if i[g]:
                        yield i[g], named or title, i.start(g), len(i[g])
            at = max(end, m.start() + 1)


#: Federal numbers such as 1437f or 78o-4; state numbers such as 17a-101b-2.
USC = Grammar(r"\d+[a-zA-Z]*(?:-\d+)?", usc=True)
CGS = Grammar(r"\d+[a-zA-Z]*-\d+[a-zA-Z]*(?:-\d+[a-zA-Z]*)*", usc=False)


def usc_rows(text: str | None, title: str | None) -> list[tuple]:
    return [(s, t, o, n, f"/statutes/section/{t}/{s}" if t else None) for s, t, o, n in USC.references(text or "", title)]


def cgs_rows(text: str | None) -> list[tuple]:
    return [(s, None, o, n, f"/statutes/section/{s.lower()}") for s, _, o, n in CGS.references(text or "", None)]


def inline(text: str, rows: list[tuple]) -> str:
    """The text with each reference as a markdown link; pieces are taken in order, so offsets never shift."""
    out, at = [], 0
    for section, _, offset, length, link in sorted(rows, key=lambda r: r[2]):
        if link and offset >= at:
            out += [text[at:offset], f"[{text[offset : offset + length]}]({link})"]
            at = offset + length
    return "".join([*out, text[at:]])


@F.pandas_udf(REFERENCES)
def usc_references(text: pd.Series, title: pd.Series) -> pd.Series:
    return pd.Series([usc_rows(x, t) for x, t in zip(text, title)])


@F.pandas_udf(REFERENCES)
def cgs_references(text: pd.Series) -> pd.Series:
    return pd.Series([cgs_rows(x) for x in text])


@F.pandas_udf(T.StringType())
def inline_usc(text: pd.Series, title: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else inline(x, usc_rows(x, t)) for x, t in zip(text, title)])


@F.pandas_udf(T.StringType())
def inline_cgs(text: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else inline(x, cgs_rows(x)) for x in text])


def chapter_rows(text: str | None) -> list[tuple]:
    """State references of title-chapter-section numbers, linked by their chapter."""
    slug = lambda x: re.sub(r"[^a-z0-9.]+", "-", x.lower()).strip("-")
    out = []
    for s, _, o, n in CGS.references(text or "", None):
        chapter = s.rpartition("-")[0]
        out.append((s, None, o, n, f"/title/{slug(chapter.partition('-')[0])}/chapter/{slug(chapter)}/section/{slug(s)}"))
    return out


@F.pandas_udf(T.StringType())
def inline_chapters(text: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else inline(x, chapter_rows(x)) for x in text])


def explode_citations(df: DataFrame, key: str, references: Column) -> DataFrame:
    """The citation graph's edges: one row per reference."""
    return df.select(key, F.posexplode(references).alias("ordinal", "r")).select(key, "ordinal", "r.*")
