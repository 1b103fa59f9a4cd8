"""United States Legislative Markup: title files and public-law volumes as rows.

The file is read as a stream of XML events and freed as it goes.  Body text is written
as markdown: markers and headings bold, one level of block quote per level below the
section, references as links.
"""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

#: Levels above the section, outermost first, and below it (fixed values).
UPPER = ("title", "subtitle", "chapter", "subchapter", "part", "subpart", "division", "subdivision")
LOWER = ("subsection", "paragraph", "subparagraph", "clause", "subclause", "item", "subitem")
NODES = "level string, level_index int, number string, name string, identifier string, parent_identifier string, path string, citation string, body string, blocks array<struct<type:string,label:string,content:string>>"
_DASH = str.maketrans("‐‑‒–—", "-----")


def tag(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""


def usc_href(href: str) -> str | None:
    """/statutes/section/T/S of an identifier path."""
    parts = href.removeprefix("/us/usc/").split("/") if href.startswith("/us/usc/") else []
    title = next((p[1:] for p in parts if re.match("t.", p)), None)
    section = next((p[1:].translate(_DASH) for p in parts if re.match("s.", p) and not p.startswith(("sch", "st"))), None)
    return f"/statutes/section/{title}/{section}" if title and section else None


def inline(e: ET.Element) -> str:
    """Text of an element and what it holds, references as links, footnote marks left out."""
    out = [e.text or ""]
    for c in e:
        t = tag(c)
        if t == "ref" and ("footnoteRef" in c.get("class", "") or c.get("idref")):
            pass
        elif t == "ref" and (link := usc_href(c.get("href", ""))):
            out.append(f"[{inline(c)}]({link})")
        elif not (t == "note" and c.get("type") == "footnote"):
            out.append(inline(c))
        out.append(c.tail or "")
    return "".join(out)


def clean(text: str) -> str:
    text = re.sub(r"\s+", " ", text).strip()
    return re.sub(r"\s+([,.;:)\]])", r"\1", text)


def children(e: ET.Element, *names: str) -> list[ET.Element]:
    return [c for c in e if tag(c) in names]


def first_text(e: ET.Element, name: str) -> str:
    return next((clean(inline(c)) for c in children(e, name)), "")


def body_parts(e: ET.Element, depth: int) -> Iterator[str]:
    """Paragraphs of a section or a level within it."""
    quote = "> " * depth
    lead = []
    if tag(e) in LOWER:
        lead = [f"**{x}**" for x in (first_text(e, "num"), first_text(e, "heading")) if x]
    for c in e:
        t = tag(c)
        if t in LOWER:
            if lead and len(lead) > 1:  # a heading keeps its own line
                yield quote + " ".join(lead)
                lead = []
            inner = list(body_parts(c, LOWER.index(t)))
            if lead and inner:  # a bare marker is followed by its first child on the same line
                inner[0] = quote + " ".join(lead) + " " + inner[0].lstrip("> ")
                lead = []
            yield from inner
        elif t in ("chapeau", "content", "continuation", "text", "p") or (t == "quotedContent"):
            paras = [clean(inline(p)) for p in children(c, "p")] or [clean(inline(c))]
            for p in filter(None, paras):
                yield quote + " ".join([*lead, p])
                lead = []
    if lead:
        yield quote + " ".join(lead)


def note_blocks(section: ET.Element) -> list[dict]:
    out = [{"type": "source_credit", "label": "Source Credit", "content": clean(inline(c))} for c in children(section, "sourceCredit")]
    for notes in children(section, "notes"):
        for n in children(notes, "note"):
            heading = first_text(n, "heading")
            text = "\n\n".join(filter(None, (clean(inline(c)) for c in n if tag(c) not in ("heading", "num"))))
            if "crossHeading" in n.get("role", "") + n.get("class", ""):
                out.append({"type": "heading", "label": heading, "content": None})
            elif text:
                kind = "amendments" if n.get("topic") == "amendments" or heading.lower().startswith("amendments") else "note"
                out.append({"type": kind, "label": heading or None, "content": text})
    return out


def parse_title(xml: str) -> Iterator[dict]:
    """Levels and sections of one title; sections inside notes and quotations are passed over."""
    above: list[dict] = []
    inside = 0
    seen: dict[str, int] = {}
    title = None
    for event, e in ET.iterparse(io.BytesIO(xml.encode()), events=("start", "end")):
        t = tag(e)
        if t in ("notes", "note", "quotedContent"):
            inside += 1 if event == "start" else -1
        if inside:
            continue
        if event == "start" and t in UPPER:
            above.append({"level": t, "identifier": e.get("identifier"), "e": e})
        elif event == "end" and t == "section":
            ident = e.get("identifier") or ""
            number = next((p[1:] for p in reversed(ident.split("/")) if re.match("s[0-9]", p)), None) or next((n.get("value") for n in children(e, "num") if n.get("value")), None)
            if number:
                number = number.translate(_DASH)
                title = title or next((p[1:] for p in ident.split("/") if re.match("t[0-9]", p)), None)
                path = f"/section/{title}/{number}"
                seen[path] = seen.get(path, 0) + 1
                body = "\n\n".join(body_parts(e, 0))
                blocks = ([{"type": "body", "label": None, "content": body}] if body else []) + note_blocks(e)
                yield {
                    "level": "section", "level_index": 8, "number": number, "name": first_text(e, "heading"), "identifier": ident, "parent_identifier": above[-1]["identifier"] if above else None,
                    "path": path if seen[path] == 1 else f"{path}-{seen[path]}", "citation": f"{title} USC {number}", "body": body, "blocks": blocks,
                }
            e.clear()
        elif event == "end" and t in UPPER and above:
            above.pop()
            number = next((n.get("value") or clean(inline(n)) for n in children(e, "num")), "")
            if t == "title":
                title = title or number
            yield {
                "level": t, "level_index": UPPER.index(t), "number": number, "name": first_text(e, "heading"), "identifier": e.get("identifier"), "parent_identifier": above[-1]["identifier"] if above else None,
                "path": f"/title/{number}" if t == "title" else None, "citation": f"Title {number}" if t == "title" else None, "body": None, "blocks": [],
            }
            e.clear()


def parse_volume(xml: str) -> Iterator[dict]:
    """Public laws of a volume; private laws and laws without a number are passed over."""
    for _, e in ET.iterparse(io.BytesIO(xml.encode()), events=("end",)):
        if tag(e) != "pLaw":
            continue
        meta = {tag(c): clean(inline(c)) for m in children(e, "meta") for c in m}
        if meta.get("publicPrivate") == "public" and meta.get("docNumber") and meta.get("congress", "0") != "0":
            body = "\n\n".join(p for main in children(e, "main") for s in main for p in _law_parts(s))
            cite = next((clean(inline(c)) for m in children(e, "meta") for c in children(m, "citableAs") if "Stat" in inline(c)), "")
            n, k = meta["congress"], meta["docNumber"]
            yield {
                "level": "law", "level_index": 1, "number": k, "name": meta.get("title", ""), "identifier": f"/us/pl/{n}/{k}", "parent_identifier": f"/us/pl/{n}", "path": f"/{n}/{k}",
                "citation": ", ".join(filter(None, (f"Pub. L. {n}-{k}", cite))), "body": body, "blocks": [{"type": "body", "label": None, "content": body}] if body else [],
            }
        e.clear()


def _law_parts(e: ET.Element) -> Iterator[str]:
    if tag(e) in ("legislativeHistory", "preface", "meta", "toc", "sidenote", "page"):
        return
    if tag(e) == "section":
        head = " ".join(f"**{x}**" for x in (first_text(e, "num"), first_text(e, "heading")) if x)
        if head:
            yield head
        yield from body_parts(e, 0)
    elif children(e, "section", *UPPER):
        head = " ".join(f"**{x}**" for x in (first_text(e, "num"), first_text(e, "heading")) if x)
        if head:
            yield head
        for c in e:
            yield from _law_parts(c)
    elif tag(e) not in ("num", "heading"):
        if text := clean(inline(e)):
            yield text


def first_xml(content: bytes) -> str | None:
    """The first .xml member of a ZIP archive; null for other bytes, such as an HTML page sent in its place."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            name = next((n for n in z.namelist() if n.lower().endswith(".xml")), None)
            return z.read(name).decode("utf-8") if name else None
    except zipfile.BadZipFile:
        return None


def read_titles(files: DataFrame, volumes: bool = False) -> DataFrame:
    """Rows of a binaryFile DataFrame (path, content) of ZIP or XML files, one file at a time in each task."""
    parser = parse_volume if volumes else parse_title

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = []
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                xml = first_xml(content) if content[:2] == b"PK" else content.decode("utf-8")
                if xml and xml.lstrip().startswith("<") and "<html" not in xml[:500].lower():
                    for row in parser(xml):
                        rows.append(row | {"file": path})
                        if len(rows) >= 500:  # many small files share a batch, and a large one goes on in parts
                            yield pd.DataFrame(rows)
                            rows = []
        if rows:
            yield pd.DataFrame(rows)

    return files.select("path", "content").mapInPandas(parse, NODES + ", file string")


MGL_CHAPTER = "Code string, Name string, IsRepealed boolean, StrickenText string, Part struct<Code:string,Details:string>, Sections array<struct<Code:string,ChapterCode:string,Details:string>>"
MGL_SECTION = "Code string, Name string, IsRepealed boolean, Text string, Chapter struct<Code:string,Details:string>, Part struct<Code:string,Details:string>"


def mgl_sections(chapters: DataFrame, sections: DataFrame) -> DataFrame:
    """Sections listed by chapter JSON with their own JSON's text; native. Columns chapter, number, name, body, path, citation."""
    from lexwright.functions.designators import normalize_compact
    from lexwright.functions.text import collapse_whitespace, normalize_body

    ch = chapters.select(F.from_json("json", MGL_CHAPTER).alias("c")).select(F.col("c.Code").alias("chapter"), F.col("c.Part.Code").alias("part"), F.posexplode("c.Sections").alias("position", "s"))
    se = sections.select(F.from_json("json", MGL_SECTION).alias("s")).select(F.col("s.Chapter.Code").alias("chapter"), F.col("s.Code").alias("code"), F.col("s.Name").alias("name"), F.col("s.Text").alias("text"))
    j = ch.select("chapter", "part", "position", F.col("s.Code").alias("code")).join(se, ["chapter", "code"], "left")
    low = lambda c: F.lower(normalize_compact(F.col(c)))
    return j.select(
        "chapter", normalize_compact(F.col("code")).alias("number"), collapse_whitespace(F.coalesce("name", F.lit(""))).alias("name"), normalize_body(F.coalesce("text", F.lit(""))).alias("body"),
        F.concat(F.lit("/part/"), low("part"), F.lit("/chapter/"), low("chapter"), F.lit("/section/"), low("code")).alias("path"),
        F.concat(F.lit("MGL c."), normalize_compact(F.col("chapter")), F.lit(" §"), normalize_compact(F.col("code"))).alias("citation"), "position",
    )


@F.pandas_udf(BinaryType())
def zipped(content: pd.Series) -> pd.Series:
    """Each file as the only member of a ZIP archive."""

    def pack(data: bytes) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("file.xml", data)
        return out.getvalue()

    return content.map(lambda x: None if x is None else pack(bytes(x)))
