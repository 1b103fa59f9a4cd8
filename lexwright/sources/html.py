"""State statute pages: HTML in, section rows out.

A page is flattened once into a list of (tag, attributes, text) blocks by the standard
parser; each source then reads sections off that list with a handful of patterns.  Pages
are independent, so a table of (url, html) goes through ``mapInPandas`` without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SECTION = "url string, number string, name string, body string, blocks array<struct<type:string,label:string,content:string>>"
LINK = "url string, kind string, number string, name string, href string"

_BREAKS = {"br", "p", "div", "tr", "h1", "h2", "h3", "h4", "hr", "li", "table", "center"}
_BLOCKS = {"p", "h1", "h2", "h3", "h4", "codesect", "sourcenote", "b", "td", "li", "span", "a", "title"}


class Flat(HTMLParser):
    """Text runs in document order, each with the chain of elements that it stands in."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[int, str, dict]] = []
        self.runs: list[tuple[str, tuple]] = []
        self.meta: dict[str, str] = {}
        self.count = 0

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "meta" and "name" in a:
            self.meta[a["name"].lower()] = a.get("content", "")
        if tag in _BREAKS:
            self.runs.append(("\n", tuple(self.open)))
        if tag not in ("br", "hr", "meta", "img", "link", "input"):
            if tag == "p":
                while any(t == "p" for _, t, _ in self.open):
                    self.handle_endtag("p")
            self.count += 1
            self.open.append((self.count, tag, a))

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][1] == tag:
                if tag in _BREAKS:
                    self.runs.append(("\n", tuple(self.open)))
                del self.open[k:]
                return

    def handle_data(self, data):
        if not any(t in ("script", "style", "head") and t != "title" for _, t, _ in self.open) or any(t == "title" for _, t, _ in self.open):
            self.runs.append((data, tuple(self.open)))


def flatten(html: str) -> Flat:
    f = Flat()
    f.feed(html or "")
    f.close()
    return f


def squeeze(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def lines(text: str) -> str:
    """Stripped, single-spaced lines with at most one blank line between."""
    return re.sub(r"\n{3,}", "\n\n", "\n".join(squeeze(x) for x in text.split("\n"))).strip()


def elements(flat: Flat, tags: set[str]) -> Iterator[tuple[str, dict, list[tuple[str, tuple]]]]:
    """(tag, attributes, runs) of each outermost element with one of the tags, in order."""
    last, runs, head = None, [], None
    for text, chain in flat.runs:
        own = next(((n, t, a) for n, t, a in chain if t in tags), None)
        if own is None:
            continue
        if own[0] != last:
            if head is not None:
                yield head[1], head[2], runs
            last, head, runs = own[0], own, []
        runs.append((text, chain))
    if head is not None:
        yield head[1], head[2], runs


def text_of(runs: list[tuple[str, tuple]], bold: bool = False) -> str:
    out, was = [], False
    for text, chain in runs:
        now = bold and any(t in ("b", "strong") for _, t, _ in chain)
        if now != was:
            out.append("**")
            was = now
        out.append(text)
    if was:
        out.append("**")
    return re.sub(r"\*\*(\s*)\*\*", r"\1", "".join(out))


def row(url: str, number: str, name: str, body: str, *extra: tuple[str, str | None, str]) -> dict:
    blocks = [{"type": "body", "label": None, "content": body}] if body else []
    blocks += [{"type": t, "label": label, "content": c} for t, label, c in extra if c]
    return {"url": url, "number": number, "name": name, "body": body, "blocks": blocks}


# --- chapter pages whose sections start at <span class="catchln"> ---------------------------------

_CATCH = re.compile(r"^Secs?\.\s*(.+?)\.\s*(.*)$", re.S)
_TARGETS = (("source", "history_short", "Source"), ("history", "history_long", "History"), ("annotation", "citations", "Citations"), ("cross-ref", "see_also", "See also"))


def catchline_sections(url: str, html: str) -> Iterator[dict]:
    """Sections of a chapter page; paragraph classes route text to body, history, citations or see-also blocks."""
    current, body, extra, kind = None, [], {}, None

    def done():
        if current:
            text = trim_trailing_headings(lines("\n".join(body)))
            yield row(url, *current, text, *[(t, label, lines("\n".join(extra.get(t, [])))) for _, t, label in _TARGETS])

    for _, attrs, runs in elements(flatten(html), {"p", "table", "h2", "h3", "h4"}):
        cls = attrs.get("class", "")
        if "toc_" in cls or "nav_tbl" in cls or "chap" in cls:
            continue
        catch = squeeze("".join(t for t, c in runs if any(x == "span" and "catchln" in a.get("class", "") for _, x, a in c)))
        rest = text_of([(t, c) for t, c in runs if not any(x == "span" and "catchln" in a.get("class", "") for _, x, a in c)])
        if catch:
            yield from done()
            m = _CATCH.match(catch)
            current, body, extra, kind = ((m[1], m[2].strip().rstrip(".")) if m else (catch, "")), [], {}, None
        elif current:
            found = next((t for word, t, _ in _TARGETS if cls.startswith(word)), None)
            kind = found or (kind if not cls and kind else None) if cls or kind is None else kind
        if current:
            (extra.setdefault(kind, []) if kind else body).append(rest)
    yield from done()


def trim_trailing_headings(text: str) -> str:
    """Without headings at the end: short lines in capitals, or in parentheses of capitals, that belong to what follows."""
    rows = text.split("\n")
    while rows and (not rows[-1].strip() or (len(rows[-1]) <= 80 and re.search("[A-Z]", rows[-1]) and rows[-1] == rows[-1].upper() and not re.search(r"[.;:]$", rows[-1]))):
        rows.pop()
    return "\n".join(rows)


# --- pages with <codesect> and <sourcenote> --------------------------------------------------------

_DASHES = str.maketrans({"–": "-", "—": "-", "\x96": "-"})
_HEADED = re.compile(r"^\s*([0-9A-Z-]+:[0-9A-Z-]+)\s+(.+?)\s*-?\s*$", re.I | re.S)


def codesect_sections(url: str, html: str) -> Iterator[dict]:
    flat = flatten(html)
    heads, bodies, notes = [], [], []
    for tag, _, runs in elements(flat, {"codesect", "sourcenote", "b"}):
        text = text_of(runs, bold=tag == "codesect")
        if tag == "b" and (m := _HEADED.match(squeeze(text).translate(_DASHES))):
            heads.append((m[1], m[2].rstrip(". -")))
        elif tag == "codesect":
            bodies.append(lines(text))
        elif tag == "sourcenote":
            notes.append((len(bodies), squeeze(text)))
    by = {}
    for k, t in notes:
        by.setdefault(k, t)
    for k, (number, name) in enumerate(heads):
        body = bodies[k] if k < len(bodies) else ""
        yield row(url, number, name, body or ("Repealed." if "repealed" in name.lower() else ""), ("note", "Source", re.sub(r"^Source\.\s*", "", by.get(k + 1, ""))))


# --- pages whose sections start with a bold or plain "§ n. Name" ------------------------------------

_SIGN = re.compile(r"^§+\s*([A-Za-z0-9.\-]+?)\.\s*(.*)$", re.S)
_HISTORY = re.compile(r"^(added|amended|formerly|repealed|renumbered|transferred)\b", re.I)


def sign_sections(url: str, html: str) -> Iterator[dict]:
    """Paragraphs between section headings; those that start with a history word, or follow "History of Section.", are notes."""
    current, body, notes, sticky = None, [], [], False
    for tag, _, runs in elements(flatten(html), {"p", "b", "h1", "h2", "h3"}):
        if tag.startswith("h"):
            continue
        text = lines(text_of(runs))
        m = _SIGN.match(squeeze(text))
        if m:
            if current and current[0] == m[1]:
                continue  # the heading is told twice
            if current:
                yield row(url, *current, "\n\n".join(body), ("note", "History", "\n".join(notes)))
            current, body, notes, sticky = (m[1], m[2].strip().rstrip(".")), [], [], False
        elif current and text:
            if text.startswith("History of Section."):
                sticky, text = True, text.removeprefix("History of Section.").strip()
            (notes if sticky or _HISTORY.match(text) else body).append(text if sticky or _HISTORY.match(text) else lines(text_of(runs, bold=True)))
    if current:
        yield row(url, *current, "\n\n".join(body), ("note", "History", "\n".join(notes)))


# --- index pages -----------------------------------------------------------------------------------

_KINDS = re.compile(r"^(title|chapter|section|part|article)\s*:?\s*([0-9A-Za-z.:\-]+)\s*[:.]?\s*(.*)$", re.I | re.S)


def index_links(url: str, html: str) -> Iterator[dict]:
    """Links of an index page that name a title, chapter or section, resolved against the page; first of equal targets."""
    from urllib.parse import urldefrag, urljoin

    seen = set()
    for _, attrs, runs in elements(flatten(html), {"a"}):
        m = _KINDS.match(squeeze(text_of(runs)))
        href = attrs.get("href")
        if m and href:
            target = urldefrag(urljoin(url, href.strip()))[0]
            if target not in seen:
                seen.add(target)
                yield {"url": url, "kind": m[1].lower(), "number": m[2].rstrip(":."), "name": m[3].strip(), "href": target}


def version_of(html: str, patterns: tuple[str, ...] = (r"current\s+through\s+(\d{4})", r"Search\s+the\s+(\d{4})\s+General\s+Laws", r"actions\s+of\s+the\s+(\d{4})\s+session")) -> str:
    """Version marker of a landing page, else ``undated-`` and the FNV-1a hash of the page."""
    plain = squeeze(text_of(flatten(html).runs))
    for p in patterns:
        if m := re.search(p, plain, re.I):
            return m[1]
    return f"undated-{fnv1a64((html or '').encode()):x}"


def fnv1a64(data: bytes) -> int:
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 % (1 << 64)
    return h


#: Source code -> reader of its section pages.
READERS: dict[str, Callable[[str, str], Iterator[dict]]] = {"cgs": catchline_sections, "nh": codesect_sections, "rigl": sign_sections, "vt": sign_sections}


def parse_pages(pages: DataFrame, source: str) -> DataFrame:
    """Section rows of (url, html) pages of a source. Null and empty pages have none."""
    return _map(pages, READERS[source], SECTION)


def parse_links(pages: DataFrame) -> DataFrame:
    return _map(pages, index_links, LINK)


def _map(pages: DataFrame, reader: Callable[[str, str], Iterator[dict]], schema: str) -> DataFrame:
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [r for u, h in zip(b["url"], b["html"]) if h for r in reader(u, h)]
            if found:
                yield pd.DataFrame(found)

    return pages.select("url", "html").mapInPandas(parse, schema)


TOC = "url string, target string, number string, name string"


def toc_entries(url: str, html: str) -> Iterator[dict]:
    """Entries of a chapter page's own table of contents: the section that each link leads to, and its catch-line."""
    seen = set()
    for _, attrs, runs in elements(flatten(html), {"p"}):
        if "toc_" not in attrs.get("class", ""):
            continue
        link = next((a for _, c in runs for _, t, a in c if t == "a" and a.get("href", "").startswith("#")), None)
        m = _CATCH.match(squeeze(text_of(runs)))
        if link and m and link["href"] not in seen:
            seen.add(link["href"])
            yield {"url": url, "target": link["href"][1:], "number": m[1], "name": m[2].strip().rstrip(".")}


def parse_toc(pages: DataFrame) -> DataFrame:
    return _map(pages, toc_entries, TOC)


def parse_versions(pages: DataFrame) -> DataFrame:
    """(url, version) of landing pages."""
    return _map(pages, lambda url, html: [{"url": url, "version": version_of(html)}], "url string, version string")


def section_range(sections: DataFrame, start: int, end: int) -> DataFrame:
    """Sections [start, end) of each page, in the page's order, with their position."""
    place = Window.partitionBy("url").orderBy("__id")
    return sections.withColumn("__id", F.monotonically_increasing_id()).withColumn("position", F.row_number().over(place) - 1).where((F.col("position") >= start) & (F.col("position") < end)).drop("__id")
