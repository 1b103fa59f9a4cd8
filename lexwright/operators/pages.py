"""Bill pages: placed text items to lines, and lines to paragraphs.

Items and lines of a document are a sequence with state that crosses pages (line-number
column, running paragraph), so a document is one group; documents are independent.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from statistics import median

import pandas as pd
from pyspark.sql import DataFrame

LINES = "doc_id string, line int, page int, y double, x_start double, x_end double, height double, bold boolean, text string"
PARAGRAPHS = "doc_id string, paragraph int, first_line int, last_line int, start_page int, end_page int, level int, bold boolean, text string"
#: Left edges of the indentation levels of bill text (fixed values), in points.
INDENTS = (171, 191, 211, 231, 251, 271, 291, 311)
_MARKER = re.compile(r"^[“‘\"]?\(([A-Za-z0-9]{1,5})\)")
_HEADER = re.compile(r"^(?:TITLE|Subtitle|SUBTITLE|CHAPTER|Chapter|PART|Part|DIVISION|SEC\.|SECTION)\b")


@dataclass
class Line:
    page: int
    y: float
    x: float
    end: float
    height: float
    bold: bool
    text: str


def indent_level(x: float) -> int:
    return sum(x >= b for b in INDENTS)


def join_items(items: list[tuple]) -> str:
    """Text of items (x, width, height, text) from left to right; a gap of over 0.24 of the height is a blank."""
    out, end = "", None
    for x, width, height, text in items:
        if end is not None and x - end > 0.24 * height and not out.endswith(" ") and not text.startswith(" "):
            out += " "
        out += text
        end = x + width
    return re.sub(r"``|''", '"', re.sub(r"\s+", " ", out)).strip()


def lines_of(pages: dict[int, list[tuple]]) -> list[Line]:
    """Items (x, y, width, height, bold, text) by page to lines: items whose y differ by at most 0.45 of the median height.

    A column of line numbers (1 to 25 at one place on the left, each one more than the last)
    is taken off; confidence in its place falls by half on each page that lacks it.
    """
    out, column, trust = [], None, 0.0
    for page in sorted(pages):
        items = [i for i in pages[page] if i[5].strip()]
        if not items:
            continue
        near = 0.45 * median(i[3] for i in items)
        rows: list[list[tuple]] = []
        for i in sorted(items, key=lambda i: (-i[1], i[0])):
            if rows and abs(rows[-1][0][1] - i[1]) <= near:
                rows[-1].append(i)
            else:
                rows.append([i])
        heads = [(r, min(r, key=lambda i: i[0])) for r in rows]
        numbered = [(r, h) for r, h in heads if re.fullmatch(r"\d{1,2}", h[5].strip()) and 1 <= int(h[5]) <= 25 and len(r) > 1]
        if len(numbered) >= 3:
            column, trust = median(h[0] for _, h in numbered), 1.0
        else:
            trust /= 2
        for r in rows:
            r.sort(key=lambda i: i[0])
            if column is not None and trust >= 0.25 and re.fullmatch(r"\d{1,2}", r[0][5].strip()) and abs(r[0][0] - column) <= 12 and len(r) > 1:
                r = r[1:]
            text = join_items([(i[0], i[2], i[3], i[5]) for i in r])
            if text:
                out.append(Line(page, median(i[1] for i in r), r[0][0], r[-1][0] + r[-1][2], max(i[3] for i in r), sum(len(i[5]) for i in r if i[4]) * 2 > sum(len(i[5]) for i in r), text))
    return out


def paragraphs_of(lines: list[Line]) -> list[list[int]]:
    """Runs of lines that belong together; the first rule that speaks decides."""
    if not lines:
        return []
    ends = sorted(line.end for line in lines)
    full = ends[math.floor((len(ends) - 1) * 0.75)]
    centre = median((line.x + line.end) / 2 for line in lines)
    out, depth = [[0]], 0
    for k in range(1, len(lines)):
        a, b = lines[k - 1], lines[k]
        depth = max(0, depth + a.text.count("“") - a.text.count("”"))
        out[-1].append(k) if not _breaks(a, b, len(out[-1]), full, centre, depth) else out.append([k])
    return out


def _breaks(a: Line, b: Line, so_far: int, full: float, centre: float, depth: int) -> bool:
    head_a = bool(_HEADER.match(a.text)) or (a.text.isupper() and abs((a.x + a.end) / 2 - centre) < 20)
    if _HEADER.match(b.text) and (abs((b.x + b.end) / 2 - centre) < 40 or b.text.startswith("SEC")):
        return True
    if a.text.startswith("SEC") and a.text.isupper() and not b.text.isupper():
        return True
    if re.search(r"\.{6,}", a.text):
        return True
    marked = bool(_MARKER.match(b.text))
    if re.search(r"[:—]$", a.text) and marked:
        return True
    if a.end < full - 8 and not head_a:
        return True
    step = indent_level(b.x) - indent_level(a.x)
    if step >= 1 and not head_a:
        return True
    if step <= -2 or (step == -1 and so_far > 1):
        return True
    if a.text.startswith("“") and b.text.startswith("“") and depth >= 1:
        return True
    return bool(re.search(r"[.;]$|[.;] (?:and|or)$", a.text) and marked)


def join_lines(texts: list[str], words: frozenset[str] = frozenset()) -> str:
    from lexwright.functions.anchors import drops_hyphen

    out = ""
    for t in texts:
        if out.endswith("-") and out[-2:-1].isalpha():
            out = out[:-1] + t if drops_hyphen(out, t, words) else out + t
        else:
            out = f"{out} {t}" if out else t
    return out


def extract_lines(items: DataFrame) -> DataFrame:
    """(doc_id, page, x, y, width, height, bold, text) items to lines."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pages: dict[int, list] = {}
        for r in pdf.itertuples():
            pages.setdefault(int(r.page), []).append((r.x, r.y, r.width, r.height, bool(r.bold), r.text or ""))
        d = str(pdf["doc_id"].iloc[0])
        rows = [(d, k, x.page, x.y, x.x, x.end, x.height, x.bold, x.text) for k, x in enumerate(lines_of(pages))]
        return pd.DataFrame(rows, columns=[c.strip().split()[0] for c in LINES.split(",")])

    return items.groupBy("doc_id").applyInPandas(run, LINES)


def extract_paragraphs(lines: DataFrame, words: frozenset[str] = frozenset()) -> DataFrame:
    """Lines to paragraphs; level is the indentation of the first line, bold if most of its lines are."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("line")
        ls = [Line(int(r.page), r.y, r.x_start, r.x_end, r.height, bool(r.bold), r.text) for r in pdf.itertuples()]
        d = str(pdf["doc_id"].iloc[0])
        rows = []
        for k, run_ in enumerate(paragraphs_of(ls)):
            own = [ls[i] for i in run_]
            rows.append((d, k, run_[0], run_[-1], own[0].page, own[-1].page, indent_level(own[0].x), sum(x.bold for x in own) * 2 > len(own), join_lines([x.text for x in own], words)))
        return pd.DataFrame(rows, columns=[c.strip().split()[0] for c in PARAGRAPHS.split(",")])

    return lines.groupBy("doc_id").applyInPandas(run, PARAGRAPHS)
