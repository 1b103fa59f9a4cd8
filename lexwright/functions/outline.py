"""Section bodies as documents: plain text with spans, and the outline that its markers make."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

KINDS = ("subsection", "paragraph", "subparagraph", "clause", "subclause", "item", "subitem")
RANK = {k: i + 1 for i, k in enumerate(KINDS)}
_LABELS = re.compile(r"(?:\*\*)?\(([A-Za-z0-9]{1,6})\)(?:\*\*)?\s*")
_MARK = re.compile(r"\*\*|\[([^\]]*)\]\(([^)]*)\)")


@dataclass
class Node:
    kind: str
    label: str
    path: tuple[tuple[str, str], ...]
    start: int
    end: int
    indent: int
    children: list[int] = field(default_factory=list)

    @property
    def id(self) -> str:
        return "/".join(f"{k}:{v}" for k, v in self.path)


@dataclass
class Paragraph:
    start: int
    end: int
    depth: int
    labels: list[str]


def plain(markdown: str) -> tuple[str, list[tuple[int, int, str, str | None]], list[int]]:
    """(text, spans, quote depth of each line): quote marks, bold marks and link targets taken out.

    Spans are (start, end, "bold" | "link", target) over the plain text.
    """
    out, spans, depths, at = [], [], [], 0
    for line in (markdown or "").split("\n"):
        m = re.match(r"(?:>\s?)*", line)
        depths.append(m[0].count(">"))
        rest, pieces, last, bold = line[m.end() :], [], 0, None
        for t in _MARK.finditer(rest):
            pieces.append(rest[last : t.start()])
            here = at + sum(map(len, pieces))
            if t[0] == "**":
                if bold is None:
                    bold = here
                else:
                    spans.append((bold, here, "bold", None))
                    bold = None
            else:
                pieces.append(t[1])
                spans.append((here, here + len(t[1]), "link", t[2]))
            last = t.end()
        pieces.append(rest[last:])
        text = "".join(pieces)
        out.append(text)
        at += len(text) + 1
    return "\n".join(out), spans, depths


def leading_labels(line: str) -> list[str]:
    """Labels of the run of markers that a line starts with: ``(a)(1) Text`` gives a and 1."""
    out, at = [], 0
    while m := _LABELS.match(line, at):
        out.append(m[1])
        at = m.end()
    return out


def kind_of(label: str, previous: str | None, hint: int) -> str:
    """Level of a marker from its form and the level before it (or its indentation, where none is)."""
    rank = RANK.get(previous or "", 0)
    deep = rank >= RANK["subclause"]
    if label.isdigit():
        return "paragraph"
    if re.fullmatch("[ivxlc]+", label) and (rank >= RANK["subparagraph"] if previous else hint > 1):
        return "clause"
    if re.fullmatch("[IVXLCDM]+", label) and (rank >= RANK["clause"] if previous else hint > 3):
        return "subclause"
    if label.islower():
        return "item" if deep or len(label) > 1 or (not previous and hint > 5) else "subsection"
    if label.isupper():
        return "item" if len(label) > 1 and (deep or hint > 5) else "subparagraph"
    return "item"


def outline(text: str, depths: list[int] | None = None) -> list[Node]:
    """Nodes in order of their starts. A node ends where a later one of its rank or above starts."""
    nodes: list[Node] = []
    stack: list[int] = []
    at, previous = 0, None
    for k, line in enumerate(text.split("\n")):
        labels = leading_labels(line)
        hint = depths[k] if depths and k < len(depths) else 0
        for i, label in enumerate(labels):
            kind = kind_of(label, previous if i == 0 or not stack else nodes[stack[-1]].kind, hint + i)
            if i == 0 and stack and kind == "subsection" and re.fullmatch("[ivx]+", label) and any(nodes[s].kind in ("subparagraph", "clause") for s in stack) and label != _after(next((nodes[s].label for s in stack if nodes[s].kind == "subsection"), "")):
                kind = "clause"
            while stack and RANK[nodes[stack[-1]].kind] >= RANK[kind]:
                nodes[stack.pop()].end = max(at - 1, 0)
            path = (*(nodes[stack[-1]].path if stack else ()), (kind, label))
            nodes.append(Node(kind, label, path, at, len(text), hint + i))
            if stack:
                nodes[stack[-1]].children.append(len(nodes) - 1)
            stack.append(len(nodes) - 1)
            previous = kind
        at += len(line) + 1
    return nodes


def _after(label: str) -> str:
    return chr(ord(label) + 1) if len(label) == 1 and label < "z" else ""


def resolve(nodes: list[Node], path: list[tuple[str | None, str]]) -> list[int]:
    """Nodes that a path of (kind, label) leads to: children first, else descendants; by kind and label, else by label alone."""
    roots = [i for i, n in enumerate(nodes) if len(n.path) == 1]
    here, pool = None, roots
    for kind, label in path:
        near = [i for i in pool if nodes[i].label == label]
        if not near:
            near = [i for i, n in enumerate(nodes) if n.label == label and (here is None or nodes[here].start <= n.start < max(nodes[here].end, nodes[here].start + 1) and i != here)]
        exact = [i for i in near if kind is None or nodes[i].kind == kind] or near
        if len(exact) != 1:
            return exact
        here = exact[0]
        pool = nodes[here].children
    return [] if here is None else [here]
