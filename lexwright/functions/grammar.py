"""Parsing by a grammar: all ends of every rule, then the tree of the longest parse.

A grammar is text, a rule a line: ``name = ...`` with "words", /patterns/, other rules,
( ) groups, [ ] optional parts, { } repetitions and | alternatives.  A parse asks for all
places where a rule can end from a start, remembers them, and lets no rule call itself at
the same place (left recursion has no ends).  The tree is then built down to one chosen
end, longest parts first.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import NamedTuple

_TOKEN = re.compile(r'\s*(?:"((?:[^"\\]|\\.)*)"|/((?:[^/\\]|\\.)*)/|([A-Za-z_]\w*)|([()\[\]{}|]))')


class Node(NamedTuple):
    kind: str  # word, pattern, rule, seq, alt, opt, rep
    value: object


class Tree(NamedTuple):
    rule: str
    start: int
    end: int
    children: tuple[Tree, ...]

    def all(self, rule: str) -> list[Tree]:
        """Nodes of a rule in order of the text; none from within another of the same rule."""
        return [self] if self.rule == rule else [x for c in self.children for x in c.all(rule)]


def load(source: str) -> dict[str, Node]:
    """Rules of a grammar; an error for a name that no rule has."""
    rules: dict[str, Node] = {}
    for line in source.splitlines():
        line = line.strip()
        if line and not line.startswith("#"):
            name, _, body = line.partition("=")
            rules[name.strip()] = _read(body)
    missing = {n for r in rules.values() for n in _names(r)} - rules.keys()
    if missing:
        raise ValueError(f"no rules for {sorted(missing)}")
    return rules


def _names(node: Node):
    if node.kind == "rule":
        yield node.value
    elif node.kind in ("seq", "alt"):
        for x in node.value:
            yield from _names(x)
    elif node.kind in ("opt", "rep"):
        yield from _names(node.value)


def _read(body: str) -> Node:
    tokens, at = [], 0
    body = body.rstrip()
    while at < len(body):
        m = _TOKEN.match(body, at)
        if not m:
            raise ValueError(f"can't read {body[at:]!r}")
        tokens.append(m)
        at = m.end()
    node, k = _alternatives(tokens, 0)
    if k != len(tokens):
        raise ValueError(f"unbalanced: {body!r}")
    return node


def _alternatives(tokens: list, k: int) -> tuple[Node, int]:
    found: list[Node] = []
    while True:
        parts: list[Node] = []
        while k < len(tokens) and tokens[k][4] not in ("|", ")", "]", "}"):
            word, pattern, name, mark = tokens[k].groups()
            k += 1
            if mark:
                inner, k = _alternatives(tokens, k)
                if k >= len(tokens) or tokens[k][4] != {"(": ")", "[": "]", "{": "}"}[mark]:
                    raise ValueError(f"{mark} isn't closed")
                k += 1
                parts.append(inner if mark == "(" else Node("opt" if mark == "[" else "rep", inner))
            elif name:
                parts.append(Node("rule", name))
            elif pattern is not None:
                parts.append(Node("pattern", re.compile(pattern)))
            else:
                parts.append(Node("word", word.replace('\\"', '"')))
        found.append(parts[0] if len(parts) == 1 else Node("seq", tuple(parts)))
        if k >= len(tokens) or tokens[k][4] != "|":
            return found[0] if len(found) == 1 else Node("alt", tuple(found)), k
        k += 1


@dataclass
class Parser:
    rules: dict[str, Node]
    text: str
    known: dict[tuple[str, int], tuple[int, ...]] = field(default_factory=dict)
    _open: set[tuple[str, int]] = field(default_factory=set)

    def rule_ends(self, name: str, at: int) -> tuple[int, ...]:
        """All ends of a rule from a place, furthest first."""
        key = (name, at)
        if key in self.known:
            return self.known[key]
        if key in self._open:
            return ()
        self._open.add(key)
        found = tuple(sorted(self.ends(self.rules[name], at), reverse=True))
        self._open.discard(key)
        # what was found while a rule above was open may lack that rule's own ends: kept only if none was
        if not any(p == at for _, p in self._open):
            self.known[key] = found
        return found

    def ends(self, node: Node, at: int) -> set[int]:
        kind, value = node
        if kind == "word":
            return {at + len(value)} if self.text.startswith(value, at) else set()
        if kind == "pattern":
            m = value.match(self.text, at)
            return {m.end()} if m else set()
        if kind == "rule":
            return set(self.rule_ends(value, at))
        if kind == "alt":
            return {e for x in value for e in self.ends(x, at)}
        if kind == "opt":
            return {at} | self.ends(value, at)
        if kind == "seq":
            places = {at}
            for x in value:
                places = {e for p in places for e in self.ends(x, p)}
            return places
        places, edge = {at}, {at}  # any number of times: the closure over ends
        while edge:
            edge = {e for p in edge for e in self.ends(value, p)} - places
            places |= edge
        return places

    def tree(self, name: str, at: int, end: int) -> Tree | None:
        """The rule's tree from one place to another."""
        children = self._build(self.rules[name], at, end)
        return None if children is None else Tree(name, at, end, children)

    def _build(self, node: Node, at: int, end: int) -> tuple[Tree, ...] | None:
        kind, value = node
        if kind in ("word", "pattern"):
            return () if end in self.ends(node, at) else None
        if kind == "rule":
            if end not in self.rule_ends(value, at):
                return None
            found = self.tree(value, at, end)
            return None if found is None else (found,)
        if kind == "alt":
            return next((x for x in (self._build(v, at, end) for v in value if end in self.ends(v, at)) if x is not None), None)
        if kind == "opt":
            return () if at == end else self._build(value, at, end)
        if kind == "rep":
            if at == end:
                return ()
            return self._split([value, node], at, end, least=1)
        return self._split(list(value), at, end)

    def _split(self, nodes: list[Node], at: int, end: int, least: int = 0) -> tuple[Tree, ...] | None:
        if not nodes:
            return () if at == end else None
        first, rest = nodes[0], nodes[1:]
        for middle in sorted(self.ends(first, at), reverse=True):
            if at + least <= middle <= end and (rest or middle == end):
                tail = self._split(rest, middle, end) if rest else ()
                if tail is not None:
                    head = self._build(first, at, middle)
                    if head is not None:
                        return head + tail
        return None


def longest(rules: dict[str, Node], name: str, text: str, starts: list[int]) -> Tree | None:
    """The longest parse of a rule over the starts; of equally long ones the first."""
    p, best = Parser(rules, text), None
    for at in starts:
        for end in p.rule_ends(name, at)[:1]:
            if best is None or end - at > best[1] - best[0]:
                best = at, end
    return None if best is None else p.tree(name, *best)


#: Sentences that amend a section: who is amended, and by what.
AMENDMENT = load(r"""
instruction = place " " verb " " edits "."
place = "Section " number [ids] [" of " act] [note] | kind " " ids " of " place
act = "title " number ", United States Code," | "the " /[A-Z][A-Za-z ]*? Act(?= |,)/ [","]
note = " (" number " U.S.C. " number [ids] ")"
verb = "is amended" | "is further amended" | "is amended in " kind " " ids ","
edits = "by " edit { sep ["by "] edit }
sep = ", and " | "; and " | " and " | ", "
edit = strike | insert | add | redesignate | move
strike = "striking " quoted [each] [" and inserting " quoted]
each = " each place it appears"
insert = "inserting " quoted side quoted
side = " after " | " before "
add = "adding at the end the following: " quoted
redesignate = "redesignating " kind " " ids " as " kind " " ids
move = "moving " kind " " ids " to appear" side kind " " ids
kind = "subsection" | "Subsection" | "paragraph" | "Paragraph" | "subparagraph" | "Subparagraph" | "clause" | "Clause"
ids = id { id }
id = /\([A-Za-z0-9]+\)/
number = /[0-9]+[A-Za-z]*(?:[-–][0-9A-Za-z]+)*/
quoted = /“[^”]*”/
""")


def starts_of(text: str) -> list[int]:
    """Places where an instruction may begin: the head of the text and of each sentence."""
    return [m.end() for m in re.finditer(r"^|(?<=[.”])\s+(?=[A-Z])", text)]
