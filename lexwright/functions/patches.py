"""Patches of a text: choosing, applying and showing them, and the searches that find their places."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

Patch = tuple[int, int, str]  # start, end, new text


def overlap(a: Patch, b: Patch) -> bool:
    """Whether two patches touch the same characters; insertions at one place don't."""
    return a[0] < b[1] and b[0] < a[1] or (a[0] == b[0] and a[1] == b[1] and a[0] < a[1])


def choose(patches: Iterable[Patch]) -> list[Patch]:
    """The patches that no earlier chosen one overlaps, in their order."""
    out: list[Patch] = []
    for p in patches:
        if not any(overlap(p, q) for q in out):
            out.append(p)
    return out


def move(text: str, ranges: list[tuple[int, int]], at: int) -> str | None:
    """The text with the ranges, in their order, moved to a place; null if the place lies inside one of them."""
    if any(a < at < b for a, b in ranges):
        return None
    moved = "".join(text[a:b] for a, b in sorted(ranges))
    left, right, last = [], [], 0
    for a, b in [*sorted(ranges), (len(text), len(text))]:
        for lo, hi in ((last, min(a, at)), (max(last, at), a)):
            if lo < hi:
                (left if hi <= at else right).append(text[lo:hi])
        last = b
    return "".join(left) + moved + "".join(right)


class Shown:
    """A text with what was struck and what was inserted; offsets are those of the amended text."""

    def __init__(self, text: str):
        self.parts: list[tuple[str, str]] = [("same", text)] if text else []

    @property
    def text(self) -> str:
        return "".join(t for kind, t in self.parts if kind != "struck")

    def apply(self, patches: Iterable[Patch]) -> None:
        for a, b, new in sorted(patches, reverse=True):
            self._one(a, b, new)

    def _one(self, a: int, b: int, new: str) -> None:
        out, at, done = [], 0, False
        for kind, t in self.parts:
            if kind == "struck":
                out.append((kind, t))
                continue
            lo, hi = max(a - at, 0), min(b - at, len(t))
            # an insertion goes to the first part that reaches its place; a strike to all that it touches
            if not done and (a == b and 0 <= a - at <= len(t) or a < b and lo < hi):
                lo = min(lo, len(t))
                out += [(kind, t[:lo]), *([("struck", t[lo:hi])] if lo < hi and kind == "same" else []), ("inserted", new), (kind, t[max(lo, hi) :])]
                done = True
            elif a < b and lo < hi:
                out += [(kind, t[:lo]), *([("struck", t[lo:hi])] if kind == "same" else []), (kind, t[hi:])]
            else:
                out.append((kind, t))
            at += len(t)
        if not done and new:
            out.append(("inserted", new))
        self.parts = _joined(out)


def _joined(parts: list[tuple[str, str]]) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []
    for kind, t in parts:
        if t and out and out[-1][0] == kind:
            out[-1] = (kind, out[-1][1] + t)
        elif t:
            out.append((kind, t))
    return out


def mark_at_end(text: str, mark: str) -> int:
    """Place of a punctuation mark that ends the text, closing quotes and white space aside; -1 if another one or none does."""
    end = re.search(r"[\s”’\")]*\Z", text).start()
    return end - 1 if end and text[end - 1] == mark else -1


#: A section number of any form, where the number itself may have changed.
_SECTION = re.compile(r"\b(sections?)\s+\d+[0-9A-Za-z.-]*(?:\([0-9A-Za-z]+\))*")


def any_section(needle: str) -> re.Pattern | None:
    """A pattern for a text with its section numbers left open; null for one that names no section."""
    if not _SECTION.search(needle):
        return None
    out, last = [], 0
    for m in _SECTION.finditer(needle):
        out += [r"\s+".join(re.escape(x) for x in re.split(r"\s+", needle[last : m.start()])), re.escape(m[1]) + r"\s+\d+[0-9A-Za-z.-]*(?:\([0-9A-Za-z]+\))*"]
        last = m.end()
    out.append(r"\s+".join(re.escape(x) for x in re.split(r"\s+", needle[last:])))
    return re.compile("".join(out))


def find_loosely(text: str, needle: str) -> tuple[int, int] | None:
    """First place of a text: as it is, in any case, with hyphens left out, or with its section numbers left open."""
    for pattern in (re.escape(needle), "(?i)" + re.escape(needle), "(?i)" + "[-‐]?".join(map(re.escape, re.sub("[-‐]", "", needle)))):
        if needle and (m := re.search(pattern, text)):
            return m.span()
    pattern = any_section(needle)
    m = pattern.search(text) if pattern else None
    return m.span() if m else None


def translate(text: str, codes: Callable[[str], tuple[str, str] | None]) -> str:
    """References to sections of a law as references to the code: ``section 5(a)`` becomes ``section 12(a) of title 7``.

    codes gives (title, section) of a law's section, or null; references that name a title already stay.
    """

    def put(m: re.Match) -> str:
        found = codes(m[2])
        return f"{m[1]} {found[1]}{m[3]} of title {found[0]}" if found else m[0]

    return re.sub(r"\b(section) (\d+[0-9A-Za-z-]*)((?:\([0-9A-Za-z]+\))*)(?![0-9A-Za-z(])(?! of title)", put, text)


def inserted_ranges(text: str, inserted: list[str]) -> list[tuple[int, int] | None]:
    """The first place of each text that no earlier one has taken; null where there is none."""
    used: list[tuple[int, int]] = []
    out: list[tuple[int, int] | None] = []
    for x in inserted:
        found, at = None, text.find(x) if x else -1
        while at >= 0:
            if not any(a < at + len(x) and at < b for a, b in used):
                found = (at, at + len(x))
                break
            at = text.find(x, at + 1)
        if found:
            used.append(found)
        out.append(found)
    return out
