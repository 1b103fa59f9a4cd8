"""Finding quoted text in statute text that differs in marks which don't matter."""

from __future__ import annotations

import re

_FRACTIONS = {"1/4": "¼", "1/2": "½", "3/4": "¾", "1/3": "⅓", "2/3": "⅔", "1/5": "⅕", "2/5": "⅖", "3/5": "⅗", "4/5": "⅘", "1/6": "⅙", "5/6": "⅚", "1/8": "⅛", "3/8": "⅜", "5/8": "⅝", "7/8": "⅞"}


def find(haystack: str, needle: str, ignore_in_haystack: str = "", ignore_in_needle: str = "", any_case: bool = False) -> tuple[int, str] | None:
    """(index, matched text) of the first place of needle with the ignorable characters left out of each side.

    Leading ignorable characters of the haystack are not part of the match.
    """
    kept = [i for i, c in enumerate(haystack) if c not in ignore_in_haystack]
    a, b = "".join(haystack[i] for i in kept), "".join(c for c in needle if c not in ignore_in_needle)
    if not b:
        return None
    m = re.search(re.escape(b), a, re.I if any_case else 0)
    if not m:
        return None
    start, end = kept[m.start()], kept[m.end() - 1] + 1
    return start, haystack[start:end]


def occurrences(haystack: str, needle: str) -> list[int]:
    """Starts of the non-overlapping places, left to right."""
    return [m.start() for m in re.finditer(re.escape(needle), haystack)] if needle else []


def slash_fractions(text: str) -> str:
    """``1/2`` and the like as single characters, also after a whole number (``2 1/2``); other fractions with a fraction slash."""
    text = text.replace("⁄", "/")

    def one(m: re.Match) -> str:
        return _FRACTIONS.get(m[0], m[0].replace("/", "⁄"))

    return re.sub(r"(?<![\d/])\d{1,2}/\d{1,2}(?![\d/])", one, text)


def drops_hyphen(before: str, after: str, words: frozenset[str]) -> bool:
    """Whether a line-end hyphen goes when lines are joined: the joined word is known, or the parts with the hyphen are not."""
    left = re.search(r"([A-Za-z]+)-$", before.rstrip())
    right = re.match(r"\s*([A-Za-z]+)", after)
    if not left or not right or right[1][0].isupper():
        return False
    whole = (left[1] + right[1]).lower()
    if whole in words:
        return True
    return not (left[1].lower() in words and right[1].lower() in words)
