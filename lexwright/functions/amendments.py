"""Amendment instructions: from their sentences to a list of edits.

Quoted matter is taken out first and stands as numbered tokens, so the sentence that is
left has a small fixed vocabulary and is read by patterns.  A list of sub-instructions
becomes one edit each, with the places named above it inherited.
"""

from __future__ import annotations

import re

from lexwright.functions.outline import KINDS, leading_labels

_QUOTE = re.compile(r"“[^“”]*(?:\n\s*“[^“”]*)*”")
_KIND = "|".join(KINDS)
_IDS = r"(?:\([A-Za-z0-9]+\))+"
_Q = r"⟦(\d+)⟧"
_PLACE = rf"({_KIND})s? ({_IDS})"
#: Ordinals of the grammar (fixed values).
ORDINALS = ("first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth")
_MARKS = {"period": ".", "semicolon": ";", "comma": ","}
START = re.compile(
    r"^(?:\([A-Za-z0-9]+\)\s*)*(?:[A-Z0-9 .;(),\-]+\.—)?\s*(?:Section \d|(?:Subsection|Paragraph|Subparagraph|Clause|Subclause|Item|Subitem) \(|The (?:\w+ sentence of|heading (?:for|of)|[A-Z]))"
)


def ids(text: str) -> list[str]:
    return re.findall(r"\(([A-Za-z0-9]+)\)", text)


def named_path(kind: str, labels: list[str]) -> list[tuple[str, str]]:
    """Labels from the named kind downwards."""
    k = KINDS.index(kind)
    return [(KINDS[min(k + i, len(KINDS) - 1)], x) for i, x in enumerate(labels)]


def merge(base: list, more: list) -> list:
    """The base without its levels at or below the first new one, then the new ones."""
    if not more:
        return base
    first = KINDS.index(more[0][0])
    return [p for p in base if KINDS.index(p[0]) < first] + more


def spans(paragraphs: list[str]) -> list[tuple[int, int]]:
    """(first, last) of each instruction in a bill: from a paragraph that starts one to the end of its quoted or lettered list."""
    out, i = [], 0
    while i < len(paragraphs):
        head = paragraphs[i]
        if not (START.match(head) and re.search(r"\bamended\b", (head + "\n" + "\n".join(paragraphs[i + 1 : i + 3]))[:700])):
            i += 1
            continue
        j, open_ = i, head.count("“") > head.count("”")
        listed = bool(re.search(r"—\s*$", head))
        while j + 1 < len(paragraphs):
            nxt = paragraphs[j + 1]
            quoted = nxt.lstrip().startswith("“")
            if not (open_ and quoted) and not (re.search(r"follows:\s*$|following[^.;]*:\s*$", paragraphs[j]) and quoted):
                if not (listed and leading_labels(nxt) and not (START.match(nxt) and re.search(r"\bis (?:further )?amended", nxt))):
                    break
            j += 1
            text = "\n".join(paragraphs[i : j + 1])
            open_ = quoted and not re.search(r"”[.;,]?(?: and)?\s*$", nxt)
            listed = listed and not re.search(r"\.\s*$", _QUOTE.sub("q", text)) or bool(re.search(r"—\s*$", nxt))
        out.append((i, j))
        i = j + 1
    return out


def target_of(head: str) -> dict | None:
    """Title, section and path that a head names: its U.S.C. citation first, else its own section and code."""
    if m := re.search(rf"(\d+[A-Z]?) U\.?S\.?C\.? (\d+[A-Za-z0-9–-]*)\s?({_IDS})?( note)?", head):
        return None if m[4] else {"title": m[1], "section": m[2].replace("–", "-"), "path": named_path("subsection", ids(m[3] or ""))}
    m = re.search(rf"[Ss]ection (\d+[A-Za-z0-9–-]*)\s?({_IDS})?", head)
    title = re.search(r"title (\d+), United States Code", head)
    title = title[1] if title else "26" if "Internal Revenue Code" in head or "such Code" in head else None
    if not m or not title:
        return None
    path = named_path("subsection", ids(m[2] or ""))
    if p := re.match(rf"\s*(?:\([A-Za-z0-9]+\)\s*)*({'|'.join(k.capitalize() for k in KINDS)}) ({_IDS})", head):
        path = merge(path, named_path(p[1].lower(), ids(p[2])))
    return {"title": title, "section": m[1].replace("–", "-"), "path": path}


def unquote(text: str) -> str:
    """Quoted matter without the quote marks at the ends of its lines."""
    return "\n".join(re.sub(r"^\s*“|”\s*$", "", x).strip() for x in text.split("\n")).strip()


def expand(kind: str, listed: str) -> list[tuple[str, str]]:
    """(kind, label) of a plural: ``(2) and (3)``, ``(2) through (5)``."""
    labels = ids(listed)
    if "through" in listed and len(labels) == 2:
        a, b = labels
        if a.isdigit() and b.isdigit():
            labels = [str(x) for x in range(int(a), int(b) + 1)]
        elif len(a) == len(b) == 1:
            labels = [chr(x) for x in range(ord(a), ord(b) + 1)]
    return [(kind, x) for x in labels]


def _where(text: str) -> tuple[dict, str]:
    """Places that a clause names before its verbs, and the rest."""
    found: dict = {}
    while True:
        if m := re.match(rf"\s*,?\s*in {_PLACE}(?:[^,—⟦]*? of {_PLACE})?(?:, as (?:so )?\w+(?: by [^,]*)?,| \(as [^)]*\))?\s*(?:,|—|$)\s*", text):
            more = named_path(m[1], ids(m[2]))
            found["path"] = merge(found.get("path", []), (named_path(m[3], ids(m[4])) if m[3] else []) + more)
        elif m := re.match(rf"\s*,?\s*in the ({'|'.join(ORDINALS)}|last) sentence\s*(?:of {_PLACE}\s*)?(?:,|—|$)\s*", text):
            found["sentence"] = -1 if m[1] == "last" else ORDINALS.index(m[1])
            if m[2]:
                found["path"] = merge(found.get("path", []), named_path(m[2], ids(m[3])))
        elif m := re.match(rf"\s*,?\s*in the matter (preceding|following) {_PLACE}\s*(?:,|—|$)\s*", text):
            found["matter"] = [m[1], *named_path(m[2], ids(m[3]))[-1:]]
        elif m := re.match(r"\s*,?\s*in the (?:\w+ )?heading(?: of [^,]*| thereof)?\s*(?:,|—|$)\s*", text):
            found["heading"] = True
        else:
            return found, text
        text = text[m.end() :]


def _edits(text: str, quotes: list[str]) -> list[dict]:
    q = lambda k: quotes[int(k)]
    inserted = lambda m, g: q(m[g]) if m[g] else None
    new = rf"(?: the following[^:⟦]*:?)?\s*{_Q}"
    forms = (
        (rf"striking {_Q} and all that follows(?: through (?:{_Q}|(the period(?: at the end)?)|the end(?: of [^,;]*?)?))?(?: and inserting:?{new})?", lambda m: {"op": "strike", "text": q(m[1]), "through": inserted(m, 2) or ("." if m[3] else None), "to_end": not m[2] and not m[3], "insert": inserted(m, 4)}),
        (rf"striking {_Q}(?:,? (?:in )?(each place it appears|each place such term appears|both places it appears))?( at the end)?(?: and inserting:?{new})?", lambda m: {"op": "strike", "text": q(m[1]), "each": bool(m[2]), "last": bool(m[3]), "insert": inserted(m, 4)}),
        (rf"striking the (period|semicolon|comma)(?: at the end)?(?: of {_PLACE})?(?: and inserting(?: a (period|semicolon|comma)|:?{new}))?", lambda m: {"op": "strike", "text": _MARKS[m[1]], "last": True, "insert": _MARKS[m[4]] if m[4] else inserted(m, 5), "path": named_path(m[2], ids(m[3])) if m[2] else []}),
        (rf"striking the ({'|'.join(ORDINALS)}|last) sentence(?: and inserting:?{new})?", lambda m: {"op": "strike_sentence", "n": -1 if m[1] == "last" else ORDINALS.index(m[1]), "insert": inserted(m, 2)}),
        (rf"striking ({_KIND})s? ((?:{_IDS}(?:(?:, and |, | and | through |[-–])(?=\())?)+)(?: of {_PLACE})?(?: and inserting:?{new})?", lambda m: {"op": "strike_nodes", "nodes": [named_path(m[1], ids(m[2]))] if re.fullmatch(_IDS, m[2].strip()) else [[x] for x in expand(m[1], m[2])], "insert": inserted(m, 5), "path": named_path(m[3], ids(m[4])) if m[3] else []}),
        (rf"inserting {_Q}(?:,)? (after|before) (?:{_Q}|the (period|semicolon|comma)(?: at the end)?)( each place it appears)?", lambda m: {"op": "insert", "insert": q(m[1]), "side": m[2], "text": q(m[3]) if m[3] else _MARKS[m[4]], "last": bool(m[4]), "each": bool(m[5])}),
        (rf"(?:inserting|adding) (after|before) ({_KIND}) ({_IDS})(?: \([^)]*\))?,?{new}", lambda m: {"op": "insert_node", "side": m[1], "node": named_path(m[2], ids(m[3])), "insert": q(m[4])}),
        (rf"adding at the end{new}", lambda m: {"op": "append", "insert": q(m[1])}),
        (rf"(?:adding|inserting) {_Q} at the end(?: of {_PLACE})?", lambda m: {"op": "append", "insert": q(m[1]), "inline": True, "path": named_path(m[2], ids(m[3])) if m[2] else []}),
        (rf"redesignating ({_KIND})s? ((?:{_IDS}(?:(?:, and |, | and | through )(?=\())?)+)(?:[^⟦]*?) as ({_KIND})s? ((?:{_IDS}(?:(?:, and |, | and | through )(?=\())?)+)", lambda m: {"op": "redesignate", "pairs": [[a, b] for a, b in zip(expand(m[1], m[2]), expand(m[3], m[4]))]}),
        (rf"moving ({_KIND})s? ((?:{_IDS}(?:(?:, and |, | and | through )(?=\())?)+)(?:,? so as)? to (?:appear|follow) ?(after|before)? ({_KIND}) ({_IDS})", lambda m: {"op": "move", "nodes": [[x] for x in expand(m[1], m[2])], "side": m[3] or "after", "node": named_path(m[4], ids(m[5]))}),
        (rf"amending ({_KIND}) ({_IDS}) to read as follows:\s*{_Q}", lambda m: {"op": "rewrite", "path": named_path(m[1], ids(m[2])), "insert": q(m[3])}),
        (rf"to read as follows:\s*{_Q}", lambda m: {"op": "rewrite", "insert": q(m[1])}),
    )
    found, taken = [], []
    for pattern, make in forms:
        for m in re.finditer(pattern, text):
            if all(m.end() <= a or b <= m.start() for a, b in taken):
                taken.append((m.start(), m.end()))
                found.append((m.start(), make(m)))
    return [e for _, e in sorted(found, key=lambda x: x[0])]


def parse(text: str) -> dict | None:
    """{title, section, edits, unread}: edits carry path, sentence, matter and heading places; null if no target is named."""
    quotes: list[str] = []

    def take(m: re.Match) -> str:
        quotes.append(unquote(m[0]))
        return f"⟦{len(quotes) - 1}⟧"

    masked = _QUOTE.sub(take, text)
    m = re.search(r"\b(?:is|are)(?: further)? amended\b", masked)
    if not m:
        return None
    target = target_of(masked[: m.start()])
    if not target:
        return None
    head, _, rest = masked[m.end() :].partition("\n")
    if re.search(r"[:⟧—]\s*$", head) and not head.rstrip().endswith("—"):
        head, rest = masked[m.end() :], ""
    edits, unread = [], []
    places = [(-1, {"path": target["path"]})]

    def leaf(level: int, clause: str) -> None:
        while places and places[-1][0] >= level:
            places.pop()
        where, body = _where(clause)
        above = places[-1][1]
        here = {**above, **where, "path": merge(above["path"], where.get("path", []))}
        if re.search(r"—\s*$", clause):
            places.append((level, here))
            return
        got = _edits(body, quotes)
        if not got and body.strip(" ,;.") not in ("", "and"):
            unread.append(body.strip())
        for e in got:
            edits.append({**{k: v for k, v in here.items() if k != "path"}, **e, "path": merge(here["path"], e.get("path", []))})

    leaf(0, head.rstrip("\n"))
    levels: list[str] = []
    for line in filter(str.strip, rest.split("\n")):
        labels = leading_labels(line)
        if not labels:
            leaf(len(levels) + 1, line)
            continue
        form = "1" if labels[0].isdigit() else "i" if re.fullmatch("[ivx]+", labels[0]) and levels and levels[-1] in ("A", "i") else "I" if re.fullmatch("[IVX]+", labels[0]) and "i" in levels else "A" if labels[0].isupper() else "a"
        levels = levels[: levels.index(form)] + [form] if form in levels else levels + [form]
        leaf(len(levels), re.sub(r"^(?:\([A-Za-z0-9]+\)\s*)+", "", line.strip()))
    return {"title": target["title"], "section": target["section"], "edits": edits, "unread": unread}
