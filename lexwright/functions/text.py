"""Text shaping for retrieval: whitespace, truncation, chunks, headings, numerals and casing. All native expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as JavaScript and Rust see it, spelled out because Java's \s is ASCII only.
WS = r"[\s\x0B\u0085   -     　﻿]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def collapse_whitespace(c: Column) -> Column:
    return strip(F.regexp_replace(c, f"{WS}+", " "))


def truncate_chars(c: Column, most: int) -> Column:
    """Cut at ``most`` characters, strip, and add three dots; shorter texts stay."""
    return once(c, lambda v: F.when(F.length(v) <= most, v).otherwise(F.concat(strip(F.substring(v, 1, most)), F.lit("..."))))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once; a lambda would compute what it captures for every element."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def chunks(c: Column, size: int, most: int | None = None) -> Column:
    """Array of consecutive pieces of ``size`` characters, stripped, empty ones left out; at most ``most`` of them are cut."""
    return once(c, lambda v: _chunks(v, size, most))


def _chunks(c: Column, size: int, most: int | None) -> Column:
    n = F.ceil(F.length(c) / size).cast("int")
    if most:
        n = F.least(n, F.lit(most))
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(F.transform(at, lambda i: strip(F.substring(c, i * size + 1, F.lit(size)))), lambda x: x != "")


def heading(citation: Column, name: Column, joint: str) -> Column:
    """The given parts, without null and empty ones."""
    return F.concat_ws(joint, F.when(citation != "", citation), F.when(name != "", name))


def under_heading(head: Column, body: Column) -> Column:
    return F.when(head != "", F.concat(head, F.lit("\n\n"), body)).otherwise(body)


def quick_text(citation: Column, name: Column, body: Column, most: int = 1400) -> Column:
    return truncate_chars(collapse_whitespace(under_heading(heading(citation, name, " - "), body)), most)


def tool_chunks(citation: Column, name: Column, body: Column, size: int = 1200, most: int = 3) -> Column:
    return chunks(collapse_whitespace(under_heading(heading(citation, name, "\n"), body)), size, most)


def block_text(blocks: Column) -> Column:
    """Content of an array of {type, label, content}: labels prefixed, empty blocks left out, blank lines between."""
    each = F.transform(
        F.filter(blocks, lambda b: F.coalesce(b["content"], F.lit("")) != ""),
        lambda b: F.when(F.coalesce(b["label"], F.lit("")) != "", F.concat(b["label"], F.lit(": "), b["content"])).otherwise(b["content"]),
    )
    return F.array_join(each, "\n\n")


def limit_tokens(c: Column, most: int) -> Column:
    """The first ``most`` words by white space, single-spaced."""
    return F.array_join(F.slice(F.filter(F.split(c, f"{WS}+"), lambda w: w != ""), 1, most), " ")


def capitalize_first(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 30))


def capitalize_words(c: Column) -> Column:
    """Each space-separated word with a capital first letter and the rest in lower case."""
    return F.array_join(F.transform(F.split(c, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))), " ")


def pluralize(count: Column, singular: str, plural: str | None = None) -> Column:
    return F.when(count == 1, singular).otherwise(plural or singular + "s")


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, r"(?is)<[^>]+>", " ")


def normalize_html_text(c: Column) -> Column:
    """Named entities for blanks, dashes and ampersands decoded, white space collapsed."""
    for entity, plain in (("&nbsp;", " "), (" ", " "), ("&amp;", "&"), ("&#150;", "-"), ("&mdash;", "-"), ("&ndash;", "-")):
        c = F.replace(c, F.lit(entity), F.lit(plain))
    return collapse_whitespace(c)


def normalize_body(c: Column) -> Column:
    """Unix line ends, plain blanks, stripped lines, no triple line ends, and no leading "Section X." """
    c = F.regexp_replace(c, r"\r\n?", "\n")
    c = F.translate(c, "  ", "  ")
    c = F.array_join(F.transform(F.split(c, "\n"), strip), "\n")
    c = strip(F.replace(c, F.lit("\n\n\n"), F.lit("\n\n")))
    return F.regexp_replace(c, r"^Section\s+[0-9]+[A-Za-z]*\.\s*", "")


def congress_years(congress: Column) -> Column:
    start = 1787 + 2 * congress
    return F.concat(start.cast("string"), F.lit("–"), (start + 1).cast("string"))


def extract_json(c: Column) -> Column:
    """The text from the first { to the last }, if it is an object; else null."""
    a, b = F.instr(c, "{"), F.length(c) - F.instr(F.reverse(c), "}") + 1
    body = F.substring(c, a, b - a + 1)
    ok = (a > 0) & (F.instr(c, "}") > 0) & (b > a)
    return F.when(ok & F.try_parse_json(body).isNotNull(), body)


def agent_action(c: Column) -> Column:
    """Struct (type, answer, tool, args) of what a model answered: a final answer or the call of a tool; null for anything else."""
    v = F.try_parse_json(extract_json(c))
    get = lambda path, kind="string": F.try_variant_get(v, path, kind)
    kind = get("$.type")
    empty = F.lit(None).cast("string")
    answer = F.struct(kind.alias("type"), F.coalesce(get("$.answer"), F.lit("")).alias("answer"), empty.alias("tool"), empty.alias("args"))
    tool = F.struct(kind.alias("type"), empty.alias("answer"), F.coalesce(get("$.tool"), F.lit("")).alias("tool"), F.coalesce(F.to_json(F.try_variant_get(v, "$.args", "variant")), F.lit("{}")).alias("args"))
    return F.when(kind == "final", answer).when(kind == "tool", tool)


def volume_metadata(c: Column) -> Column:
    """Struct of a volume's package, volume, congress, session, date_issued and last_modified, joined by bars; null for fewer than six."""
    parts = F.split(c, r"\|")
    number = lambda k, otherwise: F.coalesce(F.get(parts, F.lit(k)).try_cast("int"), F.lit(otherwise))
    at = lambda k: F.get(parts, F.lit(k))
    out = F.struct(at(0).alias("package_id"), number(1, 0).alias("volume"), number(2, 0).alias("congress"), number(3, 1).alias("session"), at(4).alias("date_issued"), at(5).alias("last_modified"))
    return F.when(F.size(parts) >= 6, out)
