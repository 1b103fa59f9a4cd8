"""Designators: normal forms, slugs and sort keys of title, chapter and section numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX = 2**31 - 1


def _saturated(c: Column) -> Column:
    return F.least(c, F.lit(MAX).cast("long"))


def sort_order(value: Column) -> Column:
    """Number * 100000 plus the letter suffix in base 27 (a = 1), saturating; the maximum where malformed."""
    number = F.regexp_extract(value, r"^([0-9]+)([A-Za-z]*)$", 1)
    letters = F.filter(F.split(F.lower(F.regexp_extract(value, r"^([0-9]+)([A-Za-z]*)$", 2)), ""), lambda x: x != "")
    tail = F.aggregate(letters, F.lit(0).cast("long"), lambda acc, ch: _saturated(acc * 27 + F.ascii(ch) - 96))
    n = F.try_to_number(number, F.lit("9999999999")).cast("long")
    head = F.when(F.length(number) > 10, F.lit(None).cast("long")).otherwise(n)
    key = _saturated(_saturated(head * 100000) + tail)
    return F.when((number != "") & (head <= MAX), key).otherwise(F.lit(MAX).cast("long")).cast("int")


def normalize_compact(c: Column) -> Column:
    """Upper case without blanks."""
    return F.upper(F.replace(F.trim(c), F.lit(" "), F.lit("")))


def slug(c: Column, keep_dot: bool = False) -> Column:
    """Lower case, other characters than letters, digits, dash (and dot) as dashes, none at the ends."""
    out = F.regexp_replace(F.lower(F.trim(c)), r"[^a-z0-9.\-]+" if keep_dot else r"[^a-z0-9\-]+", "-")
    out = F.regexp_replace(out, r"^-+|-+$", "")
    return F.replace(out, F.lit("--"), F.lit("-")) if keep_dot else out


def strip_zeros(c: Column) -> Column:
    """A designator (number and letters) without leading zeros; null where it isn't one."""
    number, suffix = F.regexp_extract(c, r"^0*([0-9]+)([A-Za-z]*)$", 1), F.regexp_extract(c, r"^0*([0-9]+)([A-Za-z]*)$", 2)
    return F.when(number != "", F.concat(number, suffix))


def padded(c: Column, width: int) -> Column:
    """Number zero-padded to ``width`` (never cut), suffix in lower case; null where it isn't a designator."""
    number, suffix = F.regexp_extract(c, r"^0*([0-9]+)([A-Za-z]*)$", 1), F.lower(F.regexp_extract(c, r"^0*([0-9]+)([A-Za-z]*)$", 2))
    return F.when(number != "", F.concat(F.when(F.length(number) < width, F.lpad(number, width, "0")).otherwise(number), suffix))


def display(c: Column) -> Column:
    return padded(c, 1)


def trim_zeros_for_display(c: Column) -> Column:
    out = F.regexp_replace(c, "^0+", "")
    return F.when(out == "", "0").otherwise(out)


def token_key(c: Column, separators: str = r"[-:]") -> Column:
    """Array that sorts like the parts of a designator: numbers by value and before words, a prefix before what extends it."""
    parts = F.filter(F.split(F.lower(c), separators), lambda x: F.trim(x) != "")
    return F.transform(parts, lambda x: F.when(x.rlike("^[0-9]{1,18}$"), F.concat(F.lit("0"), F.lpad(x, 19, "0"))).otherwise(F.concat(F.lit("1"), x)))


def run_key(c: Column) -> Column:
    """token_key over runs of digits and of letters."""
    return F.transform(F.regexp_extract_all(F.lower(c), F.lit(r"([0-9]+|[a-z]+)"), F.lit(1)), lambda x: F.when(x.rlike("^[0-9]{1,18}$"), F.concat(F.lit("0"), F.lpad(x, 19, "0"))).otherwise(F.concat(F.lit("1"), x)))


def roman_value(c: Column) -> Column:
    """Value of a roman numeral read from the right: a digit below the largest so far is taken off; other letters count 0."""
    worth = F.create_map(*[F.lit(x) for p in zip("IVXLCDM", (1, 5, 10, 50, 100, 500, 1000)) for x in p])
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("prev"))

    def step(acc: Column, ch: Column) -> Column:
        v = F.coalesce(F.try_element_at(worth, ch), F.lit(0))
        return F.struct(F.when(v < acc["prev"], acc["sum"] - v).otherwise(acc["sum"] + v).alias("sum"), F.when(v < acc["prev"], acc["prev"]).otherwise(v).alias("prev"))

    return F.aggregate(F.filter(F.split(F.reverse(c), ""), lambda x: x != ""), start, step, lambda acc: acc["sum"])


def small_roman(c: Column) -> Column:
    """I to V in either case; the maximum for all else."""
    u = F.upper(c)
    return F.when(u == "I", 1).when(u == "II", 2).when(u == "III", 3).when(u == "IV", 4).when(u == "V", 5).otherwise(MAX)


def int_to_roman(c: Column) -> Column:
    """Upper-case roman numeral of 1 to 3999."""
    steps = ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I"))
    table = F.array(*[F.struct(F.lit(v).alias("v"), F.lit(r).alias("r")) for v, r in steps])
    start = F.struct(c.cast("int").alias("left"), F.lit("").alias("out"))
    return F.aggregate(
        table, start, lambda acc, s: F.struct((acc["left"] % s["v"]).alias("left"), F.concat(acc["out"], F.repeat(s["r"], F.floor(acc["left"] / s["v"]).cast("int"))).alias("out")), lambda acc: acc["out"]
    )


def alpha_value(c: Column) -> Column:
    """Letters as a base-26 number, a = 1; null for anything but letters."""
    letters = F.filter(F.split(F.lower(c), ""), lambda x: x != "")
    return F.when(c.rlike("^[A-Za-z]{1,6}$"), F.aggregate(letters, F.lit(0), lambda acc, ch: acc * 26 + F.ascii(ch) - 96))


def usc_title_key(c: Column) -> Column:
    """Title number as a double; a letter adds hundredths, another suffix 0.99, and no number at all sorts last."""
    plain = c.rlike(r"^[0-9]+(\.[0-9]+)?$")
    digits = F.regexp_extract(c, "^[0-9]+", 0)
    letter = F.lower(F.substring(F.regexp_replace(c, "^[0-9]+", ""), 1, 1))
    offset = F.when(letter.rlike("^[a-z]$"), (F.ascii(letter) - 96) / 100.0).otherwise(0.99)
    return F.when(plain, c.try_cast("double")).when(digits == "", float("inf")).otherwise(digits.try_cast("double") + offset)


def parse_label(c: Column) -> Column:
    """Struct (number, title, range_start, range_end) of "Sec. 1-2. Title" and "Secs. 1-2 to 1-5. Title"."""
    pattern = r"(?i)^\s*(Secs?)\.\s*([^.]+)\.\s*(.*)$"
    many = F.lower(F.regexp_extract(c, pattern, 1)) == "secs"
    number, title = F.trim(F.regexp_extract(c, pattern, 2)), F.trim(F.regexp_extract(c, pattern, 3))
    has_to = number.contains(" to ")
    start = F.when(~many, number).when(has_to, F.trim(F.substring_index(number, " to ", 1)))
    end = F.when(~many, number).when(has_to, F.trim(F.substring(number, F.instr(number, " to ") + 4, F.length(number))))
    ok = number != ""
    return F.struct(
        F.when(ok, number).alias("number"), F.when(ok & (title != ""), title).alias("title"), F.when(ok, start).alias("range_start"), F.when(ok, end).alias("range_end")
    )
