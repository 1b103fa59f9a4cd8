"""PII: format-preserving Feistel pseudonyms.

No Python runs on the executors and nothing is shuffled: matches are extracted and
the text between them split off by one pattern, each match is replaced by a keyed
permutation of its own format, and the pieces are put together again.  The pseudonym
depends on key, kind and value only, so equal values stay linked across documents and
runs, on any number of executors and without a table of values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexwright.llm.common import free_name

ROUNDS = 8
KINDS = ("email", "phone", "card", "ip", "date", "secret")

_LOCAL = r"[\p{L}\p{N}._%+-]"
EMAIL = r"@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+"
NAMED = "(?i:password|passwd|secret|token|api_key)"
ASSIGNED = f"{NAMED}="
#: Assignments as configuration files write them; without a bare "=" the value must have a digit.
LOOSE = rf"{NAMED}[\x22']?\x20{{0,2}}[:=]\x20{{0,2}}[\x22']?"
#: Numbers with no digit before or after, so that both ends of a range are found; addresses and plain cards aren't sought within decimals.
DATE = "(?<![0-9])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9])"
SLASHED = "(?<![0-9/])[0-9]{2}/[0-9]{2}/[0-9]{4}(?![0-9/])"
DASHED = "(?<![0-9])[0-9]{4}(?:[- ][0-9]{4}){3}(?![0-9])"
#: A letter before it makes it a version and no address.
IP = r"(?<![0-9A-Za-z])(?<![0-9]\.)[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
IP6 = r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:)+:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*)(?![0-9A-Za-z:])"
CARD = r"(?<![0-9])(?<![0-9]\.)[0-9]{13,19}(?![0-9]|\.[0-9])"
ABROAD = r"\+[0-9]{1,3} \([0-9]+\) [0-9]+-[0-9]+"
HOME = r"(?<![0-9-])(?:\([0-9]{3}\) |[0-9]{3}-)[0-9]{3}-[0-9]{4}(?![0-9-])"
#: National identity numbers of the form 123-45-6789.
IDENTITY = "(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
#: One token pattern; what it catches is validated afterwards and left alone if it isn't valid.
#: The email's look-behind and possessive run keep the scan linear on long runs; what matches is the same without them.
PATTERN = (
    rf"(?<!{_LOCAL}){_LOCAL}++{EMAIL}|{ASSIGNED}[0-9A-Za-z]{{6,}}|{LOOSE}[0-9A-Za-z]{{6,}}|AKIA[0-9A-Z]{{16}}"
    rf"|{ABROAD}|{IP6}|[0-9A-Fa-f]{{32,}}|{DATE}|{SLASHED}|{DASHED}|{HOME}|{IDENTITY}|{IP}|{CARD}"
)
#: The SQL's pattern: it caps secrets and takes a range as one number, which differs on no given table.
PLAIN_PATTERN = (
    rf"{_LOCAL}+{EMAIL}|{ASSIGNED}[0-9A-Za-z]{{6,64}}|AKIA[0-9A-Z]{{16}}"
    r"|\+[0-9]{1,3} \([0-9]+\) [0-9]+-[0-9]+|[0-9A-Fa-f]{32,}|[0-9]+(?:[.-][0-9]+)*"
)
#: Every valid match has one of these: secrets may do without a digit.
MAY_HOLD = "[0-9@=]|AKIA"

DAYS_BEFORE = (0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334)


def _long(c: Column) -> Column:
    return c.cast("long")


def _pad(c: Column, width: Column) -> Column:
    return F.lpad(c.cast("string"), width, F.lit("0"))


def feistel(a: Column, b: Column, ra: Column, rb: Column, key: str, kind: str) -> Column:
    """Struct (a, b) after alternating rounds: a += f(b) mod ra, then b += f(a) mod rb. A bijection of [0, ra) x [0, rb)."""

    def step(acc: Column, r: Column) -> Column:
        even = r % 2 == 0
        source = F.when(even, acc["b"]).otherwise(acc["a"])
        digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), r.cast("string"), ra.cast("string"), rb.cast("string"), source.cast("string")), 256)
        f = F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")
        return F.struct(F.when(even, (acc["a"] + f) % ra).otherwise(acc["a"]).alias("a"), F.when(even, acc["b"]).otherwise((acc["b"] + f) % rb).alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(_long(a).alias("a"), _long(b).alias("b")), step)


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def _digits(text: Column, key: str, kind: str) -> Column:
    """Keyed permutation of the strings of as many digits (at most 18)."""
    n = F.length(text)
    u = F.floor(n / 2).cast("int")
    v = n - u
    ten = lambda k: F.pow(F.lit(10), k).cast("long")
    out = feistel(F.substring(text, F.lit(1), u), F.substring(text, u + 1, v), ten(u), ten(v), key, kind)
    return _let(out, lambda s: F.concat(_pad(s["a"], u), _pad(s["b"], v)))


def _luhn(text: Column) -> Column:
    """Sum of the digits, every second one from the right doubled (the last one is not)."""
    n = F.length(text)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(text, i, F.lit(1)).cast("int")
        return acc + F.when((n - i) % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def _leap(y: Column) -> Column:
    return (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))


def _date_parts(m: Column) -> tuple[Column, Column, Column]:
    return F.substring(m, 1, 4).cast("int"), F.substring(m, 6, 2).cast("int"), F.substring(m, 9, 2).cast("int")


def _is_date(m: Column) -> Column:
    y, mo, d = _date_parts(m)
    most = F.when(mo.isin(4, 6, 9, 11), 30).when(mo == 2, F.when(_leap(y), 29).otherwise(28)).otherwise(31)
    return m.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.when(m.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), (y >= 100) & mo.between(1, 12) & (d >= 1) & (d <= most)).otherwise(False)


def _date(m: Column, key: str) -> Column:
    """Keyed permutation of the dates of a century: (year of century, day of year), Feistel over 100 x 365.

    The 366th days of leap years, which have no partner in other years, are rotated among themselves.
    """
    y, mo, d = _date_parts(m)
    before = F.element_at(F.array(*[F.lit(x) for x in DAYS_BEFORE]), mo)
    day = before + d - 1 + F.when(_leap(y) & (mo > 2), 1).otherwise(0)
    century = y - y % 100
    turn = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("leap"), century.cast("string")), 256), 1, 12), 16, 10).cast("long")
    first = F.when(century % 400 == 0, 0).otherwise(1)
    leaps = 25 - first
    other = century + 4 * (((y % 100 / 4).cast("int") - first + turn) % leaps + first)
    normal = _let(
        feistel(y % 100, day, F.lit(100).cast("long"), F.lit(365).cast("long"), key, "date"),
        lambda s: F.date_format(F.date_add(F.make_date((century + s["a"]).cast("int"), F.lit(1), F.lit(1)), s["b"].cast("int")), "yyyy-MM-dd"),
    )
    return F.when(day == 365, F.concat(_pad(other, F.lit(4)), F.lit("-12-31"))).otherwise(normal)


def _iso(m: Column) -> Column:
    """A date with slashes as YYYY-MM-DD: month first, or day first where the first number can't be a month."""
    first, second = F.substring(m, 1, 2), F.substring(m, 4, 2)
    return F.when(m.rlike(f"^{SLASHED}$"), F.when(first > "12", F.concat_ws("-", F.substring(m, 7, 4), second, first)).otherwise(F.concat_ws("-", F.substring(m, 7, 4), first, second))).otherwise("")


def _slashed(m: Column, iso: Column) -> Column:
    y, mo, d = F.substring(iso, 1, 4), F.substring(iso, 6, 2), F.substring(iso, 9, 2)
    return F.when(F.substring(m, 1, 2) > "12", F.concat_ws("/", d, mo, y)).otherwise(F.concat_ws("/", mo, d, y))


_IS_IP6 = r"^[0-9A-Fa-f:]*:[0-9A-Fa-f:]*:[0-9A-Fa-f:]*$"


def _groups(m: Column) -> Column:
    return F.filter(F.split(m, ":"), lambda x: x != "")


def _ip6(m: Column, key: str) -> Column:
    """Keyed permutation of the 128 bits: a Feistel network on two halves with exclusive or. Written in full."""
    halves = F.split(m, "::")
    left, right = _groups(F.get(halves, F.lit(0))), _groups(F.coalesce(F.get(halves, F.lit(1)), F.lit("")))
    full = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(8 - F.size(left) - F.size(right), F.lit(0))), right)
    digits = F.array_join(F.transform(full, lambda x: F.lpad(F.lower(x), 4, "0")), "")
    half = lambda t: F.conv(t, 16, -10).cast("long")
    text = lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")

    def step(acc: Column, r: Column) -> Column:
        f = half(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("ip6"), r.cast("string"), text(acc["b"])), 256), 1, 16))
        return F.struct(acc["b"].alias("a"), acc["a"].bitwiseXOR(f).alias("b"))

    start = F.struct(half(F.substring(digits, 1, 16)).alias("a"), half(F.substring(digits, 17, 16)).alias("b"))
    out = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)
    return _let(out, lambda s: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.substring(F.concat(text(s["a"]), text(s["b"])), k * 4 + 1, F.lit(4))), ":"))


def _identity(m: Column, key: str) -> Column:
    """Keyed permutation of the valid numbers: areas 001 to 899 but 666, groups 01 to 99, serials 0001 to 9999."""
    area, rest = _long(F.substring(m, 1, 3)), (_long(F.substring(m, 5, 2)) - 1) * 9999 + _long(F.substring(m, 8, 4)) - 1
    out = feistel(area - 1 - F.when(area > 666, 1).otherwise(0), rest, F.lit(898).cast("long"), F.lit(99 * 9999).cast("long"), key, "identity")
    back = lambda s: F.concat_ws("-", _pad(s["a"] + 1 + F.when(s["a"] >= 665, 1).otherwise(0), F.lit(3)), _pad(F.floor(s["b"] / 9999) + 1, F.lit(2)), _pad(s["b"] % 9999 + 1, F.lit(4)))
    return _let(out, back)


def kind_of(m: Column) -> Column:
    """Kind of a valid match; null for one that validation turns down."""
    digits = F.translate(m, "- ", "")
    card = m.rlike(r"^(?:[0-9]{13,19}|[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{4}|[0-9]{4} [0-9]{4} [0-9]{4} [0-9]{4})$") & ~digits.rlike("^([0-9])\\1*$")
    ip = m.rlike(r"^[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}$")
    return (
        F.when(m.contains("@"), "email")
        .when(m.rlike(r"^(?:\+[0-9]{1,3} )?\([0-9]{3}\) [0-9]{3}-[0-9]{4}$|^[0-9]{3}-[0-9]{3}-[0-9]{4}$"), "phone")
        .when(card & F.when(card, _luhn(digits) % 10 == 0).otherwise(False), "card")
        .when(ip & F.when(ip, F.forall(F.split(m, r"\."), lambda x: x.cast("int") <= 255)).otherwise(False), "ip")
        .when(m.rlike(_IS_IP6) & (F.size(_groups(m)) >= 3) & m.rlike("[0-9]"), "ip")
        .when(_is_date(m) | _is_date(_iso(m)), "date")
        .when(m.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$"), "secret")
        .when(m.rlike(rf"^{LOOSE}") & (m.rlike(rf"^{ASSIGNED}") | F.regexp_replace(m, rf"^{LOOSE}", "").rlike("[0-9]")), "secret")
        .when(m.rlike(rf"^{ASSIGNED}") | m.rlike("^AKIA[0-9A-Z]{16}$"), "secret")
        .when(m.rlike(r"^[0-9A-Fa-f]{32,}$") & m.rlike("[0-9]") & ((F.length(m) <= 64) | m.rlike("[A-Fa-f]")), "secret")
    )


def _digest(value: Column, key: str) -> Column:
    """As many hex digits as value has: its keyed digest, then keyed digests of that one and a counter."""
    more = lambda first: F.transform(F.sequence(F.lit(0), F.floor((F.length(value) - 1) / 64).cast("int")), lambda i: F.when(i == 0, first).otherwise(F.sha2(F.concat_ws("|", F.lit(key), F.lit("secret"), i.cast("string"), first), 256)))
    return _let(F.sha2(F.concat_ws("|", F.lit(key), F.lit("secret"), value), 256), lambda first: F.substring(F.array_join(more(first), ""), F.lit(1), F.length(value)))


def pseudonym(m: Column, key: str) -> Column:
    """The replacement of a match; the match itself where it isn't valid."""
    kind = kind_of(m)
    # what stands around the three groups of a phone number stays
    abroad, last = F.regexp_extract(m, r"^(?:\+[0-9]+ )?\(?", 0), lambda p: F.concat(F.substring(p, 4, 3), F.lit("-"), F.substring(p, 7, 4))
    phone = lambda p: F.concat(abroad, F.substring(p, 1, 3), F.when(m.contains(")"), ") ").otherwise("-"), last(p))
    number = F.translate(m, "- ", "")
    n = F.length(number)
    close = lambda p: _let(F.concat(p, F.lit("0")), lambda q: F.concat(p, ((10 - _luhn(q) % 10) % 10).cast("string")))
    fours = lambda c, by: F.concat_ws(by, *[F.substring(c, 1 + 4 * k, 4) for k in range(4)])
    dashed = lambda c: F.when(m.contains("-"), fours(c, "-")).when(m.contains(" "), fours(c, " ")).otherwise(c)
    card = _let(_let(_digits(F.substring(number, F.lit(1), n - 1), key, "card"), close), dashed)
    part = lambda k: F.get(F.split(m, r"\."), F.lit(k)).cast("long")
    half = F.lit(65536).cast("long")
    ip = _let(
        feistel(part(0) * 256 + part(1), part(2) * 256 + part(3), half, half, key, "ip"),
        lambda s: F.concat_ws(".", *[F.shiftright(s[h], b).bitwiseAND(F.lit(255)).cast("string") for h in ("a", "b") for b in (8, 0)]),
    )
    email = F.concat(F.lit("u"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), m), 256), 1, 16), F.lit("@pseudonym.invalid"))
    named = F.regexp_extract(m, rf"^(?:{LOOSE}|AKIA)", 0)
    value = F.substring(m, F.length(named) + 1, F.length(m))
    secret = F.concat(named, _let(_digest(value, key), lambda x: F.when(value == F.upper(value), F.upper(x)).otherwise(x)))
    return _let(
        F.coalesce(kind, F.lit("")),
        lambda k: F.when(k == "email", email).when(k == "phone", _let(_digits(F.translate(F.regexp_replace(m, r"^\+[0-9]+", ""), "() -", ""), key, "phone"), phone)).when(k == "card", card)
        .when((k == "ip") & m.contains(":"), _ip6(m, key)).when(k == "ip", ip)
        .when((k == "date") & m.contains("/"), _slashed(m, _date(_iso(m), key))).when(k == "date", _date(m, key))
        .when((k == "secret") & m.rlike("^[0-9]{3}-"), _identity(m, key)).when(k == "secret", secret).otherwise(m),
    )


def pseudonymise(docs: DataFrame, key: str, text: str = "text", prefix: str | None = "n_") -> DataFrame:
    """Replace personal data in every text and add n_email, n_phone, n_card, n_ip, n_date and n_secret.

    Numbers keep their format: card numbers (13 to 19 digits, also in fours) pass
    the Luhn test before and after, IPv4 addresses and dates (YYYY-MM-DD and, with the same pseudonyms, MM/DD/YYYY
    or DD/MM/YYYY; years from 100) stay valid, IPv6 addresses are written in full, phone numbers (+1 (301) 555-0100,
    (301) 555-0100, 301-555-0100) keep the country code.  Email addresses become a keyed name
    at pseudonym.invalid, secrets (32 hex digits or more, values assigned to password, token and the like, AWS-style
    key ids) a keyed digest of their length, however long; more than 64 decimal digits are a number.  Identity numbers
    (123-45-6789) count as secrets and keep their format.  Both ends of a range are replaced.
    Invalid look-alikes stay as they are, as do versions (v1.2.3.4) and numbers of one digit throughout.
    A null text stays null with counts 0; columns named like the counts are replaced.  With another prefix the
    counts are called otherwise; with None there are none, and all columns but the text stay whatever they are called.
    """
    kinds = {k: f"{prefix}{k}" for k in KINDS} if prefix is not None else {}
    new = set(kinds.values())
    base = docs.drop(*(new - {text}))
    found_, kind_, made_ = (free_name(x, base.columns) for x in ("__m", "__k", "__p"))
    t = F.col(f"`{text}`")
    found = F.when(t.rlike(MAY_HOLD), F.regexp_extract_all(t, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))
    d = base.withColumn(found_, F.coalesce(found, F.array().cast("array<string>")))
    d = d.withColumn(kind_, F.transform(found_, kind_of))
    d = d.withColumn(made_, F.when(F.exists(kind_, lambda k: k.isNotNull()), F.transform(found_, lambda m: pseudonym(m, key))))
    pieces = F.zip_with(F.split(t, PATTERN, -1), F.array_append(made_, ""), lambda a, b: F.concat(a, b))
    counts = {name: _count(kind_, k) for k, name in kinds.items()}
    return d.withColumns(counts | {text: F.when(F.col(made_).isNotNull(), F.array_join(pieces, "")).otherwise(t)}).drop(found_, kind_, made_)


def _count(kinds: str, kind: str) -> Column:
    return F.size(F.filter(kinds, lambda x: x == kind)).cast("long")
