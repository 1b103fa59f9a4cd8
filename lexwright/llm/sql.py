"""DuckDB SQL that the queries must equal."""

from __future__ import annotations

from lexwright.llm import licenses, pii

FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def urls(rules: list[tuple[str, str, str]]) -> str:
    values = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in rules)
    return f"""
WITH r(verdict, h, p) AS (VALUES {values}),
a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM (
  SELECT b.page_id, host, path, h || p AS rule, verdict, row_number() OVER (PARTITION BY b.page_id ORDER BY length(h || p) DESC NULLS LAST, verdict DESC) AS k
  FROM b LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) WHERE k = 1"""


def _places(words: str) -> str:
    """Every place where the words stand consecutively, as a list of starts."""
    w = words.split()
    test = " AND ".join(f"w[i + {j}] = '{x}'" for j, x in enumerate(w, 1))
    return f"list_filter(range(len(w)), lambda i: {test})"


def license_scan(accept: float = 0.6) -> str:
    """Base places by lists; templates as a table whose words are joined with the files' words, and alignments grouped."""
    places = ", ".join(f"{_places(p)} AS p{k}" for k, p in enumerate(licenses.BASE))
    base = ", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{label}' END" for k, label in enumerate(licenses.BASE.values()))
    every = " || ".join(f"p{k}" for k in range(len(licenses.BASE)))
    last = ", ".join(f"list_max(p{k})" for k in range(len(licenses.BASE)))
    names = lambda x: f"coalesce(array_to_string(list_sort(list_distinct(list_filter({x}, lambda x: x IS NOT NULL))), ','), '')"
    values = ", ".join(f"({t}, '{label}', '{words}', '{key}')" for t, (label, words, key) in enumerate(licenses.TEMPLATES))
    return f"""
WITH a AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({FOLD}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
tpl(t, label, body, phrase) AS (VALUES {values}),
tok AS (SELECT t, unnest(string_split(body, ' ')) AS x, generate_subscripts(string_split(body, ' '), 1) AS q FROM tpl),
idf AS (SELECT x, CAST(round(1000 * ln(1 + (SELECT count(*) FROM tpl) / count(DISTINCT t))) AS BIGINT) AS idf FROM tok GROUP BY x),
rare AS (SELECT DISTINCT x FROM (SELECT t, x, row_number() OVER (PARTITION BY t ORDER BY any_value(idf) DESC, min(q)) AS k FROM tok JOIN idf USING (x) GROUP BY t, x) WHERE k <= 3),
placed AS (SELECT t, tok.x, q, idf, tok.x IN (SELECT x FROM rare) AS is_rare,
  len(string_split(split_part(' ' || body || ' ', ' ' || phrase || ' ', 1), ' ')) AS k1, len(string_split(phrase, ' ')) AS kn, sum(idf) OVER (PARTITION BY t) AS total FROM tok JOIN idf USING (x) JOIN tpl USING (t)),
word AS (SELECT rid, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM a),
aligned AS (SELECT rid, t, i - q AS s, sum(idf) / CAST(any_value(total) AS DOUBLE) AS share FROM word JOIN placed USING (x) GROUP BY rid, t, i - q
  HAVING count(*) FILTER (is_rare) >= 2 AND count(*) FILTER (q >= k1 AND q < k1 + kn) = any_value(kn)),
method AS (SELECT rid, list(label) FILTER (share >= {accept}) AS found, max(share) AS score FROM aligned JOIN tpl USING (t) GROUP BY rid),
b AS (SELECT rid, doc_id, w, {places} FROM a)
SELECT doc_id, len(w) AS n_words, len({every}) AS n_base, list_min({every}) AS first_word, greatest({last}) AS last_word,
  {names(f"[{base}]")} AS base_labels, {names(f"list_concat([{base}], coalesce(found, []))")} AS labels, coalesce(score, 0.0) AS score FROM b LEFT JOIN method USING (rid)"""


def _f(key: str, kind: str, r: int, ra: str, rb: str, source: str) -> str:
    return f"CAST('0x' || substr(sha256('{key}|{kind}|{r}|' || {ra} || '|' || {rb} || '|' || {source}), 1, 12) AS BIGINT)"


def _rounds(cte: str, key: str, kind: str, ra: str, rb: str, rounds: int) -> str:
    """A chain of subqueries over (m, a, b, ra, rb)."""
    out = f"SELECT m, a, b, CAST({ra} AS BIGINT) AS ra, CAST({rb} AS BIGINT) AS rb FROM {cte}"
    for r in range(rounds):
        a, b = (f"(a + {_f(key, kind, r, 'ra', 'rb', 'b')}) % ra", "b") if r % 2 == 0 else ("a", f"(b + {_f(key, kind, r, 'ra', 'rb', 'a')}) % rb")
        out = f"SELECT m, {a} AS a, {b} AS b, ra, rb FROM ({out})"
    return out


def _luhn(text: str) -> str:
    digit = f"CAST({text}[i] AS INTEGER)"
    double = f"CASE WHEN (len({text}) - i) % 2 = 1 THEN CASE WHEN {digit} > 4 THEN 2 * {digit} - 9 ELSE 2 * {digit} END ELSE {digit} END"
    return f"list_sum(list_transform(range(1, len({text}) + 1), lambda i: {double}))"


def pseudonyms(key: str) -> str:
    """Distinct matches are permuted in a table of their own and joined back, unlike the query's in-row form."""
    pat = pii.PLAIN_PATTERN
    n = pii.ROUNDS
    leap = "(y % 4 = 0 AND (y % 100 <> 0 OR y % 400 = 0))"
    days = "[" + ", ".join(map(str, pii.DAYS_BEFORE)) + "]"
    lap = lambda c: f"CAST('0x' || substr(sha256('{key}|leap|' || {c}), 1, 12) AS BIGINT)"
    first = "CASE WHEN c % 400 = 0 THEN 0 ELSE 1 END"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
found AS (SELECT rid, regexp_extract_all(text, '{pat}') AS ms, string_split_regex(text, '{pat}') AS ps FROM docs WHERE regexp_matches(text, '[0-9@]')),
hits AS (SELECT rid, unnest(ms) AS m, generate_subscripts(ms, 1) AS i FROM found),
vals AS (SELECT DISTINCT m, replace(m, '-', '') AS digits FROM hits),
dated AS (SELECT m, CAST(substr(m, 1, 4) AS INTEGER) AS y, CAST(substr(m, 6, 2) AS INTEGER) AS mo, CAST(substr(m, 9, 2) AS INTEGER) AS d FROM vals WHERE regexp_full_match(m, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')),
okdate AS (SELECT * FROM dated WHERE y >= 100 AND mo BETWEEN 1 AND 12 AND d >= 1 AND d <= CASE WHEN mo IN (4, 6, 9, 11) THEN 30 WHEN mo = 2 THEN CASE WHEN {leap} THEN 29 ELSE 28 END ELSE 31 END),
kinds AS (SELECT m, digits, CASE WHEN contains(m, '@') THEN 'email'
  WHEN regexp_full_match(m, '\\+[0-9]{{1,3}} \\([0-9]{{3}}\\) [0-9]{{3}}-[0-9]{{4}}') THEN 'phone'
  WHEN regexp_full_match(m, '[0-9]{{13,19}}|[0-9]{{4}}-[0-9]{{4}}-[0-9]{{4}}-[0-9]{{4}}') AND {_luhn("(CASE WHEN regexp_full_match(digits, '[0-9]+') THEN digits ELSE '0' END)")} % 10 = 0 THEN 'card'
  WHEN regexp_full_match(m, '[0-9]{{1,3}}(\\.[0-9]{{1,3}}){{3}}') AND list_max(list_transform(string_split(m, '.'), lambda x: TRY_CAST(x AS INTEGER))) <= 255 THEN 'ip'
  WHEN m IN (SELECT m FROM okdate) THEN 'date'
  WHEN regexp_matches(m, '^{pii.ASSIGNED}') OR regexp_full_match(m, 'AKIA[0-9A-Z]{{16}}') THEN 'secret'
  WHEN regexp_full_match(m, '[0-9A-Fa-f]{{32,64}}') AND regexp_matches(m, '[0-9]') THEN 'secret' END AS kind FROM vals),
nums AS (SELECT m, kind, CASE WHEN kind = 'card' THEN left(digits, len(digits) - 1) ELSE regexp_replace(regexp_extract(m, '\\(.*$'), '[^0-9]', '', 'g') END AS s FROM kinds WHERE kind IN ('card', 'phone')),
ab AS (SELECT m, kind, len(s) // 2 AS u, len(s) - len(s) // 2 AS v, CAST(left(s, len(s) // 2) AS BIGINT) AS a, CAST(substr(s, len(s) // 2 + 1) AS BIGINT) AS b FROM nums),
numbers AS (SELECT ab.m, ab.kind, lpad(CAST(x.a AS VARCHAR), CAST(u AS INTEGER), '0') || lpad(CAST(x.b AS VARCHAR), CAST(v AS INTEGER), '0') AS p FROM ab JOIN (
  {_rounds("ab WHERE kind = 'card'", key, 'card', 'pow(10, u)', 'pow(10, v)', n)} UNION ALL {_rounds("ab WHERE kind = 'phone'", key, 'phone', 'pow(10, u)', 'pow(10, v)', n)}) x USING (m)),
cards AS (SELECT m, p || CAST((10 - {_luhn("(p || '0')")} % 10) % 10 AS VARCHAR) AS c FROM numbers WHERE kind = 'card'),
ips AS (SELECT m, o[1] * 256 + o[2] AS a, o[3] * 256 + o[4] AS b FROM (SELECT m, list_transform(string_split(m, '.'), lambda x: CAST(x AS BIGINT)) AS o FROM kinds WHERE kind = 'ip')),
ydays AS (SELECT m, y - y % 100 AS c, y % 100 AS a, {days}[mo] + d - 1 + CASE WHEN {leap} AND mo > 2 THEN 1 ELSE 0 END AS b FROM okdate),
dates AS (SELECT m, strftime(make_date(CAST(c + x.a AS INTEGER), 1, 1) + CAST(x.b AS INTEGER), '%Y-%m-%d') AS r
  FROM (SELECT m, c FROM ydays WHERE b < 365) JOIN ({_rounds("ydays WHERE b < 365", key, 'date', '100', '365', n)}) x USING (m)
  UNION ALL SELECT m, lpad(CAST(c + 4 * ((a // 4 - ({first}) + {lap('c')}) % (25 - ({first})) + ({first})) AS VARCHAR), 4, '0') || '-12-31' FROM ydays WHERE b = 365),
made AS (
  SELECT m, kind, 'u' || substr(sha256('{key}|email|' || m), 1, 16) || '@pseudonym.invalid' AS r FROM kinds WHERE kind = 'email'
  UNION ALL SELECT m, kind, regexp_extract(m, '^\\+[0-9]+') || ' (' || substr(p, 1, 3) || ') ' || substr(p, 4, 3) || '-' || substr(p, 7, 4) FROM numbers WHERE kind = 'phone'
  UNION ALL SELECT m, 'card', CASE WHEN contains(m, '-') THEN concat_ws('-', substr(c, 1, 4), substr(c, 5, 4), substr(c, 9, 4), substr(c, 13, 4)) ELSE c END FROM cards
  UNION ALL SELECT m, 'ip', concat_ws('.', a // 256, a % 256, b // 256, b % 256) FROM ({_rounds('ips', key, 'ip', '65536', '65536', n)})
  UNION ALL SELECT m, 'date', r FROM dates
  UNION ALL SELECT m, kind, p || CASE WHEN v = upper(v) THEN upper(substr(sha256('{key}|secret|' || v), 1, len(v))) ELSE substr(sha256('{key}|secret|' || v), 1, len(v)) END
    FROM (SELECT m, kind, regexp_extract(m, '^(?:[A-Za-z_]+=|AKIA)') AS p, substr(m, len(regexp_extract(m, '^(?:[A-Za-z_]+=|AKIA)')) + 1) AS v FROM kinds WHERE kind = 'secret')),
parts AS (SELECT rid, string_agg(ps[i] || coalesce(r, m), '' ORDER BY i) || any_value(ps[len(ps)]) AS body, {', '.join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in pii.KINDS)}
  FROM hits JOIN found USING (rid) LEFT JOIN made USING (m) GROUP BY rid)
SELECT doc_id, coalesce(body, text) AS text, {', '.join(f"coalesce(n_{k}, 0) AS n_{k}" for k in pii.KINDS)} FROM docs LEFT JOIN parts USING (rid)"""


def _shingled(name: str, key: str, table: str, width: int = 5) -> str:
    words = f"regexp_extract_all({FOLD}, '[^\\x20\\x09-\\x0D]+')"
    return f"""{name} AS (SELECT DISTINCT rid, {key}, unnest(CASE WHEN len(w) >= {width} THEN list_transform(range(1, len(w) - {width - 2}), lambda i: array_to_string(w[i:i + {width - 1}], ' '))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] END) AS s FROM (SELECT row_number() OVER () AS rid, {key}, {words} AS w FROM {table}))"""


def containment(share_percent: int = 80) -> str:
    return f"""
WITH {_shingled('d', 'doc_id', 'documents')}, {_shingled('b', 'item_id', 'benchmark')},
n AS (SELECT rid, count(*) AS n_item FROM b GROUP BY rid)
SELECT doc_id, item_id, n_item, n_shared, n_shared / CAST(n_item AS DOUBLE) AS containment FROM (
  SELECT d.rid AS x, b.rid AS rid, any_value(doc_id) AS doc_id, any_value(item_id) AS item_id, count(*) AS n_shared FROM d JOIN b USING (s) GROUP BY 1, 2) JOIN n USING (rid)
WHERE 100 * n_shared >= {share_percent} * n_item"""
