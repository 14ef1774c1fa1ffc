"""Literal relations that both engines read, SQL to compare, and small kernels of queries."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from larkveil.kernel import bodies
from larkveil.kernel.checks import COUNTRY_CODES, FILE_ENDINGS, IBAN_LENGTHS, TOP_DOMAINS, VIN_LETTERS, VIN_LETTER_VALUES, VIN_WEIGHTS
from larkveil.kernel.sse import event
from larkveil.kernel.text import normalized as _normalized
from larkveil.plans.catalog import default_classes

#: A border between an ASCII word character and another, as RE2 means \b.
JAVA_ASCII_B = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
IPV4_RE2 = r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"
CARD_RE2 = r"\b(?:[0-9][ -]?){13,19}\b"
AWS_RE2 = r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b"
_LIST = lambda xs: ", ".join(f"'{x}'" for x in xs)
FQDN_OK = f"list_last(string_split(lower(value), '.')) IN ({_LIST(TOP_DOMAINS)}) AND list_last(string_split(lower(value), '.')) NOT IN ({_LIST(FILE_ENDINGS)}) AND len(list_filter(string_split(value, '.'), lambda x: len(x) > 63)) = 0"


def spans_sql(name: str, key: str, text: str, pattern: str, _where: str = "", extra: str = "TRUE") -> str:
    """Starts, ends and values of all matches, from the lengths of gaps and matches."""
    gaps = f"list_transform(regexp_split_to_array({text}, '{pattern}'), lambda g: length(g))"
    return (
        f'SELECT {key}, start, start + length(value) AS "end", value FROM (SELECT {key}, m[i] AS value, '
        f"CAST(list_sum(g[1:i]) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS start FROM (SELECT {key}, m, g, unnest(range(1, len(m) + 1)) AS i "
        f"FROM (SELECT {key}, regexp_extract_all({text}, '{pattern}') AS m, {gaps} AS g FROM {name}))) WHERE {extra}"
    )


def luhn_sql(v: str) -> str:
    d = f"regexp_replace({v}, '[ -]', '', 'g')"
    digit = f"CAST({d}[length({d}) - i] AS INTEGER)"
    total = f"list_sum(list_transform(range(0, length({d})), lambda i: CASE WHEN i % 2 = 0 THEN {digit} WHEN {digit} > 4 THEN 2 * {digit} - 9 ELSE 2 * {digit} END))"
    return f"CASE WHEN regexp_full_match({d}, '[0-9][0-9]+') THEN {total} % 10 = 0 ELSE FALSE END"


def ip_scope_sql(v: str) -> str:
    octet = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    a, b = (f"TRY_CAST(split_part(trim({v}), '.', {i}) AS INTEGER)" for i in (1, 2))
    private = f"({a} IN (10, 127) OR ({a} = 172 AND {b} BETWEEN 16 AND 31) OR ({a} = 192 AND {b} = 168) OR ({a} = 169 AND {b} = 254) OR ({a} = 100 AND {b} BETWEEN 64 AND 127))"
    return f"CASE WHEN regexp_full_match(trim({v}), '{octet}(?:\\.{octet}){{3}}') THEN CASE WHEN {private} THEN 'private' ELSE 'public' END END"


def _values(*values: str) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"('{v}')" for v in values) + ") AS t(value)"


#: Values for each validator; both engines read them.
PROBES = {
    "luhn": _values("4111 1111 1111 1111", "4111111111111112", "0", "00", "79927398713", "7992-7398-714", "abc", ""),
    "iban": _values("DE89 3704 0044 0532 0130 00", "DE89370400440532013001", "GB82 WEST 1234 5698 7654 32", "FR1420041010050500013M02606", "DE8937040044053201300", "XX00"),
    "bic": _values("DEUTDEFF", "DEUTDEFF500", "DEUTXXFF", "deutdeff", "COBADEFFXXX", "AAAA"),
    "ip": _values("10.0.0.1", "8.8.8.8", "256.1.1.1", "01.2.3.4", "172.16.0.1", "172.32.0.1", "100.64.0.1", "1.2.3"),
    "mac": _values("00:1A:2b:3C:4d:5E", "00-1A-2B-3C-4D-5E", "00:1A-2B:3C:4D:5E", "00:1A:2B:3C:4D"),
    "vin": _values("1HGCM82633A004352", "1M8GDM9AXKP042788", "1M8GDM9AYKP042788", "IOQ00000000000000"),
    "phone": _values("+49 (30) 123-4567", "123456", "1234567", "1234567890123456", "12a4567"),
    "date": _values("31.12.1999", "29/02/2023", "29.02.2024", "2024-13-01", "1.1.2000", "1.1.99", "1899-12-31", "2100-12-31", "31.12/1999"),
    "tax_id": _values("86 095 742 719", "86095742718", "DE123456789", "XX123456789", "ATU12345678", "123"),
    "ssn": _values("65 170839 J 003", "65170839J004", "123-45-6789", "000-12-3456", "666-12-3456", "912-34-5678", "123-00-6789", "123-45-0000"),
    "fqdn": _values("example.com", "a.b.example.org", "setup.py", "localhost", "x..com", "mail.unknown", "Host.LOCAL"),
}
_NO_SPACE = "upper(replace(value, ' ', ''))"
_NUM = "CAST(CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END AS INTEGER)"
_TURNED = f"(substr({_NO_SPACE}, 5) || substr({_NO_SPACE}, 1, 4))"
_IBAN_NUMBER = f"array_to_string(list_transform(string_split({_TURNED}, ''), lambda c: CAST({_NUM} AS VARCHAR)), '')"
_LENGTHS = "CASE substr(" + _NO_SPACE + ", 1, 2) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in IBAN_LENGTHS.items()) + f" ELSE length({_NO_SPACE}) END"
_VIN = "upper(trim(value))"
_VIN_VALUE = "CASE c " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in zip(VIN_LETTERS, VIN_LETTER_VALUES)) + " ELSE TRY_CAST(c AS INTEGER) END"
_SSN = "regexp_replace(upper(trim(value)), '[ -]', '', 'g')"
_PENSION = f"(substr({_SSN}, 1, 8) || lpad(CAST(ascii(substr({_SSN}, 9, 1)) - 64 AS VARCHAR), 2, '0') || substr({_SSN}, 10, 2))"
_DATE = "CASE WHEN regexp_full_match(trim(value), '\\d{1,2}\\.\\d{1,2}\\.\\d{4}') THEN try_strptime(trim(value), '%d.%m.%Y') WHEN regexp_full_match(trim(value), '\\d{1,2}/\\d{1,2}/\\d{4}') THEN try_strptime(trim(value), '%d/%m/%Y') WHEN regexp_full_match(trim(value), '\\d{4}-\\d{2}-\\d{2}') THEN try_strptime(trim(value), '%Y-%m-%d') END"
_TAX = "list_reduce(list_prepend(10, list_transform(string_split(substr(" + _NO_SPACE + ", 1, 10), ''), lambda c: coalesce(TRY_CAST(c AS INTEGER), 0))), lambda p, d: (CASE WHEN (p + d) % 10 = 0 THEN 10 ELSE (p + d) % 10 END * 2) % 11)"
_CODES = _LIST(sorted(COUNTRY_CODES))
VALID_SQL = {
    "luhn": luhn_sql("value"),
    "iban": f"CASE WHEN regexp_full_match({_NO_SPACE}, '[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{10,30}}') AND {_LENGTHS} = length({_NO_SPACE}) THEN list_reduce(list_prepend(0, list_transform(string_split({_IBAN_NUMBER}, ''), lambda c: CAST(c AS INTEGER))), lambda a, d: (a * 10 + d) % 97) = 1 ELSE FALSE END",
    "bic": f"regexp_full_match(replace(value, ' ', ''), '[A-Z]{{6}}[A-Z0-9]{{2}}(?:[A-Z0-9]{{3}})?') AND substr(replace(value, ' ', ''), 5, 2) IN ({_CODES})",
    "ip": ip_scope_sql("value") + " IS NOT NULL",
    "mac": "regexp_full_match(trim(value), '(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}|(?:[0-9A-Fa-f]{2}-){5}[0-9A-Fa-f]{2}')",
    "vin": f"CASE WHEN regexp_full_match({_VIN}, '[A-HJ-NPR-Z0-9]{{17}}') THEN substr('0123456789X', CAST(list_sum(list_transform(list_zip(string_split({_VIN}, ''), [{', '.join(map(str, VIN_WEIGHTS))}]), lambda p: (CASE p[1] {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {v}' for k, v in zip(VIN_LETTERS, VIN_LETTER_VALUES))} ELSE TRY_CAST(p[1] AS INTEGER) END) * p[2])) % 11 AS INTEGER) + 1, 1) = substr({_VIN}, 9, 1) ELSE FALSE END",
    "phone": "regexp_full_match(trim(value), '[0-9+()/ .-]+') AND length(regexp_replace(value, '[^0-9]', '', 'g')) BETWEEN 7 AND 15",
    "date": f"year({_DATE}) BETWEEN 1900 AND 2100",
    "tax_id": f"CASE WHEN regexp_full_match({_NO_SPACE}, '[0-9]{{11}}') THEN (11 - {_TAX}) % 10 = CAST(substr({_NO_SPACE}, 11, 1) AS INTEGER) WHEN regexp_full_match({_NO_SPACE}, '[0-9]+') THEN FALSE ELSE regexp_full_match({_NO_SPACE}, '[A-Z]{{2}}[0-9A-Z]{{8,12}}') AND substr({_NO_SPACE}, 1, 2) IN ({_CODES}) END",
    "ssn": f"CASE WHEN regexp_full_match({_SSN}, '[0-9]{{8}}[A-Z][0-9]{{3}}') THEN list_sum(list_transform(list_zip(string_split({_PENSION}, ''), [2, 1, 2, 5, 7, 1, 2, 1, 2, 1, 2, 1]), lambda p: (CAST(p[1] AS INTEGER) * p[2]) // 10 + (CAST(p[1] AS INTEGER) * p[2]) % 10)) % 10 = CAST(substr({_SSN}, 12, 1) AS INTEGER) ELSE regexp_full_match({_SSN}, '[0-9]{{9}}') AND substr({_SSN}, 1, 3) NOT IN ('000', '666') AND substr({_SSN}, 1, 1) <> '9' AND substr({_SSN}, 4, 2) <> '00' AND substr({_SSN}, 6, 4) <> '0000' END",
    "fqdn": f"len(string_split(value, '.')) >= 2 AND len(list_filter(string_split(value, '.'), lambda x: len(x) NOT BETWEEN 1 AND 63)) = 0 AND {FQDN_OK}",
}


NAMED = "SELECT * FROM (VALUES ('sessionid'), ('AUTH'), ('_csrf'), ('api_key'), ('ISO-9001'), ('XY-12'), ('eyJhbGciOiJIUzI1NiJ9.e30.x'), ('e30.e30.x'), ('a.b')) AS t(value)"
NAMED_SQL = (
    "SELECT value, cookie, secret, standard, web_token FROM (VALUES ('sessionid', 'SESSION_COOKIE', NULL, FALSE, FALSE), ('AUTH', 'AUTH_COOKIE', NULL, FALSE, FALSE), ('_csrf', 'CSRF_TOKEN', NULL, FALSE, FALSE), "
    "('api_key', NULL, 'API_KEY', FALSE, FALSE), ('ISO-9001', NULL, NULL, TRUE, FALSE), ('XY-12', NULL, NULL, FALSE, FALSE), ('eyJhbGciOiJIUzI1NiJ9.e30.x', NULL, NULL, FALSE, TRUE), "
    "('e30.e30.x', NULL, NULL, FALSE, FALSE), ('a.b', NULL, NULL, FALSE, FALSE)) AS t(value, cookie, secret, standard, web_token)"
)


def _rows(columns: str, *rows: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join(rows)}) AS t({columns})"


# --- spans ---
SPANS = 'SELECT doc, seq, start, stop AS `end` FROM (VALUES (1, 0, 0, 10), (1, 1, 5, 12), (1, 2, 12, 15), (1, 3, 13, 14), (1, 4, 2, 9), (2, 0, 3, 4), (2, 1, 3, 4), (2, 2, 0, 20), (3, 0, 7, 9)) AS t(doc, seq, start, stop)'
COVERS = 'SELECT doc, start, stop AS `end` FROM (VALUES (1, 0, 11), (2, 0, 20)) AS t(doc, start, stop)'
_D = lambda s: s.replace("`", '"')  # noqa: E731  the same relation for DuckDB
UNION_SQL = (
    f'WITH s AS (SELECT DISTINCT doc, start, "end" FROM ({_D(SPANS)})), n AS (SELECT *, CASE WHEN start < max("end") OVER (PARTITION BY doc ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM s), '
    'i AS (SELECT *, sum(new) OVER (PARTITION BY doc ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM n) SELECT doc, min(start) AS start, max("end") AS "end" FROM i GROUP BY doc, island'
)
CONTAINED_SQL = f'WITH s AS ({_D(SPANS)}) SELECT doc, seq, start, "end" FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE b.doc = a.doc AND b.seq < a.seq AND b.start <= a.start AND a."end" <= b."end")'
OUTSIDE_SQL = f'WITH s AS ({_D(SPANS)}), c AS ({_D(COVERS)}) SELECT doc, seq, start, "end" FROM s a WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.doc = a.doc AND b.start <= a.start AND a."end" <= b."end")'

# --- entities ---
FINDINGS = (
    "SELECT doc, seq, start, stop AS `end`, cls, value, CAST(conf AS DOUBLE) AS conf, gender, token FROM (VALUES "
    "(1, 0, 0, 11, 'PERSON_FULL_NAME', 'Anna Keller', 0.95, 'female', CAST(NULL AS STRING)), (1, 1, 20, 26, 'PERSON_LAST_NAME', 'keller', 0.3, CAST(NULL AS STRING), CAST(NULL AS STRING)), "
    "(1, 2, 30, 34, 'PERSON_FIRST_NAME', 'Anna', 0.3, 'female', NULL), (1, 3, 40, 45, 'PERSON_INITIALS', 'A. K.', 0.4, NULL, NULL), "
    "(1, 4, 50, 60, 'PERSON_FULL_NAME', 'Tom Becker', 0.85, NULL, NULL), (1, 5, 70, 77, 'GENERIC_ID', 'AB-1234', 0.9, NULL, NULL), (1, 6, 80, 87, 'TICKET_ID', 'ab-1234', 0.85, NULL, NULL), "
    "(2, 0, 0, 9, 'PERSON_FULL_NAME', 'Eva Koch', 0.95, 'female', NULL), (2, 1, 10, 19, 'PERSON_FULL_NAME', 'Max Koch', 0.95, 'male', NULL), (2, 2, 30, 34, 'PERSON_LAST_NAME', 'Koch', 0.95, 'male', NULL), "
    "(2, 3, 40, 52, 'PHONE', '030 1234567', 0.98, NULL, NULL), (2, 4, 60, 72, 'PHONE', '030-1234567', 0.98, NULL, NULL), "
    "(3, 0, 0, 8, 'PERSON_FULL_NAME', 'Ida Roth', 0.95, 'female', NULL), (3, 1, 9, 17, 'PERSON_FULL_NAME', 'ida  roth', 0.95, 'male', NULL)) AS t(doc, seq, start, stop, cls, value, conf, gender, token)"
)
_F = _D(FINDINGS).replace("AS STRING", "AS VARCHAR")
_KEY = "CASE WHEN cls IN ('PHONE', 'MOBILE_PHONE', 'FAX', 'IBAN', 'CREDIT_CARD', 'BANK_ACCOUNT') THEN regexp_replace(value, '[^0-9]', '', 'g') ELSE lower(regexp_replace(trim(value), '\\s+', ' ', 'g')) END"
_WITH = (
    f"WITH f AS (SELECT *, {_KEY} AS key FROM ({_F})), g AS (SELECT doc, cls, key, min(start) AS start, max(conf) AS conf, count(*) AS n, "
    "CASE WHEN cls = 'PERSON_FULL_NAME' AND contains(key, ' ') THEN split_part(key, ' ', 1) WHEN cls = 'PERSON_FIRST_NAME' THEN key END AS fn, "
    "CASE WHEN cls = 'PERSON_FULL_NAME' THEN split_part(key, ' ', -1) WHEN cls = 'PERSON_LAST_NAME' THEN key END AS ln FROM f GROUP BY doc, cls, key), "
    "p AS (SELECT * FROM g WHERE cls IN ('PERSON_FULL_NAME', 'PERSON_LAST_NAME', 'PERSON_FIRST_NAME') AND conf >= 0.5), "
    "m AS (SELECT g.doc, g.cls, g.key, p.cls AS to_cls, p.key AS to_key FROM g JOIN p ON g.doc = p.doc AND (g.cls <> p.cls OR g.key <> p.key) WHERE (g.cls = 'PERSON_LAST_NAME' AND p.ln = g.key) OR (g.cls = 'PERSON_FIRST_NAME' AND p.fn = g.key) "
    "OR (g.cls = 'PERSON_INITIALS' AND p.fn[1] || p.ln[1] = regexp_replace(g.key, '[^\\p{L}]', '', 'g'))), "
    "pl AS (SELECT * FROM m QUALIFY count(*) OVER (PARTITION BY doc, cls, key) = 1), "
    "gm AS (SELECT g.doc, g.cls, g.key, o.cls AS to_cls, o.key AS to_key FROM g JOIN g o ON g.doc = o.doc AND g.key = o.key AND o.cls <> g.cls WHERE g.cls = 'GENERIC_ID'), "
    "gl AS (SELECT * FROM gm QUALIFY count(*) OVER (PARTITION BY doc, key) = 1) "
)
GROUPS_SQL = _WITH + "SELECT doc, cls, key, start, conf, n FROM g"
PERSON_LINKS_SQL = _WITH + "SELECT doc, cls, key, to_cls, to_key FROM pl"
GENERIC_LINKS_SQL = _WITH + "SELECT doc, cls, key, to_cls, to_key FROM gl"
ENTITIES_SQL = _WITH + (
    ", l AS (SELECT *, TRUE AS raised FROM pl UNION ALL SELECT *, FALSE FROM gl), x AS (SELECT f.*, coalesce(l.to_cls, f.cls) AS gc, coalesce(l.to_key, f.key) AS gk, CASE WHEN l.raised THEN greatest(f.conf, 0.9) ELSE f.conf END AS c2 "
    "FROM f LEFT JOIN l ON f.doc = l.doc AND f.cls = l.cls AND f.key = l.key), e AS (SELECT doc, gc, gk, min(start) AS s, list_distinct(list(gender)) AS gs FROM x GROUP BY doc, gc, gk), "
    "k AS (SELECT *, 'e' || row_number() OVER (PARTITION BY doc ORDER BY s) AS entity FROM e) "
    "SELECT x.doc, x.seq, k.entity, x.gc AS entity_cls, substr(sha256(x.gk), 1, 16) AS norm, CAST(x.c2 AS DOUBLE) AS conf, CASE WHEN len(gs) = 1 THEN gs[1] END AS gender, len(gs) > 1 AS gender_conflict FROM x JOIN k ON x.doc = k.doc AND x.gc = k.gc AND x.gk = k.gk"
)
MAILS = _rows("doc, seq, local", "(1, 0, 'anna.keller')", "(1, 1, 'info')", "(2, 0, 'e.mueller')", "(2, 1, 'koch')", "(3, 0, 'kochmueller')")
PEOPLE = _rows("doc, entity, last", "(1, 'e1', 'Keller')", "(1, 'e2', 'Becker')", "(2, 'e1', 'Müller')", "(2, 'e2', 'Koch')", "(3, 'e1', 'Koch')", "(3, 'e2', 'Mueller')")
_UML = lambda c: f"replace(replace(replace(replace(lower({c}), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss')"
MAIL_LINK_SQL = f"SELECT m.doc, m.seq, min(p.entity) AS linked_entity FROM ({MAILS}) m JOIN ({PEOPLE}) p ON m.doc = p.doc AND contains({_UML('m.local')}, {_UML('p.last')}) GROUP BY m.doc, m.seq HAVING count(DISTINCT p.entity) = 1"

# --- tokens ---
TO_TOKENIZE = _rows("doc, start, entity, label, gender", "(1, 0, 'e1', 'PERSON', 'female')", "(1, 9, 'e2', 'PERSON', 'male')", "(1, 30, 'e1', 'PERSON', 'female')", "(1, 40, 'e3', 'EMAIL', NULL)", "(1, 50, 'e4', 'PERSON', NULL)", "(2, 5, 'e1', 'EMAIL', NULL)", "(2, 8, 'e2', 'EMAIL', NULL)")
RESERVED = "SELECT 1 AS doc, 'PERSON' AS label, array(1, 3) AS numbers"
COUNTERS = "SELECT 2 AS doc, 'EMAIL' AS label, 998 AS last"
NUMBERING_SQL = (
    f"WITH a AS (SELECT doc, label, entity, min(start) AS s, max(gender) AS gender FROM ({TO_TOKENIZE}) GROUP BY 1, 2, 3), b AS (SELECT *, row_number() OVER (PARTITION BY doc, label ORDER BY s, entity) AS k FROM a), "
    "c AS (SELECT *, list_filter(range(CASE WHEN doc = 2 AND label = 'EMAIL' THEN 999 ELSE 1 END, 1100), lambda n: NOT (doc = 1 AND label = 'PERSON' AND n IN (1, 3)))[k] AS number FROM b) "
    "SELECT doc, label, entity, number, '<' || label || CASE WHEN label = 'PERSON' AND gender IN ('female', 'male') THEN '_' || upper(gender) ELSE '' END || '_' || lpad(CAST(number AS VARCHAR), CAST(greatest(3, length(CAST(number AS VARCHAR))) AS INTEGER), '0') || '>' AS token FROM c"
)
TOKEN_TEXTS = _rows("doc, text", "(1, 'a <PERSON_FEMALE_003> b <PERSON_003> <EMAIL_1000> <EMAIL_01>')", "(2, 'none <X_REDACTED>')", "(3, '<A_B_001><A_B_001>')")
RESERVED_SQL = (
    "SELECT DISTINCT doc, regexp_replace(regexp_extract(x, '<([A-Z][A-Z_]*?)_([0-9]{3,})>', 1), '^PERSON_(FEMALE|MALE)$', 'PERSON') AS label, CAST(regexp_extract(x, '<([A-Z][A-Z_]*?)_([0-9]{3,})>', 2) AS BIGINT) AS number "
    f"FROM (SELECT doc, unnest(regexp_extract_all(text, '<[A-Z][A-Z_]*?_[0-9]{{3,}}>')) AS x FROM ({TOKEN_TEXTS}))"
)
REWRITE_TEXTS = _rows("doc, text", "(1, 'Anna met Tom and Anna')", "(2, 'nothing')", "(3, 'x😀yz')")
REPLACEMENTS = 'SELECT doc, start, stop AS `end`, new FROM (VALUES (1, 0, 4, \'<P_001>\'), (1, 9, 12, \'<P_002>\'), (1, 17, 21, \'<P_001>\'), (3, 1, 3, \'_\')) AS t(doc, start, stop, new)'
REWRITE_SQL = _rows("doc, text", "(1, '<P_001> met <P_002> and <P_001>')", "(2, 'nothing')", "(3, 'x_z')")
ANSWERS = _rows("doc, session, text", "(1, 's', 'Dear <PERSON_001> and <PERSON_001> and <PERSON_001>, <EMAIL_001> <EMAIL_009>')", "(2, 's', 'none')", "(3, 't', 'hi <PERSON_001>')")
MAPPING = "SELECT 's' AS session, '<PERSON_001>' AS token, 'Anna' AS value, array('Anna', 'ANNA') AS forms UNION ALL SELECT 's', '<EMAIL_001>', 'a@b.de', array('a@b.de') UNION ALL SELECT 't', '<PERSON_001>', 'Tom', cast(array() AS array<string>)"
RESTORE_SQL = (
    f"WITH a AS (SELECT doc, session, regexp_split_to_array(text, '<[A-Z][A-Z_]*?_[0-9]{{3,}}>') AS g, regexp_extract_all(text, '<[A-Z][A-Z_]*?_[0-9]{{3,}}>') AS m FROM ({ANSWERS})), "
    "r AS (SELECT doc, session, i, g[i] AS gap, CASE WHEN i <= len(m) THEN m[i] END AS token FROM (SELECT *, unnest(range(1, len(g) + 1)) AS i FROM a)), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY doc, token ORDER BY i) AS k FROM r), "
    "v AS (SELECT * FROM (VALUES ('s', '<PERSON_001>', 'Anna', ['Anna', 'ANNA']), ('s', '<EMAIL_001>', 'a@b.de', ['a@b.de']), ('t', '<PERSON_001>', 'Tom', [])) AS t(session, token, value, forms)) "
    "SELECT doc, string_agg(gap || coalesce(forms[k], value, k.token, ''), '' ORDER BY i) AS text, count(v.value) AS restored FROM k LEFT JOIN v ON k.session = v.session AND k.token = v.token GROUP BY doc"
)
UNKNOWN_SQL = f"SELECT DISTINCT doc, token FROM (SELECT doc, session, unnest(regexp_extract_all(text, '<[A-Z][A-Z_]*?_[0-9]{{3,}}>')) AS token FROM ({ANSWERS})) WHERE (session, token) NOT IN (('s', '<PERSON_001>'), ('s', '<EMAIL_001>'), ('t', '<PERSON_001>'))"
LEAK_TEXTS = _rows("doc, session, text", "(1, 's', 'call 030 123 4567 now')", "(2, 's', 'Anna  Keller went')", "(3, 's', 'annas kellerei, Bo and Bob')", "(4, 's', 'nothing <X_001>')", "(5, 't', 'Anna Keller')")
LEAK_VALUES = _rows("session, cls, value", "('s', 'PHONE', '0301234567')", "('s', 'PERSON', 'Anna Keller')", "('s', 'PERSON', 'Bo')", "('s', 'PERSON', 'Anna')")
LEAKS_SQL = _rows("doc, value", "(1, '0301234567')", "(2, 'Anna Keller')", "(2, 'Anna')", "(3, 'Anna')", "(3, 'Bo')")

# --- the vault ---
SESSIONS = "SELECT id, CAST(created AS TIMESTAMP) AS created_at FROM (VALUES ('s1', '2024-01-10 00:00:00'), ('s2', '2024-02-20 00:00:00'), ('s3', '2024-01-31 00:00:00')) AS t(id, created)"
VAULT_MAPPINGS = _rows("session_id, token", "('s1', '<PERSON_FEMALE_003>')", "('s1', '<PERSON_MALE_012>')", "('s1', '<EMAIL_001>')", "('s2', '<EMAIL_1001>')", "('s2', '<K2_TAG_004>')")
SESSIONS_SQL = f"SELECT s.id, (SELECT count(*) FROM ({VAULT_MAPPINGS}) m WHERE m.session_id = s.id) AS token_count FROM ({SESSIONS}) s ORDER BY created_at, id"
COUNTERS_SQL = f"SELECT session_id, regexp_replace(regexp_extract(token, '^<(.+)_([0-9]+)>$', 1), '_(FEMALE|MALE)$', '') AS label, max(CAST(regexp_extract(token, '^<(.+)_([0-9]+)>$', 2) AS BIGINT)) AS last FROM ({VAULT_MAPPINGS}) GROUP BY 1, 2"
ENTRIES_PLAIN = _rows("session_id, token, data_class, value", "('s1', '<PERSON_001>', 'PERSON_LAST_NAME', 'Keller')", "('s1', '<EMAIL_001>', 'EMAIL', 'a@b.de')", "('s2', '<PERSON_001>', 'PERSON_LAST_NAME', 'Äß')")
ENTRIES_CHANGED = _rows("session_id, token, data_class, value", "('s1', '<PERSON_001>', 'PERSON_LAST_NAME', 'Koch')", "('s1', '<EMAIL_001>', 'EMAIL', 'a@b.de')")
ENTRIES = f"SELECT *, array(value, upper(value)) AS forms FROM ({ENTRIES_PLAIN})"
ENTRIES_SQL = f"SELECT session_id, token, data_class, value, value || '/' || upper(value) AS forms FROM ({ENTRIES_PLAIN})".replace("upper(value)", "CASE WHEN value = 'Äß' THEN 'ÄSS' ELSE upper(value) END")


def catalog_values() -> str:
    """The catalogue as SQL values."""
    return ", ".join(f"('{c.name}', '{c.category}', '{c.policy}', {c.priority}, '{c.label}')" for c in default_classes().values())


# --- conversations, bodies, streams ---
TURNS = _rows(
    "conv_id, turn, text",
    "(1, 0, 'Frau Keller, mail k@firma.de, please')", "(1, 1, 'again KELLER and K@firma.de')", "(1, 2, 'Herr Roth and <PERSON_002> is a literal')",
    "(2, 0, 'IBAN DE89 3704 0044 0532 0130 00')", "(2, 1, 'it was DE89370400440532013000')", "(2, 2, 'password: geheim123')",
)
REQUESTS = [
    (1, json.dumps({"system": "be kind", "messages": [{"role": "user", "content": "hi Frau Keller"}, {"role": "assistant", "content": [{"type": "text", "text": "a"}, {"type": "tool_use", "input": {"q": ["x", 1, {"y": "z"}]}}]}]})),
    (2, json.dumps({"messages": [{"role": "user", "content": [{"type": "tool_result", "content": [{"type": "text", "text": "r"}]}, {"type": "image"}, {"type": "document", "source": {"type": "text", "data": "d"}}]}]})),
    (3, "[]"),
    (4, None),
]
KEY_ROWS = [(1, '{"session_id": " abc "}', None), (2, "user_x_session_01234567-89ab-cdef-0123-456789abcdef", "own"), (3, "plain", " own "), (4, None, None)]
STREAM_MAPPING = {"<PERSON_001>": ("Keller", ["Keller"]), "<EMAIL_001>": ("k@firma.de", ["k@firma.de"])}


def _stream() -> bytes:
    delta = lambda i, d: event("content_block_delta", {"type": "content_block_delta", "index": i, "delta": d})
    parts = [
        event("message_start", {"type": "message_start"}),
        delta(0, {"type": "text_delta", "text": "Dear <PER"}), delta(0, {"type": "text_delta", "text": "SON_001>, write to <EMAIL_0"}), delta(0, {"type": "text_delta", "text": "01>."}),
        event("content_block_stop", {"type": "content_block_stop", "index": 0}),
        delta(1, {"type": "input_json_delta", "partial_json": '{"to": "<EMA'}), delta(1, {"type": "input_json_delta", "partial_json": 'IL_001>"}'}),
        event("content_block_stop", {"type": "content_block_stop", "index": 1}),
        event("message_stop", {"type": "message_stop"}),
    ]
    return b"".join(parts)


STREAM = _stream()
CHUNKS = [("whole", 0, STREAM), *(("cut", i, STREAM[i * 37 : (i + 1) * 37]) for i in range(-(-len(STREAM) // 37)))]


def normalized(docs: DataFrame) -> DataFrame:
    """text, starts, ends (null where nothing changes) of normalised texts; ASCII texts aren't sent to Python at all."""
    from pyspark.sql import functions as F

    schema = "doc_id long, text string, starts array<int>, ends array<int>"
    none = F.lit(None).cast("array<int>")
    plain = F.col("text").rlike(r"^\p{ASCII}*$")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, t, _normalized(t)) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            columns = [[k for k, _, _ in rows], [a.text if a else t for _, t, a in rows], [a.starts.tolist() if a else None for _, _, a in rows], [a.ends.tolist() if a else None for _, _, a in rows]]
            kinds = (pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "text", "starts", "ends"])

    other = docs.where(~plain).mapInArrow(run, schema)
    same = docs.where(plain | F.col("text").isNull()).select("doc_id", "text", none.alias("starts"), none.alias("ends"))
    return same.unionByName(other)


def request_texts(requests: DataFrame) -> DataFrame:
    """id, pos, path, text of each text in a request body; bodies that aren't JSON objects give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [
                (i, n, "/".join(map(str, path)), text)
                for i, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist())
                if (body := bodies.parse(raw)) is not None
                for n, (path, text) in enumerate(bodies.texts(body))
            ]
            c = list(zip(*rows)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.string()), pa.array(c[3], pa.string())], names=["id", "pos", "path", "text"])

    return requests.mapInArrow(run, "id long, pos long, path string, text string")
