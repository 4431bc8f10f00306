"""DuckDB SQL over the planted streams: the rules themselves for single events, expected rows elsewhere."""

from __future__ import annotations

import json

from strandline import wire
from strandline.plans import planted


def quoted(v) -> str:
    if v is None:
        return "NULL"
    return str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"


def values(name: str, columns: str, rows: list[tuple]) -> str:
    """A constant table; the first row is all NULL of the right type and left out again."""
    types = [c.split(" ") for c in columns.split(", ")]
    body = ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows)
    casts = ", ".join(f"{c}::{t} AS {c}" for c, t in types)
    return f"{name} AS (SELECT {casts} FROM (VALUES {body}) AS v({', '.join(c for c, _ in types)}))"


def keyed(c: str) -> str:
    return f"replace({c}, '{{k}}', k::VARCHAR)"


_FIELDS = ("path", "header", "kind", "datatype", "generics", "clarifiers", "identity", "value", "origin", "span")


def _flat(r: dict) -> tuple:
    own = [json.dumps(r[f], ensure_ascii=False) if f in ("generics", "clarifiers") and f in r else r.get(f) for f in _FIELDS]
    return (*own, "|".join(sorted(k for k in r if k not in _FIELDS)))


O = "o AS (SELECT o_orderkey::BIGINT AS k FROM orders)"
_TYPES = ", ".join(f"{f} VARCHAR" for f in (*_FIELDS, "ext"))
_FILLED = ", ".join(f"{keyed('c.' + f)} AS {f}" for f in _FIELDS)
EVENT_ROWS = f"""{O},
{values('c', 'i INT, ' + _TYPES, [(i, *_flat(r)) for i, r in enumerate(planted.EVENT_CASES)])},
ev AS (SELECT k, i, CASE WHEN k % 2 = 0 THEN 'aeon.document.v1' END AS projection, {_FILLED}, c.ext FROM o JOIN c ON c.i = k % {len(planted.EVENT_CASES)})"""

_SEG = r"(?:\.@)?\.(?:[A-Za-z_][A-Za-z0-9_]*|\[\"(?:[^\"\\]|\\.)*\"\])|\[(?:0|[1-9][0-9]*)\]".replace('\\"', '"')


def _canonical(c: str) -> str:
    return f"""({c} <> '$' AND regexp_full_match({c}, '\\$({_SEG})+') AND NOT regexp_matches({c}, '\\["[A-Za-z_][A-Za-z0-9_]*"\\]'))"""


def _limits(field: str, address: str, where: str) -> str:
    limits = planted.EVENT_LIMITS
    over = lambda counter, observed: f"SELECT k, 'AES_LIMIT_EXCEEDED', {field}, '{counter}', {observed}, {getattr(limits, counter)} FROM y WHERE {where} AND {observed} > {getattr(limits, counter)}"
    segs = f"regexp_extract_all({address}, '{_SEG}')"
    run = f"CASE WHEN regexp_matches({address}, '(\\.@\\.[A-Za-z_][A-Za-z0-9_]*){{2}}') THEN 2 WHEN contains({address}, '.@.') THEN 1 ELSE 0 END"
    bare = r"regexp_replace(seg, '^(?:\.@)?\.', '')"
    length = rf"""CASE WHEN {bare} LIKE '["%' THEN length(regexp_replace({bare}, '\\(u[0-9a-f]{{4}}|.)', '_', 'g')) - 4 ELSE length({bare}) END"""
    most = limits.max_key_segment_codepoints
    keys = f"SELECT k, 'AES_LIMIT_EXCEEDED', f, 'max_key_segment_codepoints', n, {most} FROM (SELECT k, f, {length} AS n FROM (SELECT k, {field} AS f, unnest({segs}) AS seg FROM y WHERE {where}) WHERE NOT starts_with(seg, '[')) WHERE n > {most}"
    return "\nUNION ALL ".join([over("max_path_depth", f"len({segs})"), over("max_path_characters", f"length({address})"), over("max_attribute_depth", run), keys])


def _set(items) -> str:
    return "(" + ", ".join(map(quoted, items)) + ")"


_SCALARS = [k for k in wire.KINDS if k not in wire.CONTAINERS]
_REF = f"kind IN {_set(wire.REFERENCES)} AND value IS NOT NULL"
_RULES: list[tuple[str, str, str]] = [
    ("AES_MISSING_ADDRESS", "NULL", "path IS NULL AND header IS NULL"),
    ("AES_MULTIPLE_ADDRESSES", "NULL", "path IS NOT NULL AND header IS NOT NULL"),
    ("AES_MISSING_FIELD", "'kind'", "kind IS NULL"),
    ("AES_INVALID_PATH", "'path'", "plane = 'path' AND NOT ok"),
    ("AES_INVALID_HEADER_PATH", "'header'", "plane = 'header' AND NOT ok"),
    ("AES_INVALID_HEADER_PATH", "'header'", "plane = 'header' AND ok AND NOT starts_with(header, '$.[\"aeon:')"),
    ("AES_HEADER_REQUIRES_PROJECTION", "'header'", "plane = 'header' AND projection IS NULL"),
    ("AES_UNKNOWN_KIND", "'kind'", f"kind NOT IN {_set(wire.KINDS)}"),
    ("AES_UNEXPECTED_VALUE", "'value'", f"kind IN {_set(wire.CONTAINERS)} AND value IS NOT NULL"),
    ("AES_MISSING_VALUE", "'value'", f"kind IN {_set(_SCALARS)} AND value IS NULL"),
    ("AES_INVALID_VALUE", "'value'", " OR ".join(f"(kind = '{k}' AND value NOT IN {_set(v)})" for k, v in wire.EXACT_VALUES.items())),
    ("AES_INVALID_VALUE", "'value'", "kind = 'HexLiteral' AND NOT regexp_full_match(value, '[0-9a-f]+')"),
    ("AES_INVALID_VALUE", "'value'", "kind IN ('NodeHead', 'SymbolicLiteral') AND value = ''"),
    ("AES_INVALID_VALUE", "'value'", "kind = 'WTCDateTimeLiteral' AND contains(value, '&') AND lower(string_split(value, '&')[-1]) = 'local' AND string_split(value, '&')[-1] <> 'local'"),
    ("AES_INVALID_REFERENCE", "'value'", f"{_REF} AND NOT {_canonical('value')}"),
    ("AES_EMPTY_FIELD", "'datatype'", "datatype = ''"),
    ("AES_EMPTY_FIELD", "'identity'", "identity = ''"),
    ("AES_DATATYPE_COMPONENTS", "'generics'", "(datatype IS NULL) AND (generics IS NOT NULL)"),
    ("AES_DATATYPE_COMPONENTS", "'clarifiers'", "datatype IS NOT NULL AND generics IS NOT NULL AND clarifiers IS NULL"),
    ("AES_INVALID_DATATYPE", "'datatype'", "clarifiers IS NOT NULL AND NOT regexp_full_match(datatype, '[A-Za-z_][A-Za-z0-9_]*')"),
    ("AES_INVALID_DATATYPE", "'datatype'", "regexp_matches(clarifiers, '\"NumberLiteral\", \"value\": \"[^\"]*e\"')"),
    ("AES_INVALID_ORIGIN", "'origin'", "NOT regexp_full_match(origin, 'sha256:[0-9a-f]{64}')"),
    ("AES_SPAN_REQUIRES_ORIGIN", "'span'", "span IS NOT NULL AND origin IS NULL"),
    ("AES_INVALID_SPAN", "'span'", "span IS NOT NULL AND (NOT regexp_full_match(span, '(0|[1-9][0-9]*):(0|[1-9][0-9]*)') OR split_part(span, ':', 1)::BIGINT >= split_part(span, ':', 2)::BIGINT)"),
]
_VALUE_LIMITS = [("kind = 'StringLiteral'", "max_string_codepoints", "'value'", "length(value)"), ("kind = 'NodeHead'", "max_key_segment_codepoints", "'value'", "length(value)")]
_VALUE_LIMITS += [("clarifiers IS NOT NULL", "max_string_codepoints", "'clarifiers'", "length(regexp_extract(clarifiers, '\"StringLiteral\", \"value\": \"([^\"]*)\"', 1))")]
#: Descriptors that nest or list too much, by case.
_DESCRIPTORS = [(42, "AES_DATATYPE_DEPTH", "max_generic_depth", 2, 1), (43, "AES_DATATYPE_LIMIT", "max_generic_arguments", 3, 2), (44, "AES_DATATYPE_LIMIT", "max_clarifier_values", 2, 1), (48, "AES_DATATYPE_LIMIT", "max_datatype_components", 5, 4)]

EVENT_FINDINGS = f"""WITH {EVENT_ROWS},
{values('ds', 'i INT, code VARCHAR, counter VARCHAR, observed BIGINT, lim BIGINT', _DESCRIPTORS)},
x AS (SELECT *, CASE WHEN path IS NOT NULL AND header IS NULL THEN 'path' WHEN header IS NOT NULL AND path IS NULL THEN 'header' END AS plane,
             CASE WHEN path IS NULL THEN header WHEN header IS NULL THEN path END AS address FROM ev),
y AS (SELECT *, plane IS NOT NULL AND {_canonical('address')} AS ok FROM x),
f(record, code, field, counter, observed, lim) AS (
{chr(10).join(f"SELECT k, '{code}', {field}, NULL::VARCHAR, NULL::BIGINT, NULL::BIGINT FROM y WHERE {rule} UNION ALL" for code, field, rule in _RULES)}
{chr(10).join(f"SELECT k, 'AES_LIMIT_EXCEEDED', {field}, '{counter}', {n}, {getattr(planted.EVENT_LIMITS, counter)} FROM y WHERE {rule} AND {n} > {getattr(planted.EVENT_LIMITS, counter)} UNION ALL" for rule, counter, field, n in _VALUE_LIMITS)}
{_limits('plane', 'address', 'ok')}
UNION ALL {_limits("'value'", 'value', f"{_REF} AND {_canonical('value')}")}
UNION ALL SELECT k, 'AES_UNKNOWN_FIELD', e, NULL, NULL, NULL FROM (SELECT k, unnest(string_split(ext, '|')) AS e FROM y WHERE ext <> '') WHERE e NOT IN {_set(planted.REGISTERED + ('',))}
UNION ALL SELECT k, code, 'datatype', counter, observed, lim FROM y JOIN ds USING (i))
SELECT record, code, field::VARCHAR AS field, counter, observed::BIGINT AS observed, lim::BIGINT AS lim FROM f"""

#: (case, record, code, required_path, first_record, counter, observed)
STREAM_EXPECTED = [
    (1, None, "AES_UNSUPPORTED_PROFILE", None, None, None, None),
    (2, None, "AES_UNSUPPORTED_PROJECTION", None, None, None, None),
    (3, 0, "AES_MISSING_PARENT", "$", None, None, None),
    (3, 1, "AES_MISSING_PARENT", "$", None, None, None),
    (4, 2, "AES_DUPLICATE_PATH", None, 0, None, None),
    (6, 1, "AES_DUPLICATE_PATH", None, 0, None, None),
    (7, 0, "AES_HEADER_REQUIRES_PROJECTION", None, None, None, None),
    (7, 1, "AES_HEADER_REQUIRES_PROJECTION", None, None, None, None),
    (8, 0, "AES_MISSING_PARENT", "$.a{k}", None, None, None),
    (9, 1, "AES_INCOMPATIBLE_PARENT", "$.a", None, None, None),
    (10, 0, "AES_LIMIT_EXCEEDED", None, None, "max_tuple_items", 2),
    (11, 2, "AES_INCOMPATIBLE_PARENT", "$.a", None, None, None),
    (12, 0, "AES_INVALID_NODE_HEAD", None, None, None, None),
    (13, 1, "AES_DUPLICATE_IDENTITY", None, 0, None, None),
    (13, 2, "AES_EMPTY_FIELD", None, None, None, None),
    (14, 0, "AES_DUPLICATE_IDENTITY", None, 1, None, None),
    (15, 0, "AES_MISSING_REFERENCE_TARGET", "$.b{k}", None, None, None),
    (16, 0, "AES_MISSING_REFERENCE_TARGET", "$.gone{k}", None, None, None),
    (17, 1, "AES_HEADER_ORDER", None, None, None, None),
    (18, 2, "AES_LIMIT_EXCEEDED", None, None, "max_value_nesting_depth", 3),
    (19, None, "AES_LIMIT_EXCEEDED", None, None, "max_events", 6),
    (20, 0, "AES_LIMIT_EXCEEDED", None, None, "max_list_items", 3),
]
_N = len(planted.STREAM_CASES)
STREAM_FINDINGS = f"""WITH {O}, {values('x', 'i INT, record BIGINT, code VARCHAR, required VARCHAR, first_record BIGINT, counter VARCHAR, observed BIGINT', STREAM_EXPECTED)}
SELECT 't' || k AS stream_id, record, code, {keyed('required')} AS required_path, first_record, counter, observed FROM o JOIN x ON i = k % {_N}"""

#: (case, code, line, counter, canonical, events); cases that are not listed are canonical texts of one event.
TEXT_EXPECTED = [
    (1, "TELEX_BOM", 1, None, None, 0),
    (2, "TELEX_BARE_CR", None, None, None, 0),
    (3, None, None, None, 0, 1),
    (4, "TELEX_EMPTY_PROFILE", 2, None, None, 0),
    (5, "TELEX_EMPTY_PROJECTION", 2, None, None, 0),
    (6, "TELEX_DUPLICATE_STREAM_FIELD", 3, None, None, 0),
    (7, None, None, None, 0, 1),
    (9, "TELEX_LIMIT_EXCEEDED", 5, "max_line_bytes", None, 0),
    (10, "TELEX_LIMIT_EXCEEDED", 7, "max_fields_per_event", None, 0),
    (11, "TELEX_LIMIT_EXCEEDED", 10, "max_events", None, 0),
    (12, "TELEX_LIMIT_EXCEEDED", 9, "max_decoded_payload_bytes", None, 0),
    (13, "TELEX_LIMIT_EXCEEDED", None, "max_input_bytes", None, 0),
    (14, None, None, None, 0, 1),
    (15, None, None, None, 0, 1),
    (16, None, None, None, 0, 1),
    (17, None, None, None, 0, 1),
    (18, None, None, None, 0, 1),
    (19, "TELEX_INVALID_UNICODE_SCALAR", 5, None, None, 0),
    (20, "TELEX_INVALID_UNICODE_ESCAPE", 5, None, None, 0),
    (21, None, None, None, 0, 1),
    (22, "TELEX_DATATYPE_LIMIT", 5, "max_generic_depth", None, 0),
    (23, "TELEX_DATATYPE_LIMIT", 5, "max_clarifier_values", None, 0),
    (24, "TELEX_INVALID_DATATYPE", 5, None, None, 0),
    (25, None, None, None, 1, 0),
    (26, None, None, None, 0, 0),
    (27, "TELEX_INVALID_PREAMBLE", 1, None, None, 0),
]
_T = len(planted.TEXT_CASES)
_X = values("x", "i INT, code VARCHAR, line BIGINT, counter VARCHAR, canonical INT, events INT", TEXT_EXPECTED)
TEXT_FAULTS = f"""WITH {O}, {_X}
SELECT k::VARCHAR AS stream_id, code, line, counter, CASE WHEN i IS NULL THEN TRUE ELSE canonical = 1 END AS canonical, coalesce(events, 1)::INT AS events FROM o LEFT JOIN x ON i = k % {_T}"""

_HEAD, _ONE = "telex.aes=1\n", "\npath=$.o{k}\nkind=ObjectNode\n"
_BOTH = _HEAD + "profile=a\nprojection=b{k}\n" + _ONE
_SPELT = {7: _BOTH, 8: _BOTH, 17: _HEAD + _ONE + "value=a\\n\\0\n", 18: _HEAD + _ONE + "value=\\u{1}\\u{7F}\n", 21: _HEAD + _ONE + "datatype=list<a{k}, b>\n", 25: _HEAD, 26: _HEAD}
_CANONICAL = [(i, _SPELT.get(i, _HEAD + _ONE)) for i in range(_T) if i not in {x[0] for x in TEXT_EXPECTED if x[1]}]
TEXT_CANONICAL = f"""WITH {O}, {_X}, {values('s', 'j INT, spelt VARCHAR', _CANONICAL)}
SELECT k::VARCHAR AS stream_id, {keyed('spelt')} AS text, code FROM o LEFT JOIN x ON i = k % {_T} LEFT JOIN s ON j = k % {_T}"""

STREAM_ROWS = f"""{O},
{values('c', 'i INT, ordinal BIGINT, ' + _TYPES, [(i, j, *_flat(r)) for i, (_, _, rs) in enumerate(planted.STREAM_CASES) for j, r in enumerate(rs)])},
{values('cx', 'i INT, profile VARCHAR, projection VARCHAR', [(i, p, j) for i, (p, j, _) in enumerate(planted.STREAM_CASES)])},
st AS (SELECT k, cx.i, 't' || k AS stream_id, {keyed('profile')} AS profile, projection FROM o JOIN cx ON cx.i = k % {_N}),
ev AS (SELECT k, c.i, 't' || k AS stream_id, ordinal, {_FILLED} FROM o JOIN c ON c.i = k % {_N})"""

ENCODE_GUARDS = f"""WITH {STREAM_ROWS},
n AS (SELECT stream_id, count(*) AS n, max(greatest(strlen('path=' || coalesce(path, '')), strlen('header=' || coalesce(header, '')), strlen('kind=' || kind), strlen('value=' || coalesce(value, '')), strlen('identity=' || coalesce(identity, '')))) AS l FROM ev GROUP BY ALL)
SELECT stream_id, CASE WHEN n > 4 THEN 'max_events' WHEN greatest(l, strlen('profile=' || profile), strlen('projection=' || coalesce(projection, ''))) > 23 THEN 'max_line_bytes' END AS error FROM st LEFT JOIN n USING (stream_id)"""

INVALID = sorted({x[0] for x in STREAM_EXPECTED})


# -- logical bytes as SQL -----------------------------------------------------------


class Expr(str):
    """An SQL expression that gives a string; null is the logical null."""


class Encoded(str):
    """An SQL expression that is already in logical bytes."""


def logical(v) -> str:
    """The encoding of a nested value with expressions at its leaves."""
    if v is None:
        return "'n'"
    if isinstance(v, Encoded):
        return str(v)
    if isinstance(v, Expr):
        return f"CASE WHEN {v} IS NULL THEN 'n' ELSE 's' || strlen({v}) || ':' || {v} END"
    if isinstance(v, str):
        return quoted(f"s{len(v.encode())}:{v}")
    if isinstance(v, list):
        return " || ".join([f"'l{len(v)}:'", *(f"({logical(x)})" for x in v)])
    return " || ".join([f"'m{len(v)}:'", *(f"{logical(k)} || ({logical(x)})" for k, x in sorted(v.items(), key=lambda m: m[0].encode()))])


def _member(key: str, column: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN '' ELSE 's{len(key)}:{key}' || 's' || strlen({column}) || ':' || {column} END"


def _record(fields: tuple[str, ...]) -> str:
    return "'m' || (" + " + ".join(f"({f} IS NOT NULL)::INT" for f in fields) + ") || ':' || " + " || ".join(_member(f, f) for f in sorted(fields))


_OWN = ("header", "identity", "kind", "path", "value")


def _digest(ordering: str, scope: str, provenance: str = wire.PROVENANCE_EXCLUDED) -> str:
    value = {
        "integrity": wire.INTEGRITY_CONTRACT, "events": wire.EVENT_CONTRACT, "profile": Expr("profile"), "projection": Expr("projection"), "ordering": ordering,
        "scope": scope, "provenance": provenance, "digest": "sha256", "records": Encoded("'l' || coalesce(n, 0) || ':' || coalesce(body, '')"),
    }
    return f"sha256('{wire.INTEGRITY_CONTRACT}' || chr(0) || {logical(value)})"


def _bodies(order: str, where: str, fields: tuple[str, ...] = _OWN) -> str:
    return f"bd AS (SELECT stream_id, count(*) AS n, string_agg({_record(fields)}, '' ORDER BY {order}) AS body FROM ev WHERE {where} GROUP BY stream_id)"


_REFUSED = f"st.i IN {_set(INVALID)}"
_BODY_DIGESTS = f"WITH {STREAM_ROWS}, {_bodies('ordinal', 'path IS NOT NULL')}, d AS (SELECT st.stream_id, k, CASE WHEN {_REFUSED} THEN NULL ELSE {_digest(wire.EXACT_ORDER, wire.BODY_SCOPE)} END AS digest FROM st LEFT JOIN bd USING (stream_id))"
_SIGNED = {"signature": wire.SIGNATURE_CONTRACT, "integrity": wire.INTEGRITY_CONTRACT, "digest": "sha256", "hash": Expr("digest"), "alg": "ed25519", "kid": "key-1"}
_SOURCED = """d AS (SELECT doc_id, text, strlen(text) AS n FROM documents WHERE text IS NOT NULL),
ev AS (SELECT 'd' || (doc_id % 5) AS stream_id, doc_id * 2 + j AS ordinal, 'StringLiteral' AS kind, '$.d' || doc_id || '_' || j AS path, 'x' AS value,
              'sha256:' || sha256(CASE WHEN doc_id % 7 = 0 THEN text || 'x' WHEN doc_id % 11 = 0 THEN 'absent' ELSE text END) AS origin,
              CASE WHEN j = 0 THEN '0:' || (n // 2 + 1) ELSE (n // 3) || ':' || (n + doc_id % 3) END AS span FROM d, range(2) t(j))"""


def _provenance(name: str, fields: tuple[str, ...], contract: str) -> str:
    return f"{name} AS (SELECT stream_id, {_digest(wire.EXACT_ORDER, wire.BODY_SCOPE, contract)} AS h FROM (SELECT stream_id, 'aes.complete.v1' AS profile, NULL::VARCHAR AS projection, count(*) AS n, string_agg({_record(fields)}, '' ORDER BY ordinal) AS body FROM ev GROUP BY stream_id))"


#: Framing errors by case: (case, code, offset, counted from the end of the address, record, component).
_BINARY_EXPECTED = [
    (1, "FILM_INVALID_PREAMBLE", 0, 0, None, "preamble"),
    (2, "FILM_TRUNCATED", 3, 0, None, "preamble"),
    (3, "FILM_TRUNCATED", 7, 0, 0, "record"),
    (4, "FILM_INVALID_RECORD", 7, 0, 0, "record-control"),
    (5, "FILM_INVALID_KIND", 8, 0, 0, "kind"),
    (6, "FILM_INVALID_KIND", 8, 0, 0, "kind"),
    (7, "FILM_NONCANONICAL", 7, 0, 0, "record-length"),
    (8, "FILM_NONCANONICAL", 6, 0, 0, "record-length"),
    (9, "FILM_INVALID_UTF8", 9, 0, 0, "address"),
    (10, "FILM_INVALID_RECORD", 7, 0, 0, "record-control"),
    (11, "FILM_INVALID_RECORD", 44, 1, 0, "span"),
    (12, "FILM_INVALID_EXTENSION", 10, 1, 0, "extension-name"),
    (13, "FILM_NONCANONICAL", 17, 1, 0, "extension-name"),
    (14, "FILM_TRUNCATED", 11, 1, 0, "extension-name"),
    (15, "FILM_INVALID_CONTEXT", 5, 0, None, "stream-context"),
]
_B = 20
_BINARY = values("x0", "i INT, code VARCHAR, place BIGINT, after INT, record BIGINT, component VARCHAR", _BINARY_EXPECTED) + ", x AS (SELECT * REPLACE (after = 1 AS after) FROM x0)"
_REFUSALS = values("r", "i INT, codes VARCHAR", [(16, "AES_EMPTY_FIELD"), (17, "AES_UNKNOWN_FIELD"), (19, "AES_INVALID_NODE_HEAD,AES_INVALID_VALUE")])
_NOT_CANONICAL = (3, 7, 10, 14, 15, 16, 17, 18, 21, 26)
#: Under the default limits; the rest is refused by the event rules (unknown profile, values of containers, repeats, events without an address).
_REFUSED_TEXTS = [(x[0], x[1]) for x in TEXT_EXPECTED if x[1] and x[1] != "TELEX_LIMIT_EXCEEDED"] + [(i, "FILM_SOURCE_NONCANONICAL") for i in _NOT_CANONICAL] + [(i, "FILM_AES_INVALID") for i in (8, 9, 11, 12, 13)]

_MORE = "need-more-input"
#: (case, seq, status, error) of the incremental decoder: sound, unfinished, late, repeated and early chunks, two faults.
_CHUNKS = [
    *((i, j, _MORE, None) for i in (0, 1, 2, 4) for j in (0, 1)),
    *((i, 2, "complete", None) for i in (0, 2, 4)),
    (2, 3, "error", "TELEX_DECODER_CLOSED"),
    (3, 0, _MORE, None),
    (3, 1, _MORE, None),
    (3, 1, "error", "CHUNK_REPEATED"),
    (5, 0, "error", "TELEX_INVALID_PREAMBLE"),
    (5, 1, "error", "TELEX_DECODER_CLOSED"),
    (5, 2, "error", "TELEX_DECODER_CLOSED"),
    (6, 0, _MORE, None),
    (6, 1, "error", "TELEX_INVALID_FIELD_LINE"),
]

_KEY = Expr("k::VARCHAR")
#: The bodies of the query of transactions.
_BODY = {
    "transaction": wire.TX_CONTRACT, "id": Expr("('t-' || k)"), "intent": Expr("('i-' || k)"), "attempt": Expr("(CASE WHEN k % 41 = 0 THEN 't-' ELSE 'a-' END || k)"),
    "events": wire.EVENT_CONTRACT, "profile": wire.PARTIAL_PROFILE, "projection": None, "ordering": wire.EXACT_ORDER, "application": {"contract": wire.TX_SCALAR_REPLACEMENT},
    "target": {"contract": wire.TX_TARGET, "id": Expr("('x' || k % 2)"), "boundary": "$"}, "preconditions": [{"contract": wire.TX_REVISION, "scope": "$", "revision": _KEY}],
    "preparation": {"contract": wire.TX_IDENTITY_PREPARATION}, "authorization": {"contract": wire.TX_HOST_AUTHORIZATION, "context": "c"},
    "limits": {"contract": wire.TX_LIMITS_CLAIM, "id": "l", "version": Expr("(k % 2)::VARCHAR")},
    "assertions": {"eventCount": Expr("CASE WHEN k % 43 = 0 THEN '2' ELSE '1' END"), "containers": []},
    "records": [{"path": "$.total", "kind": Expr("CASE WHEN k % 47 = 0 THEN 'ObjectNode' ELSE 'NumberLiteral' END"), "value": "1"}],
    "integrity": {"contract": wire.TX_INTEGRITY, "digest": "sha256"},
}

ORACLES: dict[str, str] = {
    "event_findings": EVENT_FINDINGS,
    "stream_findings": STREAM_FINDINGS,
    "text_faults": TEXT_FAULTS,
    "text_canonical": TEXT_CANONICAL,
    "encode_guards": ENCODE_GUARDS,
    "text_completeness": f"""WITH {O} SELECT k::VARCHAR AS stream_id, 'path' AS plane, '$.a' || k AS path, '$.a' || k || '.b[0]' AS required_by FROM o WHERE k % 2 = 0
UNION ALL SELECT k::VARCHAR, 'path', '$.a' || k || '.b', '$.a' || k || '.b[0]' FROM o WHERE k % 2 = 0""",
    "digest_refusals": f"""WITH {STREAM_ROWS}, {_bodies('path', 'path IS NOT NULL')},
e AS (SELECT st.*, n, body, CASE WHEN {_REFUSED} THEN 'AES_INTEGRITY_INVALID_LOGICAL_VALUE' WHEN st.i = 5 THEN 'AES_INTEGRITY_AMBIGUOUS_CANONICAL_ORDER' END AS error FROM st LEFT JOIN bd USING (stream_id))
SELECT stream_id, CASE WHEN error IS NULL THEN {_digest(wire.CANONICAL_ORDER, wire.BODY_SCOPE)} END AS digest, error FROM e""",
    "digest_document": f"""WITH {STREAM_ROWS}, {_bodies('ordinal', 'TRUE')},
e AS (SELECT st.*, n, body, CASE WHEN projection IS DISTINCT FROM 'aeon.document.v1' THEN 'AES_INTEGRITY_UNSUPPORTED_SCOPE' WHEN {_REFUSED} THEN 'AES_INTEGRITY_INVALID_LOGICAL_VALUE' END AS error FROM st LEFT JOIN bd USING (stream_id))
SELECT stream_id, CASE WHEN error IS NULL THEN {_digest(wire.EXACT_ORDER, wire.DOCUMENT_SCOPE)} END AS digest, error FROM e""",
    "digest_verify": f"{_BODY_DIGESTS} SELECT stream_id, digest IS NOT NULL AND k % 3 = 0 AS matches FROM d",
    "signature_inputs": f"{_BODY_DIGESTS} SELECT stream_id, sha256('{wire.SIGNATURE_CONTRACT}' || chr(0) || {logical(_SIGNED)}) AS h FROM d WHERE digest IS NOT NULL",
    "digest_provenance": f"""WITH {_SOURCED}, {_provenance('a', ('kind', 'origin', 'path', 'span', 'value'), wire.PROVENANCE_INCLUDED)}, {_provenance('b', ('kind', 'path', 'value'), wire.PROVENANCE_EXCLUDED)}
SELECT stream_id, a.h AS included, b.h AS excluded FROM a JOIN b USING (stream_id)""",
    "path_building": rf"""WITH {O} SELECT k, '$.o' || k || '[' || k || '].@.["é ' || k || '"].["' || k || '\"\\\n\u0001/"]' AS path, TRUE AS canonical FROM o""",
    "json_round_trip": f"WITH {EVENT_ROWS} SELECT k AS ordinal, path, header, kind, datatype, generics, clarifiers, identity, value, origin, span, coalesce(ext, '') AS ext FROM ev",
    "delta_blocks": f"""WITH {EVENT_ROWS}, x AS (SELECT 'v' || (k % 16) AS stream_id, k AS ordinal, coalesce(path, header) AS address FROM ev WHERE (path IS NULL) <> (header IS NULL))
SELECT stream_id, ordinal, 'block' AS layout, address FROM x WHERE stream_id = 'v3' AND ordinal // 256 = 1 UNION ALL SELECT stream_id, ordinal, 'whole', address FROM x""",
    "compact_streams": f"""WITH {STREAM_ROWS} SELECT stream_id, count(*)::INT AS events, max(CASE WHEN ordinal = 1 THEN coalesce(path, header) END) AS second, count(value)::INT AS "values", max(CASE WHEN ordinal = 0 THEN identity END) AS identity FROM ev GROUP BY stream_id""",
    "provenance_summary": f"""WITH {_SOURCED}, t AS (SELECT DISTINCT 'sha256:' || sha256(CASE WHEN doc_id % 7 = 0 THEN text || 'x' ELSE text END) AS origin, 'sha256:' || sha256(text) AS actual FROM d),
u AS (SELECT DISTINCT stream_id, ev.origin, actual FROM ev LEFT JOIN t USING (origin)),
n AS (SELECT stream_id, count(CASE WHEN actual = origin THEN 1 END)::INT AS verified, count(CASE WHEN actual IS NULL THEN 1 END)::INT AS missing, count(CASE WHEN actual <> origin THEN 1 END) AS wrong FROM u GROUP BY ALL),
b AS (SELECT stream_id, max(span_end > n) AS long FROM (SELECT ev.stream_id, split_part(span, ':', 2)::BIGINT AS span_end, t.n FROM ev JOIN (SELECT 'sha256:' || sha256(text) AS origin, max(n) AS n FROM d WHERE doc_id % 7 <> 0 GROUP BY 1) t USING (origin)) GROUP BY ALL)
SELECT stream_id, NOT (wrong > 0 OR missing > 0 OR coalesce(long, FALSE)) AS valid, missing = 0 AS complete, verified, missing FROM n LEFT JOIN b USING (stream_id)""",
    "binary_faults": f"""WITH {O}, {_BINARY}
SELECT k::VARCHAR AS stream_id, code, place + CASE WHEN after THEN strlen('$.o' || k) ELSE 0 END AS offset, record, component, CASE WHEN code IS NOT NULL THEN 'film' END AS stage,
       CASE WHEN k % {_B} = 17 THEN '0:5' END AS span, CASE WHEN code IS NULL THEN (k % {_B} = 17)::INT END AS extensions FROM o LEFT JOIN x ON i = k % {_B}""",
    "binary_acceptance": f"""WITH {O}, {_BINARY}, {_REFUSALS}
SELECT k::VARCHAR AS stream_id, coalesce(code, CASE WHEN codes IS NOT NULL THEN 'FILM_AES_INVALID' END) AS error, coalesce(codes, '') AS diagnostics FROM o LEFT JOIN x ON x.i = k % {_B} LEFT JOIN r ON r.i = k % {_B}""",
    "binary_to_text": f"""WITH {O}, {_BINARY}, {_REFUSALS}, t AS (SELECT k, 'telex.aes=1' || chr(10) || chr(10) || 'path=$.o' || k || chr(10) || 'kind=' ||
  CASE k % {_B} WHEN 18 THEN 'StringLiteral' || chr(10) || 'value=1' WHEN 17 THEN 'ObjectNode' || chr(10) || 'origin=sha256:{"0f" * 32}' || chr(10) || 'span=0:5' || chr(10) || 'x.a.b=1' ELSE 'ObjectNode' END || chr(10) AS text FROM o)
SELECT k::VARCHAR AS stream_id, CASE WHEN code IS NULL AND (codes IS NULL OR codes = 'AES_UNKNOWN_FIELD') THEN text END AS text,
       coalesce(code, CASE WHEN codes <> 'AES_UNKNOWN_FIELD' THEN 'FILM_AES_INVALID' END) AS error FROM t LEFT JOIN x ON x.i = k % {_B} LEFT JOIN r ON r.i = k % {_B}""",
    "text_to_binary": f"""WITH {O}, {values('x', 'i INT, error VARCHAR', _REFUSED_TEXTS)}
SELECT k::VARCHAR AS stream_id, CASE k % {_T} WHEN 0 THEN '4f5f5fff0100' || printf('%02x', 3 + strlen('$.o' || k)) || '0011' || printf('%02x', strlen('$.o' || k)) || lower(hex(encode('$.o' || k))) WHEN 25 THEN '4f5f5fff0100' END AS hex, error
FROM o LEFT JOIN x ON i = k % {_T}""",
    "text_chunk_decoding": f"""WITH {O}, {values("x", "i INT, seq BIGINT, status VARCHAR, error VARCHAR", _CHUNKS)} SELECT k::VARCHAR AS stream_id, seq, status, error FROM o JOIN x ON i = k % 7""",
    "accepted_chunks": f"""WITH {O} SELECT k::VARCHAR AS stream_id, 'aes.complete.v1' AS profile, TRUE AS valid, 0::BIGINT AS n_diagnostics FROM o WHERE k % 7 IN (0, 2, 4)""",
    "transaction_evidence": f"""WITH {O}, d AS (SELECT k, sha256('{wire.TX_INTEGRITY}' || chr(0) || {logical(_BODY)}) AS digest,
  k % 41 = 0 OR k % 43 = 0 OR k % 47 = 0 AS unsound FROM o)
SELECT 't-' || k AS tx_id, digest, NOT unsound AND k % 5 = 4 AS valid, NOT unsound AND k % 5 >= 3 AS evidence_verified, NOT unsound AND k % 5 = 4 AND k % 2 = 0 AS ready,
       k % 5 IN (0, 1, 3) OR (k % 5 = 2 AND NOT unsound) AS refused FROM d""",
}
