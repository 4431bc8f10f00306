"""DuckDB SQL that gives the rows of the registered queries."""

from __future__ import annotations

EVENTS = r"""
o AS (SELECT o_orderkey::BIGINT AS k, o_custkey, o_orderstatus AS st, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS total,
             strftime(o_orderdate, '%Y-%m-%d') AS dt, o_orderpriority AS pr, 's' || (o_custkey % 16)::VARCHAR AS stream_id, '$.o' || o_orderkey::VARCHAR AS b FROM orders),
ev AS (
  SELECT stream_id, 1000000000 + k * 100 AS ordinal, b AS path, NULL::VARCHAR AS header, 'ObjectNode' AS kind, NULL::VARCHAR AS value,
         CASE WHEN k % 89 = 0 THEN 'again' ELSE 'o-' || k::VARCHAR END AS identity FROM o WHERE k % 97 <> 0
  UNION ALL SELECT stream_id, 1000000000 + k * 100 + 1, b || '.total', NULL, 'NumberLiteral', total, NULL FROM o
  UNION ALL SELECT stream_id, 1000000000 + k * 100 + 2, b || '.status', NULL, 'StringLiteral', st, NULL FROM o
  UNION ALL SELECT stream_id, 1000000000 + k * 100 + 3, b || '.date', NULL, 'DateLiteral', dt, NULL FROM o
  UNION ALL SELECT stream_id, 1000000000 + k * 100 + 4, b || '.@.priority', NULL, 'StringLiteral', pr, NULL FROM o
  UNION ALL SELECT stream_id, 1000000000 + k * 100 + 5, b || '.customer', NULL, 'PointerReference',
                   CASE WHEN k % 83 = 0 THEN '$.gone' ELSE '$.c' END || o_custkey::VARCHAR, NULL FROM o
  UNION ALL SELECT stream_id, 1000000000 + k * 100 + 6, b || '.open', NULL, 'BooleanLiteral',
                   CASE WHEN k % 50 = 0 THEN 'maybe' WHEN st = 'O' THEN 'true' ELSE 'false' END, NULL FROM o
  UNION ALL SELECT stream_id, 1000000000 + k * 100 + 7, b || '.lines', NULL, CASE WHEN k % 71 = 0 THEN 'ObjectNode' ELSE 'ListNode' END, NULL, NULL FROM o
  UNION ALL SELECT stream_id, 1000000000 + k * 100 + 8, b || '.total', NULL, 'NumberLiteral', total, NULL FROM o WHERE k % 89 = 0
  UNION ALL SELECT stream_id, 1000000000 + k * 100 + 9, NULL, '$.["aeon:k' || k::VARCHAR || '"]', 'StringLiteral', total, NULL FROM o WHERE k % 61 = 0
  UNION ALL SELECT stream_id, 1000000000 + k * 100 + 20 + l_linenumber, b || '.lines[' || (l_linenumber - 1)::VARCHAR || ']', NULL, 'NumberLiteral',
                   CAST(CAST(l_quantity AS DECIMAL(18,2)) AS VARCHAR), NULL FROM (SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL) JOIN o ON l_orderkey = k
  UNION ALL SELECT 's' || (c_custkey % 16)::VARCHAR, c_custkey::BIGINT, '$.c' || c_custkey::VARCHAR, NULL, 'ObjectNode', NULL, NULL FROM customer),
st AS (SELECT 's' || i::VARCHAR AS stream_id, CASE WHEN i % 2 = 0 THEN 'aes.complete.v1' ELSE 'aes.partial.v1' END AS profile,
              CASE WHEN i % 4 < 2 THEN 'aeon.document.v1' END AS projection FROM range(16) t(i))"""

ADDRESSED = (
    EVENTS
    + r""",
ad AS (SELECT *, CASE WHEN path IS NOT NULL THEN 'path' ELSE 'header' END AS plane, coalesce(path, header) AS address,
              regexp_extract_all(coalesce(path, header), '(?:\.@)?\.(?:[A-Za-z_][A-Za-z0-9_]*|\["[^"]*"\])|\[[0-9]+\]') AS segs FROM ev),
pr AS (SELECT *, segs[-1] AS seg, len(segs) AS depth, substr(address, 1, length(address) - length(segs[-1])) AS parent FROM ad),
ix AS (SELECT stream_id, plane, address, min(ordinal) AS first, arg_min(kind, ordinal) AS first_kind, count(*) AS times FROM ad GROUP BY ALL)"""
)


def events(select: str) -> str:
    return f"WITH {EVENTS}\n{select}"


def addressed(select: str) -> str:
    return f"WITH {ADDRESSED}\n{select}"


_DIAG = "NULL::VARCHAR AS field, NULL::VARCHAR AS required_path, NULL::BIGINT AS first_record"
CHILD = r"""
ch AS (SELECT pr.*, p.first_kind AS pk, CASE WHEN seg LIKE '[%' THEN 'index' WHEN seg LIKE '.@.%' THEN 'attribute' ELSE 'member' END AS t
       FROM pr LEFT JOIN ix p ON p.stream_id = pr.stream_id AND p.plane = pr.plane AND p.address = pr.parent WHERE depth > 1)"""
DIAGNOSTICS = (
    CHILD
    + r""",
dg AS (
  SELECT a.stream_id, a.ordinal AS record, 'AES_DUPLICATE_PATH' AS code, plane FROM ad a JOIN ix USING (stream_id, plane, address) WHERE ordinal > first
  UNION ALL SELECT stream_id, ordinal, 'AES_MISSING_PARENT', plane FROM ch WHERE pk IS NULL
  UNION ALL SELECT stream_id, ordinal, 'AES_INCOMPATIBLE_PARENT', plane FROM ch
            WHERE (t = 'member' AND pk <> 'ObjectNode') OR (t = 'index' AND pk NOT IN ('ListNode', 'TupleLiteral', 'NodeHead', 'NodeLiteral'))
  UNION ALL SELECT stream_id, ordinal, 'AES_MISSING_REFERENCE_TARGET', plane FROM ad r WHERE kind = 'PointerReference'
            AND NOT EXISTS (SELECT 1 FROM ix WHERE ix.stream_id = r.stream_id AND ix.plane = 'path' AND ix.address = r.value)),
un AS (SELECT a.* FROM ad a JOIN st USING (stream_id) WHERE identity <> '' AND (CASE WHEN plane = 'path' THEN profile = 'aes.complete.v1' ELSE projection IS NOT NULL END)),
al AS (
  SELECT stream_id, record, code FROM dg JOIN st USING (stream_id) WHERE CASE WHEN plane = 'path' THEN profile = 'aes.complete.v1' ELSE projection IS NOT NULL END
  UNION ALL SELECT stream_id, ordinal, 'AES_DUPLICATE_IDENTITY' FROM (SELECT *, row_number() OVER (PARTITION BY stream_id, identity ORDER BY plane = 'header', ordinal) AS r FROM un) WHERE r > 1
  UNION ALL SELECT stream_id, ordinal, 'AES_INVALID_VALUE' FROM ad WHERE kind = 'BooleanLiteral' AND value NOT IN ('true', 'false')
  UNION ALL SELECT h.stream_id, ordinal, 'AES_HEADER_ORDER' FROM ad h WHERE plane = 'header' AND ordinal > (SELECT min(ordinal) FROM ad b WHERE b.stream_id = h.stream_id AND b.plane = 'path')
  UNION ALL SELECT stream_id, ordinal, 'AES_HEADER_REQUIRES_PROJECTION' FROM ad JOIN st USING (stream_id) WHERE plane = 'header' AND projection IS NULL)"""
)

_S = "'s' || strlen({0})::VARCHAR || ':' || {0}"


def _m(key: str, value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '' ELSE 's{len(key)}:{key}' || {_S.format(value)} END"


def _count(*values: str) -> str:
    return " + ".join(f"({v} IS NOT NULL)::INT" for v in values)


RECORD = (
    "'m' || (" + _count("header", "identity", "kind", "path", "value") + ")::VARCHAR || ':' || " + " || ".join(_m(c, c) for c in ("header", "identity", "kind", "path", "value"))
)


def digest(ordering: str, order_by: str) -> str:
    fixed = lambda k, v: f"s{len(k)}:{k}s{len(v)}:{v}"
    head = f"aes.integrity.v1' || chr(0) || 'm9:{fixed('digest', 'sha256')}{fixed('events', 'aes.events.v1')}{fixed('integrity', 'aes.integrity.v1')}{fixed('ordering', ordering)}s7:profile"
    tail = f"{fixed('provenance', 'aes.provenance.excluded.v1')}s7:recordsl"
    return events(f"""
, r AS (SELECT stream_id, count(*) AS n, string_agg({RECORD}, '' ORDER BY {order_by}) AS body FROM ev WHERE path IS NOT NULL GROUP BY stream_id)
SELECT stream_id, sha256('{head}' || {_S.format('profile')} || 's10:projection' || CASE WHEN projection IS NULL THEN 'n' ELSE {_S.format('projection')} END ||
       '{tail}' || n::VARCHAR || ':' || body || '{fixed('scope', 'aes.scope.body.v1')}') AS digest FROM r JOIN st USING (stream_id)
""")


#: Escapes of the text format: short ones, then every other control by its code.
_SPELT = "replace(text, '\\', '\\\\')"
for _code in (*range(32), 127):
    _short = {0: "\\0", 9: "\\t", 10: "\\n", 13: "\\r"}.get(_code, f"\\u{{{_code:X}}}")
    _SPELT = f"replace({_SPELT}, chr({_code}), '{_short}')"

SMALL_DIGESTS = digest("aes.order.canonical-semantic.v1", "path").replace("FROM ev WHERE path IS NOT NULL GROUP BY stream_id", "FROM small GROUP BY stream_id").replace(
    "\n, r AS", "\n, small AS (SELECT * REPLACE (regexp_extract(path, '^\\$\\.([oc][0-9]+)', 1) AS stream_id) FROM ev WHERE path IS NOT NULL), op AS (SELECT DISTINCT stream_id FROM small GROUP BY stream_id, path HAVING count(*) > 1), r AS"
)
SMALL_DIGESTS = SMALL_DIGESTS.replace("AS digest FROM r JOIN st USING (stream_id)", "AS digest, CASE WHEN stream_id IN (FROM op) THEN 'AES_INTEGRITY_AMBIGUOUS_CANONICAL_ORDER' END AS error FROM (SELECT *, 'aes.partial.v1' AS profile, NULL::VARCHAR AS projection FROM r)")
SMALL_DIGESTS = f"SELECT stream_id, CASE WHEN error IS NULL THEN digest END AS digest, error FROM ({SMALL_DIGESTS})"

_ERRORS = """SELECT o_orderkey::VARCHAR AS stream_id
,  CASE o_orderkey % 10 WHEN 1 THEN 'TELEX_DUPLICATE_FIELD' WHEN 2 THEN 'TELEX_UNKNOWN_ESCAPE' WHEN 3 THEN 'TELEX_UNESCAPED_CONTROL' WHEN 4 THEN 'TELEX_INVALID_FIELD_NAME' WHEN 5 THEN 'TELEX_INVALID_FIELD_LINE' WHEN 6 THEN 'TELEX_UNTERMINATED_UNICODE_ESCAPE' WHEN 7 THEN 'TELEX_INCOMPLETE_ESCAPE' WHEN 8 THEN 'TELEX_MISSING_HEADER_SEPARATOR' ELSE 'TELEX_INVALID_PREAMBLE' END AS code
,  CASE o_orderkey % 10 WHEN 8 THEN 2 WHEN 9 THEN 1 ELSE 5 END::BIGINT AS line FROM orders WHERE o_orderkey % 10 <> 0"""

ORACLES: dict[str, str] = {
    "project_events": events("SELECT * FROM ev"),
    "address_planes": addressed("SELECT stream_id, plane, count(*) AS events, count(DISTINCT address) AS addresses FROM ad GROUP BY ALL"),
    "path_segments": addressed("SELECT stream_id, ordinal, address, array_to_string(segs, '|') AS segs, len(segs)::INT AS depth, parent FROM pr"),
    "path_prefixes": addressed("SELECT stream_id, plane, prefix, count(*) AS events FROM (SELECT stream_id, plane, unnest(list_transform(range(1, len(segs) + 1), lambda i: '$' || array_to_string(segs[1:i], ''))) AS prefix FROM ad) GROUP BY ALL"),
    "path_limits": addressed("SELECT stream_id, ordinal AS record, 'max_path_depth' AS counter, len(segs)::BIGINT AS observed FROM ad WHERE len(segs) > 2 UNION ALL SELECT stream_id, ordinal, 'max_path_characters', length(address) FROM ad WHERE length(address) > 14"),
    "invalid_values": addressed("SELECT stream_id, ordinal AS record, 'AES_INVALID_VALUE' AS code FROM ad WHERE kind = 'BooleanLiteral' AND value NOT IN ('true', 'false') UNION ALL SELECT a.stream_id, ordinal, 'AES_HEADER_REQUIRES_PROJECTION' FROM ad a JOIN st USING (stream_id) WHERE plane = 'header' AND projection IS NULL"),
    "header_order": addressed("SELECT h.stream_id, ordinal AS record FROM ad h WHERE plane = 'header' AND ordinal > (SELECT min(ordinal) FROM ad b WHERE b.stream_id = h.stream_id AND b.plane = 'path')"),
    "first_occurrences": addressed("SELECT stream_id, plane, address, first, first_kind, times FROM ix"),
    "duplicate_paths": addressed("SELECT a.stream_id, ordinal AS record, address AS path, first AS first_record FROM ad a JOIN ix USING (stream_id, plane, address) WHERE ordinal > first"),
    "missing_parents": addressed("SELECT c.stream_id, ordinal AS record, address AS path, parent AS required_path FROM pr c WHERE depth > 1 AND NOT EXISTS (SELECT 1 FROM ix p WHERE p.stream_id = c.stream_id AND p.plane = c.plane AND p.address = c.parent)"),
    "incompatible_parents": f"WITH {ADDRESSED}, {CHILD} SELECT stream_id, ordinal AS record, address AS path, parent AS required_path FROM ch WHERE (t = 'member' AND pk <> 'ObjectNode') OR (t = 'index' AND pk NOT IN ('ListNode', 'TupleLiteral', 'NodeHead', 'NodeLiteral'))",
    "node_heads": f"WITH {ADDRESSED}, {CHILD} SELECT stream_id, ordinal AS record, address AS path FROM ch WHERE t = 'index' AND pk IS NOT NULL AND pk <> 'NodeLiteral'",
    "missing_references": addressed("SELECT r.stream_id, ordinal AS record, value AS required_path FROM ad r WHERE kind = 'PointerReference' AND NOT EXISTS (SELECT 1 FROM ix WHERE ix.stream_id = r.stream_id AND ix.plane = 'path' AND ix.address = r.value)"),
    "duplicate_identities": addressed("SELECT stream_id, ordinal AS record, f AS first_record FROM (SELECT *, row_number() OVER w AS r, first_value(ordinal) OVER w AS f FROM ad WHERE identity <> '' WINDOW w AS (PARTITION BY stream_id, identity ORDER BY plane = 'header', ordinal)) WHERE r > 1"),
    "nesting_depth": addressed(", cn AS (SELECT * FROM ix WHERE first_kind IN ('ObjectNode', 'ListNode')), px AS (SELECT stream_id, plane, address AS a, first, unnest(list_transform(range(1, len(s) + 1), lambda i: '$' || array_to_string(s[1:i], ''))) AS address FROM (SELECT *, regexp_extract_all(address, '(?:\\.@)?\\.(?:[A-Za-z_][A-Za-z0-9_]*)|\\[[0-9]+\\]') AS s FROM cn)) SELECT stream_id, first AS record, observed FROM (SELECT px.stream_id, px.a, px.first, count(*) AS observed FROM px JOIN cn USING (stream_id, plane, address) GROUP BY ALL) WHERE observed > 1".replace("\\\\", "\\")),
    "list_items": addressed("SELECT c.stream_id, p.first AS record, count(*) AS observed FROM (SELECT DISTINCT stream_id, plane, address, parent, seg FROM pr) c JOIN ix p ON p.stream_id = c.stream_id AND p.plane = c.plane AND p.address = c.parent WHERE seg LIKE '[%' AND p.first_kind = 'ListNode' GROUP BY ALL HAVING count(*) > 5"),
    "missing_prefixes": addressed(", px AS (SELECT stream_id, plane, address, ordinal, unnest(list_transform(range(1, len(segs)), lambda i: '$' || array_to_string(segs[1:i], ''))) AS path FROM ad WHERE len(segs) > 1) SELECT px.stream_id, px.plane, px.path, arg_min(px.address, px.ordinal) AS required_by FROM px LEFT JOIN ix ON ix.stream_id = px.stream_id AND ix.plane = px.plane AND ix.address = px.path WHERE ix.address IS NULL GROUP BY ALL"),
    "stream_verdicts": f"WITH {ADDRESSED}, {DIAGNOSTICS} SELECT st.stream_id, profile, count(code) = 0 AS valid, count(code) AS n_diagnostics FROM st LEFT JOIN al USING (stream_id) GROUP BY ALL",
    "diagnostic_counts": f"WITH {ADDRESSED}, {DIAGNOSTICS} SELECT stream_id, code, count(*) AS n FROM al GROUP BY ALL",
    "digest_exact": digest("aes.order.exact.v1", "ordinal"),
    "digest_canonical": SMALL_DIGESTS,
    "record_bytes": events(f"SELECT stream_id, ordinal, {RECORD} AS text FROM ev"),
    "payload_spelling": f"SELECT doc_id, md5({_SPELT}) AS spelt FROM documents",
    "payload_round_trip": "SELECT doc_id, md5(text) AS h, CASE WHEN text IS NOT NULL THEN TRUE END AS well_formed FROM documents",
    "encode_text": events(r""", sz AS (SELECT stream_id, string_agg(CASE WHEN header IS NULL THEN 'path=' || path ELSE 'header=' || header END || chr(10) || 'kind=' || kind || CASE WHEN identity IS NULL THEN '' ELSE chr(10) || 'identity=' || identity END || CASE WHEN value IS NULL THEN '' ELSE chr(10) || 'value=' || value END, chr(10) || chr(10) ORDER BY ordinal) AS body FROM ev GROUP BY stream_id)
SELECT stream_id, md5('telex.aes=1' || chr(10) || 'profile=' || profile || CASE WHEN projection IS NULL THEN '' ELSE chr(10) || 'projection=' || projection END || chr(10) || chr(10) || body || chr(10)) AS text_md5 FROM sz JOIN st USING (stream_id)"""),
    "stanza_fields": events("SELECT stream_id, field, count(*) AS n, sum(strlen(v))::BIGINT AS bytes FROM (SELECT stream_id, unnest(['path', 'header', 'kind', 'identity', 'value']) AS field, unnest([path, header, kind, identity, value]) AS v FROM ev) WHERE v IS NOT NULL GROUP BY ALL"),
    "text_round_trip": events("SELECT stream_id, count(*) AS events, count(value) AS \"values\", count(identity) AS identities FROM ev GROUP BY ALL"),
    "binary_round_trip": events(r"SELECT own AS stream_id, CASE WHEN bad THEN 'FILM_AES_INVALID' END AS error, CASE WHEN NOT bad THEN n END AS events, CASE WHEN NOT bad THEN v END AS \"values\" FROM (SELECT own, own LIKE 'o%' AND substr(own, 2)::BIGINT % 50 = 0 AS bad, count(*) AS n, count(value) AS v FROM (SELECT *, regexp_extract(path, '^\$\.([oc][0-9]+)', 1) AS own FROM ev WHERE path IS NOT NULL) GROUP BY own)".replace('\\"', '"')),
    "chunk_decoding": events("SELECT own AS stream_id, count(*) AS events FROM (SELECT *, regexp_extract(path, '^\\$\\.([oc][0-9]+)', 1) AS own FROM ev WHERE path IS NOT NULL) WHERE NOT (own LIKE 'o%' AND substr(own, 2)::BIGINT % 50 = 0) GROUP BY ALL".replace("\\\\", "\\")),
    "prefix_delta": addressed(", d AS (SELECT *, lag(address) OVER (PARTITION BY stream_id, plane, ordinal // 256 ORDER BY ordinal) AS b FROM ad), n AS (SELECT *, CASE WHEN b IS NULL THEN 0 ELSE coalesce(list_min(list_filter(range(1, least(length(b), length(address)) + 1), lambda i: substr(b, i, 1) <> substr(address, i, 1))) - 1, least(length(b), length(address))) END AS shared FROM d) SELECT stream_id, ordinal, shared::INT AS shared, substr(address, shared::INT + 1) AS suffix FROM n"),
    "block_index": addressed(", d AS (SELECT *, ordinal // 256 AS block, lag(address) OVER (PARTITION BY stream_id, plane, ordinal // 256 ORDER BY ordinal) AS b FROM ad), n AS (SELECT *, CASE WHEN b IS NULL THEN 0 ELSE coalesce(list_min(list_filter(range(1, least(length(b), length(address)) + 1), lambda i: substr(b, i, 1) <> substr(address, i, 1))) - 1, least(length(b), length(address))) END AS shared FROM d) SELECT stream_id, block, min(ordinal) AS first_record, count(*) AS records, sum(strlen(substr(address, shared::INT + 1)))::BIGINT AS bytes FROM n GROUP BY stream_id, block"),
    "delta_round_trip": addressed("SELECT stream_id, plane, count(*) AS events, md5(string_agg(address, '|' ORDER BY ordinal)) AS addresses FROM ad GROUP BY ALL"),
    "provenance_audit": r"""WITH d AS (SELECT doc_id, text, strlen(text) AS n FROM documents WHERE text IS NOT NULL),
f AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN text || 'x' WHEN doc_id % 11 = 0 THEN 'absent' ELSE text END AS src FROM d),
e AS (SELECT d.doc_id, 'd' || (d.doc_id % 5)::VARCHAR AS stream_id, d.doc_id * 2 + i AS ordinal, sha256(src) AS origin,
             CASE WHEN i = 0 THEN 0 ELSE n // 3 END AS a, CASE WHEN i = 0 THEN n // 2 + 1 ELSE n + d.doc_id % 3 END AS b FROM d JOIN f USING (doc_id), range(2) t(i)),
a AS (SELECT DISTINCT ON (origin) * FROM (SELECT sha256(CASE WHEN doc_id % 7 = 0 THEN text || 'x' ELSE text END) AS origin, sha256(text) AS actual, text FROM d)),
s AS (SELECT e.stream_id, e.origin, min(ordinal) AS record, any_value(actual) AS actual FROM e LEFT JOIN a USING (origin) GROUP BY ALL),
raw AS (SELECT origin, actual, encode(text) AS bytes, octet_length(encode(text)) AS n FROM a)
SELECT stream_id, record, CASE WHEN actual IS NULL THEN 'AES_SOURCE_REQUIRED' ELSE 'AES_ORIGIN_MISMATCH' END AS code, 'origin' AS field FROM s WHERE actual IS NULL OR actual <> origin
UNION ALL SELECT stream_id, ordinal, 'AES_INVALID_SPAN', 'span' FROM e JOIN raw USING (origin) WHERE raw.actual = origin AND (a >= b OR b > n OR
  (a > 0 AND a < n AND substr(hex(bytes), (a * 2 + 1)::BIGINT, 1) IN ('8', '9', 'A', 'B')) OR (b < n AND substr(hex(bytes), (b * 2 + 1)::BIGINT, 1) IN ('8', '9', 'A', 'B')))""",
    "limit_counts": addressed("SELECT stream_id, count(*) AS observed FROM ad GROUP BY stream_id HAVING count(*) > 100"),
    "host_records": "SELECT o_orderkey::BIGINT AS ordinal, CASE o_orderkey % 3 WHEN 0 THEN 'AES_INVALID_EVENT' WHEN 1 THEN 'AES_INVALID_PAYLOAD' ELSE '' END AS faults FROM orders",
    "datatype_descriptors": """
WITH d AS (SELECT p_partkey::BIGINT AS k, p_size AS n FROM part)
SELECT k, CASE WHEN n % 5 = 0 THEN NULL WHEN n % 5 = 4 THEN 'kind' || n ELSE 'list<item' || n || CASE WHEN n % 5 = 1 THEN '[' || n || '.5]' ELSE '' END || CASE WHEN n % 5 = 3 THEN ', other' ELSE '' END || '>' END AS spelt,
       CASE WHEN n % 5 = 0 THEN 'TELEX_INVALID_DATATYPE' END AS code, CASE WHEN n % 5 = 0 THEN 0 WHEN n % 5 = 4 THEN 1 WHEN n % 5 = 3 THEN 3 ELSE 2 END AS nodes FROM d""",
    "transactions": """
WITH o AS (SELECT o_orderkey::BIGINT AS k FROM orders)
SELECT 't-' || k AS tx_id, NOT (k % 41 = 0 OR k % 43 = 0 OR k % 47 = 0) AS valid, k % 2 = 0 AS supported,
       list_aggregate(list_sort(list_concat(
         CASE WHEN k % 41 = 0 THEN ['AES_TRANSACTION_BODY_INVALID'] ELSE [] END,
         CASE WHEN k % 43 = 0 THEN ['AES_TRANSACTION_APPLICATION_INVALID', 'AES_TRANSACTION_ASSERTION_FAILED'] ELSE [] END,
         CASE WHEN k % 47 = 0 THEN CASE WHEN k % 43 = 0 THEN ['AES_TRANSACTION_EVENT_INVALID'] ELSE ['AES_TRANSACTION_APPLICATION_INVALID', 'AES_TRANSACTION_EVENT_INVALID'] END ELSE [] END,
         CASE WHEN k % 2 = 1 THEN ['AES_TRANSACTION_UNSUPPORTED_CONTRACT'] ELSE [] END)), 'string_agg', ',') AS codes FROM o""",
    "stanza_segments": events("SELECT stream_id, count(*) AS stanzas, sum(2 + (identity IS NOT NULL)::INT + (value IS NOT NULL)::INT)::BIGINT AS lines FROM ev GROUP BY ALL"),
    "syntax_errors": _ERRORS,
    "decoding_errors": _ERRORS,
    "field_order": "SELECT o_orderkey::VARCHAR AS stream_id, o_orderkey % 3 <> 0 AS canonical FROM orders",
    "payload_bytes": "SELECT o_orderkey::VARCHAR AS stream_id, n::BIGINT AS bytes, n::BIGINT AS total FROM (SELECT o_orderkey, CASE o_orderkey % 10 WHEN 8 THEN 10 WHEN 1 THEN 5 + m WHEN 4 THEN 1 + m ELSE m END AS n FROM (SELECT o_orderkey, 13 + length(o_orderkey::VARCHAR) AS m FROM orders))",
}

# the same rows, by way of files
ORACLES["text_files"] = ORACLES["encode_text"]
ORACLES["binary_files"] = ORACLES["binary_round_trip"]
