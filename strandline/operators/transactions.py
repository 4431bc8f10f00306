"""Transactions: closed documents around a list of event records.

A document's shape is a table of rules that one walk applies; documents are JSON
texts, one a row. Events that are sound at sight are judged where they are walked.
Those of other documents are exploded and go through stream validation with the
transaction as their stream, so a million of them validate together in the same joins.
"""

from __future__ import annotations

import hashlib
import json
import marshal
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline import schema, wire
from strandline.config import Limits
from strandline.functions import logical
from strandline.operators import integrity, provenance, validate
from strandline.operators.shape import event_row
from strandline.storage import materialize

BODY, ENVELOPE, INTEGRITY, SIGNATURE = (f"AES_TRANSACTION_{x}_INVALID" for x in ("BODY", "ENVELOPE", "INTEGRITY", "SIGNATURE"))
APPLICATION, ASSERTION = "AES_TRANSACTION_APPLICATION_INVALID", "AES_TRANSACTION_ASSERTION_FAILED"
_SURROGATE = re.compile("[\ud800-\udfff]")
_UNSIGNED = re.compile(r"0|[1-9][0-9]*")
_SHA256 = re.compile(r"[0-9a-f]{64}")
_EXTENSION = re.compile(wire.EXTENSION_NAME)
Found = Iterator[tuple[str, str | None]]
Rule = Callable[[object, str, str], Found]


# -- rules -----------------------------------------------------------------------


def _scalar_text(v: object) -> bool:
    return isinstance(v, str) and v != "" and not _SURROGATE.search(v)


def name(v: object, path: str, code: str) -> Found:
    if not (_scalar_text(v) and len(v) <= 256):
        yield code, path


def unsigned(v: object, path: str, code: str) -> Found:
    if not (isinstance(v, str) and _UNSIGNED.fullmatch(v)):
        yield code, path


def exactly(expected: str) -> Rule:
    def rule(v: object, path: str, code: str) -> Found:
        if v != expected:
            yield code, path

    return rule


def both(*rules: Rule) -> Rule:
    def rule(v: object, path: str, code: str) -> Found:
        for r in rules:
            yield from r(v, path, code)

    return rule


def optional(inner: Rule) -> Rule:
    return lambda v, path, code: iter(()) if v is None else inner(v, path, code)


def mapping(fields: dict[str, Rule], own: str | None = None) -> Rule:
    """A map of exactly these fields; ``own`` replaces the code inside."""

    def rule(v: object, path: str, code: str) -> Found:
        code = own or code
        if not isinstance(v, dict):
            yield code, path
            return
        for k in v:
            if k not in fields:
                yield code, f"{path}.{k}"
        for k, r in fields.items():
            yield from r(v.get(k), f"{path}.{k}", code)

    return rule


def listing(item: Rule) -> Rule:
    def rule(v: object, path: str, code: str) -> Found:
        if not isinstance(v, list):
            yield code, path
            return
        for i, x in enumerate(v):
            yield from item(x, f"{path}[{i}]", code)

    return rule


def _signature_names(v: object, path: str, code: str) -> Found:
    if isinstance(v, dict) and not all(_scalar_text(v.get(k)) for k in ("alg", "kid", "sig")):
        yield code, path


def anything(v: object, path: str, code: str) -> Found:
    return iter(())


BODY_RULES: dict[str, Rule] = {
    "transaction": exactly(wire.TX_CONTRACT),
    "events": exactly(wire.EVENT_CONTRACT),
    "ordering": exactly(wire.EXACT_ORDER),
    "id": name,
    "intent": name,
    "attempt": name,
    "profile": name,
    "application": mapping({"contract": name}),
    "target": mapping({"contract": name, "id": name, "boundary": name}),
    "preconditions": listing(mapping({"contract": name, "scope": name, "revision": unsigned})),
    "preparation": mapping({"contract": name}),
    "authorization": mapping({"contract": name, "context": name}),
    "limits": mapping({"contract": both(name, exactly(wire.TX_LIMITS_CLAIM)), "id": name, "version": name}),
    "assertions": mapping({"eventCount": unsigned, "containers": listing(mapping({"path": name, "payloadDirectItemCount": unsigned, "resultDirectItemCount": unsigned}))}),
    "integrity": mapping({"contract": both(name, exactly(wire.TX_INTEGRITY)), "digest": exactly("sha256")}),
}
_SIGNATURES = listing(both(mapping({"signature": exactly(wire.TX_SIGNATURE), "alg": anything, "kid": anything, "sig": anything}, SIGNATURE), lambda v, p, c: _signature_names(v, p, SIGNATURE)))


def _digest_text(v: object, path: str, code: str) -> Found:
    if not (isinstance(v, str) and _SHA256.fullmatch(v)):
        yield code, path


EVIDENCE = mapping({"integrity": exactly(wire.TX_INTEGRITY), "digest": exactly("sha256"), "hash": _digest_text, "signatures": _SIGNATURES}, INTEGRITY)


def _part(body: dict, key: str, inner: str) -> object:
    v = body.get(key)
    return v.get(inner) if isinstance(v, dict) else None


def body_findings(body: object, registered: tuple[str, ...] = (), met: dict[str, tuple] | None = None, encodes: bool | None = None) -> Found:
    """Everything wrong with a body apart from its events. ``met`` and ``encodes`` are what is known of its members already."""
    if not isinstance(body, dict):
        yield BODY, None
        return
    for k in body:
        if k not in wire.TX_BODY_FIELDS and not (_EXTENSION.fullmatch(k) and k in registered):
            yield ("AES_TRANSACTION_EXTENSION_UNREGISTERED" if k.startswith("x.") else BODY), k
    for k, rule in BODY_RULES.items():
        yield from rule(body.get(k), k, BODY) if met is None or k not in met else met[k]
    # an absent projection is not the same as a null one
    if body.get("projection", "") is not None:
        yield from name(body.get("projection"), "projection", BODY)
    ids = [body.get(k) for k in ("id", "intent", "attempt")]
    if all(isinstance(x, str) for x in ids) and len(set(ids)) < 3:
        yield BODY, "id"
    records, count = body.get("records"), _part(body, "assertions", "eventCount")
    if not isinstance(records, list):
        yield BODY, "records"
    elif isinstance(count, str) and _UNSIGNED.fullmatch(count) and count != str(len(records)):
        yield ASSERTION, "assertions.eventCount"
    if _part(body, "application", "contract") == wire.TX_SCALAR_REPLACEMENT:
        yield from _scalar_replacement(body)
    if encodes is None:
        encodes = _encodes(body)
    if not encodes:
        yield BODY, None


def _encodes(body: dict) -> bool:
    try:
        logical.encode(body)
    except logical.LogicalError:
        return False
    return True


def _scalar_replacement(body: dict) -> Found:
    """What replacing one scalar asks of the rest of the document."""
    records, conditions = body.get("records"), body.get("preconditions")
    only = conditions[0] if isinstance(conditions, list) and len(conditions) == 1 and isinstance(conditions[0], dict) else {}
    single = isinstance(records, list) and len(records) == 1
    demands = {
        "profile": body.get("profile") == wire.PARTIAL_PROFILE and "projection" in body and body["projection"] is None,
        "target": _part(body, "target", "contract") == wire.TX_TARGET and _part(body, "target", "boundary") == "$",
        "preconditions": only.get("contract") == wire.TX_REVISION and only.get("scope") == "$",
        "application": _part(body, "preparation", "contract") == wire.TX_IDENTITY_PREPARATION and _part(body, "authorization", "contract") == wire.TX_HOST_AUTHORIZATION,
        "records": single and _part(body, "assertions", "eventCount") == "1" and _part(body, "assertions", "containers") == [],
    }
    yield from ((APPLICATION, k) for k, met in demands.items() if not met)
    if demands["records"]:
        r = records[0]
        if not isinstance(r, dict) or not set(r) <= {"path", "kind", "value"} or r.get("kind") not in wire.TX_SCALAR_KINDS or not isinstance(r.get("value"), str):
            yield APPLICATION, "records[0]"


@dataclass(frozen=True)
class Support:
    """What a consumer can do, by component."""

    applications: frozenset[str] = frozenset()
    targets: frozenset[str] = frozenset()
    preparations: frozenset[str] = frozenset()
    authorizations: frozenset[str] = frozenset()
    limit_sets: frozenset[str] = frozenset()
    integrity_contracts: frozenset[str] = frozenset()
    preconditions: frozenset[str] = frozenset()


def unsupported(body: object, support: Support) -> list[str]:
    """The components whose contract the consumer does not support."""
    if not isinstance(body, dict):
        return ["body"]
    limit = [_part(body, "limits", k) for k in ("id", "version")]
    asked = [
        ("application", _part(body, "application", "contract"), support.applications),
        ("target", _part(body, "target", "contract"), support.targets),
        ("preparation", _part(body, "preparation", "contract"), support.preparations),
        ("authorization", _part(body, "authorization", "contract"), support.authorizations),
        ("limits", "@".join(limit) if all(isinstance(x, str) and x for x in limit) else None, support.limit_sets),
        ("integrity", _part(body, "integrity", "contract"), support.integrity_contracts),
    ]
    conditions = body.get("preconditions")
    asked += [("precondition", c.get("contract") if isinstance(c, dict) else None, support.preconditions) for c in (conditions if isinstance(conditions, list) else ())]
    return [part for part, contract, known in asked if contract not in known]


def body_bytes(body: dict) -> bytes:
    return wire.TX_INTEGRITY.encode() + b"\0" + logical.encode(body)


def body_digest(body: dict) -> str:
    return hashlib.sha256(body_bytes(body)).hexdigest()


def signature_input(digest: str, alg: str, kid: str) -> bytes:
    return integrity.signature_input(digest, alg, kid, wire.TX_SIGNATURE, wire.TX_INTEGRITY)


# -- as tables -------------------------------------------------------------------


@dataclass(frozen=True)
class Options:
    registered: tuple[str, ...] = ()
    registered_event_fields: tuple[str, ...] = ()
    limits: Limits = Limits()
    support: Support = field(default_factory=Support)
    require_evidence: bool = False


_SHAPED = "tx_id string, found array<struct<code:string,path:string>>, missing array<string>, digest string, expected string, evidence boolean, profile string, projection string, context boolean, source_backed boolean, "
_INSIDE = "struct<" + ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in schema.EVENTS.fields[2:]) + ",faults:array<string>>"
_EXT = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
_HOST_FIELDS = [(n, _EXT if n == "ext" else pa.string()) for n in schema.EVENTS.fieldNames()[2:]] + [("faults", pa.list_(pa.string()))]
_HOST_NAMES = [n for n, _ in _HOST_FIELDS]


def shaped(docs: DataFrame, options: Options = Options(), envelope: bool = True) -> DataFrame:
    """One walk over each document (tx_id, json): findings of its shape, unsupported parts, digests, events with their ``faults``."""

    def run(batches):
        pair = pa.struct([("code", pa.string()), ("path", pa.string())])
        text, flag, texts = pa.string(), pa.bool_(), pa.list_(pa.string())
        known = _Known(options.support)
        arrow = pa.schema(
            [("tx_id", text), ("found", pa.list_(pair)), ("missing", texts), ("digest", text), ("expected", text), ("evidence", flag), ("profile", text), ("projection", text), ("context", flag), ("source_backed", flag), ("events", pa.list_(pa.struct(_HOST_FIELDS)))]
        )
        for batch in batches:
            rows = [_shape(t, j, options, envelope, known) for t, j in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([_column([r[f.name] for r in rows], f.type) for f in arrow], schema=arrow)

    return docs.select("tx_id", "json").mapInArrow(run, f"{_SHAPED}events array<{_INSIDE}>")


def _column(values: list, kind: pa.DataType) -> pa.Array:
    """An array of ``values``; nested ones that are the same object are made once."""
    if not pa.types.is_nested(kind):
        return pa.array(values, kind)
    places: dict[int, int] = {}
    at = [places.setdefault(id(v), len(places)) for v in values]
    if len(places) == len(values):
        return pa.array(values, kind)
    once = {p: v for p, v in zip(at, values, strict=True)}
    return pa.array([once[p] for p in range(len(once))], kind).take(pa.array(at, pa.int32()))


def digests(docs: DataFrame) -> DataFrame:
    """The digests of the bodies of envelopes (json), as ``shaped`` gives them, in place of the documents, which are not judged; other columns stay."""
    rest = docs.drop("json")

    def run(batches):
        known = _Known(Support())
        for batch in batches:
            found = [_body_digest(j, known) for j in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found, pa.string())], names=[*batch.schema.names[1:], "digest"])

    return docs.select("json", *rest.columns).mapInArrow(run, T.StructType([*rest.schema, T.StructField("digest", T.StringType())]))


def _body_digest(text: str | None, known: _Known) -> str | None:
    try:
        doc = json.loads(text or "null")
    except ValueError:
        return None
    body = doc.get("body") if isinstance(doc, dict) else None
    if not (isinstance(body, dict) and body):
        return None
    raw = known.joined({k: (known.encoded(k, v), ()) for k, v in body.items()})
    return None if raw is None else hashlib.sha256(wire.TX_INTEGRITY.encode() + b"\0" + raw).hexdigest()


class _Known:
    """What the members of bodies have given, where they are short: most members of many bodies are the same."""

    MOST, LONGEST = 10_000, 4_096
    OWN = ("id", "intent", "attempt")  # texts that each body has for itself

    def __init__(self, support: Support):
        self.support = support
        self.members: dict[tuple[str, bytes | str], tuple[bytes | None, tuple]] = {}
        self.bytes: dict[tuple[str, bytes | str], tuple[bytes | None]] = {}
        self.orders: dict[tuple, tuple[list[str] | None]] = {}
        self.missing: dict[tuple, list[str]] = {}
        self.records: dict[bytes, list[dict]] = {}

    def kept(self, held: dict, key, size: int, make):
        if (found := held.get(key)) is None:
            found = make()
            if size <= self.LONGEST:
                if len(held) >= self.MOST:
                    held.clear()
                held[key] = found
        return found

    def encoded(self, name: str, value: object) -> bytes | None:
        code = _code(value)
        if (found := self.bytes.get((name, code))) is not None:
            return found[0]
        if name in self.OWN:
            return _member_bytes(name, value)
        return self.kept(self.bytes, (name, code), len(name) + len(code), lambda: (_member_bytes(name, value),))[0]

    def member(self, name: str, value: object, code: bytes | str) -> tuple[bytes | None, tuple]:
        """The bytes of a member, null where it has none, and what its rule finds."""
        if (found := self.members.get((name, code))) is not None:
            return found

        def make() -> tuple[bytes | None, tuple]:
            return _member_bytes(name, value), tuple(BODY_RULES[name](value, name, BODY)) if name in BODY_RULES else ()

        return make() if name in self.OWN else self.kept(self.members, (name, code), len(name) + len(code), make)

    def joined(self, parts: dict[str, tuple[bytes | None, tuple]]) -> bytes | None:
        """The logical bytes of a body from those of its members."""
        order = self.kept(self.orders, names := tuple(parts), sum(map(len, names)), lambda: (_in_order(names),))[0]
        if order is None or any(raw is None for raw, _ in parts.values()):
            return None
        return b"m%d:%s" % (len(order), b"".join([parts[k][0] for k in order]))

    def unsupported(self, body: dict, codes: dict[str, bytes | str]) -> list[str]:
        parts = ("application", "target", "preparation", "authorization", "limits", "integrity", "preconditions")
        key = tuple(map(codes.get, parts))
        return self.kept(self.missing, key, sum(len(c or "") for c in key), lambda: unsupported(body, self.support))

    def events(self, records: list, code: bytes) -> list[dict]:
        return self.kept(self.records, code, len(code), lambda: [dict(zip(_HOST_NAMES, _host_fields(r), strict=True)) for r in records])


def _shape(tx_id: str, text: str | None, options: Options, envelope: bool, known: _Known) -> dict:
    try:
        doc = json.loads(text or "null")
    except ValueError:
        doc = None
    found: list[tuple[str, str | None]] = []
    body, evidence = doc, None
    if envelope:
        if not isinstance(doc, dict):
            found.append((ENVELOPE, None))
            doc = {}
        else:
            found += [(BODY, f"envelope.{k}") for k in doc if k not in ("envelope", "body", "evidence")]
            found += exactly(wire.TX_ENVELOPE)(doc.get("envelope"), "envelope", ENVELOPE)
        body, evidence = doc.get("body"), doc.get("evidence", "") if doc else None
        if evidence is None:
            found += [(INTEGRITY, "evidence")] if options.require_evidence and doc else []
        else:
            found += EVIDENCE(evidence, "evidence", INTEGRITY)
    own = body if isinstance(body, dict) else {}
    codes = {k: _code(v) for k, v in own.items()}
    parts = {k: known.member(k, v, codes[k]) for k, v in own.items()}
    raw = known.joined(parts)
    if not (envelope and not doc):
        found += body_findings(body, options.registered, {k: p[1] for k, p in parts.items()}, raw is not None)
    expected = evidence.get("hash") if isinstance(evidence, dict) else None
    digest = hashlib.sha256(wire.TX_INTEGRITY.encode() + b"\0" + raw).hexdigest() if own and raw is not None else None
    records = own.get("records") if isinstance(own.get("records"), list) else []
    context = isinstance(own.get("profile"), str) and "projection" in own and (own["projection"] is None or isinstance(own["projection"], str))
    return {
        "tx_id": tx_id,
        "found": [{"code": c, "path": p} for c, p in found],
        "missing": known.unsupported(body, codes) if own else unsupported(body, options.support),
        "digest": digest,
        "expected": expected if isinstance(expected, str) and _SHA256.fullmatch(expected) else None,
        "evidence": evidence is not None,
        "profile": own["profile"] if context else None,
        "projection": own["projection"] if context else None,
        "context": context,
        "source_backed": _part(own, "preparation", "contract") == wire.TX_SOURCE_BACKED,
        "events": known.events(records, codes["records"]) if records else [],
    }


def _member_bytes(name: str, value: object) -> bytes | None:
    try:
        return logical.encode(name) + logical.encode(value)
    except (logical.LogicalError, UnicodeEncodeError):  # the latter from keys
        return None


def _code(value: object) -> bytes | str:
    """What names a member's value: marshal spells equal values of equal types alike."""
    return value if isinstance(value, str) else marshal.dumps(value, 2)


def _in_order(names: tuple[str, ...]) -> list[str] | None:
    try:
        return sorted(names, key=lambda k: k.encode("utf-8"))
    except UnicodeEncodeError:
        return None


def host_records(rows: DataFrame) -> DataFrame:
    """EVENTS and ``faults`` from rows (stream_id, ordinal, json) of host objects.

    A record that is no object has the fault AES_INVALID_EVENT; a payload that is no
    string has AES_INVALID_PAYLOAD and is left out.
    """
    names = schema.EVENTS.fieldNames()

    def run(batches):
        arrow = pa.schema([(names[0], pa.string()), (names[1], pa.int64()), *_HOST_FIELDS])
        known, held = _Known(Support()), {}
        for batch in batches:
            if batch.num_rows:
                rows = [known.kept(held, t, len(t), lambda t=t: _host_fields(json.loads(t))) for t in batch.column(2).to_pylist()]
                columns = [batch.column(0), batch.column(1), *zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.EVENTS.fields)
    return rows.select("stream_id", "ordinal", "json").mapInArrow(run, f"{fields}, faults array<string>")


def _host_fields(record: object) -> tuple:
    """The fields of EVENTS after the ordinal, and the faults."""
    if not isinstance(record, dict):
        return (*[None] * (len(schema.EVENTS.fields) - 3), [], ["AES_INVALID_EVENT"])
    nested = ("generics", "clarifiers")
    faults = ["AES_INVALID_PAYLOAD" for k, v in record.items() if k not in nested and not isinstance(v, str)]
    row = event_row("", 0, {k: v for k, v in record.items() if k in nested or isinstance(v, str)})
    return (*row[2:-1], [{"name": k, "value": v} for k, v in row[-1]], faults)


_JUDGED = ["tx_id", "found", "missing", "digest", "expected", "source_backed"]


def inspect(docs: DataFrame, options: Options = Options(), artifacts: DataFrame | None = None, envelope: bool = True) -> DataFrame:
    """(tx_id, valid, supported, evidence_verified, provenance_verified, ready, actionable, codes, digest).

    ``actionable`` is always false: nothing here grants authority. ``codes`` lists the
    code of every finding, events' findings as AES_TRANSACTION_EVENT_INVALID.
    """
    context, profile, projection = F.col("context"), F.col("profile"), F.col("projection")
    told = shaped(docs, options, envelope).withColumn("alone", context & validate.alone_together(F.col("events"), profile, projection, options.limits))
    sound = F.forall("events", lambda e: (F.size(e["faults"]) == 0) & validate.plainly_sound(options.limits, lambda name: e[name]))
    apart = (context & ~(F.col("alone") & sound)) | (F.col("source_backed") & F.lit(artifacts is not None))
    # each document is walked once; the events of those that are set apart are kept
    told = told.withColumn("apart", apart)
    base = materialize(told.withColumn("events", F.when(F.col("apart"), F.col("events"))), "shaped")
    odd, plain = base.where("apart").drop("apart"), base.where("not apart").select(*_JUDGED)
    streams = odd.where("context").select(F.col("tx_id").alias("stream_id"), "profile", "projection", "alone")
    each = odd.where("context").select(F.col("tx_id").alias("stream_id"), F.posexplode("events").alias("ordinal", "event")).withColumn("ordinal", F.col("ordinal").cast("long"))
    events = each.where("not array_contains(event.faults, 'AES_INVALID_EVENT')").select("stream_id", "ordinal", "event.*").drop("faults")
    found = validate.validate_told(events, streams, options.limits, options.registered_event_fields).select("stream_id", "code")
    found = found.unionByName(each.select("stream_id", F.explode("event.faults").alias("code")))
    events_wrong = found.groupBy("stream_id").agg(F.count("*").alias("n_events_wrong"))
    joined = odd.join(events_wrong.hint("merge"), odd["tx_id"] == events_wrong["stream_id"], "left").drop("stream_id")
    unaudited = {"audit_valid": F.lit(None).cast("boolean"), "audit_complete": F.lit(None).cast("boolean"), "audit_codes": F.lit(None).cast("array<string>")}
    if artifacts is not None:
        backed = odd.where("source_backed").select(F.col("tx_id").alias("stream_id"))
        own = events.join(backed, "stream_id", "left_semi")
        audited = provenance.summary(own, backed, artifacts, True, True).select(F.col("stream_id").alias("audit_id"), F.col("valid").alias("audit_valid"), F.col("complete").alias("audit_complete"))
        codes = provenance.audit(own, artifacts, True, True).groupBy("stream_id").agg(F.collect_list("code").alias("audit_codes"))
        joined = joined.join(audited, joined["tx_id"] == F.col("audit_id"), "left").join(codes, joined["tx_id"] == codes["stream_id"], "left").drop("stream_id")
    else:
        joined = joined.withColumns(unaudited)
    own = ["n_events_wrong", *unaudited]
    joined = plain.withColumns({"n_events_wrong": F.lit(0).cast("long")} | unaudited).unionByName(joined.select(*_JUDGED, *own))
    n = F.coalesce("n_events_wrong", F.lit(0))
    sound = (F.size("found") == 0) & (n == 0)
    # evidence is compared where the body itself is sound
    body_sound = (F.size(F.filter("found", lambda f: f["code"].isin(BODY, APPLICATION, ASSERTION, "AES_TRANSACTION_EXTENSION_UNREGISTERED"))) == 0) & (n == 0)
    compared = body_sound & F.col("expected").isNotNull()
    verified = compared & (F.col("expected") == F.col("digest"))
    mismatch = compared & ~verified
    audit_ok = F.coalesce("audit_valid", ~F.col("source_backed"))
    valid = sound & ~mismatch & audit_ok
    supported = F.size("missing") == 0
    codes = F.concat(
        F.transform("found", lambda f: f["code"]),
        F.array_repeat(F.lit("AES_TRANSACTION_EVENT_INVALID"), n.cast("int")),
        F.when(mismatch, F.array(F.lit("AES_TRANSACTION_INTEGRITY_MISMATCH"))).otherwise(F.array().cast("array<string>")),
        F.transform("missing", lambda _: F.lit("AES_TRANSACTION_UNSUPPORTED_CONTRACT")),
        F.coalesce("audit_codes", F.array().cast("array<string>")),
    )
    flagged = joined.select("tx_id", valid.alias("valid"), supported.alias("supported"), verified.alias("evidence_verified"), F.when(F.col("source_backed"), F.coalesce(F.col("audit_valid") & F.col("audit_complete"), F.lit(False))).alias("provenance_verified"), codes.alias("codes"), "digest")
    ready = F.col("valid") & F.col("supported") & (F.col("evidence_verified") | F.lit(not options.require_evidence))
    return flagged.select("tx_id", "valid", "supported", "evidence_verified", "provenance_verified", ready.alias("ready"), F.lit(False).alias("actionable"), F.array_sort("codes").alias("codes"), "digest")
