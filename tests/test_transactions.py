import copy
import json

import pytest
from pyspark.sql import functions as F

from strandline import schema, wire
from strandline.operators import transactions as tx
from strandline.operators import validate
from strandline.plans import registry


def body(**more):
    return {
        "transaction": wire.TX_CONTRACT, "id": "t", "intent": "i", "attempt": "a", "events": wire.EVENT_CONTRACT, "profile": wire.PARTIAL_PROFILE, "projection": None,
        "ordering": wire.EXACT_ORDER, "application": {"contract": wire.TX_SCALAR_REPLACEMENT}, "target": {"contract": wire.TX_TARGET, "id": "x", "boundary": "$"},
        "preconditions": [{"contract": wire.TX_REVISION, "scope": "$", "revision": "7"}], "preparation": {"contract": wire.TX_IDENTITY_PREPARATION},
        "authorization": {"contract": wire.TX_HOST_AUTHORIZATION, "context": "c"}, "limits": {"contract": wire.TX_LIMITS_CLAIM, "id": "l", "version": "1"},
        "assertions": {"eventCount": "1", "containers": []}, "records": [{"path": "$.a", "kind": "StringLiteral", "value": "x"}],
        "integrity": {"contract": wire.TX_INTEGRITY, "digest": "sha256"},
    } | more


SUPPORT = tx.Support(*(frozenset([x]) for x in (wire.TX_SCALAR_REPLACEMENT, wire.TX_TARGET, wire.TX_IDENTITY_PREPARATION, wire.TX_HOST_AUTHORIZATION, "l@1", wire.TX_INTEGRITY, wire.TX_REVISION)))


def patched(path, value):
    b = copy.deepcopy(body())
    at = b
    *head, last = path
    for k in head:
        at = at[k]
    if value is KeyError:
        del at[last]
    else:
        at[last] = value
    return b


CASES = [
    (body(), []),
    (None, [tx.BODY]),
    (body(extra="1"), [tx.BODY]),
    (body(**{"x.own.y": "1"}), ["AES_TRANSACTION_EXTENSION_UNREGISTERED"]),
    (patched(["transaction"], "v0"), [tx.BODY]),
    (patched(["id"], ""), [tx.BODY]),
    (patched(["id"], "é" * 257), [tx.BODY]),
    (patched(["attempt"], "t"), [tx.BODY]),
    (patched(["target"], "x"), [tx.BODY, tx.APPLICATION]),
    (patched(["target", "boundary"], "$.a"), [tx.APPLICATION]),
    (patched(["limits", "contract"], KeyError), [tx.BODY, tx.BODY]),
    (patched(["preconditions", 0, "revision"], "07"), [tx.BODY]),
    (patched(["preconditions"], []), [tx.APPLICATION]),
    (patched(["assertions", "eventCount"], "2"), [tx.ASSERTION, tx.APPLICATION]),
    (patched(["assertions", "containers"], [{"path": "p", "payloadDirectItemCount": "1", "resultDirectItemCount": "x"}]), [tx.BODY, tx.APPLICATION]),
    (patched(["integrity", "digest"], "md5"), [tx.BODY]),
    (patched(["records", 0, "identity"], "i"), [tx.APPLICATION]),
    (patched(["records", 0, "kind"], "ObjectNode"), [tx.APPLICATION, "AES_TRANSACTION_EVENT_INVALID"]),
    (patched(["records", 0, "path"], "a"), ["AES_TRANSACTION_EVENT_INVALID"]),
    (patched(["projection"], KeyError), [tx.BODY, tx.APPLICATION]),
    (patched(["records", 0, "value"], 1), [tx.APPLICATION, tx.BODY, "AES_TRANSACTION_EVENT_INVALID", "AES_TRANSACTION_EVENT_INVALID"]),
]


def table(spark, docs):
    return spark.createDataFrame([(f"t{i}", json.dumps(d, ensure_ascii=False)) for i, d in enumerate(docs)], "tx_id string, json string")


def test_bodies(spark):
    got = {r.tx_id: r for r in tx.inspect(table(spark, [b for b, _ in CASES]), tx.Options(support=SUPPORT), envelope=False).collect()}
    for i, (b, codes) in enumerate(CASES):
        own = [c for c in got[f"t{i}"].codes if c != "AES_TRANSACTION_UNSUPPORTED_CONTRACT"]
        assert own == sorted(codes), (b, got[f"t{i}"])
        assert got[f"t{i}"].valid == (not codes) and got[f"t{i}"].actionable is False
    assert got["t0"].digest == tx.body_digest(body()) and got["t0"].ready


def test_envelopes(spark):
    good = {"integrity": wire.TX_INTEGRITY, "digest": "sha256", "hash": tx.body_digest(body()), "signatures": [{"signature": wire.TX_SIGNATURE, "alg": "a", "kid": "k", "sig": "s"}]}
    env = lambda e, b=None, **more: {"envelope": wire.TX_ENVELOPE, "body": b or body(), "evidence": e} | more
    cases = [
        (env(good), True, True, []),
        (env(None), True, False, []),
        (env(good | {"hash": "0" * 64}), False, False, ["AES_TRANSACTION_INTEGRITY_MISMATCH"]),
        (env(good | {"hash": "0"}), False, False, [tx.INTEGRITY]),
        (env(good | {"signatures": [{"signature": "v0", "alg": "", "kid": "k", "sig": "s"}]}), False, True, [tx.SIGNATURE, tx.SIGNATURE]),
        (env("x"), False, False, [tx.INTEGRITY]),
        (env(None, more="1"), False, False, [tx.BODY]),
        (env(None) | {"envelope": "v0"}, False, False, [tx.ENVELOPE]),
        ([], False, False, [tx.ENVELOPE]),
    ]
    got = {r.tx_id: r for r in tx.inspect(table(spark, [c[0] for c in cases]), tx.Options(support=SUPPORT)).collect()}
    for i, (doc, valid, verified, codes) in enumerate(cases):
        r = got[f"t{i}"]
        assert (r.valid, r.evidence_verified, [c for c in r.codes if c != "AES_TRANSACTION_UNSUPPORTED_CONTRACT"]) == (valid, verified, sorted(codes)), (doc, r)
    needed = {r.tx_id: r for r in tx.inspect(table(spark, [env(None), env(good)]), tx.Options(support=SUPPORT, require_evidence=True)).collect()}
    assert (needed["t0"].valid, needed["t0"].ready, needed["t1"].ready) == (False, False, True)
    unsupported = tx.inspect(table(spark, [env(good)])).head()
    assert unsupported.valid and not unsupported.supported and not unsupported.ready and len(unsupported.codes) == 7


def test_source_backed(spark):
    import hashlib

    raw = b"source"
    origin = "sha256:" + hashlib.sha256(raw).hexdigest()
    b = body(application={"contract": "other"}, preparation={"contract": wire.TX_SOURCE_BACKED}, records=[{"path": "$.a", "kind": "StringLiteral", "value": "x", "origin": origin, "span": "0:3"}])
    artifacts = spark.createDataFrame([(origin, bytearray(raw))], schema.ARTIFACTS)
    docs = table(spark, [b])
    r = tx.inspect(docs, tx.Options(), artifacts, envelope=False).head()
    assert r.valid and r.provenance_verified
    r = tx.inspect(docs, tx.Options(), artifacts.limit(0), envelope=False).head()
    assert not r.valid and r.provenance_verified is False and "AES_SOURCE_REQUIRED" in r.codes


def test_signature_input():
    digest = tx.body_digest(body())
    assert tx.signature_input(digest, "a", "k").startswith(wire.TX_SIGNATURE.encode() + b"\0m6:")
    with pytest.raises(ValueError):
        tx.signature_input("x", "a", "k")


def test_members_are_judged_once(monkeypatch):
    """Bodies that share their members cost the rules of those members once; what is found stays that of each body."""
    judged = []
    rule = tx.BODY_RULES["limits"]
    monkeypatch.setitem(tx.BODY_RULES, "limits", lambda v, path, code: judged.append(v) or rule(v, path, code))
    known = tx._Known(SUPPORT)
    docs = [body(id=f"t{i}", limits={"contract": wire.TX_LIMITS_CLAIM, "id": "l", "version": str(i % 2) if i % 3 else 1}) for i in range(12)]
    got = [tx._shape("t", json.dumps(d), tx.Options(support=SUPPORT), False, known) for d in docs]
    assert len(judged) == 3
    for d, g in zip(docs, got, strict=True):
        assert [(f["code"], f["path"]) for f in g["found"]] == list(tx.body_findings(d))
        assert g["missing"] == tx.unsupported(d, SUPPORT)
        assert g["digest"] == (None if d["limits"]["version"] == 1 else tx.body_digest(d))


@pytest.mark.parametrize("value", [None, 1, True, 1.0, [], {}, "x", "\ud800", {"contract": 1}, [{"contract": "a"}], {"\ud800": "x"}])
@pytest.mark.parametrize("key", [*tx.BODY_RULES, "records", "projection", "x.a.b"])
def test_known_members_against_rules(key, value):
    known, b = tx._Known(SUPPORT), body(**{key: value})
    for _ in range(2):
        got = tx._shape("t", json.dumps(b), tx.Options(support=SUPPORT), False, known)
        try:
            digest = tx.body_digest(b)
        except (ValueError, UnicodeEncodeError):
            digest = None
        assert got["digest"] == digest and got["missing"] == tx.unsupported(b, SUPPORT)
        if not (isinstance(value, dict) and "\ud800" in value):
            assert [(f["code"], f["path"]) for f in got["found"]] == list(tx.body_findings(b))


def test_digests_are_not_judged(spark, monkeypatch):
    """Digests of bodies without a walk of their rules."""
    docs = [{"envelope": wire.TX_ENVELOPE, "body": b, "evidence": None} for b in (body(), body(id=1), {}, None, body(extra=["\u00e9"]))] + [[], "x"]
    want = {r.tx_id: r.digest for r in tx.shaped(table(spark, docs)).collect()}
    assert {r.tx_id: r.digest for r in tx.digests(table(spark, docs)).collect()} == want and sum(d is not None for d in want.values()) == 2


EVENT = {"path": "$.a", "kind": "StringLiteral", "value": "x"}
RECORDS = [
    [EVENT], [], [EVENT, EVENT], [EVENT | {"identity": "i"}, EVENT | {"path": "$.b", "identity": "i"}], [EVENT | {"path": "$.a.b"}], [EVENT | {"path": "a"}], [EVENT | {"value": 1}, "x"],
    [{"header": '$.["aeon:a"]', "kind": "StringLiteral", "value": "x"}], [EVENT | {"kind": "ObjectNode"}], [EVENT | {"x.own": "1"}], [EVENT, EVENT | {"path": "$.b.c"}], [EVENT | {"path": "$" + 300 * ".a"}],
]


def test_events_of_each_context(spark):
    """Events judged where they are walked, and those set apart, against the validation of all of them."""
    contexts = [(wire.PARTIAL_PROFILE, None), (wire.COMPLETE_PROFILE, None), (wire.PARTIAL_PROFILE, wire.DOCUMENT_PROJECTION), (wire.COMPLETE_PROFILE, wire.DOCUMENT_PROJECTION), ("other", None), (wire.PARTIAL_PROFILE, "other")]
    docs = [body(profile=p, projection=j, records=r) for p, j in contexts for r in RECORDS]
    rows = [(f"t{i}", n, json.dumps(r)) for i, d in enumerate(docs) for n, r in enumerate(d["records"])]
    host = tx.host_records(spark.createDataFrame(rows, "stream_id string, ordinal long, json string"))
    streams = spark.createDataFrame([(f"t{i}", d["profile"], d["projection"]) for i, d in enumerate(docs)], "stream_id string, profile string, projection string")
    found = validate.validate(host.where("not array_contains(faults, 'AES_INVALID_EVENT')").drop("faults"), streams).select("stream_id", "code")
    found = found.unionByName(host.select("stream_id", F.explode("faults").alias("code")))
    want = {r.stream_id: r["count"] for r in found.groupBy("stream_id").count().collect()}
    got = {r.tx_id: r.codes.count("AES_TRANSACTION_EVENT_INVALID") for r in tx.inspect(table(spark, docs), envelope=False).collect()}
    assert got == {f"t{i}": want.get(f"t{i}", 0) for i in range(len(docs))} and 12 < len(want) < len(docs)


def test_sound_events_stay_where_they_are(spark, monkeypatch):
    """Only the events of documents that are not sound at sight leave the walk, and nothing else of them is written."""
    written, told = [], validate.validate_told
    for module in (tx, validate):
        monkeypatch.setattr(module, "materialize", lambda df, tag, *more, f=module.materialize: written.append(tag) or f(df, tag, *more))
    monkeypatch.setattr(validate, "validate_told", lambda events, *more: written.append(events.count()) or told(events, *more))
    docs = [body(id=f"t{i}") for i in range(20)] + [body(records=[EVENT | {"kind": "ObjectNode"}])]
    got = tx.inspect(table(spark, docs), tx.Options(support=SUPPORT), envelope=False)
    assert written == ["shaped", 1, "odd"]
    assert sorted((r.tx_id, r.valid) for r in got.collect()) == sorted((f"t{i}", i < 20) for i in range(21))


def test_evidence_without_tables_of_documents(spark, monkeypatch):
    """Digests go into the evidence in passing: no table of documents or digests, and no join of orders with their digests."""
    plans = []
    monkeypatch.setattr(registry, "materialize", lambda *more: pytest.fail("a table is written"))
    monkeypatch.setattr(tx, "shaped", lambda docs, *more, f=tx.shaped: plans.append(docs._jdf.queryExecution().optimizedPlan().toString()) or f(docs, *more))
    rows = registry.transaction_evidence(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count() and all(r.digest for r in rows)
    assert "Join" not in plans[0]


def test_digests_keep_other_columns(spark):
    docs = table(spark, [{"envelope": wire.TX_ENVELOPE, "body": body(), "evidence": None}]).withColumn("k", F.lit(7).cast("long"))
    assert [r.asDict() for r in tx.digests(docs).collect()] == [{"tx_id": "t0", "k": 7, "digest": tx.body_digest(body())}]


def test_nothing_is_broadcast_by_the_size_of_files(spark, monkeypatch):
    """Tables with a row a document stay out of the driver, however small their files look."""
    plans, threshold = [], "spark.sql.autoBroadcastJoinThreshold"
    plan = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df
    for module in (tx, validate):
        monkeypatch.setattr(module, "materialize", lambda df, tag, *more, f=module.materialize: f(plan(df), tag, *more))
    spark.conf.set(threshold, "1g")
    try:
        plan(tx.inspect(table(spark, [body(), body(records=[EVENT | {"kind": "ObjectNode"}])]), tx.Options(support=SUPPORT), envelope=False))
        docs = tx.host_records(spark.createDataFrame([("t", 0, json.dumps(EVENT))], "stream_id string, ordinal long, json string")).drop("faults")
        validate.validate(docs, spark.createDataFrame([("t", wire.PARTIAL_PROFILE, None)], "stream_id string, profile string, projection string"))
    finally:
        spark.conf.unset(threshold)
    assert sum("Join" in p for p in plans) >= 4 and not any("Broadcast" in p for p in plans)
