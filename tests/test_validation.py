"""Validators against a small model, and findings one by one."""

import random
import re
from collections import Counter

import pytest

from strandline import schema, wire
from strandline.config import Limits
from strandline.operators import completeness, integrity, provenance, shape, validate

CODES = "AES_"
OBJ, LIST, STR = "ObjectNode", "ListNode", "StringLiteral"


def run(spark, streams, limits=Limits(), registered=()):
    """Codes by stream of {id: (profile, projection, records)}."""
    events = shape.events_from_records(spark, [(i, r) for i, (_, _, r) in streams.items()])
    context = spark.createDataFrame([(i, p, True, j, j is not None, True) for i, (p, j, _) in streams.items()], schema.STREAMS)
    found = {i: [] for i in streams}
    for d in validate.validate(events, context, limits, registered).collect():
        found[d.stream_id].append(d)
    return found


def s(path, value="x", **more):
    return {"path": path, "kind": STR, "value": value, **more}


def test_single_findings(spark):
    part, whole, doc = wire.PARTIAL_PROFILE, wire.COMPLETE_PROFILE, wire.DOCUMENT_PROJECTION
    h = {"header": '$.["aeon:x"]', "kind": STR, "value": "x"}
    cases = {
        "AES_UNSUPPORTED_PROFILE": ("other", None, []),
        "AES_UNSUPPORTED_PROJECTION": (part, "other", []),
        "AES_UNKNOWN_FIELD": (part, None, [s("$.a") | {"x.a.b": "1"}]),
        "AES_MISSING_ADDRESS": (part, None, [{"kind": STR, "value": ""}]),
        "AES_MULTIPLE_ADDRESSES": (part, None, [s("$.a") | {"header": "$.b"}]),
        "AES_MISSING_FIELD": (part, None, [{"path": "$.a"}]),
        "AES_INVALID_PATH": (part, None, [s("$")]),
        "AES_INVALID_HEADER_PATH": (part, doc, [{"header": "$.a", "kind": STR, "value": ""}]),
        "AES_HEADER_REQUIRES_PROJECTION": (part, None, [h]),
        "AES_HEADER_ORDER": (part, doc, [s("$.a"), h]),
        "AES_UNKNOWN_KIND": (part, None, [{"path": "$.a", "kind": "Other"}]),
        "AES_UNEXPECTED_VALUE": (part, None, [{"path": "$.a", "kind": OBJ, "value": ""}]),
        "AES_MISSING_VALUE": (part, None, [{"path": "$.a", "kind": "NullLiteral"}]),
        "AES_INVALID_VALUE": (part, None, [{"path": "$.a", "kind": "HexLiteral", "value": "AB"}]),
        "AES_INVALID_REFERENCE": (part, None, [{"path": "$.a", "kind": "CloneReference", "value": "$"}]),
        "AES_EMPTY_FIELD": (part, None, [s("$.a", identity="")]),
        "AES_DATATYPE_COMPONENTS": (part, None, [s("$.a", generics=[])]),
        "AES_INVALID_DATATYPE": (part, None, [s("$.a", datatype="1", generics=[], clarifiers=[])]),
        "AES_DATATYPE_DEPTH": (part, None, [s("$.a", datatype="a", generics=[{"datatype": "b", "generics": [{"datatype": "c", "generics": [{"datatype": "d", "generics": [], "clarifiers": []}], "clarifiers": []}], "clarifiers": []}], clarifiers=[])]),
        "AES_DATATYPE_LIMIT": (part, None, [s("$.a", datatype="a", generics=[], clarifiers=[{"kind": "NumberLiteral", "value": "1"}] * 2)]),
        "AES_INVALID_ORIGIN": (part, None, [s("$.a", origin="sha256:0")]),
        "AES_SPAN_REQUIRES_ORIGIN": (part, None, [s("$.a", span="0:1")]),
        "AES_INVALID_SPAN": (part, None, [s("$.a", origin="sha256:" + "0" * 64, span="9:10") , s("$.b", origin="sha256:" + "0" * 64, span="10:9")]),
        "AES_DUPLICATE_PATH": (whole, None, [s("$.a"), s("$.a")]),
        "AES_MISSING_PARENT": (whole, None, [s("$[0]"), s("$.a.b")]),
        "AES_INCOMPATIBLE_PARENT": (whole, None, [s("$.a"), s("$.a.b"), s("$.a.@.c")]),
        "AES_INVALID_NODE_HEAD": (whole, None, [{"path": "$.a", "kind": "NodeHead", "value": "t"}]),
        "AES_MISSING_REFERENCE_TARGET": (whole, None, [{"path": "$.a", "kind": "PointerReference", "value": "$.z"}]),
        "AES_DUPLICATE_IDENTITY": (whole, None, [s("$.a", identity="i"), s("$.b", identity="i")]),
    }
    found = run(spark, cases)
    for code, diagnostics in found.items():
        assert {d.code for d in diagnostics} == {code}, (code, diagnostics)
    assert found["AES_DUPLICATE_PATH"][0].first_record == 0 and found["AES_DUPLICATE_PATH"][0].record == 1
    assert Counter(d.required_path for d in found["AES_MISSING_PARENT"]) == {"$": 1, "$.a": 1}
    assert len(found["AES_INVALID_SPAN"]) == 1 and found["AES_INVALID_SPAN"][0].record == 1


@pytest.mark.parametrize(
    "counter,at,records",
    [
        ("max_events", 2, [s("$.a"), s("$.b")]),
        ("max_path_depth", 2, [s("$.a.b")]),
        ("max_path_characters", 4, [s("$.ab")]),
        ("max_attribute_depth", 1, [s("$.a.@.b")]),
        ("max_key_segment_codepoints", 3, [s('$.["é😀x"]')]),
        ("max_string_codepoints", 2, [s("$.a", "é😀")]),
        ("max_value_nesting_depth", 2, [{"path": "$.a", "kind": OBJ}, {"path": "$.a.b", "kind": OBJ}, s("$.a.b.c")]),
        ("max_list_items", 1, [{"path": "$.a", "kind": LIST}, s("$.a[0]"), s("$.a[0]")]),
        ("max_tuple_items", 1, [{"path": "$.a", "kind": "TupleLiteral"}, s("$.a[0]")]),
        ("max_path_depth", 2, [{"path": "$.a", "kind": "CloneReference", "value": "$.b.c"}]),
    ],
)
def test_limits_at_and_over(spark, counter, at, records):
    stream = {"a": (wire.PARTIAL_PROFILE, None, records)}
    assert run(spark, stream, Limits(**{counter: at}))["a"] == []
    (d,) = run(spark, stream, Limits(**{counter: at - 1}))["a"]
    assert (d.code, d.counter, d.observed, d.lim) == ("AES_LIMIT_EXCEEDED", counter, at, at - 1)


# -- a model of the checks between events ------------------------------------------

_SEG = re.compile(r"\.@\.\w+|\.\w+|\[\d+\]")


def model(records):
    """Codes of the stream checks for simple well-formed addresses under the complete profile."""
    out, first = Counter(), {}
    for i, r in enumerate(records):
        if r["path"] in first:
            out["AES_DUPLICATE_PATH"] += 1
        first.setdefault(r["path"], i)
    ids = Counter(r["identity"] for r in records if r.get("identity"))
    out["AES_DUPLICATE_IDENTITY"] = sum(n - 1 for n in ids.values())
    for r in records:
        segs = _SEG.findall(r["path"])
        parent, seg = "$" + "".join(segs[:-1]), segs[-1]
        kind = "index" if seg[0] == "[" else "attribute" if seg[1] == "@" else "member"
        head = r["kind"] == "NodeHead"
        if r["kind"] in wire.REFERENCES and r["value"] not in first:
            out["AES_MISSING_REFERENCE_TARGET"] += 1
        if len(segs) == 1:
            out["AES_MISSING_PARENT"] += kind != "member"
            out["AES_INVALID_NODE_HEAD"] += head
        elif parent not in first:
            out["AES_MISSING_PARENT"] += 1
        else:
            up = records[first[parent]]["kind"]
            good = {"member": up == OBJ, "attribute": True, "index": head if up == "NodeLiteral" else up in wire.INDEXED}[kind]
            out["AES_INCOMPATIBLE_PARENT"] += not good
            out["AES_INVALID_NODE_HEAD"] += head and not (kind == "index" and up == "NodeLiteral")
    return +out


def random_records(seed):
    r = random.Random(seed)
    kinds = [OBJ, LIST, "TupleLiteral", "NodeLiteral", "NodeHead", STR, "PointerReference"]
    known = ["$"]
    out = []
    for i in range(r.randrange(25)):
        base = r.choice(known) if r.random() < 0.9 else "$.nowhere"
        path = base + r.choice([".a", ".b", "[0]", "[1]", ".@.k"]) if r.random() < 0.9 else r.choice(known)
        path = path if path != "$" else "$.c"
        if ".@.k.@." in path:
            continue
        kind = r.choice(kinds)
        e = {"path": path, "kind": kind}
        if kind not in wire.CONTAINERS:
            e["value"] = r.choice(known[1:] or ["$.zz"]) if kind == "PointerReference" else "v"
        if r.random() < 0.3:
            e["identity"] = r.choice("xyz")
        known.append(path)
        out.append(e)
    return out


def test_stream_checks_against_model(spark):
    streams = {f"s{i}": (wire.COMPLETE_PROFILE, None, random_records(i)) for i in range(150)}
    found = run(spark, streams)
    for i, (_, _, records) in streams.items():
        assert Counter(d.code for d in found[i]) == model(records), (i, records)


def test_completeness(spark):
    streams = [(f"s{i}", random_records(i)) for i in range(40)]
    got = {}
    for r in completeness.missing_prefixes(shape.events_from_records(spark, streams)).collect():
        got.setdefault(r.stream_id, {})[r.path] = r.required_by
    for i, records in streams:
        there, want = {r["path"] for r in records}, {}
        for r in records:
            segs = _SEG.findall(r["path"])
            for n in range(1, len(segs)):
                p = "$" + "".join(segs[:n])
                if p not in there:
                    want.setdefault(p, r["path"])
        assert got.get(i, {}) == want


def test_plan_has_no_python_on_the_simple_path(spark):
    events = shape.events_from_records(spark, [("a", [s("$.a")])])
    rows = shape.addressed(events).withColumn("projection", validate.F.lit(None).cast("string"))
    index = validate.first_index(rows)
    for df in (validate.parents(rows, index), validate.duplicate_identities(rows), completeness.missing_prefixes(events)):
        assert "Python" not in df._jdf.queryExecution().toString() and "Cartesian" not in df._jdf.queryExecution().toString()


# -- integrity and provenance ---------------------------------------------------------


def test_digests(spark):
    import hashlib

    from strandline.functions import logical

    records = [s("$.b", "é", origin="sha256:" + "0" * 64), {"path": "$.a", "kind": "ListNode", "datatype": "l", "generics": [{"datatype": "g", "generics": [], "clarifiers": []}], "clarifiers": []}, {"header": '$.["aeon:h"]', "kind": STR, "value": ""} | {"x.a.b": "1"}]
    events = shape.events_from_records(spark, [("s", records)])
    context = spark.createDataFrame([("s", wire.COMPLETE_PROFILE, False, wire.DOCUMENT_PROJECTION, True, True), ("none", wire.PARTIAL_PROFILE, False, None, False, True)], schema.STREAMS)
    for ordering, scope, prov in [(wire.EXACT_ORDER, wire.DOCUMENT_SCOPE, wire.PROVENANCE_INCLUDED), (wire.CANONICAL_ORDER, wire.BODY_SCOPE, wire.PROVENANCE_EXCLUDED), (wire.CANONICAL_ORDER, wire.DOCUMENT_SCOPE, wire.PROVENANCE_EXCLUDED)]:
        covered = [r for r in records if scope == wire.DOCUMENT_SCOPE or "path" in r]
        covered = [{k: v for k, v in r.items() if prov == wire.PROVENANCE_INCLUDED or k not in ("origin", "span")} for r in covered]
        if ordering == wire.CANONICAL_ORDER:
            covered.sort(key=lambda r: ("path" in r, r.get("header", r.get("path"))))
        value = {"integrity": wire.INTEGRITY_CONTRACT, "events": wire.EVENT_CONTRACT, "profile": wire.COMPLETE_PROFILE, "projection": wire.DOCUMENT_PROJECTION, "ordering": ordering, "scope": scope, "provenance": prov, "digest": "sha256", "records": covered}
        want = hashlib.sha256(wire.INTEGRITY_CONTRACT.encode() + b"\0" + logical.encode(value)).hexdigest()
        got = {r.stream_id: r for r in integrity.digests(events, context, ordering, scope, prov).collect()}
        assert got["s"].digest == want
        assert (got["none"].error is None) == (scope == wire.BODY_SCOPE)
    refused = spark.createDataFrame([("s",)], "stream_id string")
    assert integrity.digests(events, context, wire.EXACT_ORDER, wire.BODY_SCOPE, wire.PROVENANCE_EXCLUDED, refused).where("stream_id = 's'").head().error == "AES_INTEGRITY_INVALID_LOGICAL_VALUE"
    twice = shape.events_from_records(spark, [("s", [s("$.a"), s("$.a")])])
    assert integrity.digests(twice, context, wire.CANONICAL_ORDER, wire.BODY_SCOPE, wire.PROVENANCE_EXCLUDED).where("stream_id = 's'").head().error == "AES_INTEGRITY_AMBIGUOUS_CANONICAL_ORDER"
    for bad in [(None, wire.BODY_SCOPE, wire.PROVENANCE_EXCLUDED), ("x", wire.BODY_SCOPE, wire.PROVENANCE_EXCLUDED), (wire.EXACT_ORDER, "x", wire.PROVENANCE_EXCLUDED), (wire.EXACT_ORDER, wire.BODY_SCOPE, "x")]:
        with pytest.raises(integrity.IntegrityError):
            integrity.digests(events, context, *bad)
    found = integrity.digests(events, context, wire.EXACT_ORDER, wire.BODY_SCOPE, wire.PROVENANCE_EXCLUDED)
    expected = spark.createDataFrame([("s", found.where("stream_id = 's'").head().digest), ("none", "XYZ")], "stream_id string, expected string")
    assert {r.stream_id: r.matches for r in integrity.verify(found, expected).collect()} == {"s": True, "none": False}
    (row,) = integrity.signature_inputs(found.where("stream_id = 's'"), "alg", "kid").collect()
    assert bytes(row.bytes) == integrity.signature_input(found.where("stream_id = 's'").head().digest, "alg", "kid")


def test_provenance(spark):
    import hashlib

    name = lambda b: "sha256:" + hashlib.sha256(b).hexdigest()
    good, broken = "aé😀b".encode(), b"\xff\xfe"
    records = [
        s("$.a", origin=name(good), span="0:1"), s("$.b", origin=name(good), span="0:2"), s("$.c", origin=name(good), span="1:8"), s("$.d", origin=name(good), span="1:9"),
        s("$.e", origin=name(broken)), s("$.f", origin=name(b"wrong")), s("$.g", origin=name(b"absent")), s("$.h", origin=name(b"absent")), s("$.i"), s("$.j", origin="x"), s("$.k", origin=name(good), span="3:3"),
    ]
    artifacts = spark.createDataFrame([(name(good), bytearray(good)), (name(broken), bytearray(broken)), (name(b"wrong"), bytearray(b"other"))], schema.ARTIFACTS)
    events = shape.events_from_records(spark, [("s", records)])
    streams = shape.streams(spark, events)
    found = sorted((r.record, r.code) for r in provenance.audit(events, artifacts, True, True).collect())
    assert found == [(1, "AES_INVALID_SPAN"), (3, "AES_INVALID_SPAN"), (4, "AES_SOURCE_INVALID_UTF8"), (5, "AES_ORIGIN_MISMATCH"), (6, "AES_SOURCE_REQUIRED"), (8, "AES_SOURCE_REQUIRED"), (9, "AES_INVALID_ORIGIN"), (10, "AES_INVALID_SPAN")]
    r = provenance.summary(events, streams, artifacts).head()
    assert (r.valid, r.complete, r.verified_origins, r.missing_origins) == (False, False, [name(good)], [name(b"absent")])
