"""The binary format's column paths against its record-by-record ones."""

import random

import pytest

from strandline import wire
from strandline.config import BinaryLimits, Limits
from strandline.operators import shape, validate
from strandline.operators.shape import event_row
from strandline.sources import binary_format as binary
from strandline.sources.text_format import Stream
from strandline.streaming import decoder

RECORDS = [
    {"path": "$.a", "kind": "ObjectNode"},
    {"path": "$.a.b", "kind": "StringLiteral", "value": "x" * 200},
    {"header": '$.["aeon:h"]', "kind": "NumberLiteral", "value": "é1", "identity": "i"},
    {"path": "$.c", "kind": "NullLiteral", "value": "", "x.a.b": "1"},
    {"path": "$.d", "kind": "StringLiteral", "value": "v", "datatype": "a", "generics": [], "clarifiers": []},
]
COLUMNS = ("ordinal", "path", "header", "kind", "identity", "value")


def test_plain_records_go_past_the_reader(monkeypatch):
    """Only records that are not plain cost a cursor each."""
    data, calls = binary.write(Stream(records=RECORDS[:1] * 50)), []
    monkeypatch.setattr(binary, "read_record", lambda *a: calls.append(a))
    records = decoder.BinaryDecoder().push(data, True)
    assert records == RECORDS[:1] * 50 and not calls


def test_scan_and_decoder_against_parse():
    rng, base, sound = random.Random(1), binary.write(Stream(records=RECORDS * 2)), 0
    names = ("stream_id", "ordinal", "path", "header", "kind", "datatype", "generics", "clarifiers", "identity", "value")
    for t in range(3000):
        x = bytearray(base)
        for _ in range(rng.randint(0, 3)):
            x[rng.randrange(5, len(x))] = rng.randrange(256)
        limits = BinaryLimits(max_field_bytes=rng.choice([3, 100, 10**6]), max_record_bytes=rng.choice([20, 10**6])) if t % 3 == 0 else BinaryLimits()
        events = Limits(max_events=rng.choice([3, 100_000]))
        rows, out, faults, want = binary.Rows(), [], [], []
        feed, at = decoder.BinaryDecoder(limits, events), 0
        try:
            want = binary.parse(bytes(x), limits, events).records
            sound += 1
            fault = None
        except binary.BinaryError as e:
            fault = e
        try:
            binary._scan(bytes(x), rows, limits, events)
        except binary.BinaryError as e:
            faults.append((e.code, e.offset, e.record, e.component))
        assert faults == ([(fault.code, fault.offset, fault.record, fault.component)] if fault else [])
        try:
            while at < len(x):
                n = rng.randint(1, 40)
                out += feed.push(bytes(x[at : at + n]), at + n >= len(x))
                at += n
        except binary.BinaryError as e:
            assert fault and (e.code, e.record) == (fault.code, fault.record)
        if fault is None:
            assert out == want
            full = [dict(zip(names, event_row("", i, r)[:10], strict=True)) for i, r in enumerate(want)]
            assert list(zip(*(getattr(rows, c) for c in COLUMNS), strict=True)) == [tuple(f[c] for c in COLUMNS) for f in full]
    assert sound > 100


def test_encode_against_write(spark):
    records = {"a": [RECORDS[0], RECORDS[1], {"path": "$.c", "kind": "StringLiteral", "value": "x" * 20_000}], "b": RECORDS[4:], "c": [{"path": "$.d", "kind": "BooleanLiteral", "value": "maybe"}], "d": [], "gone": RECORDS[:1]}
    events = shape.events_from_records(spark, records.items())
    ids = spark.createDataFrame([(k,) for k in records if k != "gone"], "stream_id string")
    for limits in (BinaryLimits(), BinaryLimits(max_field_bytes=150), BinaryLimits(max_input_bytes=230), BinaryLimits(max_record_bytes=150)):
        streams = shape.streams(spark, ids, profile=wire.PARTIAL_PROFILE)
        got = {r.stream_id: (None if r.bytes is None else bytes(r.bytes), r.error) for r in binary.encode(events, streams, limits).collect()}
        assert set(got) == set(records) - {"gone"}
        for k in got:
            try:
                want = (binary.write(Stream(wire.PARTIAL_PROFILE, True, records=records[k]), limits), None)
            except binary.BinaryError as e:
                want = (None, e.code)
            assert got[k] == ((None, "FILM_AES_INVALID") if k == "c" else want)


@pytest.mark.parametrize("limits", [Limits(), Limits(max_events=2, max_value_nesting_depth=2, max_list_items=1, max_path_characters=9, max_attribute_depth=0)])
def test_streams_told_apart(spark, limits):
    """Findings are the same whether or not streams that need no join skip the joins."""
    cases = [
        [{"path": "$.a", "kind": "ObjectNode"}, {"path": "$.a.b", "kind": "BooleanLiteral", "value": "no"}],
        [{"path": '$.["é x"]', "kind": "StringLiteral", "value": "x"}, {"path": "$.a.@.b.@.c", "kind": "StringLiteral", "value": "x"}],
        [{"path": "$.a[0][1][2]", "kind": "ListNode"}, {"path": "$.a[0][1]", "kind": "ListNode"}, {"path": "$.a[0]", "kind": "ListNode"}, {"path": "$.a", "kind": "ListNode"}],
        [{"path": "$.a", "kind": "StringLiteral", "value": "x", "identity": ""}, {"kind": "PointerReference", "value": "$.a.@.b"}],
        [{"path": "$.a", "kind": "PointerReference", "value": "a"}, {"path": "$.a01", "kind": "HexLiteral", "value": "ab"}, {"path": "$.b", "kind": "HexLiteral", "value": "AB"}],
        [{"header": '$.["aeon:x"]', "kind": "StringLiteral", "value": "x"}, {"path": "$.a", "kind": "ObjectNode", "x.a.b": "1"}],
        [],
    ]
    events = shape.events_from_records(spark, [(f"{p}{i}", c) for p in "abc" for i, c in enumerate(cases)])
    contexts = [(f"{p}{i}", *about) for p, about in (("a", (wire.PARTIAL_PROFILE, None)), ("b", (wire.COMPLETE_PROFILE, None)), ("c", (wire.PARTIAL_PROFILE, wire.DOCUMENT_PROJECTION))) for i in range(len(cases))]
    streams = spark.createDataFrame(contexts, "stream_id string, profile string, projection string")
    spell = lambda df: sorted(map(str, df.collect()))
    got = spell(validate.validate(events, streams, limits))
    assert got and got == spell(validate._validate(events, streams, limits, ()))


def test_scan_of_plain_records_goes_past_the_reader(monkeypatch):
    data, calls, rows = binary.write(Stream(records=RECORDS[:1] * 50)), [], binary.Rows()
    monkeypatch.setattr(binary, "read_record", lambda *a: calls.append(a))
    binary._scan(data, rows, BinaryLimits(), Limits())
    assert rows.path == ["$.a"] * 50 and rows.ordinal == list(range(50)) and not calls


def test_round_trip_deals_events_out_once(spark):
    """The registered query counts in each stream's row; no event is dealt out again after decoding."""
    from strandline.plans import registry

    plan = registry.QUERIES["binary_round_trip"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan
