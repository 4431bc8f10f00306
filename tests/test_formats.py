"""Text and binary formats: spelling, errors, limits and round trips."""

import random

import pytest
from pyspark.sql import functions as F

from strandline import schema, wire
from strandline.config import BinaryLimits, Limits
from strandline.functions import datatypes, payload
from strandline.operators import shape
from strandline.sources import binary_format as binary
from strandline.sources import text_format as text

HEAD = "telex.aes=1\n"
ONE = HEAD + "\npath=$.a\nkind=StringLiteral\nvalue=x\n"


@pytest.mark.parametrize(
    "source,code,line",
    [
        ("", "TELEX_INVALID_PREAMBLE", 1),
        ("﻿" + HEAD, "TELEX_BOM", 1),
        (HEAD + "\r\rx", "TELEX_BARE_CR", None),
        ("telex.aes=2\n", "TELEX_INVALID_PREAMBLE", 1),
        (HEAD + "profile=\n", "TELEX_EMPTY_PROFILE", 2),
        (HEAD + "projection=\n", "TELEX_EMPTY_PROJECTION", 2),
        (HEAD + "profile=a\nprofile=b\n", "TELEX_DUPLICATE_STREAM_FIELD", 3),
        (HEAD + "path=$.a\n", "TELEX_MISSING_HEADER_SEPARATOR", 2),
        (HEAD + "\nnofield\n", "TELEX_INVALID_FIELD_LINE", 3),
        (HEAD + "\n=x\n", "TELEX_INVALID_FIELD_LINE", 3),
        (HEAD + "\nBad=x\n", "TELEX_INVALID_FIELD_NAME", 3),
        (HEAD + "\nkind=a\nkind=b\n", "TELEX_DUPLICATE_FIELD", 4),
        (HEAD + "\nkind=a\tb\n", "TELEX_UNESCAPED_CONTROL", 3),
        (HEAD + "\nkind=a\\\n", "TELEX_INCOMPLETE_ESCAPE", 3),
        (HEAD + "\nkind=\\q\n", "TELEX_UNKNOWN_ESCAPE", 3),
        (HEAD + "\nkind=\\u{41\n", "TELEX_UNTERMINATED_UNICODE_ESCAPE", 3),
        (HEAD + "\nkind=\\u{}\n", "TELEX_INVALID_UNICODE_ESCAPE", 3),
        (HEAD + "\nkind=\\u{D800}\n", "TELEX_INVALID_UNICODE_SCALAR", 3),
        (HEAD + "\nkind=\\u{110000}\n", "TELEX_INVALID_UNICODE_SCALAR", 3),
        (HEAD + "\npath=$.a\ndatatype=list<1>\nkind=x\n", "TELEX_INVALID_DATATYPE", 4),
        (HEAD + "\npath=$.a\ngenerics=[]\n", "TELEX_INVALID_DATATYPE", 4),
        (HEAD + "\ndatatype=a<b<c<d>>>\n", "TELEX_DATATYPE_LIMIT", 3),
        (HEAD + "\ndatatype=a[1, 2]\n", "TELEX_DATATYPE_LIMIT", 3),
    ],
)
def test_text_errors(source, code, line):
    with pytest.raises(text.TextError) as e:
        text.parse(source)
    assert (e.value.code, e.value.line) == (code, line)


@pytest.mark.parametrize(
    "source,canonical",
    [
        (HEAD, True),
        (HEAD[:-1], False),
        (HEAD + "\n", False),
        (ONE, True),
        (ONE[:-1], False),
        (ONE + "\n", False),
        (ONE.replace("\n", "\r\n"), False),
        (ONE.replace("\n\n", "\n\n\n"), False),
        (HEAD + "\nkind=x\npath=$.a\n", False),
        (HEAD + "\npath=$.a\nkind=\\u{61}\n", True),
        (HEAD + "\npath=$.a\nkind=\\u{061}\n", False),
        (HEAD + "\npath=$.a\nkind=\\u{A}\n", False),
        (HEAD + "projection=b\nprofile=a\n", False),
        (HEAD + "profile=a\nprojection=b\n", True),
        (HEAD + "\npath=$.a\nkind=k\ndatatype=a<b,c>\n", False),
        (HEAD + "\npath=$.a\nkind=k\nx.b=1\nx.a=1\n", False),
    ],
)
def test_text_canonicality(source, canonical):
    assert text.parse(source).canonical is canonical
    assert text.parse(text.spell(text.parse(source))).canonical


@pytest.mark.parametrize("counter,at,over", [("max_input_bytes", len(ONE), len(ONE) - 1), ("max_line_bytes", 18, 17), ("max_fields_per_event", 3, 2), ("max_events", 1, 0), ("max_decoded_payload_bytes", 17, 16)])
def test_text_limits(counter, at, over):
    assert text.parse(ONE, Limits(**{counter: at})).records
    with pytest.raises(text.TextError) as e:
        text.parse(ONE, Limits(**{counter: over}))
    assert (e.value.code, e.value.counter, e.value.limit) == ("TELEX_LIMIT_EXCEEDED", counter, over)


def random_record(r, i):
    pick = ["plain", "", "a\\b\n\r\t\0\x01\x7f", "é😀", "=x=", " "]
    kind = r.choice(["StringLiteral", "NumberLiteral", "ObjectNode", "SymbolicLiteral"])
    out = {"path": f"$.p{i}", "kind": kind}
    if kind != "ObjectNode":
        out["value"] = r.choice(pick) or "v"
    if r.random() < 0.5:
        out["identity"] = f"i{i}" + r.choice(pick)
    if r.random() < 0.4:
        generics = [{"datatype": "g", "generics": [], "clarifiers": [{"kind": "StringLiteral", "value": r.choice(pick)}]}] if r.random() < 0.5 else []
        out |= {"datatype": "T", "generics": generics, "clarifiers": [{"kind": "NumberLiteral", "value": "-1.5e3"}] if r.random() < 0.5 else []}
    if r.random() < 0.4:
        out["origin"] = "sha256:" + "0f" * 32
        if r.random() < 0.5:
            out["span"] = f"{i}:{i + 2**63}"
    if r.random() < 0.3:
        out |= {"x.own.b": r.choice(pick), "x.own.a": "1"}
    return out


def random_stream(seed):
    r = random.Random(seed)
    return text.Stream(wire.PARTIAL_PROFILE, True, None, False, [random_record(r, i) for i in range(r.randrange(12))])


@pytest.mark.parametrize("seed", range(20))
def test_round_trips(seed):
    s = random_stream(seed)
    assert text.parse(text.spell(s)).records == s.records and text.parse(text.spell(s)).canonical
    back = binary.parse(binary.write(s))
    assert back.records == s.records and (back.profile, back.profile_explicit) == (s.profile, True)
    assert binary.write(back) == binary.write(s)


@pytest.mark.parametrize("seed", range(4))
def test_damaged_bytes_never_break_the_reader(seed):
    r = random.Random(seed)
    good = binary.write(random_stream(seed + 3))
    for _ in range(500):
        data = bytearray(good)
        for _ in range(r.randrange(1, 4)):
            data[r.randrange(len(data))] = r.randrange(256)
        data = bytes(data[: r.randrange(len(data) + 1)])
        try:
            s = binary.parse(data)
        except binary.BinaryError as e:
            assert e.code.startswith("FILM_") and 0 <= e.offset <= len(data) + 1
        else:
            assert binary.write(s) == data


def test_binary_errors():
    head = wire.BINARY_PREAMBLE
    for data, code, offset in [
        (b"", "FILM_TRUNCATED", 0),
        (b"O__", "FILM_TRUNCATED", 3),
        (b"XXXXX\0", "FILM_INVALID_PREAMBLE", 0),
        (head, "FILM_TRUNCATED", 5),
        (head + b"\4", "FILM_INVALID_CONTEXT", 5),
        (head + b"\1\0", "FILM_INVALID_CONTEXT", 6),
        (head + b"\0\0", "FILM_NONCANONICAL", 7),
        (head + b"\0\x81\0", "FILM_NONCANONICAL", 6),
        (head + b"\0" + b"\xff" * 10, "FILM_INTEGER_OVERFLOW", 6),
        (head + b"\0\5\0\1", "FILM_TRUNCATED", 7),
        (head + b"\0\3\x20\1\0", "FILM_INVALID_RECORD", 7),
        (head + b"\0\3\0\x19\0", "FILM_INVALID_KIND", 8),
        (head + b"\0\4\0\1\1\xff", "FILM_INVALID_UTF8", 9),
    ]:
        with pytest.raises(binary.BinaryError) as e:
            binary.parse(data)
        assert (e.value.code, e.value.offset) == (code, offset), data


def test_tables_agree_with_single_streams(spark):
    streams = [random_stream(i) for i in range(12)]
    texts = [(f"s{i}", text.spell(s)) for i, s in enumerate(streams)] + [("bad", "nope"), ("null", None)]
    decoded = text.decode(spark.createDataFrame(texts, "stream_id string, text string")).cache()
    assert {r.stream_id for r in text.errors_of(decoded).collect()} == {"bad", "null"}
    events, context = text.events_of(decoded), text.streams_of(decoded)
    assert events.schema == schema.EVENTS or events.columns == schema.EVENTS.fieldNames()
    again = {r.stream_id: r.text for r in text.encode(events, context).collect()}
    assert again == dict(t for t in texts if t[0].startswith("s"))
    blobs = binary.encode(events, context, registered=("x.own.a", "x.own.b")).cache()
    assert {r.stream_id: bytes(r.bytes) for r in blobs.collect()} == {f"s{i}": binary.write(s) for i, s in enumerate(streams)}
    back = {r.stream_id: r.text for r in binary.to_text(blobs, registered=("x.own.a", "x.own.b")).collect()}
    assert back == again
    codes = {r.error for r in binary.to_text(blobs).collect()}
    assert codes == {None, "FILM_AES_INVALID"}
    direct = binary.from_text(spark.createDataFrame([*texts, ("loose", ONE + "\n")], "stream_id string, text string"), registered=("x.own.a", "x.own.b"))
    got = {r.stream_id: (r.bytes and bytes(r.bytes), r.error) for r in direct.collect()}
    assert got["s3"] == (binary.write(streams[3]), None) and got["loose"] == (None, "FILM_SOURCE_NONCANONICAL") and got["bad"][1] == "TELEX_INVALID_PREAMBLE"
    assert {r.json for r in text.to_json(events).collect()} and text.from_json(text.to_json(events)).count() == events.count()


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text(ONE)
    assert [r.value for r in text.events_of(text.read(spark, str(tmp_path))).collect()] == ["x"]
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "c.bin").write_bytes(binary.write(text.parse(ONE)))
    assert [r.value for r in text.events_of(binary.read(spark, f"{tmp_path}/b")).collect()] == ["x"]
    small = binary.read(spark, f"{tmp_path}/b", BinaryLimits(max_input_bytes=3)).head()
    assert small.error.code == "FILM_LIMIT_EXCEEDED" and small.events == []


def test_expressions_match_functions(spark):
    values = ["", "plain", "a\\b\n\r\t\0\x01\x7f\x1f", "é😀\\u{41}", "\\", "x" * 1000]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert [r[0] for r in df.select(payload.encoded(F.col("v"))).collect()] == [payload.encode(v) for v in values]
    spelt = [payload.encode(v) for v in values] + ["\\u{1F600}x\\u{0}"]
    rows = spark.createDataFrame([(v,) for v in spelt], "v string").select(payload.decoded(F.col("v")), payload.well_formed(F.col("v"))).collect()
    assert [tuple(r) for r in rows] == [(payload.decode(v)[0], True) for v in spelt]
    for bad in ("\\", "\\q", "\\u{}", "\\u{D800}", "\\u{110000}", "a\nb", "\\u{0000041}"):
        assert not spark.createDataFrame([(bad,)], "v string").select(payload.well_formed(F.col("v"))).head()[0], bad
    numbers = [0, 1, 127, 128, 300, 16383, 16384, 2**31, 2**62]
    got = spark.createDataFrame([(n,) for n in numbers], "n long").select(binary.uleb_hex(F.col("n"))).collect()
    assert [r[0] for r in got] == [binary.uleb(n).hex() for n in numbers]
    records = [{"path": "$.a", "kind": "ObjectNode"}, {"header": "$.b", "kind": "StringLiteral", "value": "é" * 100, "identity": "i"}]
    rows = shape.events_from_records(spark, [("s", records)]).orderBy("ordinal").select(binary.plain_record_hex()).collect()
    assert [r[0] for r in rows] == [(binary.uleb(len(binary.write_record(x))) + binary.write_record(x)).hex() for x in records]


def test_descriptors():
    d = datatypes.parse(' a < b [ "x\\n" ] , c > [ +1.5 ] ', Limits(max_clarifier_values=2))
    assert datatypes.spell(d) == 'a<b["x\\n"], c>[+1.5]'
    assert [(n["name"], n["parent"], n["level"], n["n_generics"]) for n in datatypes.nodes(d)] == [("a", -1, 0, 2), ("b", 0, 1, 0), ("c", 0, 1, 0)]
    for bad in ("", "1a", "a<", "a<>", "a[]", "a<b", "a[x]", 'a["', "a b", "a<b>>", "a<1>", 'a["\\ud800"]'):
        with pytest.raises(datatypes.DescriptorError) as e:
            datatypes.parse(bad)
        assert e.value.code == "TELEX_INVALID_DATATYPE", bad


def test_limits_are_checked():
    assert Limits.of(max_depth=3, max_items=9) == Limits(max_generic_depth=3, max_datatype_components=9)
    for bad in (-1, 2**53, 1.5, True):
        with pytest.raises(ValueError):
            Limits(max_events=bad)


def test_lines_find_what_the_decoder_finds(spark):
    from strandline.operators import text_lines

    r = random.Random(12)
    pieces = ["profile=a", "projection=b", "profile=", "", "", "path=$.a", "kind=x", "kind=\\u{41}", "value=\\q", "value=a\tb", "Bad=1", "nofield", "=x", "value=\\u{D800}", "value=\\", "value=\\u{4", "value=\\u{}", "x.a=1", "\r"]
    rows = [(f"s{i}", "\n".join(["telex.aes=1" if r.random() < 0.95 else "no", *(r.choice(pieces) for _ in range(r.randrange(8)))]) + r.choice(["\n", "", "\r\n"])) for i in range(400)]
    rows += [("bom", "﻿telex.aes=1\n"), ("null", None), ("long", HEAD + "\nvalue=" + "x" * 200 + "\n")]
    limits = Limits(max_line_bytes=100, max_fields_per_event=4, max_decoded_payload_bytes=40)
    texts = spark.createDataFrame(rows, "stream_id string, text string")
    got = {x.stream_id: (x.code, x.line) for x in text_lines.first_errors(texts, limits).collect()}
    want = {x.stream_id: (x.code, x.line) for x in text.errors_of(text.decode(texts, limits)).collect()}
    assert got == want
