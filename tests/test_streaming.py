"""Chunked decoding: every division gives what one shot gives."""

import random
import time

import pytest

from strandline import wire
from strandline.config import BinaryLimits, Limits
from strandline.sources import binary_format as binary
from strandline.sources import text_format as text
from strandline.streaming import decoder
from tests.test_formats import HEAD, ONE, random_stream


def fed(make, data, cuts):
    d, out = make(), []
    parts = [data[a:b] for a, b in zip([0, *cuts], [*cuts, len(data)])]
    for i, p in enumerate(parts):
        out += d.push(p, i == len(parts) - 1)
    assert d.status == "complete"
    return out, d


@pytest.mark.parametrize("seed", range(4))
def test_every_division(seed):
    s = random_stream(seed + 1)
    r = random.Random(seed)
    for make, data in ((decoder.BinaryDecoder, binary.write(s)), (decoder.TextDecoder, text.spell(s).encode())):
        for cuts in [[], list(range(1, len(data))), *([c] for c in range(0, len(data), 7)), *(sorted(r.sample(range(len(data)), min(5, len(data)))) for _ in range(20))]:
            records, _ = fed(make, data, cuts)
            assert records == s.records
    _, d = fed(decoder.TextDecoder, text.spell(s).encode(), [5])
    assert d.stream.canonical and d.stream.profile == s.profile and d.count == len(s.records)


@pytest.mark.parametrize("source", [HEAD[:-1], HEAD + "\n", ONE + "\n", ONE[:-1], ONE.replace("\n", "\r\n"), HEAD + "projection=b\nprofile=a\n", HEAD + "profile=\n", HEAD + "x=1\n", HEAD + "\nkind=\\q\n", HEAD + "\nkind=a\nkind=b\n", "", "nope\n", HEAD + "profile=a\nprofile=b\n", HEAD + "\n\n\nkind=x\n"])
def test_text_decoder_agrees_with_parser(source):
    try:
        want = text.parse(source)
        want = (want.records, want.canonical, want.profile)
    except text.TextError as e:
        want = e.code
    for cut in range(0, len(source) + 1, 3):
        d = decoder.TextDecoder()
        try:
            records = d.push(source.encode()[:cut]) + d.push(source.encode()[cut:], True)
            got = (records, d.stream.canonical, d.stream.profile)
        except text.TextError as e:
            got = e.code
        assert got == want


def test_status_limits_and_closing():
    data = binary.write(text.parse(ONE))
    d = decoder.BinaryDecoder()
    assert d.push(data[:3]) == [] and d.status == "need-more-input"
    assert d.push(data[3:6]) == [] and d.status == "provisional"
    assert len(d.push(data[6:])) == 1 and d.status == "provisional"
    d.push(b"", True)
    with pytest.raises(decoder.Closed):
        d.push(b"")
    d = decoder.BinaryDecoder()
    d.push(data[:-1])
    with pytest.raises(binary.BinaryError) as e:
        d.push(b"", True)
    assert e.value.code == "FILM_TRUNCATED" and d.closed
    with pytest.raises(binary.BinaryError) as e:
        decoder.BinaryDecoder(BinaryLimits(max_buffered_bytes=6)).push(data)
    assert (e.value.code, e.value.detail) == ("FILM_LIMIT_EXCEEDED", "max_buffered_bytes")
    with pytest.raises(binary.BinaryError):
        decoder.BinaryDecoder(BinaryLimits(max_input_bytes=10)).push(data)
    with pytest.raises(text.TextError):
        decoder.TextDecoder(Limits(max_line_bytes=20)).push(b"x" * 30)


def chunk_rows(streams, size, kind):
    for key, data in streams.items():
        n = max(1, -(-len(data) // size))
        for i in range(n):
            yield (key, i, bytearray(data[i * size : (i + 1) * size]), i == n - 1)


SCHEMA = "stream_id string, seq long, bytes binary, final boolean"


def test_batch_chunks(spark):
    streams = {f"s{i}": random_stream(i) for i in range(10)}
    rows = list(chunk_rows({k: binary.write(s) for k, s in streams.items()}, 11, "binary"))
    random.Random(1).shuffle(rows)
    out = decoder.decode_chunks(spark.createDataFrame(rows, SCHEMA)).cache()
    events = decoder.events_from_output(out)
    counts = {r.stream_id: r["count"] for r in events.groupBy("stream_id").count().collect()}
    assert counts == {k: len(s.records) for k, s in streams.items() if s.records}
    verdicts = {r.stream_id: r.valid for r in decoder.accept_completed(out, registered=("x.own.a", "x.own.b")).collect()}
    assert set(verdicts) == set(streams) and any(verdicts.values())


def test_repeated_and_late_chunks(spark):
    data = binary.write(text.parse(ONE))
    rows = [("again", 0, bytearray(data[:9]), False), ("again", 0, bytearray(data[:9]), False), ("late", 0, bytearray(data), True), ("late", 1, bytearray(b"x"), False), ("gap", 1, bytearray(b"x"), True), ("bad", 0, bytearray(b"XXXXXX"), False), ("bad", 1, bytearray(b"x"), True)]
    out = decoder.decode_chunks(spark.createDataFrame(rows, SCHEMA)).collect()
    errors = {(r.stream_id, r.seq, r.error) for r in out if r.status == "error"}
    assert errors == {("again", 0, "CHUNK_REPEATED"), ("late", 1, "TELEX_DECODER_CLOSED"), ("bad", 0, "FILM_INVALID_PREAMBLE"), ("bad", 1, "TELEX_DECODER_CLOSED")}
    assert not [r for r in out if r.stream_id == "gap"]


def test_structured_streaming(spark, tmp_path):
    streams = {f"s{i}": random_stream(i) for i in range(4)}
    rows = list(chunk_rows({k: text.spell(s).encode() for k, s in streams.items()}, 40, "text"))
    rows.sort(key=lambda r: -r[1])  # the worst order: the last chunks first
    source = tmp_path / "in"
    third = -(-len(rows) // 3)
    for i in range(3):
        spark.createDataFrame(rows[i * third : (i + 1) * third], SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
        time.sleep(0.01)
    chunks = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source))
    out = decoder.decode_chunks(chunks, "text")
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = spark.read.parquet(str(tmp_path / "out")).cache()
    assert got.where("status = 'error'").count() == 0
    assert {r.stream_id for r in got.where("status = 'complete'").collect()} == set(streams)
    counts = {r.stream_id: r["count"] for r in decoder.events_from_output(got).groupBy("stream_id").count().collect()}
    assert counts == {k: len(s.records) for k, s in streams.items() if s.records}
    assert decoder.contexts_from_output(got).where(f"profile = '{wire.PARTIAL_PROFILE}'").count() == 4


def test_many_records_in_one_push():
    s = text.Stream(records=[{"path": f"$.a{i}", "kind": "StringLiteral", "value": "x" * 20} for i in range(50_000)])
    data = binary.write(s)
    began = time.time()
    d = decoder.BinaryDecoder()
    assert len(d.push(data, True)) == 50_000 and d.status == "complete"
    assert time.time() - began < 20


def test_contiguous_chunks(spark):
    data = binary.write(text.parse(ONE))
    rows = [("gap", 0, bytearray(data[:9]), False), ("gap", 2, bytearray(b""), True), ("whole", 0, bytearray(data[:9]), False), ("whole", 1, bytearray(data[9:]), True)]
    out = decoder.decode_chunks(spark.createDataFrame(rows, SCHEMA), contiguous=True).collect()
    assert {(r.stream_id, r.seq, r.error) for r in out if r.status == "error"} == {("gap", 2, "CHUNK_ORDER")}
    assert [r.stream_id for r in out if r.status == "complete"] == ["whole"]


def test_ended_streams_leave_a_mark(spark, tmp_path):
    data = binary.write(text.parse(ONE))
    batches = [[("a", 0, bytearray(data), True), ("b", 0, bytearray(data[:9]), False)], [("a", 1, bytearray(b"x"), False), ("b", 1, bytearray(data[9:]), True)]]
    source = tmp_path / "in"
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
        time.sleep(0.01)
    chunks = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source))
    out = decoder.decode_chunks(chunks, forget_after=8)
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(processingTime="1 second").start()
    held, end = [], time.time() + 120
    while time.time() < end and not (2 in held and held[-1] == 0):
        time.sleep(0.5)
        held += [p["stateOperators"][0]["numRowsTotal"] for p in (q.lastProgress,) if p and p["stateOperators"]]
    q.stop()
    assert 2 in held and held[-1] == 0
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {r.stream_id for r in got if r.status == "complete"} == {"a", "b"}
    assert {(r.stream_id, r.seq, r.error) for r in got if r.status == "error"} == {("a", 1, "TELEX_DECODER_CLOSED")}
