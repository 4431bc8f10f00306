"""Chunks of a batch table accepted in one pass: the same verdicts as from the provisional output."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandline import wire
from strandline.config import Limits
from strandline.operators import ordered, validate
from strandline.plans import planted, registry
from strandline.sources import binary_format as binary
from strandline.sources import text_format as text
from strandline.streaming import decoder
from tests.test_formats import HEAD, ONE, random_stream
from tests.test_streaming import SCHEMA, chunk_rows

SF = "/root/testdata/sf0.001"
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def agree(chunks, kind, limits=Limits()):
    want = sorted(map(tuple, decoder.accept_completed(decoder.decode_chunks(chunks, kind, event_limits=limits), limits).collect()))
    got = sorted(map(tuple, decoder.accept_chunks(chunks, kind, event_limits=limits).collect()))
    assert got == want
    return got


def spoilt(rows, r):
    """Chunks of streams, some of them without one, with one twice, with a late one, or without an end."""
    by_stream = {}
    for row in rows:
        by_stream.setdefault(row[0], []).append(row)
    out = []
    for i, (key, own) in enumerate(by_stream.items()):
        own = list(own)
        match i % 8:
            case 1:
                own.pop(r.randrange(len(own)))
            case 2:
                own.append(r.choice(own))
            case 3:
                own.append((key, len(own), bytearray(b"late"), r.random() < 0.5))
            case 4:
                own[-1] = (*own[-1][:3], None)
            case 5:
                own.append((key, -1, bytearray(b""), False))
        out += own
    r.shuffle(out)
    return out


@pytest.mark.parametrize(("held", "rows"), [(1 << 20, 10_000), (300, 7)])
@pytest.mark.parametrize("kind", ["binary", "text"])
def test_agrees(spark, monkeypatch, kind, held, rows):
    """Whatever the batches, the faults and the length of the streams."""
    r = random.Random(held)
    monkeypatch.setattr(decoder, "_HELD", held)
    spell = binary.write if kind == "binary" else lambda s: text.spell(s).encode()
    streams = {f"s{i}": spell(random_stream(i)) for i in range(24)}
    plain = [{"path": "$.a", "kind": "ObjectNode"}, {"path": "$.a.é", "kind": "StringLiteral", "value": "é"}, {"path": "$.a.b", "kind": "NullLiteral", "value": ""}]
    streams |= {f"p{i}": spell(text.Stream(records=plain[: i % 2 * 2 + 1] * (i % 3 + 1))) for i in range(24)}
    streams |= {f"many{i}": spell(text.Stream(records=[{"path": f"$.x{j}", "kind": "NullLiteral", "value": ""} for j in range(40)])) for i in range(8)}
    chunks = spark.createDataFrame(spoilt(list(chunk_rows(streams, 30, kind)), r), SCHEMA).cache()
    before = spark.conf.get(BATCH)
    try:
        spark.conf.set(BATCH, rows)
        found = agree(chunks, kind)
        assert {v for _, _, v, _ in found} == {True, False}
        agree(chunks, kind, Limits(max_events=2))
    finally:
        spark.conf.set(BATCH, before)


TEXTS = [HEAD[:-1], HEAD, HEAD + "\n", ONE, ONE + "\n", ONE[:-1], ONE.replace("\n", "\r\n"), HEAD + "projection=b\nprofile=a\n", HEAD + "profile=\n", HEAD + "x=1\n", HEAD + "\nkind=\\q\n", HEAD + "\nkind=a\nkind=b\n", "", "nope\n", HEAD + "\n\n\nkind=x\n", HEAD.replace(".", "x"), "\ufeff" + ONE, HEAD + "\nvalue=1\n", HEAD + "\nkind=NullLiteral\npath=$.a\nvalue=\n", HEAD + "\npath=$.a\nkind=NullLiteral\n", HEAD + "\npath=$.a\nkind=NullLiteral\nvalue=\x7f\n"]
TEXTS += [HEAD + f"profile={p}\n" + q + "\npath=$.a\nkind=NullLiteral\nvalue=\u2028x\n" for p in (wire.PARTIAL_PROFILE, wire.COMPLETE_PROFILE, "other") for q in ("", f"projection={wire.DOCUMENT_PROJECTION}\n", "projection=other\n")]


@pytest.mark.parametrize("limits", [Limits(), Limits(max_fields_per_event=2, max_path_depth=0), Limits(max_line_bytes=14), Limits(max_input_bytes=40), Limits(max_decoded_payload_bytes=9), Limits(max_events=0)])
def test_texts(spark, limits):
    sources = [t.encode() for t in TEXTS] + [ONE.encode() + b"\n\xff", b"\xff", (HEAD + "\npath=$.a\nkind=NullLiteral\nvalue=").encode() + b"\xed\xa0\x80\n"]
    rows = chunk_rows({f"t{i}": t for i, t in enumerate(sources)}, 17, "text")
    agree(spark.createDataFrame(list(rows), SCHEMA), "text", limits)


def test_planted_faults(spark):
    """Streams with one fault each; none of those with a fault is sound at sight."""
    events, streams = planted.stream_events(spark, SF), planted.stream_contexts(spark, SF).withColumns({"profile_explicit": F.col("profile").isNotNull(), "projection_explicit": F.col("projection").isNotNull()})
    texts = text.encode(events, streams).where("text is not null").select("stream_id", F.lit(0).cast("long").alias("seq"), F.encode("text", "UTF-8").alias("bytes"), F.lit(True).alias("final"))
    found = agree(texts.cache(), "text", planted.STREAM_LIMITS)
    assert {v for _, _, v, _ in found} == {True, False}
    ended = decoder.decode_ended(texts, "text", event_limits=planted.STREAM_LIMITS)
    sound = ended.where(validate.sound_together(F.col("events"), F.col("profile"), F.col("projection"), planted.STREAM_LIMITS)).select("stream_id").collect()
    assert sound and {r.stream_id for r in sound} <= {s for s, _, v, _ in found if v}


SOUND = [
    ([("$.a", "ObjectNode"), ("$.a.b", "ListNode"), ("$.a.b[0]", "TupleLiteral"), ("$.a.b[0][0]", "NullLiteral"), ("$.a.@.x", "NullLiteral"), ("$.r", "PointerReference", "$.a.b[0]")], True),
    ([("$.a", "ObjectNode"), ("$.a", "ObjectNode")], False),
    ([("$.a.b", "NullLiteral")], False),
    ([("$.a", "ListNode"), ("$.a.b", "NullLiteral")], False),
    ([("$.a", "ObjectNode"), ("$.a[0]", "NullLiteral")], False),
    ([("$.a", "NodeLiteral"), ("$.a[0]", "NullLiteral")], False),
    ([("$[0]", "NullLiteral")], False),
    ([("$.@.a", "NullLiteral")], False),
    ([("$.a", "NodeHead", "x")], False),
    ([("$.r", "CloneReference", "$.a")], False),
    ([("$.a", "NullLiteral", "", "i"), ("$.b", "NullLiteral", "", "i")], False),
    ([("$.a", "NullLiteral", "", "i"), ("$.b", "NullLiteral", "", "j")], True),
    ([("$.b.c", "NullLiteral"), ("$.b", "ObjectNode")], True),
]


def test_sound_together(spark):
    """Plain texts, of which the sound ones are sound at sight."""
    names = ("path", "kind", "value", "identity")
    records = [[{k: v for k, v in zip(names, (*e, "") if e[1] == "NullLiteral" and len(e) == 2 else e)} for e in events] for events, _ in SOUND]
    streams = {f"s{i}": text.spell(text.Stream(records=r)).encode() for i, r in enumerate(records)}
    chunks = spark.createDataFrame(list(chunk_rows(streams, 10, "text")), SCHEMA)
    want = {f"s{i}": v for i, (_, v) in enumerate(SOUND)}
    assert {k: v for k, _, v, _ in agree(chunks, "text")} == want
    at_sight = decoder.decode_ended(chunks, "text").select("stream_id", validate.sound_together(F.col("events"), F.col("profile"), F.col("projection"), Limits()).alias("v"))
    assert {r.stream_id: r.v for r in at_sight.collect()} == want


def test_accepted_chunks_without_joins(spark):
    """The planted streams that end are sound, so no event is written or joined."""
    found = registry.QUERIES["accepted_chunks"](spark, SF)
    plan = found._jdf.queryExecution().toString()
    assert "Join" not in plan and "Aggregate" not in plan and found.count() > 0


@pytest.mark.parametrize("most", [1, 150, 10**6])
def test_whole(most):
    """Every row once and in order; no batch with True holds a part of a stream."""
    r = random.Random(most)
    ids = [i for i in range(60) for _ in range(r.choice([1, 1, 2, 9, 30]))]
    table = pa.table({"stream_id": [f"s{i:02}" if i else None for i in ids], "n": list(range(len(ids)))})
    for size in (1, 5, 10**4):
        found = list(ordered.whole(iter(table.to_batches(max_chunksize=size)), most))
        assert [n for b, _ in found for n in b["n"].to_pylist()] == list(range(len(ids)))
        own = [(set(b["stream_id"].to_pylist()), w) for b, w in found]
        assert all(w or len(s) == 1 for s, w in own)
        assert all(a.isdisjoint(b) or not (w or v) for i, (a, w) in enumerate(own) for b, v in own[i + 1 :])
        if most == 10**6:
            assert all(w for _, w in own)
