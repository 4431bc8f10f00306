"""Streams in pieces: the same results as from whole values, and plans that hold no stream."""

import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from strandline import wire
from strandline.config import Limits
from strandline.operators import integrity, ordered, shape, text_lines, validate
from strandline.plans import registry
from strandline.sources import delta, files, text_format
from strandline.streaming import decoder

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    """A long stream that needs several batches, a short one, one without events; and events of a stream that isn't listed."""
    own = lambda s, n: [(s, [{"path": f"$.é{i}", "kind": "StringLiteral", "value": f"v\n{i}"} for i in range(n)])]
    events = shape.events_from_records(spark, own("long", 25_000) + own("short", 2) + own("other", 1)).cache()
    streams = spark.createDataFrame([(s, wire.PARTIAL_PROFILE, True, None, False, True) for s in ("long", "short", "none")], "stream_id string, profile string, profile_explicit boolean, projection string, projection_explicit boolean, canonical boolean")
    return events, streams


def whole(tables):
    return {r.stream_id: r.text for r in text_format.encode(*tables, Limits(max_input_bytes=10**9)).collect()}


def test_encode_digests(tables):
    want = {k: hashlib.md5(t.encode()).hexdigest() for k, t in whole(tables).items()}
    assert {r.stream_id: r.digest for r in text_format.encode_digests(*tables).collect()} == want


@pytest.mark.parametrize("limits", [Limits(max_events=2), Limits(max_input_bytes=100), Limits(max_line_bytes=17), Limits(max_events=1, max_line_bytes=1)])
def test_encode_digests_limits(tables, limits):
    want = {r.stream_id: r.error for r in text_format.encode(*tables, limits).collect()}
    found = text_format.encode_digests(*tables, limits).collect()
    assert {r.stream_id: r.error for r in found} == want
    assert all((r.digest is None) == (r.error is not None) for r in found)


def test_digests(tables):
    options = (wire.EXACT_ORDER, wire.BODY_SCOPE, wire.PROVENANCE_EXCLUDED)
    got = {r.stream_id: r.digest for r in integrity.digests(*tables, *options).collect()}
    held = {r.stream_id: r for r in integrity.digests(*tables, *options, with_bytes=True).collect()}
    assert got == {k: hashlib.sha256(r.bytes).hexdigest() for k, r in held.items()} == {k: r.digest for k, r in held.items()}
    assert set(got) == {"long", "short", "none"}


def test_piece_stanzas(tables):
    lines = text_lines.piece_stanzas(text_format.pieces(*tables)).groupBy("stream_id").pivot("part").count().collect()
    want = {}
    for k, t in whole(tables).items():
        body = t.rstrip("\n").split("\n")
        want[k] = (1, 1, body.count("") or None, sum("=" in x for x in body) - 2 or None)
    assert {r.stream_id: (r.version, r.stream, r.blank, r.field) for r in lines} == want


@pytest.mark.parametrize("compression", [None, "gzip"])
def test_piece_files(spark, tables, tmp_path, compression):
    path = str(tmp_path / "t")
    limits = Limits(max_events=10_000)
    refused = files.write_pieces(text_format.pieces(*tables), path, limits, compression)
    assert [tuple(r) for r in refused.collect()] == [("long", "max_events")]
    names = {p.name for p in (tmp_path / "t").iterdir() if not p.name.startswith(".")}
    end = ".gz" if compression else ""
    assert names == {"_SUCCESS", f"s-short.telex{end}", f"s-none.telex{end}"}
    data = (tmp_path / "t" / f"s-short.telex{end}").read_bytes()
    assert (gzip.decompress(data) if compression else data).decode() == whole(tables)["short"]
    found = files.digests(spark, path).select(files.stream_id(F.col("path")).alias("id"), "digest").collect()
    assert {r.id: r.digest for r in found} == {k: hashlib.md5(whole(tables)[k].encode()).hexdigest() for k in ("short", "none")}


def test_decode_pieces(tables):
    events, streams = tables
    pieces = text_format.pieces(events, streams)
    names = events.columns
    got = decoder.decode_pieces(pieces)
    assert got.where("error is not null").isEmpty()
    listed = events.where("stream_id <> 'other'")
    assert got.select(names).exceptAll(listed).isEmpty() and listed.exceptAll(got.select(names)).isEmpty()
    bad = decoder.decode_pieces(pieces, Limits(max_events=2)).where("error is not null").collect()
    assert [(r.stream_id, r.ordinal, r.error) for r in bad] == [("long", None, "TELEX_LIMIT_EXCEEDED")]


@pytest.mark.parametrize("block", [None, 3, 256])
def test_delta_chains(tables, block):
    events, _ = tables
    back = delta.decode(delta.encode(events, block))
    assert back.exceptAll(events).isEmpty() and back.count() == events.count()


def test_hashed_separator(spark):
    rows = spark.createDataFrame([("a", i, f"|{i}", i == 2) for i in range(5)] + [("b", 0, "|", False)], "stream_id string, i int, text string, flag boolean")
    found = {r.stream_id: r for r in ordered.hashed(ordered.by_stream(rows, "i"), "md5", skip=1).collect()}
    assert found["a"].digest == hashlib.md5(b"0|1|2|3|4").hexdigest() and found["a"].flagged and found["a"].pieces == 5
    assert found["b"].digest == hashlib.md5(b"").hexdigest() and not found["b"].flagged


@pytest.mark.parametrize("name", ["encode_text", "digest_exact", "stanza_fields", "stanza_segments", "text_round_trip", "delta_round_trip", "chunk_decoding", "text_chunk_decoding"])
def test_no_stream_is_held(spark, name, capsys):
    """Neither a list of a stream's rows nor a Python call for each of them."""
    registry.QUERIES[name](spark, SF).explain(True)
    shown = capsys.readouterr().out
    operators = shown[shown.index("Physical Plan") :]
    assert not any(x in operators for x in ("FlatMapGroupsInPandas", "FlatMapGroupsInArrow"))
    if name != "chunk_decoding":  # its small streams are encoded as values
        assert "collect_list" not in operators


def test_accepted_chunks_in_one_pass(spark, tables):
    """Batch chunks make no Python call for each stream, and their streams are judged as before."""
    chunks = text_format.pieces(*tables).where("stream_id = 'short'").withColumn("seq", F.when(F.col("part") == 1, F.col("ordinal") + 1).when(F.col("part") == 2, 3).otherwise(0).cast("long"))
    out = decoder.decode_chunks(chunks.select("stream_id", "seq", F.encode("text", "UTF-8").alias("bytes"), (F.col("part") == 2).alias("final")), kind="text")
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().toString()
    events, streams = (t.where("stream_id = 'short'") for t in tables)
    want = validate.verdicts(streams, validate.validate(events, streams)).collect()
    assert decoder.accept_completed(out).collect() == want and len(want) == 1
