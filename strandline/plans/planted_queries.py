"""Queries over the planted streams: what each planted property must give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline import wire
from strandline.config import Limits
from strandline.functions import paths
from strandline.operators import completeness, integrity, provenance, shape, validate
from strandline.plans import generated, planted, planted_sql
from strandline.sources import binary_format, delta, text_format
from strandline.storage import materialize
from strandline.streaming import decoder

QUERIES = {}
ORACLES = planted_sql.ORACLES


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def event_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every finding of single events, with small limits."""
    projection = F.when(F.col("ordinal") % 2 == 0, planted.DOC)
    rows = shape.addressed(planted.events(spark, sf_dir)).withColumn("projection", projection)
    return validate.event_diagnostics(rows, planted.EVENT_LIMITS, planted.REGISTERED).select("record", "code", "field", "counter", "observed", "lim")


def _stream_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.validate(planted.stream_events(spark, sf_dir), planted.stream_contexts(spark, sf_dir), planted.STREAM_LIMITS)


@query
def stream_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts, both planes, root children, tuples, node heads, identities, references, order and limits."""
    return _stream_diagnostics(spark, sf_dir).select("stream_id", "record", "code", "required_path", "first_record", "counter", "observed")


@query
def text_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors, limits and canonical flags of texts."""
    found = text_format.decode(planted.texts(spark, sf_dir), planted.TEXT_LIMITS)
    return found.select("stream_id", F.col("error.code").alias("code"), F.col("error.line").alias("line"), F.col("error.counter").alias("counter"), F.col("context.canonical").alias("canonical"), F.size("events").alias("events"))


@query
def text_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_format.canonicalize(planted.texts(spark, sf_dir), planted.TEXT_LIMITS)


@query
def encode_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = text_format.encode(planted.stream_events(spark, sf_dir), planted.stream_contexts(spark, sf_dir), Limits(max_events=4, max_line_bytes=23))
    return found.select("stream_id", "error")


@query
def text_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From texts to the prefixes that they lack."""
    cases = ["telex.aes=1\n\npath=$.a{k}.b[0]\nkind=NullLiteral\nvalue=\n", "telex.aes=1\n\npath=$.a\nkind=ObjectNode\n\npath=$.a.@.k{k}\nkind=NullLiteral\nvalue=\n"]
    events = text_format.events_of(text_format.decode(planted.texts(spark, sf_dir, cases)))
    return completeness.missing_prefixes(materialize(events, "events"))


# -- integrity and provenance -----------------------------------------------------


def _digests(spark: SparkSession, sf_dir: str, ordering: str, scope: str) -> DataFrame:
    events, streams = planted.stream_events(spark, sf_dir), planted.stream_contexts(spark, sf_dir)
    refused = materialize(validate.validate(events, streams, planted.STREAM_LIMITS), "diagnostics")
    return integrity.digests(events, streams, ordering, scope, wire.PROVENANCE_EXCLUDED, refused)


@query
def digest_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical order of the body: streams that validation refuses and those whose order is open have no digest."""
    return _digests(spark, sf_dir, wire.CANONICAL_ORDER, wire.BODY_SCOPE)


@query
def digest_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact order of header and body, which only the document projection admits."""
    return _digests(spark, sf_dir, wire.EXACT_ORDER, wire.DOCUMENT_SCOPE)


@query
def digest_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests against themselves, zeros and an upper-case spelling."""
    found = materialize(_digests(spark, sf_dir, wire.EXACT_ORDER, wire.BODY_SCOPE), "digests")
    k = F.substring("stream_id", 2, 20).cast("long")
    expected = F.when(k % 3 == 0, F.col("digest")).when(k % 3 == 1, F.lit("0" * 64)).otherwise(F.upper("digest"))
    return integrity.verify(found, found.select("stream_id", F.coalesce(expected, F.lit("none")).alias("expected")))


@query
def signature_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = integrity.signature_inputs(_digests(spark, sf_dir, wire.EXACT_ORDER, wire.BODY_SCOPE), "ed25519", "key-1")
    return found.select("stream_id", F.sha2("bytes", 256).alias("h"))


@query
def digest_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams with origins and spans, digested with and without them."""
    events = materialize(generated.sourced_events(spark, sf_dir), "events")
    streams = shape.streams(spark, events)
    of = lambda p, name: integrity.digests(events, streams, wire.EXACT_ORDER, wire.BODY_SCOPE, p, nested=False).select("stream_id", F.col("digest").alias(name))
    return of(wire.PROVENANCE_INCLUDED, "included").join(of(wire.PROVENANCE_EXCLUDED, "excluded"), "stream_id")


@query
def provenance_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = materialize(generated.sourced_events(spark, sf_dir), "events")
    found = provenance.summary(events, shape.streams(spark, events), generated.artifacts(spark, sf_dir).drop("doc_id"), True, True)
    return found.select("stream_id", "valid", "complete", F.size("verified_origins").alias("verified"), F.size("missing_origins").alias("missing"))


# -- binary format ------------------------------------------------------------------


def _blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stream_id, bytes) of one record each, broken in the way of its case."""
    key = F.concat(F.lit("$.o"), F.col("k").cast("string"))
    size = F.char_length(key)
    byte = lambda n: F.lpad(F.lower(F.hex(n.cast("long"))), 2, "0")
    path = F.concat(byte(size), F.lower(F.hex(F.encode(key, "UTF-8"))))

    def blob(control: str, kind: str, tail: str = "", more: int = 0, head: str = "4f5f5fff0100", address=path):
        return F.concat(F.lit(head), byte(size + 3 + more), F.lit(control + kind), address, F.lit(tail))

    good = blob("00", "11")
    origin = "0f" * 32
    cases = [
        good,
        blob("00", "11", head="4f5f5fff0200"),
        F.lit("4f5f5f"),
        F.expr("substring(x, 1, length(x) - 2)"),
        blob("20", "11"),
        blob("00", "00"),
        blob("00", "19"),
        F.lit("4f5f5fff010000"),
        F.concat(F.lit("4f5f5fff0100"), F.lit("8500")),
        F.concat(F.lit("4f5f5fff0100"), byte(size + 3), F.lit("0011"), byte(size), F.lit("ff"), F.substring(path, 5, 100)),
        blob("10", "11", "0001", 2),
        blob("18", "11", origin + "0505", 34),
        blob("00", "11", "03" + "792e61" + "00", 5),
        blob("00", "11", ("05" + "782e612e62" + "00") * 2, 14),
        blob("00", "11", "ff", 1),
        blob("00", "11", head="4f5f5fff0104"),
        blob("04", "11", "00", 1),
        blob("18", "11", origin + "0005" + "05" + "782e612e62" + "0131", 34 + 8),
        blob("00", "01", "0131", 2),
        blob("00", "15", "00", 1),
    ]
    spelt = F.element_at(F.array(*cases), (F.col("k") % len(cases) + 1).cast("int"))
    return planted.orders(spark, sf_dir).withColumn("x", good).select(F.col("k").cast("string").alias("stream_id"), F.unhex(spelt).alias("bytes"))


@query
def binary_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Framing errors with their place, and the events of sound records."""
    found = binary_format.decode_provisional(_blobs(spark, sf_dir))
    e = F.try_element_at("events", F.lit(1))
    return found.select("stream_id", *(F.col(f"error.{c}").alias(c) for c in ("code", "offset", "record", "component", "stage")), e["span"].alias("span"), F.size(e["ext"]).alias("extensions"))


@query
def binary_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The validated scan: framing errors, refusals by the event rules and what is accepted."""
    found = binary_format.accepted(materialize(binary_format.decode_provisional(_blobs(spark, sf_dir)), "decoded"))
    return found.select("stream_id", "error", F.array_join("diagnostics", ",").alias("diagnostics"))


@query
def binary_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary_format.to_text(_blobs(spark, sf_dir), registered=("x.a.b",))


@query
def text_to_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = binary_format.from_text(planted.texts(spark, sf_dir))
    return found.select("stream_id", F.lower(F.hex("bytes")).alias("hex"), "error")


# -- streams of chunks ---------------------------------------------------------------


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of two events in three chunks; six in seven with a fault in their sequence or their end."""
    k = F.col("k")
    parts = ["telex.aes=1\n\npath=$.o{k}\nki", "nd=ObjectNode\n\npath=$.o{k}.", "a\nkind=NullLiteral\nvalue=\n"]
    row = lambda i, data, final: F.struct(F.lit(i).cast("long").alias("seq"), F.lit(data).alias("data"), F.lit(final).alias("final"))
    good = [row(0, parts[0], False), row(1, parts[1], False), row(2, parts[2], True)]
    cases = [good, good[:2], [*good, row(3, "", False)], [*good[:2], row(1, "x", False)], [good[0], good[2], good[1]], [row(0, "telex.aes=2\n", False), *good[1:]], [good[0], row(1, "x\n\n\\", True)]]
    chosen = F.element_at(F.array(*(F.array(*c) for c in cases)), (k % len(cases) + 1).cast("int"))
    rows = planted.orders(spark, sf_dir).select("k", F.explode(chosen).alias("c"))
    return rows.select(k.cast("string").alias("stream_id"), "c.seq", F.encode(F.replace(F.col("c.data"), F.lit("{k}"), k.cast("string")), "UTF-8").alias("bytes"), "c.final")


@query
def text_chunk_decoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses and errors of the incremental text decoder."""
    out = decoder.decode_chunks(_chunks(spark, sf_dir), kind="text")
    return out.where("status != 'record'").select("stream_id", "seq", "status", "error")


@query
def accepted_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks between events, once a stream has ended."""
    return decoder.accept_chunks(_chunks(spark, sf_dir), kind="text")


# -- addresses, layouts, JSON ---------------------------------------------------------


@query
def path_building(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical addresses from raw keys."""
    key = F.col("k").cast("string")
    step = lambda kind, name: F.struct(F.lit(kind).alias("kind"), name.alias("key"))
    keys = F.array(step("member", F.concat(F.lit("o"), key)), step("index", key), step("attribute", F.concat(F.lit("é "), key)), step("member", F.concat(key, F.lit('"\\\n\x01/'))))
    return planted.orders(spark, sf_dir).select("k", paths.address(keys).alias("path"), paths.is_event_path(paths.address(keys)).alias("canonical"))


@query
def delta_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block 1 of each stream, read by itself, and the unbroken layout."""
    events = materialize(planted.events(spark, sf_dir).where("(path is null) != (header is null)"), "events")
    blocked = delta.encode(events)
    one = delta.read_block(blocked, "v3", 1).select("stream_id", "ordinal", F.lit("block").alias("layout"), F.coalesce("path", "header").alias("address"))
    whole = delta.decode(delta.encode(events, block=None)).select("stream_id", "ordinal", F.lit("whole").alias("layout"), F.coalesce("path", "header").alias("address"))
    return one.unionByName(whole)


@query
def compact_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accessors of the compact shape: the second address, the number of values, the identity of the first event."""
    found = delta.compact(planted.stream_events(spark, sf_dir))
    first = F.try_element_at("identity", F.lit(0).cast("long"))
    return found.select("stream_id", F.size("kinds").alias("events"), F.when(F.size("kinds") > 1, delta.address_at(F.lit(1))).alias("second"), F.size("value").alias("values"), first.alias("identity"))


@query
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = planted.events(spark, sf_dir)
    back = text_format.from_json(text_format.to_json(events))
    return back.select("ordinal", "path", "header", "kind", "datatype", "generics", "clarifiers", "identity", "value", "origin", "span", F.array_join(F.transform("ext", lambda e: e["name"]), "|").alias("ext"))
