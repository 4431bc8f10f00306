"""The text format: a version line, optional stream fields, and stanzas of ``field=payload`` lines.

Decoding one stream is sequential and stops at the first error, so a stream is the
unit of work: one row of text (or one file) each, many in parallel. Encoding is an
expression over event rows and an ordered aggregation by stream; ``pieces`` leaves out the
aggregation, for streams whose text is too long for one value.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline import schema, wire
from strandline.config import Limits
from strandline.functions import datatypes, payload
from strandline.operators import ordered
from strandline.operators.shape import event_row

_FIELD = re.compile(wire.FIELD_NAME)
_STREAM_FIELDS = ("profile", "projection")


@dataclass
class TextError(Exception):
    code: str
    line: int | None = None
    counter: str | None = None
    observed: int | None = None
    limit: int | None = None


@dataclass
class Stream:
    profile: str = wire.COMPLETE_PROFILE
    profile_explicit: bool = False
    projection: str | None = None
    projection_explicit: bool = False
    records: list[dict] = field(default_factory=list)
    canonical: bool = True


class _Meter:
    """Holds limits and counts the payload bytes decoded so far."""

    def __init__(self, limits: Limits):
        self.limits, self.decoded = limits, 0

    def within(self, counter: str, observed: int, line: int | None = None) -> None:
        limit = getattr(self.limits, counter)
        if observed > limit:
            raise TextError("TELEX_LIMIT_EXCEEDED", line, counter, observed, limit)

    def value(self, text: str, line: int) -> tuple[str, bool]:
        try:
            value, canonical = payload.decode(text)
        except payload.PayloadError as e:
            raise TextError(e.code, line) from None
        self.decoded += len(value.encode("utf-8"))
        self.within("max_decoded_payload_bytes", self.decoded, line)
        return value, canonical


def parse(text: str, limits: Limits = Limits()) -> Stream:
    """The stream that ``text`` holds, or TextError."""
    meter = _Meter(limits)
    _physical(text, meter)
    if text.startswith("﻿"):
        raise TextError("TELEX_BOM", 1)
    if re.search(r"\r(?!\n)", text):
        raise TextError("TELEX_BARE_CR")
    out = Stream(canonical="\r\n" not in text and text.endswith("\n"))
    lines = text.replace("\r\n", "\n").split("\n")
    if lines[-1] == "":
        lines.pop()
    if not lines or lines[0] != wire.TEXT_VERSION_LINE:
        raise TextError("TELEX_INVALID_PREAMBLE", 1)
    at = _stream_fields(lines, out, meter)
    if at == len(lines):
        return out
    if lines[at] != "":
        raise TextError("TELEX_MISSING_HEADER_SEPARATOR", at + 1)
    blanks = 0
    stanza: list[tuple[int, str]] = []
    for number, line in enumerate(lines[at:], at + 1):
        if line:
            out.canonical &= bool(stanza) or blanks == 1
            blanks = 0
            stanza.append((number, _checked(line, number, stanza, meter)))
        else:
            blanks += 1
            if stanza:
                _close(stanza, number, out, meter)
                stanza = []
    if stanza:
        _close(stanza, len(lines), out, meter)
    out.canonical &= blanks == 0
    return out


def _physical(text: str, meter: _Meter) -> None:
    meter.within("max_input_bytes", len(text.encode("utf-8", "surrogatepass")))
    for number, line in enumerate(text.split("\n"), 1):
        meter.within("max_line_bytes", len(line.removesuffix("\r").encode("utf-8", "surrogatepass")), number)


def _stream_fields(lines: list[str], out: Stream, meter: _Meter) -> int:
    """Read the leading stream fields; the number of the line after them."""
    order = []
    for at, line in enumerate(lines[1:], 1):
        name, equals, text = line.partition("=")
        if not equals or name not in _STREAM_FIELDS:
            break
        value, canonical = meter.value(text, at + 1)
        if not value:
            raise TextError(f"TELEX_EMPTY_{name.upper()}", at + 1)
        if getattr(out, f"{name}_explicit"):
            raise TextError("TELEX_DUPLICATE_STREAM_FIELD", at + 1)
        setattr(out, name, value)
        setattr(out, f"{name}_explicit", True)
        order.append(name)
        out.canonical &= canonical and order == sorted(order)
    else:
        at = len(lines)
    return at


@dataclass
class _Line:
    name: str
    value: str
    canonical: bool


def _checked(line: str, number: int, stanza: list, meter: _Meter) -> _Line:
    name, equals, text = line.partition("=")
    if not equals or not name:
        raise TextError("TELEX_INVALID_FIELD_LINE", number)
    if not _FIELD.fullmatch(name):
        raise TextError("TELEX_INVALID_FIELD_NAME", number)
    if any(x.name == name for _, x in stanza):
        raise TextError("TELEX_DUPLICATE_FIELD", number)
    meter.within("max_fields_per_event", len(stanza) + 1, number)
    return _Line(name, *meter.value(text, number))


def _close(stanza: list[tuple[int, _Line]], number: int, out: Stream, meter: _Meter) -> None:
    """Make a record of the lines of a stanza."""
    meter.within("max_events", len(out.records) + 1, number)
    by_name = {x.name: (n, x.value) for n, x in stanza}
    record = {name: value for name, (_, value) in by_name.items()}
    logical = [(n, x) for n, x in stanza if x.name in ("datatype", "generics", "clarifiers")]
    for n, x in logical:
        if x.name != "datatype":
            raise TextError("TELEX_INVALID_DATATYPE", next(m for m, y in logical if y.name != "datatype"))
        try:
            descriptor = datatypes.parse(x.value, meter.limits)
        except datatypes.DescriptorError as e:
            raise TextError(e.code, n, e.counter, e.observed, e.limit) from None
        out.canonical &= datatypes.spell(descriptor) == x.value
        record |= descriptor
    names = [x.name for _, x in stanza]
    out.canonical &= all(x.canonical for _, x in stanza) and names == sorted(names, key=field_rank)
    out.records.append(record)


def field_rank(name: str) -> tuple:
    """Core fields in their order, then all others by name."""
    return (0, wire.TEXT_FIELD_ORDER.index(name), "") if name in wire.TEXT_FIELD_ORDER else (1, 0, name)


# -- as tables -------------------------------------------------------------------

_PARSED = f"stream_id string, context struct<profile:string,profile_explicit:boolean,projection:string,projection_explicit:boolean,canonical:boolean>, events array<struct<{','.join(f'{f.name}:{f.dataType.simpleString()}' for f in schema.EVENTS.fields[1:])}>>, error struct<code:string,line:bigint,counter:string,observed:bigint,lim:bigint>"


def decode(texts: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(stream_id, context, events, error) of rows (stream_id, text): context and events, or the first error.

    Persist it: streams, events and errors are three views of the same decoding.
    """
    names = [f.name for f in schema.EVENTS.fields[1:]]

    def run(batches):
        arrow = None
        for batch in batches:
            rows = []
            for stream_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows.append(_decoded(stream_id, text or "", limits, names))
            arrow = arrow or _arrow_schema()
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return texts.select("stream_id", "text").mapInArrow(run, _PARSED)


def _arrow_schema() -> pa.Schema:
    text, number, flag = pa.string(), pa.int64(), pa.bool_()
    ext = pa.list_(pa.struct([("name", text), ("value", text)]))
    event = pa.struct([(f.name, number if f.name == "ordinal" else ext if f.name == "ext" else text) for f in schema.EVENTS.fields[1:]])
    context = pa.struct([("profile", text), ("profile_explicit", flag), ("projection", text), ("projection_explicit", flag), ("canonical", flag)])
    error = pa.struct([("code", text), ("line", number), ("counter", text), ("observed", number), ("lim", number)])
    return pa.schema([("stream_id", text), ("context", context), ("events", pa.list_(event)), ("error", error)])


def _decoded(stream_id: str, text: str, limits: Limits, names: list[str]) -> dict:
    try:
        s = parse(text, limits)
    except TextError as e:
        return {"stream_id": stream_id, "context": None, "events": [], "error": {"code": e.code, "line": e.line, "counter": e.counter, "observed": e.observed, "lim": e.limit}}
    context = {k: getattr(s, k) for k in ("profile", "profile_explicit", "projection", "projection_explicit", "canonical")}
    events = []
    for i, record in enumerate(s.records):
        row = dict(zip(names, event_row(stream_id, i, record)[1:], strict=True))
        events.append(row | {"ext": [{"name": k, "value": v} for k, v in row["ext"]]})
    return {"stream_id": stream_id, "context": context, "events": events, "error": None}


def streams_of(decoded: DataFrame) -> DataFrame:
    return decoded.where("error is null").select("stream_id", "context.*").select(*schema.STREAMS.fieldNames())


def events_of(decoded: DataFrame) -> DataFrame:
    return decoded.select("stream_id", F.explode("events").alias("e")).select("stream_id", "e.*").select(*schema.EVENTS.fieldNames())


def errors_of(decoded: DataFrame) -> DataFrame:
    return decoded.where("error is not null").select("stream_id", "error.*")


def read(spark: SparkSession, path: str, limits: Limits = Limits()) -> DataFrame:
    """Decoded streams, one per file; the stream id is the file's path.

    ``spark.read.text`` in whole-file mode, so any store that Spark reads will do.
    """
    files = spark.read.text(path, wholetext=True)
    return decode(files.select(F.col("_metadata.file_path").alias("stream_id"), F.col("value").alias("text")), limits)


def wire_datatype(nested: bool = True) -> Column:
    parts = [F.col(c) for c in ("datatype", "generics", "clarifiers")]
    return datatypes.spelling(*parts) if nested else F.col("datatype")


def stanza(nested: bool = True) -> Column:
    """The lines of one event: core fields in order, extensions by name."""
    value = lambda name: wire_datatype(nested) if name == "datatype" else F.col(name)
    core = F.array(*(F.concat(F.lit(f"{name}="), payload.encoded(value(name))) for name in wire.TEXT_FIELD_ORDER))
    more = F.transform(F.array_sort(F.coalesce("ext", F.array().cast("array<struct<name:string,value:string>>"))), lambda e: F.concat(e["name"], F.lit("="), payload.encoded(e["value"])))
    return F.array_join(F.concat(core, more), "\n")


def _head() -> Column:
    """The version line and the explicit stream fields, from a row of STREAMS."""
    return F.concat(
        F.lit(wire.TEXT_VERSION_LINE),
        *(F.when(F.col(f"{f}_explicit"), F.concat(F.lit(f"\n{f}="), payload.encoded(F.col(f)))).otherwise(F.lit("")) for f in _STREAM_FIELDS),
    )


def encode(events: DataFrame, streams: DataFrame, limits: Limits = Limits(), nested: bool = True) -> DataFrame:
    """(stream_id, text, error): the canonical text, or the limit that stands against it.

    Streams without events are a header only. Semantic errors do not stop encoding. A text is
    one value here; ``pieces`` has texts of any length.
    """
    each = events.select("stream_id", F.struct("ordinal", stanza(nested).alias("s")).alias("r"))
    met = each.groupBy("stream_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["s"]), "\n\n").alias("body"), F.count("*").alias("n"))
    text = F.concat(_head(), F.when(F.col("body").isNull(), F.lit("")).otherwise(F.concat(F.lit("\n\n"), F.col("body"))), F.lit("\n"))
    whole = streams.join(met, "stream_id", "left").select("stream_id", text.alias("text"), F.col("n"))
    long = F.exists(F.split("text", "\n"), lambda x: F.octet_length(x) > limits.max_line_bytes)
    error = F.when(F.col("n") > limits.max_events, "max_events").when(F.octet_length("text") > limits.max_input_bytes, "max_input_bytes").when(long, "max_line_bytes")
    return whole.select("stream_id", error.alias("error"), "text").select("stream_id", F.when(F.col("error").isNull(), F.col("text")).alias("text"), "error")


def pieces(events: DataFrame, streams: DataFrame, nested: bool = True) -> DataFrame:
    """(stream_id, part, ordinal, text): the texts that ``encode`` gives, in pieces, in no order.

    Part 0 is the header, 1 each event after its separator, 2 the end of the last line; joined
    in the order of (part, ordinal, text) they are the stream's text. ``ordered.by_stream``
    puts them in that order without holding a stream.
    """
    own = events.join(streams.select("stream_id"), "stream_id", "left_semi")
    none = F.lit(None).cast("long")
    body = own.select("stream_id", F.lit(1).alias("part"), "ordinal", F.concat(F.lit("\n\n"), stanza(nested)).alias("text"))
    head = streams.select("stream_id", F.lit(0).alias("part"), none.alias("ordinal"), _head().alias("text"))
    end = streams.select("stream_id", F.lit(2).alias("part"), none.alias("ordinal"), F.lit("\n").alias("text"))
    return head.unionByName(body).unionByName(end)


def long_line(limits: Limits) -> Column:
    """Whether a piece has a line beyond the limit; no line goes on from one piece of ``pieces`` to the next."""
    lines = F.exists(F.split("text", "\n"), lambda x: F.octet_length(x) > limits.max_line_bytes)
    return F.when(F.octet_length("text") > limits.max_line_bytes, lines).otherwise(F.lit(False))


def over_limits(n: Column, size: Column, long: Column, limits: Limits) -> Column:
    """The error of ``encode`` for ``n`` pieces of ``size`` bytes."""
    return F.when(n - 2 > limits.max_events, "max_events").when(size > limits.max_input_bytes, "max_input_bytes").when(long, "max_line_bytes")


def encode_digests(events: DataFrame, streams: DataFrame, limits: Limits = Limits(), nested: bool = True, algorithm: str = "md5") -> DataFrame:
    """(stream_id, digest, error) of the texts that ``encode`` gives, of any length."""
    marked = pieces(events, streams, nested).withColumn("flag", long_line(limits))
    found = ordered.hashed(ordered.by_stream(marked, "part", "ordinal", "text"), algorithm)
    error = over_limits(F.col("pieces"), F.col("bytes"), F.col("flagged"), limits)
    return found.select("stream_id", F.when(error.isNull(), F.col("digest")).alias("digest"), error.alias("error"))


def canonicalize(texts: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(stream_id, text, code): the canonical text of rows (stream_id, text), or the code of the first error."""

    def run(batches):
        for batch in batches:
            out = [_canonical(t or "", limits) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in out], pa.string()), pa.array([c for _, c in out], pa.string())], names=["stream_id", "text", "code"])

    return texts.select("stream_id", "text").mapInArrow(run, "stream_id string, text string, code string")


def _canonical(text: str, limits: Limits) -> tuple[str | None, str | None]:
    try:
        return spell(parse(text, limits)), None
    except TextError as e:
        return None, e.code


def spell(stream: Stream) -> str:
    """The canonical text of one parsed stream, driver-side or in a worker."""
    head = [wire.TEXT_VERSION_LINE, *(f"{f}={payload.encode(getattr(stream, f))}" for f in _STREAM_FIELDS if getattr(stream, f"{f}_explicit"))]
    blocks = ["\n".join(head)]
    for record in stream.records:
        flat = {k: v for k, v in record.items() if k not in ("generics", "clarifiers")}
        if "datatype" in record:
            flat["datatype"] = datatypes.spell(record)
        blocks.append("\n".join(f"{k}={payload.encode(flat[k])}" for k in sorted(flat, key=field_rank)))
    return "\n\n".join(blocks) + "\n"


def to_json(events: DataFrame) -> DataFrame:
    """(stream_id, ordinal, json): each event as a portable JSON object without absent fields."""
    return events.select("stream_id", "ordinal", F.to_json(F.struct(*schema.EVENTS.fieldNames()[2:])).alias("json"))


def from_json(rows: DataFrame) -> DataFrame:
    fields = json.dumps({"type": "struct", "fields": [f.jsonValue() for f in schema.EVENTS.fields[2:]]})
    parsed = rows.select("stream_id", "ordinal", F.from_json("json", fields).alias("e"))
    none = F.array().cast("array<struct<name:string,value:string>>")
    return parsed.select("stream_id", "ordinal", "e.*").withColumn("ext", F.coalesce("ext", none)).select(*schema.EVENTS.fieldNames())
