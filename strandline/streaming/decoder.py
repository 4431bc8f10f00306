"""Streams that arrive in chunks: stateful decoding with Structured Streaming.

Chunks are rows (stream_id, seq, bytes, final). State per stream is the undecoded rest,
the stream context, and the next sequence number. Sources promise no order, so chunks
that come early wait in state, up to ``max_buffered_bytes``, or are refused; a chunk that comes again
or after the end is an error row. Records come out as they complete, provisionally:
only the ``complete`` row of a stream, written after its final chunk, says that its
events may be validated and acted on (``accept_completed``).
A batch table of chunks needs no provisional output (``accept_chunks``).
"""

from __future__ import annotations

import json
import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline import schema, wire
from strandline.config import BinaryLimits, Limits
from strandline.operators import ordered, validate
from strandline.operators.shape import event_row
from strandline.sources import binary_format as binary
from strandline.sources import text_format as text
from strandline.storage import materialize

OUTPUT = "stream_id string, seq long, status string, ordinal long, event string, error string, offset long"


class Closed(Exception):
    """Input after the end or after an error."""


@dataclass
class BinaryDecoder:
    """Feeds on bytes, yields records; the same results however the bytes are divided."""

    limits: BinaryLimits = BinaryLimits()
    event_limits: Limits = Limits()
    rest: bytes = b""
    #: How much of ``rest`` is read; cut off once a push, so that a record costs its own bytes only.
    at: int = 0
    offset: int = 0
    total: int = 0
    count: int = 0
    context: text.Stream | None = None
    pending: int | None = None
    closed: bool = False

    def push(self, data: bytes, final: bool = False) -> list[dict]:
        if self.closed:
            raise Closed
        try:
            self.total += len(data)
            if self.total > self.limits.max_input_bytes:
                raise binary.BinaryError("FILM_LIMIT_EXCEEDED", self.total, None, "stream", detail="max_input_bytes")
            out: list[dict] = []
            # slices of at most the room that is left keep what is held bounded
            while True:
                room = self.limits.max_buffered_bytes - len(self.rest)
                if data and not room:
                    self._full()
                self.rest, data = self.rest + data[:room], data[room:]
                out += self._drain(final and not data)
                if not data:
                    break
            self.closed = final
            return out
        except binary.BinaryError:
            self.closed = True
            raise

    @property
    def status(self) -> str:
        if self.closed:
            return "complete"
        return "provisional" if self.context and self.pending is None and not self.rest else "need-more-input"

    def _full(self) -> None:
        known = self.context is not None
        raise binary.BinaryError("FILM_LIMIT_EXCEEDED", self.offset, self.count if known else None, "record" if known else "stream-context", detail="max_buffered_bytes")

    def _eat(self, n: int) -> bytes:
        taken = self.rest[self.at : self.at + n]
        self.at += n
        self.offset += n
        return taken

    @property
    def _left(self) -> int:
        return len(self.rest) - self.at

    def _attempt(self, read, final: bool):
        """Run ``read`` on the rest; nothing if it needs more and more may come."""
        c = binary.Cursor(self.rest, self.offset - self.at, self.count if self.context else None, self.limits)
        c.at = self.at
        try:
            found = read(c)
        except binary.BinaryError as e:
            if e.code == "FILM_TRUNCATED" and not final:
                return None
            raise
        self._eat(c.at - self.at)
        return found

    def _drain(self, final: bool) -> list[dict]:
        out = self._records(final)
        self.rest, self.at = self.rest[self.at :], 0
        return out

    def _records(self, final: bool) -> list[dict]:
        out: list[dict] = []
        if self.context is None:
            if not binary.check_preamble(self.rest, final):
                return out

            def opening(c: binary.Cursor) -> text.Stream:
                c.at = len(wire.BINARY_PREAMBLE)
                return binary.read_context(c)

            self.context = self._attempt(opening, final)
            if self.context is None:
                return out
        while self._left or self.pending is not None:
            if self.pending is None:
                out += self._plain()
                if not self._left:
                    break
                self.pending = self._attempt(lambda c: binary.record_length(c, self.count, self.event_limits), final)
                if self.pending is None:
                    break
            if self._left < self.pending:
                if final:
                    raise binary.BinaryError("FILM_TRUNCATED", self.offset + self._left, self.count, "record")
                break
            start = self.offset
            out.append(binary.read_record(self._eat(self.pending), start, self.count, self.limits, self.event_limits))
            self.pending = None
            self.count += 1
        return out


    def _plain(self) -> list[dict]:
        """The plain records that come next and are all there."""
        rows = binary.Rows()
        at, self.count = binary.plain(self.rest, self.at, len(self.rest), rows, self.count, self.limits, self.event_limits)
        self._eat(at - self.at)
        names = ("path", "header", "kind", "identity", "value")
        found = zip(*(getattr(rows, n) for n in names), strict=True)
        return [{n: v for n, v in zip(names, r, strict=True) if v is not None} for r in found]


@dataclass
class TextDecoder:
    """Feeds on bytes of the text format, yields records as their stanzas close."""

    limits: Limits = Limits()
    rest: bytes = b""
    total: int = 0
    line: int = 0
    blanks: int = 0
    at_header: bool = True
    names: list[str] = field(default_factory=list)
    stanza: list = field(default_factory=list)
    stream: text.Stream = field(default_factory=text.Stream)
    decoded: int = 0
    count: int = 0
    closed: bool = False
    crlf: bool = False
    open_end: bool = False

    def push(self, data: bytes, final: bool = False) -> list[dict]:
        if self.closed:
            raise Closed
        meter = text._Meter(self.limits)
        meter.decoded = self.decoded
        try:
            self.total += len(data)
            meter.within("max_input_bytes", self.total)
            *lines, self.rest = (self.rest + data).split(b"\n")
            out: list[dict] = []
            for raw in lines:
                out += self._line(raw, meter)
            if len(self.rest) > self.limits.max_line_bytes + 1:
                meter.within("max_line_bytes", len(self.rest), self.line + 1)
            if final:
                out += self._end(meter)
            self.decoded = meter.decoded
            return out
        except text.TextError:
            self.closed = True
            raise

    @property
    def status(self) -> str:
        if self.closed:
            return "complete"
        return "need-more-input" if self.rest or self.stanza or not self.line else "provisional"

    def _line(self, raw: bytes, meter: text._Meter) -> list[dict]:
        self.line += 1
        ended = raw.endswith(b"\r")
        self.crlf |= ended
        body = raw[: len(raw) - ended]
        meter.within("max_line_bytes", len(body), self.line)
        if self.line == 1 and body.startswith(b"\xef\xbb\xbf"):
            raise text.TextError("TELEX_BOM", 1)
        if b"\r" in body:
            raise text.TextError("TELEX_BARE_CR")
        try:
            line = body.decode("utf-8")
        except UnicodeDecodeError:
            raise text.TextError("TELEX_INVALID_UNICODE_SCALAR", self.line) from None
        if self.line == 1:
            if line != wire.TEXT_VERSION_LINE:
                raise text.TextError("TELEX_INVALID_PREAMBLE", 1)
            return []
        if self.at_header and line:
            return self._header(line, meter)
        self.at_header = False
        if line:
            self.stream.canonical &= bool(self.stanza) or self.blanks == 1
            self.blanks = 0
            self.stanza.append((self.line, text._checked(line, self.line, self.stanza, meter)))
            return []
        self.blanks += 1
        return self._closed(self.line, meter)

    def _header(self, line: str, meter: text._Meter) -> list[dict]:
        # the leading stream fields are one unit: read them again with the new line
        probe = [wire.TEXT_VERSION_LINE, *self.names, line]
        before = meter.decoded
        meter.decoded = 0
        fresh = text.Stream()
        at = text._stream_fields(probe, fresh, meter)
        meter.decoded = max(before, meter.decoded)
        if at < len(probe):
            raise text.TextError("TELEX_MISSING_HEADER_SEPARATOR", self.line)
        self.names.append(line)
        self.stream = fresh
        return []

    def _closed(self, number: int, meter: text._Meter) -> list[dict]:
        if not self.stanza:
            return []
        meter.within("max_events", self.count + 1, number)
        text._close(self.stanza, number, self.stream, meter)
        self.stanza = []
        self.count += 1
        return [self.stream.records.pop()]

    def _end(self, meter: text._Meter) -> list[dict]:
        self.open_end = bool(self.rest) or not self.line
        out = self._line(self.rest, meter) if self.rest else []
        self.rest = b""
        if not self.line:
            raise text.TextError("TELEX_INVALID_PREAMBLE", 1)
        out += self._closed(self.line, meter)
        self.stream.canonical &= self.blanks == 0 and not self.crlf and not self.open_end
        self.closed = True
        return out


# -- as a streaming operator -------------------------------------------------------


_NAMES = schema.EVENTS.fieldNames()
#: State of a stream that has ended or failed.
_ENDED = b""


@dataclass
class _Inbox:
    """State of one stream: its decoder, the next sequence number, early chunks."""

    decoder: BinaryDecoder | TextDecoder
    expected: int = 0
    waiting: dict[int, tuple[bytes, bool]] = field(default_factory=dict)
    failed: bool = False


_PLAIN = frozenset(("path", "header", "kind", "identity", "value"))
_quoted = json.encoder.encode_basestring


def _event_json(key: str, ordinal: int, record: dict) -> str:
    """A row of EVENTS as JSON; of plain records without the detour over a row."""
    if record.keys() <= _PLAIN:
        path, header, kind, identity, value = ("null" if (v := record.get(n)) is None else _quoted(v) for n in ("path", "header", "kind", "identity", "value"))
        return (
            f'{{"stream_id": {_quoted(key)}, "ordinal": {ordinal}, "path": {path}, "header": {header}, "kind": {kind}, "datatype": null, "generics": null, "clarifiers": null, '
            f'"identity": {identity}, "value": {value}, "origin": null, "span": null, "ext": []}}'
        )
    row = dict(zip(_NAMES, event_row(key, ordinal, record), strict=True))
    row["ext"] = [{"name": k, "value": v} for k, v in row["ext"]]
    return json.dumps(row, ensure_ascii=False)


@lru_cache(64)
def _about(profile: str, profile_explicit: bool, projection: str | None, projection_explicit: bool) -> str:
    return json.dumps({"profile": profile, "profile_explicit": profile_explicit, "projection": projection, "projection_explicit": projection_explicit})


def _feed(key: str, chunks: Iterator[tuple[int, bytes, bool]], box: _Inbox, room: int, contiguous: bool) -> list[tuple]:
    """Output rows for the chunks that can be decoded now."""
    rows: list[tuple] = []

    def error(seq: int, code: str, offset: int | None = None) -> None:
        rows.append((key, seq, "error", None, None, code, offset))
        box.failed = True
        box.waiting.clear()

    for seq, data, final in sorted(chunks, key=lambda c: c[0]):
        if box.failed or box.decoder.closed:
            rows.append((key, seq, "error", None, None, "TELEX_DECODER_CLOSED", None))
        elif seq < box.expected or seq in box.waiting:
            error(seq, "CHUNK_REPEATED")
        elif contiguous and seq != box.expected:
            error(seq, "CHUNK_ORDER")
        else:
            box.waiting[seq] = (data, final)
            if seq != box.expected and sum(len(d) for d, _ in box.waiting.values()) > room:
                error(seq, "FILM_LIMIT_EXCEEDED")
        while not box.failed and box.expected in box.waiting:
            now = box.expected
            data, final = box.waiting.pop(now)
            box.expected += 1
            first = box.decoder.count
            try:
                records = box.decoder.push(data, final)
            except (binary.BinaryError, text.TextError) as e:
                error(now, e.code, getattr(e, "offset", getattr(e, "line", None)))
                break
            for i, record in enumerate(records, first):
                rows.append((key, now, "record", i, _event_json(key, i, record), None, None))
            context = box.decoder.context if isinstance(box.decoder, BinaryDecoder) else box.decoder.stream
            about = None if context is None else _about(context.profile, context.profile_explicit, context.projection, context.projection_explicit)
            rows.append((key, now, box.decoder.status, box.decoder.count, about, None, None))
            if box.decoder.closed and box.waiting:
                for late in sorted(box.waiting):
                    rows.append((key, late, "error", None, None, "TELEX_DECODER_CLOSED", None))
                box.waiting.clear()
    return rows


def _decode_table(chunks: DataFrame, make, room: int, contiguous: bool) -> DataFrame:
    """The batch form: streams one after the other, chunk by chunk, so that neither many small nor long streams cost more than their bytes."""

    def run(batches):
        arrow = pa.schema([(n, pa.int64() if t == "long" else pa.string()) for n, t in (c.split(" ") for c in OUTPUT.split(", "))])
        key, box = None, None
        for batch in batches:
            rows: list[tuple] = []
            for stream_id, *chunk in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if box is None or stream_id != key:
                    key, box = stream_id, _Inbox(make())
                rows += _feed(key, (chunk,), box, room, contiguous)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return ordered.by_stream(chunks.select("stream_id", "seq", "bytes", "final"), "seq", "final", "bytes").mapInArrow(run, OUTPUT)


def decode_chunks(
    chunks: DataFrame, kind: str = "binary", limits: BinaryLimits = BinaryLimits(), event_limits: Limits = Limits(), contiguous: bool = False, forget_after: int | None = None
) -> DataFrame:
    """OUTPUT rows of a streaming (or batch) table of chunks (stream_id, seq, bytes, final).

    With ``contiguous`` a chunk that leaves a gap before it is an error (``CHUNK_ORDER``) and
    ends its stream, instead of waiting. Of a stream that has ended or failed only a mark
    stays in state, so that later chunks are known to be late; ``forget_after`` seconds of
    processing time remove it, and a chunk that comes later still begins a new stream. Spark
    then runs batches for as long as the query is up, so ``availableNow`` doesn't end it.
    """
    make = (lambda: BinaryDecoder(limits, event_limits)) if kind == "binary" else (lambda: TextDecoder(event_limits))
    room = limits.max_buffered_bytes
    columns = [c.split(" ")[0] for c in OUTPUT.split(", ")]

    def listed(frame: pd.DataFrame) -> Iterator[tuple[int, bytes, bool]]:
        return zip(frame["seq"].astype(int), map(bytes, frame["bytes"]), frame["final"].astype(bool), strict=True)

    if not chunks.isStreaming:
        return _decode_table(chunks, make, room, contiguous)

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = state.get[0] if state.exists else None
        box = pickle.loads(held) if held else _Inbox(make(), failed=held is not None)
        new = [c for f in frames for c in listed(f)]
        rows = _feed(key[0], new, box, room, contiguous)
        ended = box.failed or box.decoder.closed
        state.update((_ENDED if ended else pickle.dumps(box),))
        if ended and forget_after is not None:
            state.setTimeoutDuration(forget_after * 1000)
        yield pd.DataFrame(rows, columns=columns)

    timeout = "NoTimeout" if forget_after is None else "ProcessingTimeTimeout"
    return chunks.groupBy("stream_id").applyInPandasWithState(step, OUTPUT, "box binary", "append", timeout)


def decode_pieces(pieces: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """EVENTS with ``error``, of texts that come as ``text_format.pieces``, of any length.

    A stream whose text is at fault has one row more, without an ordinal, that names the error;
    its events are those before the fault and not to be acted on.
    """
    names = schema.EVENTS.fieldNames()

    def run(batches):
        texts = pa.string()
        ext = pa.list_(pa.struct([("name", texts), ("value", texts)]))
        arrow = pa.schema([*((n, pa.int64() if n == "ordinal" else ext if n == "ext" else texts) for n in names), ("error", texts)])
        current, feed = None, None

        def push(data: bytes, final: bool) -> list[tuple]:
            if feed.closed:
                return []
            first = feed.count
            try:
                records = feed.push(data, final)
            except text.TextError as e:
                return [(current, None, *[None] * (len(names) - 3), [], e.code)]
            return [(*event_row(current, i, r), None) for i, r in enumerate(records, first)]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

        for batch in batches:
            offsets, data = ordered.raw(batch.column(1))
            rows = []
            for stream_id, a, b in ordered.runs(batch.column(0)):
                if feed is None or stream_id != current:
                    rows += push(b"", True) if feed else []
                    current, feed = stream_id, TextDecoder(limits)
                rows += push(bytes(data[offsets[a] : offsets[b]]), False)
            if rows:
                yield batch_of(rows)
        if feed is not None and (rows := push(b"", True)):
            yield batch_of(rows)

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.EVENTS.fields)
    return ordered.by_stream(pieces, "part", "ordinal", "text").select("stream_id", "text").mapInArrow(run, f"{fields}, error string")


# -- streams that end in a batch table ---------------------------------------------

#: Streams whose chunks have more bytes are decoded chunk by chunk and not held.
_HELD = 1 << 20
_EVENT = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in schema.EVENTS.fields[1:])
_ENDS = f"stream_id string, profile string, projection string, whole boolean, events array<struct<{_EVENT}>>"

_PAYLOAD = r"[^\\\x00-\x1f\x7f]"
#: Canonical texts of events with plain fields, without an escape.
_PLAIN_TEXT = (
    rf"\A{re.escape(wire.TEXT_VERSION_LINE)}\n(?:profile={_PAYLOAD}+\n)?(?:projection={_PAYLOAD}+\n)?"
    rf"(?:\n(?:header={_PAYLOAD}*\n)?(?:path={_PAYLOAD}*\n)?kind={_PAYLOAD}*\n(?:identity={_PAYLOAD}*\n)?(?:value={_PAYLOAD}*\n)?)*\z"
)
_PLAIN_HEAD = r"\A[^\n]*(?P<profile>\nprofile=[^\n]*)?(?P<projection>\nprojection=[^\n]*)?\z"
_PLAIN_EVENT = r"\A(?P<header>header=[^\n]*\n)?(?P<path>path=[^\n]*\n)?(?P<kind>kind=[^\n]*)(?P<identity>\nidentity=[^\n]*)?(?P<value>\nvalue=[^\n]*)?\z"


def _ends_schema() -> pa.Schema:
    texts = pa.string()
    ext = pa.list_(pa.struct([("name", texts), ("value", texts)]))
    event = pa.struct([(f.name, pa.int64() if f.name == "ordinal" else ext if f.name == "ext" else texts) for f in schema.EVENTS.fields[1:]])
    return pa.schema([("stream_id", texts), ("profile", texts), ("projection", texts), ("whole", pa.bool_()), ("events", pa.list_(event))])


def _ended(batch: pa.RecordBatch) -> tuple[pa.Array, pa.Array]:
    """Ids and bytes of the streams of a batch whose chunks are there, once each, up to their first final one; chunks after it are late and change nothing."""
    encoded = pc.run_end_encode(batch.column(0))
    ends = encoded.run_ends.to_numpy().astype(np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    n = batch.num_rows
    place = np.arange(n) - np.repeat(starts, ends - starts)
    seq = batch.column(1).fill_null(-1).to_numpy(zero_copy_only=False)
    there = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
    wrong = np.concatenate([[0], np.cumsum((seq != place) | ~there)])
    finals = np.append(np.flatnonzero(batch.column(3).fill_null(False).to_numpy(zero_copy_only=False)), n)
    last = finals[np.searchsorted(finals, starts)]
    chosen = np.flatnonzero((last < ends) & (wrong[np.minimum(last + 1, n)] == wrong[starts]))
    offsets, _ = ordered.raw(batch.column(2))
    cuts = np.empty(2 * len(chosen), np.int64)
    cuts[0::2], cuts[1::2] = offsets[starts[chosen]], offsets[last[chosen] + 1]
    data = batch.column(2).buffers()[2]
    pieces = pa.Array.from_buffers(pa.large_binary(), max(0, len(cuts) - 1), [None, pa.py_buffer(cuts if len(cuts) else np.zeros(1, np.int64)), data if data is not None else pa.py_buffer(b"")])
    return encoded.values.take(pa.array(chosen)), pieces.take(pa.array(np.arange(0, len(pieces), 2)))


def _as_text(data: pa.Array) -> pa.Array:
    """Null where the bytes are no UTF-8."""
    try:
        return data.cast(pa.large_string())
    except pa.ArrowInvalid:
        known = [None] * len(data)
        for i, x in enumerate(data.to_pylist()):
            try:
                known[i] = x.decode("utf-8")
            except UnicodeDecodeError:
                pass
        return pa.array(known, pa.large_string())


def _plain_streams(ids: pa.Array, data: pa.Array, limits: Limits, arrow: pa.Schema) -> tuple[pa.RecordBatch, np.ndarray]:
    """Rows of the plain texts, read by columns, and which of the texts they are; within the limits nothing can be wrong with them."""
    most = min(limits.max_input_bytes, limits.max_line_bytes, limits.max_decoded_payload_bytes)
    texts = _as_text(data)
    plain = pc.and_(pc.match_substring_regex(texts, _PLAIN_TEXT), pc.less_equal(pc.binary_length(data), most)).fill_null(False)
    if limits.max_fields_per_event < 5:
        plain = pa.array(np.zeros(len(data), bool))
    # an event has a line for its kind after each empty line
    plain = pc.and_(plain, pc.less_equal(pc.count_substring(texts, "\n\n"), limits.max_events)).fill_null(False)
    parts = pc.split_pattern(texts.filter(plain), "\n\n")
    cuts = parts.offsets.to_numpy().astype(np.int64)
    lines = pc.ascii_rtrim(parts.values, characters="\n")
    is_event = np.ones(len(lines), bool)
    is_event[cuts[:-1]] = False
    first = cuts - np.arange(len(cuts))

    def cut(found: pa.Array, name: str, start: int, stop: int | None = None) -> pa.Array:
        spelt = pc.struct_field(found, name)
        return pc.if_else(pc.equal(spelt, ""), pa.scalar(None, spelt.type), pc.utf8_slice_codeunits(spelt, start, stop)).cast(pa.string())

    heads = pc.extract_regex(lines.filter(pa.array(~is_event)), _PLAIN_HEAD)
    found = pc.extract_regex(lines.filter(pa.array(is_event)), _PLAIN_EVENT)
    n = len(found)
    own = {
        "ordinal": pa.array(np.arange(n) - np.repeat(first[:-1], np.diff(first))),
        "header": cut(found, "header", len("header="), -1),
        "path": cut(found, "path", len("path="), -1),
        "kind": cut(found, "kind", len("kind=")),
        "identity": cut(found, "identity", len("\nidentity=")),
        "value": cut(found, "value", len("\nvalue=")),
    }
    event = arrow.field("events").type.value_type
    none = {"ext": pa.ListArray.from_arrays(pa.array(np.zeros(n + 1, np.int32)), pa.array([], event.field("ext").type.value_type))}
    fields = [event.field(i) for i in range(event.num_fields)]
    columns = [(own | none)[f.name] if f.name in own or f.name in none else pa.nulls(n, f.type) for f in fields]
    events = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.StructArray.from_arrays(columns, fields=fields))
    profile = pc.fill_null(cut(heads, "profile", len("\nprofile=")), wire.COMPLETE_PROFILE)
    rows = [ids.filter(plain).cast(pa.string()), profile, cut(heads, "projection", len("\nprojection=")), pa.array(np.ones(len(heads), bool)), events]
    return pa.RecordBatch.from_arrays(rows, schema=arrow), plain.to_numpy(zero_copy_only=False)


def decode_ended(chunks: DataFrame, kind: str = "binary", limits: BinaryLimits = BinaryLimits(), event_limits: Limits = Limits()) -> DataFrame:
    """(stream_id, profile, projection, whole, events) of the streams of a batch table of chunks that ``decode_chunks`` finds complete.

    A stream is one row with all its events, and ``whole``, unless its chunks have more than
    1 MB: its events then come chunk by chunk, and only the row of its final chunk has a profile.
    Without such a row the stream has failed or not ended, and its events are not to be acted on.
    """
    names = schema.EVENTS.fieldNames()[1:]
    failures = (binary.BinaryError, text.TextError)

    def make() -> BinaryDecoder | TextDecoder:
        return BinaryDecoder(limits, event_limits) if kind == "binary" else TextDecoder(event_limits)

    def row(key: str | None, feed: BinaryDecoder | TextDecoder, records: list[dict], first: int, whole: bool) -> tuple:
        context = feed.context if isinstance(feed, BinaryDecoder) else feed.stream
        about = (context.profile, context.projection) if feed.closed else (None, None)
        events = [dict(zip(names, event_row(key, i, r)[1:], strict=True)) for i, r in enumerate(records, first)]
        return (key, *about, whole, events)

    def run(batches):
        arrow = _ends_schema()

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

        key, feed, expected = None, None, 0

        def passing(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            """Chunks of a long stream, one after the other; ``expected`` is -1 from its end on, good or bad."""
            nonlocal expected
            for seq, data, final in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                if expected < 0:
                    return
                first = feed.count
                try:
                    records = feed.push(data, bool(final)) if seq == expected and data is not None else None
                except failures:
                    records = None
                expected = -1 if records is None or feed.closed else expected + 1
                if records or (records is not None and feed.closed):
                    yield batch_of([row(key, feed, records, first, False)])

        for batch, whole in ordered.whole(batches, _HELD):
            if not whole:
                if feed is None or batch.column(0)[0].as_py() != key:
                    key, feed, expected = batch.column(0)[0].as_py(), make(), 0
                yield from passing(batch)
                continue
            ids, data = _ended(batch)
            rest = np.ones(len(data), bool)
            if kind != "binary":
                found, plain = _plain_streams(ids, data, event_limits, arrow)
                rest = ~plain
                if found.num_rows:
                    yield found
            rows, size = [], 0
            for i in np.flatnonzero(rest).tolist():
                one, feed = data[i].as_py(), make()
                try:
                    rows.append(row(ids[i].as_py(), feed, feed.push(one, True), 0, True))
                except failures:
                    continue
                size += len(one)
                if size > _HELD:
                    yield batch_of(rows)
                    rows, size = [], 0
            feed = None
            if rows:
                yield batch_of(rows)

    return ordered.by_stream(chunks.select("stream_id", "seq", "bytes", "final"), "seq", "final", "bytes").mapInArrow(run, _ENDS)


def accept_chunks(
    chunks: DataFrame, kind: str = "binary", limits: BinaryLimits = BinaryLimits(), event_limits: Limits = Limits(), registered: tuple[str, ...] = ()
) -> DataFrame:
    """What ``accept_completed`` gives for the output of ``decode_chunks``, of a batch table of chunks.

    Streams that are sound at sight, by themselves, are told apart as they are decoded; only the others
    are written with their events and go through ``validate``.
    """
    found = decode_ended(chunks, kind, limits, event_limits)
    sound = F.col("whole") & validate.sound_together(F.col("events"), F.col("profile"), F.col("projection"), event_limits)
    told = found.withColumn("sound", sound).withColumn("events", F.when(~F.col("sound"), F.col("events")))
    told = materialize(told, "told")
    accepted = told.where("sound").select("stream_id", "profile", F.lit(True).alias("valid"), F.lit(0).cast("long").alias("n_diagnostics"))
    rest = told.where("not sound")
    streams = rest.where("profile is not null").select("stream_id", "profile", "projection")
    if not streams.take(1):
        return accepted
    events = rest.select("stream_id", F.explode("events").alias("e")).select("stream_id", "e.*").join(streams.select("stream_id"), "stream_id", "left_semi")
    return accepted.unionByName(validate.verdicts(streams, validate.validate(events, streams, event_limits, registered)))


def events_from_output(output: DataFrame) -> DataFrame:
    """EVENTS of the record rows."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.EVENTS.fields)
    return output.where("status = 'record'").select(F.from_json("event", fields).alias("e")).select("e.*")


def contexts_from_output(output: DataFrame) -> DataFrame:
    """STREAMS of the streams that are complete."""
    fields = "profile string, profile_explicit boolean, projection string, projection_explicit boolean"
    done = output.where("status = 'complete'").select("stream_id", F.from_json("event", fields).alias("c")).select("stream_id", "c.*")
    return done.withColumn("canonical", F.lit(None).cast("boolean")).select(*schema.STREAMS.fieldNames())


def accept_completed(output: DataFrame, event_limits: Limits = Limits(), registered: tuple[str, ...] = ()) -> DataFrame:
    """(stream_id, profile, valid, n_diagnostics) of the complete streams of a provisional table.

    Checks between events need the whole stream, so they run here, as a batch over the
    table that the streaming query appends to (from ``foreachBatch``, for the ids that
    a batch completed).
    """
    streams = contexts_from_output(output)
    events = events_from_output(output).join(streams.select("stream_id"), "stream_id", "left_semi")
    return validate.verdicts(streams, validate.validate(events, streams, event_limits, registered))
