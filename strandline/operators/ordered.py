"""Work along whole streams without holding one.

A stream's pieces of text meet in one partition, in order: Spark's sort spills to disk,
and Python passes over the batches with a running state. So a stream of any length takes
the memory of a batch; streams are the unit of parallel work.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


def by_stream(pieces: DataFrame, *place: str) -> DataFrame:
    """``pieces`` with each stream in one partition, its rows together and in the order of ``place``."""
    return pieces.repartition("stream_id").sortWithinPartitions("stream_id", *place)


def runs(ids: pa.Array) -> Iterator[tuple[str | None, int, int]]:
    """(id, first row, row after the last) of each run of equal ids."""
    encoded = pc.run_end_encode(ids)
    start = 0
    for value, end in zip(encoded.values.to_pylist(), encoded.run_ends.to_pylist(), strict=True):
        yield value, start, end
        start = end


def whole(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.RecordBatch, bool]]:
    """Rows that ``by_stream`` has put in order (stream id first), cut between streams, with True.

    A stream whose rows have more than ``most`` bytes comes by itself, in one or more batches with False.
    """

    def cut(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, bool]]:
        begin = 0
        for _, a, b in runs(batch.column(0)) if batch.nbytes > most else ():
            if batch.slice(begin, b - begin).nbytes > most:
                if a > begin:
                    yield batch.slice(begin, a - begin), True
                begin = a
            if batch.slice(a, b - a).nbytes > most:
                yield batch.slice(a, b - a), False
                begin = b
        if begin < batch.num_rows:
            yield batch.slice(begin), True

    held, size, key, long = [], 0, None, False
    for batch in batches:
        spans = list(runs(batch.column(0)))
        if not spans:
            continue
        start, last = 0, spans[-1][1]
        if (held or long) and spans[0][0] == key:
            start = spans[0][2]
            head = batch.slice(0, start)
            if long:
                yield head, False
            else:
                held.append(head)
                size += head.nbytes
        if start < batch.num_rows:
            if ended := held + [batch.slice(start, last - start)] * (last > start):
                yield from cut(pa.concat_batches(ended))
            held, key, long = [batch.slice(last)], spans[-1][0], False
            size = held[0].nbytes
        if held and size > most:
            yield pa.concat_batches(held), False
            held, long = [], True
    if held:
        yield pa.concat_batches(held), True


def raw(texts: pa.Array) -> tuple[np.ndarray, memoryview]:
    """The offsets of a string (or binary) array and the bytes that they cut; row i is data[offsets[i]:offsets[i + 1]]."""
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, ends, data = texts.buffers()
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1]
    return offsets, memoryview(data if data is not None else b"")


def hashed(pieces: DataFrame, algorithm: str, skip: int = 0) -> DataFrame:
    """(stream_id, digest, bytes, pieces, flagged) of rows (stream_id, text, flag) that ``by_stream`` has put in order.

    ``digest`` is that of the texts joined, in lower-case hexadecimal, without the first ``skip``
    bytes (a separator that precedes each piece); ``flagged`` tells whether a row had its flag.
    """

    def run(batches):
        names = ["stream_id", "digest", "bytes", "pieces", "flagged"]
        types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]
        schema = pa.schema(list(zip(names, types, strict=True)))
        current, state, size, n, flagged = None, None, 0, 0, False
        for batch in batches:
            done = []
            offsets, data = raw(batch.column(1))
            marks = batch.column(2)
            for stream_id, a, b in runs(batch.column(0)):
                if state is None or stream_id != current:
                    if state is not None:
                        done.append((current, state.hexdigest(), size, n, flagged))
                    current, state, size, n, flagged = stream_id, hashlib.new(algorithm), 0, 0, False
                begin = offsets[a] if n else min(offsets[a] + skip, offsets[b])
                state.update(data[begin : offsets[b]])
                size += int(offsets[b] - offsets[a])
                n += b - a
                flagged = flagged or bool(pc.any(marks.slice(a, b - a)).as_py())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], schema=schema)
        if state is not None:
            last = (current, state.hexdigest(), size, n, flagged)
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(last, types, strict=True)], schema=schema)

    return pieces.select("stream_id", "text", "flag").mapInArrow(run, "stream_id string, digest string, bytes long, pieces long, flagged boolean")
