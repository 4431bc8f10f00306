"""Table layouts. Order within a stream is the explicit column ``ordinal``, from 0."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _B = T.StringType(), T.LongType(), T.BooleanType()


def _struct(**columns) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in columns.items()])


EXTENSION = _struct(name=_S, value=_S)

#: One row per stream. ``profile`` and ``projection`` are effective values.
STREAMS = _struct(stream_id=_S, profile=_S, profile_explicit=_B, projection=_S, projection_explicit=_B, canonical=_B)

#: One row per event. ``generics`` and ``clarifiers`` are JSON arrays; null is absent, '' is present and empty.
EVENTS = _struct(
    stream_id=_S, ordinal=_L, path=_S, header=_S, kind=_S, datatype=_S, generics=_S, clarifiers=_S, identity=_S, value=_S, origin=_S, span=_S, ext=T.ArrayType(EXTENSION)
)

#: What a check found. ``record`` is the event's ordinal, null for the stream itself.
FINDING = _struct(code=_S, field=_S, required_path=_S, first_record=_L, counter=_S, observed=_L, lim=_L)
DIAGNOSTICS = T.StructType([T.StructField("stream_id", _S), T.StructField("record", _L), T.StructField("path", _S), *FINDING.fields])

#: At most one row per stream: decoding stops at the first error.
TEXT_ERRORS = _struct(stream_id=_S, code=_S, line=_L, counter=_S, observed=_L, lim=_L)
BINARY_ERRORS = _struct(stream_id=_S, code=_S, offset=_L, record=_L, component=_S, stage=_S, detail=_S)

ARTIFACTS = _struct(origin=_S, bytes=T.BinaryType())
