"""Record shapes: constructing events, their addresses, and projections of them."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline import schema, wire
from strandline.functions import paths

_TEXT = ("path", "header", "kind", "datatype", "identity", "value", "origin", "span")


def event_row(stream_id: str, ordinal: int, record: dict) -> tuple:
    """One host record as a row of EVENTS; a missing key is null, unknown keys are extensions."""
    parts = {k: None if k not in record else json.dumps(record[k], ensure_ascii=False) for k in ("generics", "clarifiers")}
    own = {k: record.get(k) for k in _TEXT} | parts
    ext = [(k, v) for k, v in sorted(record.items()) if k not in wire.CORE_FIELDS]
    return (stream_id, ordinal, *(own[f.name] for f in schema.EVENTS.fields[2:-1]), ext)


def events_from_records(spark: SparkSession, streams: Iterable[tuple[str, list[dict]]]) -> DataFrame:
    rows = [event_row(s, i, r) for s, records in streams for i, r in enumerate(records)]
    return spark.createDataFrame(rows, schema.EVENTS)


def event_record(row) -> dict:
    """The host record of a row; absent fields are left out."""
    record = {k: row[k] for k in _TEXT if row[k] is not None}
    record |= {k: json.loads(row[k]) for k in ("generics", "clarifiers") if row[k] is not None}
    return record | {e["name"]: e["value"] for e in row["ext"] or ()}


def events(df: DataFrame, **columns: Column) -> DataFrame:
    """EVENTS from named expressions; what isn't given is absent.

    A datatype given without parts gets empty ones.
    """
    if "datatype" in columns:
        empty = F.when(columns["datatype"].isNotNull(), F.lit("[]"))
        columns = {"generics": empty, "clarifiers": empty} | columns
    absent = {f.name: F.lit(None).cast(f.dataType) for f in schema.EVENTS.fields} | {"ext": F.array().cast(schema.EVENTS["ext"].dataType)}
    return df.select(*(columns.get(f.name, absent[f.name]).cast(f.dataType).alias(f.name) for f in schema.EVENTS.fields))


def streams(spark: SparkSession, ids: DataFrame, profile: str | None = None, projection: str | None = None) -> DataFrame:
    """STREAMS for the distinct stream ids of ``ids``, all with one context."""
    return ids.select("stream_id").distinct().select(
        "stream_id",
        F.lit(profile or wire.COMPLETE_PROFILE).alias("profile"),
        F.lit(profile is not None).alias("profile_explicit"),
        F.lit(projection).cast("string").alias("projection"),
        F.lit(projection is not None).alias("projection_explicit"),
        F.lit(True).alias("canonical"),
    )


def plane() -> Column:
    """``path`` or ``header``, null where an event has both or neither."""
    return F.when(F.col("path").isNotNull() & F.col("header").isNull(), "path").when(F.col("header").isNotNull() & F.col("path").isNull(), "header")


def is_header_address(address: Column, segs: Column) -> Column:
    """Whether the first segment is a quoted member of the control plane with at least one character more."""
    first = F.try_element_at(segs, F.lit(1))
    return F.coalesce(first.startswith(f'.["{wire.HEADER_MEMBER_PREFIX}') & (F.char_length(first) > len(wire.HEADER_MEMBER_PREFIX) + 5), F.lit(False))


def addressed(df: DataFrame) -> DataFrame:
    """EVENTS with plane, address, segs, canonical (address is a canonical event path) and path_ok.

    ``path_ok`` is ``canonical`` and, on the header plane, lies under a control
    member; only such events are found by address.
    """
    out = df.withColumn("plane", plane()).withColumn("address", F.when(F.col("plane") == "path", F.col("path")).when(F.col("plane") == "header", F.col("header")))
    out = out.withColumn("canonical", F.coalesce(paths.is_event_path(F.col("address")), F.lit(False)))
    out = out.withColumn("segs", F.when(F.col("canonical"), paths.segments(F.col("address"))))
    return out.withColumn("path_ok", F.col("canonical") & ((F.col("plane") == "path") | is_header_address(F.col("address"), F.col("segs"))))


def without_provenance(df: DataFrame) -> DataFrame:
    return df.withColumns({"origin": F.lit(None).cast("string"), "span": F.lit(None).cast("string")})


def in_scope(df: DataFrame, scope: str) -> DataFrame:
    """Events that a digest of ``scope`` covers. Apply after validation, which headers take part in."""
    return df.where(F.col("path").isNotNull()) if scope == wire.BODY_SCOPE else df
