"""Provenance audit: events against the exact bytes that their origins name.

Artifacts are inspected once each, next to their bytes; what the events need from
them is a row of facts per origin. The bytes themselves are looked at again only
for spans, whose boundaries must not split a character.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline import wire

FIELDS = ["stream_id", "record", "code", "field"]


def inspect_artifacts(artifacts: DataFrame) -> DataFrame:
    """(origin, size, fault): fault is null for verified artifacts."""
    digest = F.concat(F.lit("sha256:"), F.sha2("bytes", 256))
    fault = F.when(digest != F.col("origin"), "AES_ORIGIN_MISMATCH").when(~F.is_valid_utf8(F.col("bytes").cast("string")), "AES_SOURCE_INVALID_UTF8")
    return artifacts.where(F.col("bytes").isNotNull()).select("origin", F.octet_length("bytes").alias("size"), fault.alias("fault"))


def _finding(df: DataFrame, code, field: str) -> DataFrame:
    return df.select("stream_id", F.col("ordinal").alias("record"), (F.lit(code) if isinstance(code, str) else code).alias("code"), F.lit(field).alias("field"))


def span_faults(known: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Events of verified artifacts whose span is malformed, too long or splits a character.

    ``known`` are events joined with the facts of their artifact.
    """
    start_text, end_text = (F.regexp_extract("span", rf"\A{wire.SPAN}\z", i) for i in (1, 2))
    wide = lambda x: F.struct(F.char_length(x), x)
    size = F.col("size").cast("string")
    spans = known.where(F.col("span").isNotNull() & F.col("fault").isNull()).select("stream_id", "ordinal", "origin", "span", start_text.alias("a"), end_text.alias("b"), size.alias("size"))
    bad = (F.col("a") == "") | (wide(F.col("a")) >= wide(F.col("b"))) | (wide(F.col("b")) > wide(F.col("size")))
    judged = spans.withColumn("bad", bad)
    # only what is in range needs the bytes; distinct boundaries of an origin are looked at once
    inside = judged.where("not bad")
    at = inside.select("origin", F.explode(F.array(F.col("a").cast("int"), F.col("b").cast("int"))).alias("at")).distinct()
    byte = F.conv(F.hex(F.substring("bytes", F.col("at") + 1, F.lit(1))), 16, 10).cast("int")
    splits = at.join(artifacts, "origin").where((F.col("at") > 0) & (F.col("at") < F.octet_length("bytes")) & (byte.bitwiseAND(0xC0) == 0x80)).select("origin", "at", F.lit(True).alias("split"))
    edge = lambda c: splits.select("origin", F.col("at").cast("string").alias(c), F.col("split").alias(f"split_{c}"))
    cut = inside.join(edge("a"), ["origin", "a"], "left").join(edge("b"), ["origin", "b"], "left").where("split_a or split_b")
    return _finding(judged.where("bad"), "AES_INVALID_SPAN", "span").unionByName(_finding(cut, "AES_INVALID_SPAN", "span"))


def audit(events: DataFrame, artifacts: DataFrame, require_all: bool = False, require_available: bool = False) -> DataFrame:
    """(stream_id, record, code, field) for everything that the audit finds.

    What is wrong with an artifact is reported once a stream, at the first event that
    names it.
    """
    canonical = F.col("origin").rlike(rf"\A{wire.ORIGIN}\z")
    named = events.where(canonical).select("stream_id", "ordinal", "origin", "span")
    facts = inspect_artifacts(artifacts)
    first = named.groupBy("stream_id", "origin").agg(F.min("ordinal").alias("ordinal"))
    state = first.join(facts, "origin", "left")
    parts = [
        _finding(events.where(F.col("origin").isNotNull() & ~canonical), "AES_INVALID_ORIGIN", "origin"),
        _finding(state.where("fault is not null"), F.col("fault"), "origin"),
        span_faults(named.join(facts, "origin"), artifacts),
    ]
    if require_all:
        parts.append(_finding(events.where(F.col("origin").isNull()), "AES_SOURCE_REQUIRED", "origin"))
    if require_available:
        parts.append(_finding(state.where("size is null"), "AES_SOURCE_REQUIRED", "origin"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def summary(events: DataFrame, streams: DataFrame, artifacts: DataFrame, require_all: bool = False, require_available: bool = False) -> DataFrame:
    """(stream_id, valid, complete, verified_origins, missing_origins); origins in order of first use."""
    found = audit(events, artifacts, require_all, require_available).groupBy("stream_id").agg(F.count("*").alias("n"))
    named = events.where(F.col("origin").rlike(rf"\A{wire.ORIGIN}\z")).groupBy("stream_id", "origin").agg(F.min("ordinal").alias("first"))
    state = named.join(inspect_artifacts(artifacts), "origin", "left")
    ordered = lambda keep: F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("first", "origin")))), lambda x: x["origin"])
    origins = state.groupBy("stream_id").agg(
        ordered(F.col("size").isNotNull() & F.col("fault").isNull()).alias("verified_origins"), ordered(F.col("size").isNull()).alias("missing_origins")
    )
    bare = events.groupBy("stream_id").agg(F.count(F.when(F.col("origin").isNull(), 1)).alias("bare"))
    out = streams.select("stream_id").join(found, "stream_id", "left").join(origins, "stream_id", "left").join(bare, "stream_id", "left")
    none = F.array().cast("array<string>")
    missing = F.coalesce("missing_origins", none)
    complete = (F.size(missing) == 0) & ((F.coalesce("bare", F.lit(0)) == 0) | F.lit(not require_all))
    return out.select("stream_id", F.col("n").isNull().alias("valid"), complete.alias("complete"), F.coalesce("verified_origins", none).alias("verified_origins"), missing.alias("missing_origins"))
