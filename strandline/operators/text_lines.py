"""The text format as tables: lines, stanzas, fields, and the first syntax error of each stream.

The same grammar that ``sources.text_format`` decodes, as expressions and windows over
lines, for analysis of many texts at once: where errors cluster, how payloads are
distributed. Windows range over one text, which ``max_input_bytes`` bounds.
Datatype lines are recursive and not judged here.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline import wire
from strandline.config import Limits
from strandline.functions import payload



def _lines_to(last: int):
    """The lines of a stream up to the current one (0) or the one before (-1)."""
    return Window.partitionBy("stream_id").orderBy("line").rowsBetween(Window.unboundedPreceding, last)


def lines(texts: DataFrame) -> DataFrame:
    """(stream_id, line, text) from 1, line endings removed; the piece after a final line feed is no line."""
    plain = F.regexp_replace(F.replace("text", F.lit("\r\n"), F.lit("\n")), r"\n\z", "")
    split = texts.select("stream_id", F.posexplode(F.split(F.coalesce(plain, F.lit("")), "\n")).alias("at", "text"))
    return split.select("stream_id", (F.col("at") + 1).cast("long").alias("line"), "text")


def stanzas(rows: DataFrame) -> DataFrame:
    """Lines with ``part`` (version, stream, blank, field or stray) and ``stanza``, the line before its first one.

    Stream fields are the unbroken run of them after the version line; the first line
    that is neither, if not blank, is stray.
    """
    name = F.regexp_extract("text", r"\A([^=]*)=", 1)
    own = (F.col("line") > 1) & name.isin("profile", "projection") & F.col("text").contains("=")
    marked = rows.withColumn("own", own | (F.col("line") == 1))
    broken = marked.withColumn("header", F.min(F.col("own").cast("int")).over(_lines_to(0)) == 1)
    first = F.coalesce(F.max((~F.col("header")).cast("int")).over(_lines_to(-1)), F.lit(0)) == 0
    part = F.when(F.col("line") == 1, "version").when(F.col("header"), "stream").when(F.col("text") == "", "blank").when(first, "stray").otherwise("field")
    placed = broken.withColumn("part", part)
    stanza = F.max(F.when(F.col("part").isin("blank", "version", "stream"), F.col("line"))).over(_lines_to(0))
    return placed.select("stream_id", "line", "text", "part", F.when(F.col("part") == "field", stanza).alias("stanza"))


def piece_stanzas(pieces: DataFrame) -> DataFrame:
    """What ``stanzas`` gives, of texts that come as ``text_format.pieces``, without a window over a stream.

    A piece after the header is a separator and one stanza, so the marks of its lines follow from
    the piece alone. ``line`` and ``stanza`` count from the piece's first line, and (part, ordinal)
    tells which piece that is.
    """
    body = F.when(F.col("part") == 1, F.expr("substring(text, 2)")).otherwise(F.col("text"))
    split = pieces.where("part < 2").select("stream_id", "part", "ordinal", F.posexplode(F.split(body, "\n")).alias("line", "text"))
    place = F.when(F.col("part") == 1, F.when(F.col("line") == 0, "blank").otherwise("field")).otherwise(F.when(F.col("line") == 0, "version").otherwise("stream"))
    return split.select("stream_id", F.col("part").alias("piece"), "ordinal", F.col("line").cast("long").alias("line"), "text", place.alias("part"), F.when((F.col("part") == 1) & (F.col("line") > 0), F.lit(0).cast("long")).alias("stanza"))


def fields(marked: DataFrame) -> DataFrame:
    """(stream_id, line, stanza, part, name, payload) of stream and stanza fields; name is null without ``name=``."""
    named = F.col("text").rlike(r"\A[^=]+=")
    own = marked.where(F.col("part").isin("stream", "field"))
    return own.select(
        "stream_id", "line", "stanza", "part", F.when(named, F.regexp_extract("text", r"\A([^=]+)=", 1)).alias("name"), F.when(named, F.regexp_extract("text", r"(?s)\A[^=]+=(.*)\z", 1)).alias("payload")
    )


def field_order(found: DataFrame) -> DataFrame:
    """(stream_id, stanza, canonical): whether a stanza's fields are in canonical order."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, wire.TEXT_FIELD_ORDER)), F.col("name")), F.lit(0))
    key = F.struct(F.when(rank == 0, 99).otherwise(rank).alias("r"), F.when(rank == 0, F.col("name")).otherwise("").alias("n"))
    keys = F.transform(F.array_sort(F.collect_list(F.struct("line", key.alias("k")))), lambda x: x["k"])
    met = found.where("part = 'field'").groupBy("stream_id", "stanza").agg(keys.alias("keys"))
    return met.select("stream_id", "stanza", (F.col("keys") == F.array_sort("keys")).alias("canonical"))


def decoded_bytes(found: DataFrame) -> DataFrame:
    """Fields with ``bytes``, their decoded size, and ``total``, the stream's running sum."""
    sized = found.where(payload.well_formed(F.col("payload"))).withColumn("bytes", F.octet_length(payload.decoded(F.col("payload"))).cast("long"))
    return sized.withColumn("total", F.sum("bytes").over(_lines_to(0)))


def _payload_fault(p: Column) -> Column:
    """The code of the first thing wrong with a payload that is not well formed."""
    rest = F.regexp_replace(p, r"\A(?:[^\\\x00-\x1f\x7f]|\\[\\nrt0]|\\u\{(?!0{0,2}[dD][89a-fA-F][0-9a-fA-F]{2}\})(?:0?[0-9A-Fa-f]{1,5}|10[0-9A-Fa-f]{4})\})*+", "")
    return (
        F.when(~rest.startswith("\\"), "TELEX_UNESCAPED_CONTROL")
        .when(rest == "\\", "TELEX_INCOMPLETE_ESCAPE")
        .when(~rest.startswith("\\u{"), "TELEX_UNKNOWN_ESCAPE")
        .when(~rest.contains("}"), "TELEX_UNTERMINATED_UNICODE_ESCAPE")
        .when(rest.rlike(r"\A\\u\{[0-9A-Fa-f]{1,6}\}"), "TELEX_INVALID_UNICODE_SCALAR")
        .otherwise("TELEX_INVALID_UNICODE_ESCAPE")
    )


def first_errors(texts: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(stream_id, code, line): what decoding would stop at, of all but datatype and event-count errors.

    Candidates carry where they are raised; checks of the whole input come first, then
    lines in order, and on one line the checks in their order.
    """
    raw = texts.select("stream_id", F.coalesce("text", F.lit("")).alias("text"))
    marked = stanzas(lines(raw))
    found = fields(marked)
    none = F.lit(None).cast("long")

    def candidates(df: DataFrame, condition: Column, code: str | Column, phase: int, rank: int, line: Column = F.col("line"), at: Column = F.col("line")) -> DataFrame:
        chosen = F.lit(code) if isinstance(code, str) else code
        return df.where(condition).select("stream_id", F.struct(F.lit(phase).alias("phase"), at.cast("long").alias("at"), F.lit(rank).alias("rank"), chosen.alias("code"), line.cast("long").alias("line")).alias("c"))

    physical = raw.select("stream_id", F.posexplode(F.split("text", "\n")).alias("i", "text")).select("stream_id", (F.col("i") + 1).alias("line"), F.regexp_replace("text", r"\r\z", "").alias("text"))
    again = found.where("part = 'field'").withColumn("place", F.row_number().over(Window.partitionBy("stream_id", "stanza", "name").orderBy("line")))
    crowd = found.where("part = 'field'").withColumn("nth", F.row_number().over(Window.partitionBy("stream_id", "stanza").orderBy("line")))
    twice = found.where("part = 'stream'").withColumn("place", F.row_number().over(Window.partitionBy("stream_id", "name").orderBy("line")))
    one = F.lit(1)
    bad = ~payload.well_formed(F.col("payload"))
    sized = decoded_bytes(found)
    empty = (F.col("part") == "stream") & (F.col("payload") == "")
    field = F.col("part") == "field"
    parts = [
        candidates(raw, F.octet_length("text") > limits.max_input_bytes, "TELEX_LIMIT_EXCEEDED", 0, 0, none, one),
        candidates(physical, F.octet_length("text") > limits.max_line_bytes, "TELEX_LIMIT_EXCEEDED", 0, 1),
        candidates(raw, F.col("text").startswith("﻿"), "TELEX_BOM", 1, 0, one, one),
        candidates(raw, F.col("text").rlike(r"\r(?!\n)"), "TELEX_BARE_CR", 1, 1, none, one),
        candidates(marked, (F.col("line") == 1) & (F.col("text") != wire.TEXT_VERSION_LINE), "TELEX_INVALID_PREAMBLE", 2, 0),
        candidates(marked, F.col("part") == "stray", "TELEX_MISSING_HEADER_SEPARATOR", 3, 0),
        candidates(found, field & F.col("name").isNull(), "TELEX_INVALID_FIELD_LINE", 3, 1),
        candidates(found, field & ~F.col("name").rlike(rf"\A{wire.FIELD_NAME}\z"), "TELEX_INVALID_FIELD_NAME", 3, 2),
        candidates(again, F.col("name").isNotNull() & (F.col("place") > 1), "TELEX_DUPLICATE_FIELD", 3, 3),
        candidates(crowd, F.col("nth") > limits.max_fields_per_event, "TELEX_LIMIT_EXCEEDED", 3, 4),
        candidates(found, bad, _payload_fault(F.col("payload")), 3, 5),
        candidates(sized, F.col("total") > limits.max_decoded_payload_bytes, "TELEX_LIMIT_EXCEEDED", 3, 6),
        candidates(found, empty, F.concat(F.lit("TELEX_EMPTY_"), F.upper("name")), 3, 7),
        candidates(twice, F.col("place") > 1, "TELEX_DUPLICATE_STREAM_FIELD", 3, 8),
    ]
    everything = reduce(DataFrame.unionByName, parts)
    return everything.groupBy("stream_id").agg(F.min("c").alias("c")).select("stream_id", "c.code", "c.line")
