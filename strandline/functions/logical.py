"""Deterministic bytes of logical values: ``n``, ``s<bytes>:``, ``l<items>:`` and ``m<members>:``.

All of it is text (lengths in ASCII, payloads in UTF-8), so columns hold strings and
hashing takes their UTF-8 bytes. Map members are in order of their key's UTF-8 bytes,
which is how Spark compares strings.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class LogicalError(ValueError):
    pass


def encode(value) -> bytes:
    """Of None, strings, lists and dicts with string keys; anything else is refused."""
    if value is None:
        return b"n"
    if isinstance(value, str):
        try:
            raw = value.encode("utf-8")
        except UnicodeEncodeError:
            raise LogicalError("strings hold Unicode scalar values only") from None
        return b"s%d:%s" % (len(raw), raw)
    if isinstance(value, list):
        return b"l%d:%s" % (len(value), b"".join(map(encode, value)))
    if isinstance(value, dict):
        members = sorted((k.encode("utf-8"), v) for k, v in value.items() if isinstance(k, str))
        if len(members) != len(value):
            raise LogicalError("map keys are strings")
        return b"m%d:%s" % (len(members), b"".join(b"s%d:%s%s" % (len(k), k, encode(v)) for k, v in members))
    raise LogicalError(f"no logical value: {type(value).__name__}")


def json_value(text: Column) -> Column:
    """The encoding of a JSON text; for nested parts only."""

    @F.pandas_udf(T.StringType())
    def encoded(text: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else encode(json.loads(t)).decode("utf-8") for t in text])

    return encoded(text)


# -- as expressions ------------------------------------------------------------


def string(value: Column) -> Column:
    return F.concat(F.lit("s"), F.octet_length(value).cast("string"), F.lit(":"), value)


def string_or_null(value: Column) -> Column:
    return F.when(value.isNull(), F.lit("n")).otherwise(string(value))


def sequence(encoded: Column) -> Column:
    """Of an array of encoded items, in order."""
    return F.concat(F.lit("l"), F.size(encoded).cast("string"), F.lit(":"), F.array_join(encoded, ""))


def mapping(members: Column) -> Column:
    """Of an array of structs (key, encoded value); members with a null value are absent."""
    present = F.array_sort(F.filter(members, lambda m: m["v"].isNotNull()))
    spelt = F.transform(present, lambda m: F.concat(string(m["k"]), m["v"]))
    return F.concat(F.lit("m"), F.size(present).cast("string"), F.lit(":"), F.array_join(spelt, ""))


def member(key: str, encoded: Column) -> Column:
    return F.struct(F.lit(key).alias("k"), encoded.alias("v"))
