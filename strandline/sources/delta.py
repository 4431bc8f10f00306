"""Prefix-delta layouts of addresses: each address as what it shares with the one before.

In a checkpointed layout every ``block`` events start afresh, so blocks encode and
decode in parallel and one block can be read alone. Events keep their other columns;
only the address is replaced by (shared code points, suffix).
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline import schema
from strandline.functions.paths import shared_prefix_codepoints
from strandline.operators.shape import plane

BLOCK = 256


def encode(events: DataFrame, block: int | None = BLOCK) -> DataFrame:
    """Events with ``block``, ``plane``, ``shared`` and ``suffix`` in place of path and header.

    Without ``block`` a stream is one chain for each plane.
    """
    rows = events.withColumn("plane", plane()).withColumn("block", F.floor(F.col("ordinal") / block) if block else F.lit(0).cast("long"))
    address = F.coalesce("path", "header")
    before = F.lag(address).over(Window.partitionBy("stream_id", "plane", "block").orderBy("ordinal"))
    shared = F.when(before.isNull(), 0).otherwise(shared_prefix_codepoints(before, address)).cast("int")
    return rows.withColumn("shared", shared).withColumn("suffix", F.expr("substring(coalesce(path, header), shared + 1)")).drop("path", "header")


def decode(encoded: DataFrame, only: tuple[str, ...] | None = None) -> DataFrame:
    """EVENTS again, or the addresses and the columns in ``only``. Each (stream, plane, block) is a chain of string pieces.

    Chains follow each other in a partition, in order, and Python passes over the batches, so
    neither many short chains nor a long one cost more than their rows. Encoded events that
    were not stored in between keep the partitions of ``encode``.
    """
    wanted = [c for c in schema.EVENTS.fieldNames() if only is None or c in ("path", "header", *only)]
    columns = [c for c in wanted if c not in ("path", "header")]
    sizes = encoded.schema
    keep = [*columns, "plane"]
    place = F.row_number().over(Window.partitionBy("stream_id", "plane", "block").orderBy("ordinal"))
    rows = encoded.withColumn("place", place).select(*keep, "shared", "suffix", "place")

    def run(batches):
        last = ""
        for batch in batches:
            addresses = []
            for shared, suffix, at in zip(batch.column("shared").to_pylist(), batch.column("suffix").to_pylist(), batch.column("place").to_pylist(), strict=True):
                last = last[:shared] + suffix if at > 1 else suffix
                addresses.append(last)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(addresses, pa.string())], names=[*keep, "address"])

    fields = ", ".join(f"{c} {sizes[c].dataType.simpleString()}" for c in keep)
    found = rows.mapInArrow(run, f"{fields}, address string")
    return found.select(
        *(F.when(F.col("plane") == c, F.col("address")).alias(c) if c in ("path", "header") else F.col(c) for c in wanted)
    )


def block_index(encoded: DataFrame) -> DataFrame:
    """(stream_id, block, first_record, records, bytes): where each block starts and how large it is.

    ``bytes`` adds up the UTF-8 suffixes, by which readers can balance blocks.
    """
    return encoded.groupBy("stream_id", "block").agg(F.min("ordinal").alias("first_record"), F.count("*").alias("records"), F.sum(F.octet_length("suffix")).alias("bytes"))


def read_block(encoded: DataFrame, stream_id: str, block: int) -> DataFrame:
    """The events of one block; the filter reaches the scan where the table is stored by stream and block."""
    return decode(encoded.where((F.col("stream_id") == stream_id) & (F.col("block") == block)))


def compact(events: DataFrame) -> DataFrame:
    """Per stream: one text slab and the sparse columns beside it, as an accessor-friendly shape.

    ``offsets`` cut the slab of addresses; identities, values, origins and spans are
    maps from ordinal, holding only what is there.
    """
    address = F.coalesce("path", "header")
    row = F.struct("ordinal", address.alias("address"), plane().alias("plane"), "kind", "identity", "value", "origin", "span")
    met = events.groupBy("stream_id").agg(F.array_sort(F.collect_list(row)).alias("r"))
    texts = F.transform("r", lambda x: x["address"])
    ends = F.aggregate(texts, F.array(F.lit(0)), lambda acc, t: F.concat(acc, F.array(F.element_at(acc, -1) + F.char_length(t))))
    sparse = lambda c: F.map_from_entries(F.transform(F.filter("r", lambda x: x[c].isNotNull()), lambda x: F.struct(x["ordinal"], x[c]))).alias(c)
    return met.select("stream_id", F.array_join(texts, "").alias("slab"), ends.alias("offsets"), F.transform("r", lambda x: x["plane"]).alias("planes"), F.transform("r", lambda x: x["kind"]).alias("kinds"), *map(sparse, ("identity", "value", "origin", "span")))


def address_at(i: Column) -> Column:
    """The i-th address (from 0) of a compact stream."""
    begin, end = F.element_at("offsets", F.lit(1) + i), F.element_at("offsets", F.lit(2) + i)
    return F.substring("slab", begin + 1, end - begin)
