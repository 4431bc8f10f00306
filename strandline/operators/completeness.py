"""Prefix completeness: every ancestor of every address, each missing one reported once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions import paths
from strandline.operators.shape import addressed


def missing_prefixes(events: DataFrame) -> DataFrame:
    """(stream_id, plane, path, required_by): the first event, in order, that needs a missing ancestor.

    Distinct parents are tried level by level in one pass of exploded prefixes, which
    combine to the least ordinal before the shuffle.
    """
    rows = addressed(events).where("canonical")
    ancestors = F.slice(paths.prefixes(F.col("segs")), F.lit(1), F.size("segs") - 1)
    needed = rows.where(F.size("segs") > 1).select("stream_id", "plane", "ordinal", "address", F.explode(ancestors).alias("path"))
    first = needed.groupBy("stream_id", "plane", "path").agg(F.min_by("address", "ordinal").alias("required_by"))
    there = rows.select("stream_id", "plane", F.col("address").alias("path")).distinct()
    return first.join(there, ["stream_id", "plane", "path"], "left_anti")
