r"""Mixing sources to target weights.

Every document gets a key from a seeded hash of its id and text. A source's documents
are ordered by that key; the leading hexadecimal digits of the key name a range
bucket, so buckets are even whatever the size of a source. Prefix sums of word
counts are distributed: totals per (source, bucket), a prefix over those small
totals, and a running sum inside each bucket. A source is cut at its budget
exactly: whole epochs first, then documents in key order, the last one in part.
``mix_documents`` emits the documents of the mix, ``mix_sources`` what the same plan
takes from each.

Targets: the budget is shared by weight; a source takes at most ``max_epochs``
times its size and what it can't take is shared again by weight until no source
is above. This is the level L at which the sum of min(cap, L * weight) equals
the budget, found by one pass over sources in order of cap / weight.

Edge cases: a null text has size 0; documents without words take 0; a null
source is a source of its own, last in order; rows with equal id and text are
separate rows and share their key: they are alike, so their order among each other
is immaterial, and reruns agree whatever the order of rows; very long texts are
counted whole; columns named as this module's own don't clash;
an empty table gives an empty result; other columns pass through (``mix_documents``)
or are ignored (``mix_sources``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.storage import materialize

WORD = r"[^\x20\x09-\x0D]+"
_SPACED_WORD = r"[\x20\x09-\x0D]*" + WORD


def mix_sources(
    docs: DataFrame,
    weights: tuple[float, ...] = (3.0, 1.0, 2.0),
    share: float = 1.5,
    max_epochs: float = 2.0,
    seed: str = "mix-1|",
    bucket_digits: int = 3,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken.

    ``weights`` repeat over sources in code point order, null last. ``taken``
    counts the words that the mix takes from the document, repeats counted; a
    part of an epoch takes a leading part of at most one document per source.
    """
    sized, plan = _plan(docs, weights, share, max_epochs, seed, bucket_digits, doc_id, text, source)
    taken = F.col("epochs") * F.col("size") + F.col("part")
    return plan(sized).select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mix_documents(
    docs: DataFrame,
    weights: tuple[float, ...] = (3.0, 1.0, 2.0),
    share: float = 1.5,
    max_epochs: float = 2.0,
    seed: str = "mix-1|",
    bucket_digits: int = 3,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    epoch: str = "epoch",
) -> DataFrame:
    """The mix itself: the rows of ``docs`` as often as they are taken, and ``epoch`` from 0.

    The last document of a source is cut after the last word taken; documents of which nothing is taken are absent.
    Texts are shuffled once, to their bucket.
    """
    if epoch in docs.columns:
        raise ValueError(f"documents have a column {epoch}")
    _, plan = _plan(docs, weights, share, max_epochs, seed, bucket_digits, doc_id, text, source)
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    taken = plan(_sized(docs, seed, bucket_digits, doc_id, text, source, whole)).where("size > 0 and epochs + cast(part > 0 as int) > 0")
    copies = taken.select("row", "size", "epochs", "part", F.explode(F.sequence(F.lit(0), (F.col("epochs") + (F.col("part") > 0).cast("int") - 1).cast("int"))).alias("copy"))
    own = F.col("row")[text]
    leading = F.array_join(F.slice(F.regexp_extract_all(own, F.lit(_SPACED_WORD), F.lit(0)), 1, F.col("part").cast("int")), "")
    cut = F.when((F.col("copy") == F.col("epochs")) & (F.col("part") < F.col("size")), leading).otherwise(own)
    return copies.select(*((cut if c == text else F.col("row")[c]).alias(c) for c in docs.columns), F.col("copy").alias(epoch))


def _sized(docs: DataFrame, seed: str, bucket_digits: int, doc_id: str, text: str, source: str, *more) -> DataFrame:
    spelt = lambda c: F.coalesce(F.concat(F.lit("s"), F.col(c).cast("string")), F.lit("n"))  # noqa: E731  null is not the empty string
    key = F.md5(F.concat(F.lit(seed), F.md5(spelt(doc_id)), F.md5(spelt(text))))
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).alias("source"),
        F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n")).alias("skey"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        key.alias("key"),
        F.substring(key, 1, bucket_digits).alias("bucket"),
        *more,
    )


def _plan(docs: DataFrame, weights, share, max_epochs, seed, bucket_digits, doc_id, text, source) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """Sized rows without texts, and what adds to sized rows: source_size, target, epochs (whole ones) and part (words of one more)."""
    sized = materialize(_sized(docs, seed, bucket_digits, doc_id, text, source), "sized")
    buckets = materialize(sized.groupBy("skey", "source", "bucket").agg(F.sum("size").alias("bucket_size")), "buckets")
    sources = _targets(buckets.groupBy("skey", "source").agg(F.sum("bucket_size").alias("source_size")), weights, share, max_epochs)
    before = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.select("skey", "bucket", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)).alias("bucket_offset"))
    offsets = materialize(offsets.join(sources, "skey"), "offsets")

    inside = Window.partitionBy("skey", "bucket").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    budget = F.floor(F.col("target")).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("cast(floor(target) as bigint) div source_size")).otherwise(F.lit(0))
    rest = budget - F.col("epochs") * F.col("source_size") - F.col("bucket_offset") - F.col("bucket_prior")
    part = F.least(F.col("size"), F.greatest(F.lit(0), rest))

    def plan(rows: DataFrame) -> DataFrame:
        ordered = rows.select("*", F.coalesce(F.sum("size").over(inside), F.lit(0)).alias("bucket_prior"))
        return ordered.join(offsets, ["skey", "bucket"]).withColumn("epochs", epochs).withColumn("part", part)

    return sized, plan


def _targets(sizes: DataFrame, weights: tuple[float, ...], share: float, max_epochs: float) -> DataFrame:
    """Adds ``target``. One row per source, so windows over all of them stay small."""
    n = len(weights)
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.pmod(place - 1, F.lit(n)).cast("int") + 1)
    weighted = sizes.withColumn("w", weight)
    by_cap = Window.orderBy(F.col("cap") / F.col("w"), "skey")
    everything = Window.partitionBy(F.lit(0))
    level = (F.col("budget") - F.col("cap_before")) / F.col("w_from")
    return (
        weighted.withColumn("cap", max_epochs * F.col("source_size"))
        .withColumn("budget", share * F.sum("source_size").over(everything))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("w_from", F.sum("w").over(by_cap.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("rank", F.row_number().over(by_cap))
        .withColumn("level", level)
        .withColumn("capped", F.col("level") >= F.col("cap") / F.col("w"))
        .withColumn("final", F.min(F.when(~F.col("capped"), F.struct("rank", "level"))).over(everything)["level"])
        .select("skey", "source_size", F.when(F.col("capped") | F.col("final").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("final") * F.col("w"))).alias("target"))
    )
