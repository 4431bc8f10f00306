"""Event streams made from the test tables, with faults by arithmetic.

Orders of one customer group form a stream: an object per order with a number, a
string, a date, an attribute, a reference to the customer, a boolean and a list of
line quantities. ``ordinal`` is computed from keys, so no row waits for another.
Faults: every 97th order lacks its object, every 89th repeats its total and its
identity, every 83rd refers to nobody, every 71st holds its lines in an object, every
61st adds a late header record, every 50th has no boolean for its boolean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline import wire
from strandline.operators import shape

GROUPS = 16
_FIRST = 10**9


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _stream(custkey: str) -> Column:
    return F.concat(F.lit("s"), (F.col(custkey) % GROUPS).cast("string"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVENTS of orders, lines and customers: one pass over orders exploded by slot, one join for lines."""
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    k = F.col("o_orderkey")
    base = F.concat(F.lit("$.o"), k.cast("string"))
    every = lambda n: k % n == 0
    total = F.col("o_totalprice").cast("decimal(18,2)").cast("string")

    def slot(n: int, kind, path: Column | None = None, value=None, identity=None, when=None, header: Column | None = None) -> Column:
        text = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("string")
        row = F.struct(F.lit(n).alias("slot"), text(path).alias("path"), text(header).alias("header"), text(kind).alias("kind"), text(value).alias("value"), text(identity).alias("identity"))
        return row if when is None else F.when(when, row)

    at = lambda tail: F.concat(base, F.lit(tail))
    target = F.concat(F.when(every(83), F.lit("$.gone")).otherwise(F.lit("$.c")), F.col("o_custkey").cast("string"))
    slots = F.array(
        slot(0, "ObjectNode", base, identity=F.when(every(89), F.lit("again")).otherwise(F.concat(F.lit("o-"), k.cast("string"))), when=~every(97)),
        slot(1, "NumberLiteral", at(".total"), total),
        slot(2, "StringLiteral", at(".status"), F.col("o_orderstatus")),
        slot(3, "DateLiteral", at(".date"), F.date_format("o_orderdate", "yyyy-MM-dd")),
        slot(4, "StringLiteral", at(".@.priority"), F.col("o_orderpriority")),
        slot(5, "PointerReference", at(".customer"), target),
        slot(6, "BooleanLiteral", at(".open"), F.when(every(50), "maybe").when(F.col("o_orderstatus") == "O", "true").otherwise("false")),
        slot(7, F.when(every(71), "ObjectNode").otherwise("ListNode"), at(".lines")),
        slot(8, "NumberLiteral", at(".total"), total, when=every(89)),
        slot(9, "StringLiteral", value=total, when=every(61), header=F.concat(F.lit(f'$.["{wire.HEADER_MEMBER_PREFIX}k'), k.cast("string"), F.lit('"]'))),
    )
    own = orders.select(_stream("o_custkey").alias("stream_id"), k.alias("k"), F.explode(F.filter(slots, lambda s: s.isNotNull())).alias("s"))
    own = own.select("stream_id", (F.lit(_FIRST) + F.col("k") * 100 + F.col("s.slot")).alias("ordinal"), "s.path", "s.header", "s.kind", "s.value", "s.identity")
    once = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity"))
    lines = once.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    items = lines.select(
        _stream("o_custkey").alias("stream_id"),
        (F.lit(_FIRST) + F.col("l_orderkey") * 100 + 20 + F.col("l_linenumber")).alias("ordinal"),
        F.concat(F.lit("$.o"), F.col("l_orderkey").cast("string"), F.lit(".lines["), (F.col("l_linenumber") - 1).cast("string"), F.lit("]")).alias("path"),
        F.lit(None).cast("string").alias("header"),
        F.lit("NumberLiteral").alias("kind"),
        F.col("l_quantity").cast("decimal(18,2)").cast("string").alias("value"),
        F.lit(None).cast("string").alias("identity"),
    )
    customers = _table(spark, sf_dir, "customer").select(
        _stream("c_custkey").alias("stream_id"),
        F.col("c_custkey").cast("long").alias("ordinal"),
        F.concat(F.lit("$.c"), F.col("c_custkey").cast("string")).alias("path"),
        F.lit(None).cast("string").alias("header"),
        F.lit("ObjectNode").alias("kind"),
        F.lit(None).cast("string").alias("value"),
        F.lit(None).cast("string").alias("identity"),
    )
    everything = own.unionByName(items).unionByName(customers)
    return shape.events(everything, **{c: F.col(c) for c in everything.columns})


def streams(spark: SparkSession) -> DataFrame:
    """STREAMS: even groups are complete, every fourth pair has the document projection."""
    n = F.col("id")
    return spark.range(GROUPS).select(
        F.concat(F.lit("s"), n.cast("string")).alias("stream_id"),
        F.when(n % 2 == 0, wire.COMPLETE_PROFILE).otherwise(wire.PARTIAL_PROFILE).alias("profile"),
        F.lit(True).alias("profile_explicit"),
        F.when(n % 4 < 2, wire.DOCUMENT_PROJECTION).alias("projection"),
        (n % 4 < 2).alias("projection_explicit"),
        F.lit(True).alias("canonical"),
    )


def small_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stream for each customer, without header records and repeats: many small valid-looking streams."""
    rows = events(spark, sf_dir).where("path is not null")
    own = F.coalesce(F.regexp_extract("path", r"^\$\.([oc][0-9]+)", 1), F.lit(""))
    return rows.withColumn("stream_id", own)


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' bytes under their origin; every 7th is filed under a wrong one."""
    docs = _table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select("doc_id", F.encode("text", "UTF-8").alias("bytes"))
    named = F.concat(F.lit("sha256:"), F.sha2(F.when(F.col("doc_id") % 7 == 0, F.concat("bytes", F.lit("x").cast("binary"))).otherwise(F.col("bytes")), 256))
    return docs.select("doc_id", named.alias("origin"), "bytes").dropDuplicates(["origin"])


def sourced_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two events of each document with a span of it; some spans are too long, some documents missing."""
    docs = _table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select("doc_id", F.encode("text", "UTF-8").alias("bytes"))
    size = F.octet_length("bytes")
    text = F.when(F.col("doc_id") % 7 == 0, F.concat("bytes", F.lit("x").cast("binary"))).when(F.col("doc_id") % 11 == 0, F.lit("absent").cast("binary")).otherwise(F.col("bytes"))
    parts = F.array(
        F.struct(F.lit(0).alias("i"), F.concat(F.lit("0:"), (F.floor(size / 2) + 1).cast("string")).alias("span")),
        F.struct(F.lit(1).alias("i"), F.concat(F.floor(size / 3).cast("string"), F.lit(":"), (size + F.col("doc_id") % 3).cast("string")).alias("span")),
    )
    rows = docs.select("doc_id", F.concat(F.lit("sha256:"), F.sha2(text, 256)).alias("origin"), F.explode(parts).alias("p"))
    return shape.events(
        rows,
        stream_id=F.concat(F.lit("d"), (F.col("doc_id") % 5).cast("string")),
        ordinal=F.col("doc_id") * 2 + F.col("p.i"),
        path=F.concat(F.lit("$.d"), F.col("doc_id").cast("string"), F.lit("_"), F.col("p.i").cast("string")),
        kind=F.lit("StringLiteral"),
        value=F.lit("x"),
        origin=F.col("origin"),
        span=F.col("p.span"),
    )
