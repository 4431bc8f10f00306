r"""WARC archives: writing, reading back and assembling captures.

Writing makes, for each page, a ``request``, a ``response`` (or ``revisit``) and
a ``metadata`` record; request and metadata name the capture's response or
revisit in ``WARC-Concurrent-To``. Of pages whose payloads are equal and at
least ``min_revisit`` bytes long, the one of largest id is the response and the
others are revisits that refer to it and carry no payload.

Files are written by Spark's text writer, one value per capture (the three
records, each closed by two CRLF), so they land wherever Spark can write; about
``file_bytes`` of payload go into a file. Reading takes ``binaryFile`` rows and
frames records by ``Content-Length``, never by looking for a separator, so a
payload may hold anything. Files are therefore to be at most 2 GB, as those
written here are.

``assemble`` joins the three kinds by capture id and gives one nested row per
capture. The join is one aggregation on that id, on which any record can be
missing; records of one capture that came in several files meet there. A
record's id is ``urn:strandline:<page id>:<kind>:<uuid>``, the uuid being the
row's; a revisit names its response by the part before the uuid.

Edge cases: a null payload is empty; a null url is empty; pages of null id are
written with an empty id and stay apart by row; repeated pages are separate
captures; an empty table writes no file and reads as no captures.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm._text import map_arrow
from strandline.storage import materialize, scratch_path

CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"
RECORD = "warc_type string, record_id string, concurrent_to string, refers_to string, target_uri string, date string, payload_digest string, payload binary, payload_bytes long, fields map<string,string>"
_ARROW = {"string": pa.string(), "binary": pa.binary(), "long": pa.int64(), "map<string,string>": pa.map_(pa.string(), pa.string())}


def _revisits(pages: DataFrame, min_revisit: int) -> DataFrame:
    """(digest, target): the largest id of each payload that several pages share."""
    long = pages.where(F.col("bytes") >= min_revisit)
    return long.groupBy("digest").agg(F.max("page_id").alias("target"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("d"), "target")


def _record(kind: str, record_id, block, *fields) -> F.Column:
    head = [F.lit(f"WARC/1.1{CRLF}WARC-Type: {kind}{CRLF}WARC-Record-ID: <"), record_id, F.lit(f">{CRLF}WARC-Date: {DATE}{CRLF}"), *fields]
    return F.concat(*head, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF + CRLF), block, F.lit(CRLF + CRLF))


def _field(name: str, *value) -> F.Column:
    return F.concat(F.lit(name + ": "), *value, F.lit(CRLF))


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", payload: str = "html", min_revisit: int = 1000, file_bytes: int = 32 << 20, compression: str = "gzip") -> None:
    """Write three records for each page to ``path``, in files of about ``file_bytes`` of payload."""
    body = F.coalesce(F.col(payload), F.lit(""))
    uri = F.regexp_replace(F.coalesce(F.col(url), F.lit("")), r"[\r\n]", "")
    rows = pages.select(F.col(page_id).alias("page_id"), uri.alias("url"), body.alias("body")).withColumns({"digest": F.sha1(F.encode("body", "UTF-8")), "bytes": F.octet_length("body").cast("long")})
    short = materialize(rows.select("page_id", "digest", "bytes"), "digests")
    shared = materialize(_revisits(short, min_revisit), "shared")
    total = short.agg(F.sum("bytes")).head()[0] or 0
    pages_a_file = max(1, file_bytes * short.count() // max(total, 1))
    joined = rows.join(shared, (F.col("digest") == F.col("d")) & (F.col("bytes") >= min_revisit), "left")
    dealt = joined.withColumns({"unique": F.uuid(), "is_revisit": F.col("target").isNotNull() & ~F.col("target").eqNullSafe(F.col("page_id"))})
    name = lambda part: F.concat(F.lit("urn:strandline:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(f":{part}:"), F.col("unique"))
    main = F.col("main")
    target, concurrent = _field("WARC-Target-URI", F.col("url")), _field("WARC-Concurrent-To", F.lit("<"), main, F.lit(">"))
    digest = _field("WARC-Payload-Digest", F.lit("sha1:"), F.col("digest"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF + CRLF))
    key = _field("X-Page-ID", F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    kind = lambda k: _field("Content-Type", F.lit(k))
    response = _record("response", main, F.concat(http, F.col("body")), target, digest, key, kind("application/http; msgtype=response"))
    profile = _field("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    revisit = _record("revisit", main, http, target, digest, key, profile, _field("WARC-Refers-To", F.lit("<urn:strandline:"), F.col("target").cast("string"), F.lit(":main>")), kind("application/http; msgtype=response"))
    request = _record("request", name("request"), F.lit(f"GET / HTTP/1.1{CRLF}{CRLF}"), target, concurrent, kind("application/http; msgtype=request"))
    metadata = _record("metadata", name("metadata"), F.lit(f"fetchTimeMs: 0{CRLF}"), target, concurrent, kind("application/warc-fields"))
    out = dealt.withColumn("main", name("main")).select(F.concat(request, F.when(F.col("is_revisit"), revisit).otherwise(response), metadata).alias("value"))
    last = F.expr("left(value, length(value) - 2)").alias("value")  # the writer ends each value with CRLF
    out.select(last).write.option("lineSep", CRLF).option("compression", compression).option("maxRecordsPerFile", pages_a_file).text(path)


_LENGTH = re.compile(rb"\r\ncontent-length:[ \t]*(\d+)", re.I)


def frame(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of one file: header fields (lower-case names) and block."""
    at = 0
    while True:
        at = data.find(b"WARC/", at)
        if at < 0:
            return
        head_end = data.index(b"\r\n\r\n", at)
        head = data[at:head_end]
        length = int(_LENGTH.search(head)[1])
        begin = head_end + 4
        if begin + length > len(data):
            raise ValueError(f"record at byte {at} needs {length} bytes of block, {len(data) - begin} are there")
        fields = {}
        for line in head.split(b"\r\n")[1:]:
            name, _, value = line.decode("utf-8").partition(":")
            fields[name.lower()] = value.strip()
        yield fields, data[begin : begin + length]
        at = begin + length


def _parsed(fields: dict[str, str], block: bytes) -> tuple:
    kind = fields.get("warc-type", "")
    bare = lambda k: fields.get(k, "").strip("<>") or None
    payload, size = block, len(block)
    if "application/http" in fields.get("content-type", ""):
        head, _, payload = block.partition(b"\r\n\r\n")
        size = len(payload)
        if kind == "revisit" and (m := _LENGTH.search(head)):
            size = int(m[1])
    digest = fields.get("warc-payload-digest", "").rpartition(":")[2].lower() or None
    if kind == "response":
        found = hashlib.sha1(payload).hexdigest()
        if digest and digest != found:
            raise ValueError(f"payload of {fields.get('warc-record-id')} doesn't have its digest")
        digest = found
    return kind, bare("warc-record-id"), bare("warc-concurrent-to"), bare("warc-refers-to"), fields.get("warc-target-uri"), fields.get("warc-date"), digest, payload, size, list(fields.items())


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of all files under ``path`` (``.gz`` or plain)."""
    arrow = pa.schema([(n, _ARROW[t]) for n, t in (f.split(" ") for f in RECORD.split(", "))])

    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                raw = data.as_buffer().to_pybytes()
                if raw[:2] == b"\x1f\x8b":
                    raw = _gunzip(raw)
                rows, size = [], 0
                for record in frame(raw):
                    rows.append(_parsed(*record))
                    size += len(record[1])
                    if size > 4 << 20 or len(rows) >= 2000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return map_arrow(spark.read.format("binaryFile").load(path).where("length > 0").select("content"), run, RECORD)


def _gunzip(raw: bytes) -> bytes:
    """All members of a gzip file."""
    out = []
    while raw:
        member = zlib.decompressobj(31)
        out.append(member.decompress(raw))
        raw = member.unused_data
    return b"".join(out)


def _met(records: DataFrame) -> DataFrame:
    """Flat columns of each capture, so that unused ones (payloads above all) never reach the shuffle."""
    main = F.col("warc_type").isin("response", "revisit")
    capture = F.when(main | F.col("concurrent_to").isNull(), F.col("record_id")).otherwise(F.col("concurrent_to"))
    pick = lambda on, c, prefix: F.first(F.when(on, F.col(c)), ignorenulls=True).alias(prefix + c)
    found = [pick(main, c, "response_") for c in MAIN]
    for kind in ("request", "metadata"):
        found += [pick(F.col("warc_type") == kind, c, kind + "_") for c in SIDE]
    return records.withColumns({"capture_id": capture, "page_key": F.element_at("fields", F.lit("x-page-id"))}).groupBy("capture_id").agg(*found)


MAIN = ("record_id", "warc_type", "refers_to", "target_uri", "date", "payload_digest", "payload_bytes", "payload", "page_key")
SIDE = ("record_id", "target_uri", "date", "payload")


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: capture_id and the structs request, response (or revisit) and metadata.

    Records meet through the id of the response or revisit: their own, or the one
    they are concurrent to. A record that names none, or names one that is absent,
    is a capture by itself with the others null.
    """
    nested = lambda kind, names: F.when(F.col(f"{kind}_record_id").isNotNull(), F.struct(*(F.col(f"{kind}_{c}").alias(c) for c in names))).alias(kind)
    return _met(records).select("capture_id", nested("request", SIDE), nested("response", MAIN), nested("metadata", SIDE))


def round_trip(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", min_revisit: int = 1000, file_bytes: int = 32 << 20) -> DataFrame:
    """Write ``pages``, read the archives back and give each capture's page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path, page_id, url, payload, min_revisit, file_bytes)
    captures = _met(read_archives(spark, path)).where(F.col("response_record_id").isNotNull())
    kind = pages.schema[page_id].dataType
    refers = F.regexp_extract("response_refers_to", r"^urn:strandline:(.*):main$", 1)
    return captures.select(
        F.when(F.col("response_page_key") != "", F.col("response_page_key")).cast(kind).alias("page_id"),
        F.col("response_payload_bytes").alias("payload_bytes"),
        F.col("response_payload_digest").alias("payload_digest"),
        F.col("response_warc_type").alias("record_type"),
        F.when(refers != "", refers).cast(kind).alias("refers_to"),
    )
