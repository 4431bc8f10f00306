"""Files of encoded streams: one file for each stream, written by the tasks that hold them.

A file gets its name from the stream's id, is written beside it under a name of the task's
own and then renamed. So a task that runs again, after a lost executor or as a copy, puts
the same bytes under the same name, readers never meet half a file, and the driver handles
no list of files. ``_SUCCESS`` is written when all tasks have ended; after a failed job
files of ended tasks are there without it.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from strandline.config import Limits
from strandline.operators import ordered
from strandline.sources import text_format
from strandline.storage import materialize

#: Endings of the two formats' files.
TEXT_SUFFIX, BINARY_SUFFIX = ".telex", ".film"
_PREFIX, _MAX_NAME = "s-", 255
REFUSED = "FILE_NAME"


def file_name(stream_id: str, suffix: str) -> str:
    """Letters, digits and ``_.-`` stand for themselves, other bytes are ``~xx``; no store needs to escape such a name."""
    return _PREFIX + quote(stream_id, safe="").replace("~", "%7E").replace("%", "~") + suffix


def stream_id(path: Column) -> Column:
    """The id behind the path of a file that ``write`` made; null for other files."""
    name = F.regexp_extract(path, rf"/({_PREFIX}[^/]*?)\.[a-z]+(?:\.gz)?$", 1)
    return F.when(name != "", F.url_decode(F.translate(F.substring(name, len(_PREFIX) + 1, _MAX_NAME), "~", "%")))


@dataclass
class _Written(WriterCommitMessage):
    files: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, suffix: str):
        self.path, self.suffix = path, suffix

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        fs, root = FileSystem.from_uri(self.path)
        fs.create_dir(root, recursive=True)
        mine, files = uuid.uuid4().hex, 0
        for batch in iterator:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                draft = f"{root}/_{mine}"
                with fs.open_output_stream(draft) as out:
                    out.write(data.as_buffer())
                fs.move(draft, f"{root}/{file_name(name, self.suffix)}")
                files += 1
        return _Written(files)

    def commit(self, messages: list) -> None:
        fs, root = FileSystem.from_uri(self.path)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/_SUCCESS"):
            pass


class _StreamFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "strandline_files"

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], self.options["suffix"])


def write(encoded: DataFrame, path: str) -> DataFrame:
    """Write the streams of a format's ``encode`` under ``path`` (a folder, on any store pyarrow knows).

    Streams of rows (stream_id, text or bytes, error) without an error become files; those
    that are there already are replaced. Returns (stream_id, error) of the others: refused by
    the encoder, or without an id or with one too long for a file's name (``FILE_NAME``).
    """
    text = "text" in encoded.columns
    suffix = TEXT_SUFFIX if text else BINARY_SUFFIX
    data = F.encode("text", "UTF-8") if text else F.col("bytes")
    named = F.coalesce(3 * F.octet_length("stream_id") <= _MAX_NAME - len(_PREFIX + suffix), F.lit(False))
    error = F.coalesce("error", F.when(~named, REFUSED))
    rows = materialize(encoded.select("stream_id", data.alias("bytes"), error.alias("error")), "encoded")
    encoded.sparkSession.dataSource.register(_StreamFiles)
    good = rows.where("error is null").select("stream_id", "bytes")
    good.write.format(_StreamFiles.name()).option("suffix", suffix).mode("append").save(path)
    return rows.where("error is not null").select("stream_id", "error")


def write_pieces(pieces: DataFrame, path: str, limits: Limits = Limits(), compression: str | None = None) -> DataFrame:
    """Write texts that come as ``text_format.pieces`` under ``path``; no text is held as a whole.

    With ``compression="gzip"`` files end in ``.gz``. Returns (stream_id, error) as ``write`` does;
    a limit that a text turns out to exceed takes back its file.
    """
    suffix = TEXT_SUFFIX + (".gz" if compression else "")
    named = F.coalesce(3 * F.octet_length("stream_id") <= _MAX_NAME - len(_PREFIX + suffix), F.lit(False))
    rows = ordered.by_stream(pieces.withColumns({"named": named, "flag": text_format.long_line(limits)}), "part", "ordinal", "text")

    def run(batches):
        fs, root = FileSystem.from_uri(path)
        fs.create_dir(root, recursive=True)
        draft, current, out = f"{root}/_{uuid.uuid4().hex}", None, None
        names = ["stream_id", "error", "pieces", "bytes", "flagged"]
        kinds = pa.schema(list(zip(names, (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_()), strict=True)))

        def close():
            if out is not None:
                out.close()
                why = None if current["named"] else REFUSED
                over = current["pieces"] - 2 > limits.max_events or current["bytes"] > limits.max_input_bytes or current["flagged"]
                if why is None and not over:
                    fs.move(draft, f"{root}/{file_name(current['stream_id'], suffix)}")
                else:
                    fs.delete_file(draft)
                yield pa.RecordBatch.from_pylist([{k: current[k] for k in ("stream_id", "pieces", "bytes", "flagged")} | {"error": why}], schema=kinds)

        for batch in batches:
            offsets, data = ordered.raw(batch.column("text"))
            for name, a, b in ordered.runs(batch.column("stream_id")):
                if current is None or name != current["stream_id"]:
                    yield from close()
                    current = {"stream_id": name, "named": batch.column("named")[a].as_py(), "pieces": 0, "bytes": 0, "flagged": False}
                    out = fs.open_output_stream(draft, compression=compression)
                out.write(data[offsets[a] : offsets[b]])
                current["pieces"] += b - a
                current["bytes"] += int(offsets[b] - offsets[a])
                current["flagged"] = current["flagged"] or any(batch.column("flag").slice(a, b - a).to_pylist())
        yield from close()

    told = "stream_id string, error string, pieces long, bytes long, flagged boolean"
    done = materialize(rows.select("stream_id", "named", "flag", "text").mapInArrow(run, told), "written")
    fs, root = FileSystem.from_uri(path)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/_SUCCESS"):
        pass
    error = F.coalesce(text_format.over_limits(F.col("pieces"), F.col("bytes"), F.col("flagged"), limits), "error")
    return done.select("stream_id", error.alias("error")).where("error is not null")


#: A pack is entries (length of the id, length of the bytes, id, bytes), all compressed as one.
_ENTRY = "<IQ"
_PACK, _BLOCK = ".pack.gz", 1 << 20


def write_packs(encoded: DataFrame, path: str) -> DataFrame:
    """Write the streams of the binary ``encode`` under ``path``, a pack for each task that has any.

    For streams that are many and small, of which each as a file would take a block of the disk. Returns
    (stream_id, error) of the streams that the encoder refused and of those without an id (``FILE_NAME``).
    Packs get their name when all tasks have ended, so a task that runs again leaves none twice.
    """

    def run(batches):
        fs, root = FileSystem.from_uri(path)
        fs.create_dir(root, recursive=True)
        kinds = pa.schema([("stream_id", pa.string()), ("error", pa.string()), ("pack", pa.string())])
        mine, out, buffer = uuid.uuid4().hex, None, bytearray()
        for batch in batches:
            left = []
            for name, data, error in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if error is not None or name is None:
                    left.append({"stream_id": name, "error": error or REFUSED, "pack": None})
                    continue
                key = name.encode()
                buffer += struct.pack(_ENTRY, len(key), len(data)) + key
                buffer += data
                if len(buffer) >= _BLOCK:
                    out = out or fs.open_output_stream(f"{root}/_{mine}", compression="gzip")
                    out.write(bytes(buffer))
                    buffer.clear()
            if left:
                yield pa.RecordBatch.from_pylist(left, schema=kinds)
        if buffer:
            out = out or fs.open_output_stream(f"{root}/_{mine}", compression="gzip")
            out.write(bytes(buffer))
        if out:
            out.close()
            yield pa.RecordBatch.from_pylist([{"stream_id": None, "error": None, "pack": mine}], schema=kinds)

    done = materialize(encoded.select("stream_id", "bytes", "error").mapInArrow(run, "stream_id string, error string, pack string"), "packed")
    fs, root = FileSystem.from_uri(path)
    fs.create_dir(root, recursive=True)
    for row in done.where("pack is not null").select("pack").collect():  # one a task
        fs.move(f"{root}/_{row.pack}", f"{root}/{row.pack}{_PACK}")
    with fs.open_output_stream(f"{root}/_SUCCESS"):
        pass
    return done.where("pack is null").select("stream_id", "error")


def read_packs(spark: SparkSession, path: str) -> DataFrame:
    """(stream_id, bytes) of the streams in the packs under ``path``, read entry by entry."""

    def run(batches):
        def table(rows: list[tuple[str, bytes]]) -> pa.RecordBatch:
            ids, blobs = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(blobs, pa.binary())], names=["stream_id", "bytes"])

        for batch in batches:
            for name in batch.column(0).to_pylist():
                fs, at = FileSystem.from_uri(_uri(name))
                with fs.open_input_stream(at, compression="gzip") as raw, io.BufferedReader(raw, _BLOCK) as file:
                    rows, size = [], 0
                    while head := file.read(struct.calcsize(_ENTRY)):
                        key, n = struct.unpack(_ENTRY, head)
                        stream, data = file.read(key), file.read(n)
                        if len(stream) < key or len(data) < n:
                            raise EOFError(f"{name} ends within an entry")
                        rows.append((stream.decode(), data))
                        size += n
                        if size >= _BLOCK or len(rows) >= 10_000:
                            yield table(rows)
                            rows, size = [], 0
                    if rows:
                        yield table(rows)

    listed = spark.read.format("binaryFile").option("pathGlobFilter", f"*{_PACK}").load(path).select("path")
    return listed.mapInArrow(run, "stream_id string, bytes binary")


def _uri(name: str) -> str:
    return name.replace("file:/", "file:///", 1) if name.startswith("file:/") and not name.startswith("file://") else name


def digests(spark: SparkSession, path: str, algorithm: str = "md5") -> DataFrame:
    """(path, digest) of the content of the files under ``path``, read block by block; ``.gz`` ones are unpacked."""

    def run(batches):
        for batch in batches:
            found = []
            for name in batch.column(0).to_pylist():
                fs, at = FileSystem.from_uri(_uri(name))
                state = hashlib.new(algorithm)
                with fs.open_input_stream(at, compression="detect") as file:
                    while block := file.read(1 << 20):
                        state.update(block)
                found.append(state.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["path", "digest"])

    listed = spark.read.format("binaryFile").load(path).select("path")
    return listed.mapInArrow(run, "path string, digest string")
