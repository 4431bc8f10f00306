"""Vectorised word handling shared by the operators of this subpackage.

A batch of texts is one UTF-8 byte buffer with document offsets, as Arrow holds
it. Words, their hashes and the hashes of word windows are computed for a whole
buffer at once; buffers are cut at document bounds so that memory stays bounded
by ``CHUNK_BYTES`` or by the longest single document.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

CHUNK_BYTES = 1 << 20
#: Most bytes of a batch that Spark hands to a worker, unless the session sets its own bound.
BATCH_BYTES = 4 << 20
_BATCH_BOUND = "spark.sql.execution.arrow.maxBytesPerBatch"

#: Separators of `[^\x20\x09-\x0D]+`.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Separators of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
#: Byte to byte, A-Z to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_rng = np.random.Generator(np.random.PCG64(0x5EED))
BYTE_CODE = _rng.integers(1, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words with good avalanche (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=4)
def _powers(log2: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << log2
    up, down = np.full(n, _BASE, np.uint64), np.full(n, _INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _prefix(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = max(codes.size, 1)
    up, down = _powers(max(16, int(n).bit_length()))
    total = np.empty(codes.size + 1, np.uint64)
    total[0] = 0
    np.cumsum(codes * up[: codes.size], out=total[1:])
    return total, down


def span_hashes(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of ``codes[start:end]`` for each pair of bounds; equal content gives equal hashes."""
    total, down = _prefix(codes)
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))


class Texts:
    """Some documents: ``buf`` holds their bytes, document i spans ``offs[i]:offs[i+1]``."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, first: int, lower: bool = False):
        self.buf = LOWER[buf] if lower else buf
        self.offs, self.first, self.n = offs, first, len(offs) - 1

    def words(self, separators: np.ndarray = SPACE) -> Words:
        return Words(self, separators)

    def bytes_of(self, i: int) -> bytes:
        return self.buf[self.offs[i] : self.offs[i + 1]].tobytes()


class Words:
    """Words of some documents: byte bounds, document number and 64-bit hash of each.

    ``doc_start[i]:doc_start[i+1]`` are the words of document i.
    """

    def __init__(self, texts: Texts, separators: np.ndarray):
        buf, offs = texts.buf, texts.offs
        inside = np.zeros(buf.size + 1, bool)
        np.logical_not(separators[buf], out=inside[:-1])
        begins, ends = inside[:-1].copy(), inside[:-1].copy()
        begins[1:] &= ~inside[:-2]
        ends &= ~inside[1:]
        edge = offs[:-1][np.diff(offs) > 0]
        begins[edge] = inside[:-1][edge]
        last = offs[1:][np.diff(offs) > 0] - 1
        ends[last] = inside[:-1][last]
        self.texts, self.start, self.end = texts, np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.doc_start = np.searchsorted(self.start, offs)
        self.count = np.diff(self.doc_start)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.texts.n), self.count)

    def hashes(self) -> np.ndarray:
        return span_hashes(BYTE_CODE[self.texts.buf], self.start, self.end)

    def windows(self, codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Start (a word number) and hash of each run of k words that lies in one document."""
        at = window_starts(self.doc_start, k)
        return at, span_hashes(codes, at, at + k)


def window_starts(doc_start: np.ndarray, k: int) -> np.ndarray:
    n = int(doc_start[-1])
    if n < k:
        return np.zeros(0, np.int64)
    ok = np.ones(n, bool)
    tail = np.minimum(np.diff(doc_start), k - 1)
    ends = doc_start[1:]
    if tail.size:
        cut = np.zeros(n + 1, np.int32)
        np.add.at(cut, ends - tail, 1)
        np.add.at(cut, ends, -1)
        ok = np.cumsum(cut[:-1]) == 0
    return np.flatnonzero(ok)


def per_doc(values: np.ndarray, doc_start: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over each document, empty documents included."""
    total = np.zeros(len(values) + 1, values.dtype if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[doc_start[1:]] - total[doc_start[:-1]]


def cover(n: int, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    """Which of n positions lie in one of the spans."""
    mark = np.zeros(n + 1, np.int32)
    np.add.at(mark, start, 1)
    np.add.at(mark, start + length, -1)
    return np.cumsum(mark[:-1]) > 0


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    if keys.size == 0:
        return np.zeros(0, bool)
    order = np.argsort(keys)
    s = keys[order]
    same = s[1:] == s[:-1]
    flag = np.zeros(keys.size, bool)
    flag[1:] |= same
    flag[:-1] |= same
    out = np.empty(keys.size, bool)
    out[order] = flag
    return out


def distinct(keys: np.ndarray) -> np.ndarray:
    """The distinct values in rising order, by sorting (faster here than hashing, as ``np.unique`` does)."""
    s = np.sort(keys)
    return s[np.r_[True, s[1:] != s[:-1]]] if len(s) else s


def chunks(column: pa.Array, lower: bool = False, limit: int = CHUNK_BYTES) -> Iterator[Texts]:
    """Cut a string column at document bounds into pieces of about ``limit`` bytes; null is empty."""
    column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if len(column) == 0:
        return
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        j = min(j, len(column))
        yield Texts(whole[offs[i] : offs[j]], offs[i : j + 1] - offs[i], i, lower)
        i = j


def map_arrow(rows: DataFrame, run: Callable, schema: T.StructType | str) -> DataFrame:
    """``rows.mapInArrow(run, schema)`` in batches of bounded bytes, whose freed memory goes back to the system.

    Spark keeps workers for reuse; without that an idle one would hold the most that its partitions ever took.
    """
    spark = rows.sparkSession
    if _BATCH_BOUND not in spark.conf.getAll:
        spark.conf.set(_BATCH_BOUND, str(BATCH_BYTES))

    def releasing(batches):
        try:
            yield from run(batches)
        finally:
            _release()

    return rows.mapInArrow(releasing, schema)


def _release() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)
