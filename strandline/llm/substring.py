r"""Removal of word passages that repeat across documents, found by recompression.

Words are ``[^\x20\x09-\x0D]+``. Recompression rewrites the word sequence of a
document in rounds: maximal runs of one symbol get a name, then every pair whose
first symbol falls in the left and whose second falls in the right half of the
alphabet gets a name. A name is the hash of what it stands for, so the rounds
name runs and pairs alike on every executor and need no shuffle of their own.

Each symbol carries its context: the word range that decides that it is there
(its own words and the neighbours the rounds looked at). Where two texts agree
on that range they have the same symbol. A window of ``window`` words picks, of
all symbols whose context it contains, the one of least hash; that choice
depends on the window alone, so equal windows pick equal symbols. (A window
without such a symbol, as inside a long run, stands for itself.) The picked
symbols, about one for twenty words, are all that the search shuffles:

1. Documents with equal word sequences are found by digest; all but the least id
   lose every word (if they have a window) and take no part in the rest.
2. Picked symbols are counted by least and greatest id; those of two ids or more
   mark the windows that may repeat.
3. Only those windows are compared, by a 128-bit hash of their words, again by
   least and greatest id. Windows that start in a smaller id mark their words.

Sums combine before each shuffle; joins on keys that many documents share run
against written tables, where adaptive execution can split a skewed key.

Edge cases: a null text has no words; a document with a null id neither loses
words nor makes others lose them; rows of equal id don't affect each other;
repeated rows all get the same result; shorter documents than a window stay
whole; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm._text import SPACE, chunks, cover, distinct, map_arrow, mix, span_hashes, window_starts
from strandline.storage import materialize

#: Rounds of pair naming; in those of ``RUN_ROUNDS`` runs are named first.
ROUNDS, RUN_ROUNDS = 3, (0, 2)
#: Low bits of an order value hold the symbol's place in its chunk.
_LOW = np.uint64((1 << 28) - 1)


def recompress(codes: np.ndarray, doc_start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of the symbols after all rounds and the word range [lo, hi) of each one's context.

    A context that reaches a document's end is one word longer there, so that no
    window contains it.
    """
    doc = np.repeat(np.arange(len(doc_start) - 1), np.diff(doc_start))
    names, lo, hi = codes.copy(), np.arange(len(codes)), np.arange(1, len(codes) + 1)
    for r in range(ROUNDS):
        if r in RUN_ROUNDS and len(names):
            names, lo, hi, doc = _name_runs(names, lo, hi, doc, doc_start)
        if len(names):
            names, lo, hi, doc = _name_pairs(names, lo, hi, doc, doc_start, r)
    return names, lo, hi


def _neighbours(lo, hi, doc, doc_start):
    """Context bounds of the symbol before and after each; one word outside at a document's end."""
    before, after = np.empty_like(lo), np.empty_like(hi)
    before[1:], after[:-1] = lo[:-1], hi[1:]
    first, last = np.r_[True, doc[1:] != doc[:-1]], np.r_[doc[1:] != doc[:-1], True]
    before[first] = doc_start[doc[first]] - 1
    after[last] = doc_start[doc[last] + 1] + 1
    return before, after, last


def _name_runs(names, lo, hi, doc, doc_start):
    before, after, _ = _neighbours(lo, hi, doc, doc_start)
    head = np.flatnonzero(np.r_[True, (names[1:] != names[:-1]) | (doc[1:] != doc[:-1])])
    tail = np.r_[head[1:], len(names)] - 1
    length = (tail - head + 1).astype(np.uint64)
    out = names[head]
    long = length > 1
    out[long] = mix(out[long] ^ mix(length[long] + np.uint64(0xA5A5)))
    return out, before[head], after[tail], doc[head]


def _name_pairs(names, lo, hi, doc, doc_start, r):
    before, after, last = _neighbours(lo, hi, doc, doc_start)
    left = mix(names + np.uint64(0x9E37 + r)) >> np.uint64(63) == 0
    paired = np.zeros(len(names), bool)
    paired[:-1] = left[:-1] & ~left[1:] & ~last[:-1]
    gone = np.r_[False, paired[:-1]]
    out = names.copy()
    at = np.flatnonzero(paired)
    out[at] = mix(names[at] * np.uint64(0x9E3779B97F4A7C15) + mix(names[at + 1] + np.uint64(r + 1)))
    # a left symbol looked at its successor, an unpaired right one at its predecessor
    new_lo, new_hi = np.where(left, lo, before), np.where(left, after, hi)
    keep = ~gone
    return out[keep], new_lo[keep], new_hi[keep], doc[keep]


def window_anchors(codes: np.ndarray, doc_start: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """First word of each window of k words and the key of the symbol that it picks."""
    at = window_starts(doc_start, k)
    if not len(at):
        return at, np.zeros(0, np.uint64)
    names, lo, hi = recompress(codes, doc_start)
    inside = (lo >= 0) & (hi <= len(codes))
    key = np.zeros(len(names), np.uint64)
    key[inside] = span_hashes(codes, lo[inside], hi[inside])
    a, b = np.searchsorted(lo, at, "left"), np.searchsorted(hi, at + k, "right")
    order = (mix(names) & ~_LOW) | np.arange(len(names), dtype=np.uint64)
    out = np.empty(len(at), np.uint64)
    none = b <= a
    out[none] = mix(span_hashes(codes, at[none], at[none] + k))
    size = np.maximum(b - a, 1)
    level = np.frexp(size)[1] - 1
    table = order
    for j in range(int(level.max()) + 1):
        mine = np.flatnonzero(~none & (level == j))
        picked = np.minimum(table[a[mine]], table[b[mine] - (1 << j)])
        out[mine] = key[(picked & _LOW).astype(np.int64)]
        step = 1 << j
        if len(table) > step:
            table = np.minimum(table[:-step], table[step:])
    return at, out


def _i64(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _anchor_rows(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, th, n_words, digest, anchors): the digest and the distinct picked symbols of each document."""
    schema = T.StructType([docs.schema["doc_id"], docs.schema["th"], T.StructField("n_words", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("anchors", T.ArrayType(T.LongType()))])

    def run(batches):
        for batch in batches:
            for part in chunks(batch.column(2)):
                w = part.words(SPACE)
                at, key = window_anchors(w.hashes(), w.doc_start, k)
                bounds = np.searchsorted(at, w.doc_start)
                lists = [distinct(key[a:b]).view(np.int64) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                digest = [hashlib.sha256(b" ".join(part.bytes_of(i).split())).digest()[:16] for i in range(part.n)]
                size = np.cumsum([0, *map(len, lists)])
                anchors = pa.ListArray.from_arrays(pa.array(size, pa.int32()), pa.array(np.concatenate([*lists, np.zeros(0, np.int64)])))
                rows = batch.slice(part.first, part.n)
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(w.count, pa.int64()), pa.array(digest, pa.binary()), anchors], names=schema.names)

    return map_arrow(docs, run, schema)


def _window_rows(docs: DataFrame, k: int) -> DataFrame:
    """(w1, w2, doc_id, th, pos) for each window that picked a symbol of the document's list ``keys``."""
    schema = T.StructType([T.StructField("w1", T.LongType()), T.StructField("w2", T.LongType()), docs.schema["doc_id"], docs.schema["th"], T.StructField("pos", T.IntegerType())])

    def run(batches):
        for batch in batches:
            for part in chunks(batch.column(2), limit=1 << 20):
                rows = batch.slice(part.first, part.n)
                w = part.words(SPACE)
                codes = w.hashes()
                at, key = window_anchors(codes, w.doc_start, k)
                doc = np.searchsorted(w.doc_start, at, "right") - 1
                lists = rows.column(3)
                size = np.diff(lists.offsets.to_numpy())
                wanted = lists.flatten().to_numpy().view(np.uint64) ^ mix(np.repeat(np.arange(part.n), size).astype(np.uint64))
                hit = np.isin(key ^ mix(doc.astype(np.uint64)), wanted)
                at, doc = at[hit], doc[hit]
                if not len(at):
                    continue
                take = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [_i64(span_hashes(codes, at, at + k)), _i64(span_hashes(mix(codes), at, at + k)), rows.column(0).take(take), rows.column(1).take(take), pa.array(at - w.doc_start[doc], pa.int32())],
                    names=schema.names,
                )

    return map_arrow(docs, run, schema)


def find_repeats(docs: DataFrame, window: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, th, starts, whole): the repeated windows of each document that has some.

    ``th`` tells rows of one id with different texts apart; ``whole`` marks copies
    of which every word repeats.
    """
    keyed = _keyed(docs, doc_id, text)
    rows = materialize(_anchor_rows(keyed, window), "anchors")
    owners = materialize(
        rows.where(F.col("n_words") >= window).groupBy("digest").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("most")).where("owner < most").select(F.col("digest").alias("d"), "owner"), "owners"
    )
    copy = F.coalesce(F.col("owner") < F.col("doc_id"), F.lit(False))
    marked = rows.where(F.col("doc_id").isNotNull()).join(owners, F.col("digest") == F.col("d"), "left").select("doc_id", "th", "anchors", copy.alias("whole"))
    marked = materialize(marked, "marked")
    copies = marked.where("whole").select("doc_id", "th").distinct()

    anchors = marked.where(~F.col("whole")).select("doc_id", "th", F.explode("anchors").alias("key"))
    shared = materialize(anchors.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("key"), "shared")
    wanted = anchors.join(shared, "key").groupBy("doc_id", "th").agg(F.collect_set("key").alias("keys"))
    wanted = materialize(wanted, "wanted")

    windows = materialize(_window_rows(keyed.join(wanted, ["doc_id", "th"]).select("doc_id", "th", "text", "keys"), window), "windows")
    first = materialize(windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("w1", "w2", "a"), "first")
    starts = windows.join(first, ["w1", "w2"]).where("doc_id > a").groupBy("doc_id", "th").agg(F.collect_set("pos").alias("starts"))
    return starts.select("doc_id", "th", "starts", F.lit(False).alias("whole")).unionByName(copies.select("doc_id", "th", F.lit(None).cast("array<int>").alias("starts"), F.lit(True).alias("whole")))


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(docs[doc_id].alias("doc_id"), F.xxhash64(docs[doc_id], docs[text]).alias("th"), docs[text].alias("text"))


def _annotated(docs: DataFrame, window: int, doc_id: str, text: str) -> DataFrame:
    found = materialize(find_repeats(docs, window, doc_id, text), "repeats").toDF("__id", "__th", "__starts", "__whole")
    on = (F.xxhash64(docs[doc_id], docs[text]) == F.col("__th")) & (docs[doc_id] == F.col("__id"))
    return docs.join(found, on, "left").select(*(docs[c] for c in docs.columns), "__starts", "__whole")


def _split(data: bytes, starts: list[int] | None, whole: bool | None, window: int) -> tuple[int, int, list[bytes]]:
    """Number of words, number removed, words kept."""
    words = data.split()
    if whole:
        return len(words), len(words), []
    if not starts:
        return len(words), 0, words
    gone = cover(len(words), np.asarray(starts), window)
    return len(words), int(gone.sum()), [words[i] for i in np.flatnonzero(~gone)]


def digest_kept(docs: DataFrame, window: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 (kept words joined by one space)."""
    rows = _annotated(docs.select(doc_id, text), window, doc_id, text)
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])

    def run(batches):
        for batch in batches:
            starts, whole = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for part in chunks(batch.column(1)):
                at = range(part.first, part.first + part.n)
                out = [_split(part.bytes_of(i - part.first), starts[i], whole[i], window) for i in at]
                sha = [hashlib.sha256(b" ".join(kept)).hexdigest() for _, _, kept in out]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.first, part.n), pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array(sha)], names=schema.names)

    return map_arrow(rows, run, schema)


def remove_repeats(docs: DataFrame, window: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without repeated passages: kept words joined by one space where words went.

    Texts that lose nothing stay as they are; a document that loses every word loses its row.
    """
    rows = _annotated(docs, window, doc_id, text)
    names = docs.columns
    at, n = names.index(text), len(names)

    def run(batches):
        for batch in batches:
            starts, whole = batch.column(n).to_pylist(), batch.column(n + 1).to_pylist()
            texts, keep = batch.column(at).to_pylist(), []
            for i, old in enumerate(texts):
                _, removed, kept = _split(old.encode(), starts[i], whole[i], window) if starts[i] or whole[i] else (0, 0, [])
                keep.append(not removed or bool(kept))
                if removed:
                    texts[i] = b" ".join(kept).decode()
            columns = [pa.array(texts, c.type) if j == at else c for j, c in enumerate(batch.columns[:n])]
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep))

    return map_arrow(rows, run, docs.schema)
