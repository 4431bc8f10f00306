r"""Language-model scores: prediction by partial matching over bytes, and a word unigram base.

Texts are lower-cased (A-Z) and cut into words ``[^\x20\x09-\x0D]+``; a text's
symbols are the bytes of its words, one space between words and one end symbol
(byte 0x0A, which no word contains). Both models give the probability of that
word sequence.

The trie holds, for each context of up to ``ORDER`` preceding bytes, how often
each symbol followed in all training documents. Only the deepest level is
counted and shuffled (a context and its symbol packed into 64 bits, summed per
batch and again before the shuffle); every shallower level is its sum. A text
starts with ``ORDER`` start bytes (0x0D) as context.

A symbol's probability comes from its longest known context by escape method C:
``count / (total + distinct)``, escape ``distinct / (total + distinct)``. After
an escape, symbols seen in the longer context are excluded. As they are a subset
of those seen in the shorter one, the excluded mass is one number per context,
found when the trie is built. Below the empty context all bytes not seen there are
equally likely. Probabilities of a context thus sum to 1 over the 256 bytes.

Scoring joins. Documents are packed into chunks of about ``chunk_bytes``, one
compressed row each; each chunk gives its distinct grams and tokens once, with their
counts in training. Their sums are the model's counts, and every distinct gram
of the corpus, seen in training or not, gets its log10 probability by joins with
the trie. These values go back, packed, to the chunks that asked, where the documents
add them up. Nothing of the model passes the driver or is broadcast but the
orders of bounded size (up to 256 nodes or 65,536 contexts); a worker holds one
chunk (or one longer text) and its distinct grams.

Edge cases: a null or empty text has no words, only the end; a null id hashes as
the empty string; repeated rows are learnt from and scored as often as they
stand there; without training rows, all bytes are equally likely; a long text
is a chunk by itself; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm._text import SPACE, Texts, chunks, distinct, map_arrow
from strandline.storage import drop, materialize

ORDER = 5
END, START, GAP = 0x0A, 0x0D, 0x20
#: Hash of the end token in the unigram counts.
END_TOKEN = -1


def symbols(texts: Texts) -> tuple[np.ndarray, np.ndarray, object]:
    """Bytes of the normalised texts, each ``ORDER`` starts, the words, the end; their bounds; and the words."""
    w = texts.words(SPACE)
    size = w.end - w.start
    doc = w.doc
    first = np.zeros(len(size), bool)
    first[w.doc_start[:-1][w.count > 0]] = True
    room = size + ~first  # a gap before each word but the first of a text
    bounds = np.zeros(texts.n + 1, np.int64)
    chars = np.bincount(doc, room, minlength=texts.n).astype(np.int64) if len(doc) else np.zeros(texts.n, np.int64)
    bounds[1:] = np.cumsum(chars + ORDER + 1)
    out = np.full(int(bounds[-1]), START, np.uint8)
    out[bounds[1:] - 1] = END
    if len(size):
        before = np.cumsum(room) - room
        base = bounds[doc] + ORDER + before - np.repeat(before[w.doc_start[:-1][w.count > 0]], w.count[w.count > 0])
        to = base + ~first
        out[base[~first]] = GAP
        at = np.repeat(to - (np.cumsum(size) - size), size) + np.arange(size.sum())
        out[at] = texts.buf[np.repeat(w.start - (np.cumsum(size) - size), size) + np.arange(size.sum())]
    return out, bounds, w


def grams(out: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Context and symbol of each scored byte packed into 48 bits, the symbol lowest; document bounds of these."""
    n = len(out) - ORDER
    packed = np.zeros(max(n, 0), np.uint64)
    for i in range(ORDER + 1):
        packed = packed << np.uint64(8) | out[i : i + n]
    scored = np.ones(len(out), bool)
    for i in range(ORDER):
        scored[bounds[:-1] + i] = False
    return packed[scored[ORDER:]], bounds - ORDER * np.arange(len(bounds))


def held_out_column(doc_id, modulus: int = 7, remainder: int = 2):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def _chunked(rows: DataFrame, chunk_bytes: int) -> DataFrame:
    """(chunk, docs): ``rows`` (doc_id, held_out, text) packed into compressed Arrow streams of about ``chunk_bytes`` of text."""
    schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("docs", T.BinaryType())])

    def packed(number, parts):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, parts[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))) as out:
            for part in parts:
                out.write_batch(part)
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=schema.names)

    def run(batches):
        parts, size, number = [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            length = pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            total, a = np.cumsum(length), 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + chunk_bytes - size, "right")))
                parts.append(batch.slice(a, b - a))
                size += int(length[a:b].sum())
                a = b
                if size >= chunk_bytes or a < batch.num_rows:
                    yield packed(number, parts)
                    parts, size, number = [], 0, number + 1
        if parts:
            yield packed(number, parts)

    return map_arrow(rows, run, schema)


def _documents(packed: bytes) -> Iterator[pa.RecordBatch]:
    with pa.ipc.open_stream(packed) as stream:
        yield from stream


def _pack(keys: np.ndarray, values: np.ndarray) -> bytes:
    """Keys in rising order, as differences, and the number of each one's value among the distinct ones, by planes of bytes; then these values."""
    gaps = np.diff(keys, prepend=keys.dtype.type(0))
    some, place = np.unique(values, return_inverse=True)
    planes = [x.view(np.uint8).reshape(len(keys), -1).T.tobytes() for x in (gaps, place.astype(np.uint32))]
    return pa.compress(b"".join([*planes, some.tobytes()]), codec="zstd", asbytes=True) + len(some).to_bytes(4, "little")


def _unpack(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    size = int.from_bytes(data[-4:], "little")
    raw = np.frombuffer(pa.decompress(data[:-4], 12 * n + 8 * size, codec="zstd", asbytes=True), np.uint8)
    gaps, place = (np.ascontiguousarray(x.reshape(-1, n).T).reshape(-1) for x in (raw[: 8 * n], raw[8 * n : 12 * n]))
    return np.cumsum(gaps.view(np.uint64), dtype=np.uint64), raw[12 * n :].view(np.float64)[place.view(np.uint32)]


def _packed_values(rows: DataFrame, limit: int = 1 << 20) -> DataFrame:
    """(chunk, kind, n, packed): the rows (chunk, kind, key, value), those of a chunk packed together as far as one task meets them."""
    schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("kind", T.ByteType()), T.StructField("n", T.IntegerType()), T.StructField("packed", T.BinaryType())])

    def flush(held):
        chunk, kind, key, value = (np.concatenate([h.column(i).to_numpy(zero_copy_only=False) for h in held]) for i in range(4))
        key = key.view(np.uint64)
        order = np.lexsort((key, kind, chunk))
        chunk, kind, key, value = chunk[order], kind[order], key[order], value[order]
        edge = np.flatnonzero(np.r_[True, (chunk[1:] != chunk[:-1]) | (kind[1:] != kind[:-1])])
        ends = np.r_[edge[1:], len(key)]
        data = [_pack(key[a:b], value[a:b]) for a, b in zip(edge, ends, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(chunk[edge]), pa.array(kind[edge]), pa.array(ends - edge, pa.int32()), pa.array(data, pa.binary())], names=schema.names)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= limit:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)

    return map_arrow(rows, run, schema)


def _counted(keys: np.ndarray, learnt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and how many of each are ``learnt``."""
    seen = np.sort(keys[learnt])
    lead = np.flatnonzero(np.r_[True, seen[1:] != seen[:-1]][: len(seen)])
    rest = distinct(keys[~learnt])
    return _merged([(seen[lead], np.diff(np.r_[lead, len(seen)])), (rest, np.zeros(len(rest), np.int64))])


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of equal keys added up."""
    parts = [p for p in parts if len(p[0])] or parts[:1]
    if len(parts) == 1:
        return parts[0]
    keys, n = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    lead = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[lead], np.add.reduceat(n[order], lead)


class _Tally:
    """Counts of one chunk, merged as they come."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, learnt: np.ndarray) -> None:
        self.parts.append(_counted(keys, learnt))
        self.size += len(self.parts[-1][0])
        if self.size > 2 * len(self.parts[0][0]) + (1 << 20):
            self.parts = [_merged(self.parts)]
            self.size = len(self.parts[0][0])

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        out = _merged(self.parts)
        self.parts, self.size = [], 0
        return out


def _entries(texts: DataFrame) -> DataFrame:
    """(chunk, kind, key, n): the distinct tokens (kind 0, by hash) and grams (kind 1) of each chunk, n times in training."""
    schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("kind", T.ByteType()), T.StructField("key", T.LongType()), T.StructField("n", T.LongType())])

    def rows_of(chunk, tallies):
        for kind, tally in enumerate(tallies):
            keys, n = tally.take()
            for a in range(0, len(keys), 1 << 16):
                k = keys[a : a + (1 << 16)].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), chunk)), pa.array(np.full(len(k), kind, np.int8)), pa.array(k), pa.array(n[a : a + len(k)])], names=schema.names)

    def run(batches):
        for batch in batches:
            for number, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tallies = _Tally(), _Tally()
                for docs in _documents(packed.as_buffer()):
                    learnt = ~docs.column(1).to_numpy(zero_copy_only=False)
                    for part in chunks(docs.column(2), lower=True):
                        of = learnt[part.first : part.first + part.n]
                        out, bounds, w = symbols(part)
                        ends = np.full(part.n, END_TOKEN, np.int64).view(np.uint64)
                        tallies[0].add(np.concatenate([w.hashes(), ends]), np.concatenate([of[w.doc], of]))
                        packed_grams, at = grams(out, bounds)
                        tallies[1].add(packed_grams, np.repeat(of, np.diff(at)))
                yield from rows_of(number, tallies)

    return map_arrow(texts, run, schema)


def _levels(deepest: DataFrame) -> DataFrame:
    """(order, ctx, sym, n) for all levels of the trie."""
    sym, ctx = F.col("key").bitwiseAND(F.lit(255).cast("long")), F.shiftrightunsigned("key", 8)
    level = deepest.select(F.lit(ORDER).alias("order"), ctx.alias("ctx"), sym.alias("sym"), "n")
    out = level
    for order in range(ORDER - 1, -1, -1):
        mask = (1 << (8 * order)) - 1
        level = level.groupBy(F.col("ctx").bitwiseAND(F.lit(mask).cast("long")).alias("ctx"), "sym").agg(F.sum("n").alias("n")).select(F.lit(order).alias("order"), "ctx", "sym", "n")
        out = out.unionByName(level)
    return out


def trie(deepest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (order, ctx, sym, n) and contexts (order, ctx, total, distinct, mass).

    ``mass`` is what the parent context (one byte shorter) has counted of the
    symbols seen in this one.
    """
    nodes = materialize(_levels(deepest), "levels")
    parent = nodes.select((F.col("order") + 1).alias("order"), F.col("ctx").alias("pctx"), "sym", F.col("n").alias("pn"))
    mask = F.expr("shiftleft(1L, cast(8 * (order - 1) as int)) - 1")
    with_parent = nodes.withColumn("pctx", F.when(F.col("order") > 0, F.col("ctx").bitwiseAND(mask)).otherwise(F.lit(0)))
    joined = with_parent.join(parent, ["order", "pctx", "sym"], "left")
    contexts = joined.groupBy("order", "ctx").agg(F.sum("n").alias("total"), F.count("*").alias("distinct"), F.coalesce(F.sum("pn"), F.lit(0)).alias("mass"))
    return nodes, materialize(contexts, "contexts")


def _shorter(order: int) -> Column:
    """The context of a gram, cut to its last ``order`` bytes."""
    return F.shiftrightunsigned("key", 8).bitwiseAND(F.lit((1 << (8 * order)) - 1).cast("long"))


def log_probabilities(counts: DataFrame, nodes: DataFrame, contexts: DataFrame) -> DataFrame:
    """(key, value): log10 of the probability of each gram; ``counts`` has (key, n), n being 0 for grams unseen in training."""
    sym = F.col("key").bitwiseAND(F.lit(255).cast("long"))

    def stats(order: int) -> DataFrame:
        t = contexts.where(F.col("order") == order).select(F.col("ctx").alias("c"), F.col("total").alias(f"t{order}"), F.col("distinct").alias(f"d{order}"), F.col("mass").alias(f"m{order}"))
        return F.broadcast(t) if order <= 2 else t  # at most 256**order rows

    def found(order: int) -> DataFrame:
        t = nodes.where(F.col("order") == order).select(F.col("ctx").alias("c"), F.col("sym").alias("s"), F.col("n").alias(f"n{order}"))
        return F.broadcast(t) if order <= 1 else t  # at most 256**(order + 1) rows

    seen = counts.where("n > 0").join(stats(ORDER), _shorter(ORDER) == F.col("c")).select("key", F.log10(F.col("n") / (F.col(f"t{ORDER}") + F.col(f"d{ORDER}"))).alias("value"))

    rest = counts.where("n = 0").select("key")
    zero = F.lit(0).cast("long")
    total, done = F.lit(0.0), F.lit(False)
    gone, mass = zero, zero
    for order in range(ORDER, -1, -1):
        rest = rest.join(stats(order), _shorter(order) == F.col("c"), "left").drop("c")
        hit = F.lit(False)
        here, left = F.col(f"t{order}") - mass, F.col(f"d{order}") - gone
        if order < ORDER:
            rest = rest.join(found(order), (_shorter(order) == F.col("c")) & (sym == F.col("s")), "left").drop("c", "s")
            hit = F.col(f"n{order}").isNotNull()
            total = total + F.when(~done & hit, F.log10(F.col(f"n{order}") / (here + left))).otherwise(0.0)
        escapes = ~done & ~hit & F.coalesce(left > 0, F.lit(False))
        total = total + F.when(escapes, F.log10(left / (here + left))).otherwise(0.0)
        gone, mass = F.coalesce(f"d{order}", zero), F.coalesce(f"m{order}", zero)
        done = done | hit
        # keep the expression small: what the next order needs becomes columns
        rest = rest.select("key", total.alias("total"), done.alias("done"), gone.alias("gone"), mass.alias("mass"))
        total, done, gone, mass = F.col("total"), F.col("done"), F.col("gone"), F.col("mass")
    unseen = rest.select("key", (total - F.when(done, F.lit(0.0)).otherwise(F.log10(F.lit(256) - gone))).alias("value"))
    return seen.unionByName(unseen)


def score_texts(docs: DataFrame, modulus: int = 7, remainder: int = 2, chunk_bytes: int = 16 << 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Documents with crc32(id) mod ``modulus`` equal to ``remainder`` are held out of training.
    """
    rows = docs.select(docs[doc_id].alias("doc_id"), held_out_column(docs[doc_id], modulus, remainder).alias("held_out"), docs[text].alias("text"))
    texts = materialize(_chunked(rows, chunk_bytes), "texts")
    entries = materialize(_entries(texts), "entries")
    counts = materialize(entries.groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
    n_all, v = counts.where("kind = 0 and n > 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).head()
    deepest = counts.where("kind = 1").select("key", "n")
    nodes, contexts = trie(deepest.where("n > 0"))
    known = counts.where("kind = 0").select("kind", "key", F.col("n").cast("double").alias("value"))
    values = materialize(known.unionByName(log_probabilities(deepest, nodes, contexts).select(F.lit(1).cast("byte").alias("kind"), "key", "value")), "model")
    for table in (counts, nodes, contexts):
        drop(docs.sparkSession, table)
    asked = materialize(_packed_values(entries.select("chunk", "kind", "key").join(values, ["kind", "key"]).select("chunk", "kind", "key", "value")), "values")
    for table in (entries, values):
        drop(docs.sparkSession, table)

    log_total = math.log10(n_all + v + 1)
    schema = T.StructType([rows.schema["doc_id"], rows.schema["held_out"], *(T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")), *(T.StructField(c, T.DoubleType()) for c in ("base_score", "score"))])

    def run(mine: pa.Table, model: pa.Table) -> pa.Table:
        tables, out = _tables(model), []
        for packed in mine.column("docs"):
            for docs in _documents(packed.as_buffer()):
                for part in chunks(docs.column(2), lower=True):
                    score, known, known_log = _scores(part, *tables)
                    n = part.words(SPACE).count + 1
                    numbers = [pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(part.n, n_all, np.int64)), pa.array(known_log - n * log_total), pa.array(score)]
                    out.append(pa.RecordBatch.from_arrays([*docs.slice(part.first, part.n).columns[:2], *numbers], names=schema.names))
        return pa.Table.from_batches(out)

    return texts.groupBy("chunk").cogroup(asked.groupBy("chunk")).applyInArrow(run, schema)


def _tables(model: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    """For tokens and for grams of a chunk: keys in order and their values."""
    parts = [[], []]
    for kind, n, packed in zip(*(model.column(c).to_pylist() for c in ("kind", "n", "packed")), strict=True):
        parts[kind].append(_unpack(packed, n))
    out = []
    for found in parts:
        keys, values = (np.concatenate([f[i] for f in found]) for i in (0, 1))
        order = np.argsort(keys)
        out.append((keys[order], values[order]))
    return out


def _scores(part: Texts, tokens, known_grams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each document: the log10 probability, the number of known tokens, and the sum of log10(c + 1) over tokens."""
    out, bounds, w = symbols(part)
    packed, at = grams(out, bounds)
    gram, inverse = np.unique(packed, return_inverse=True)
    score = _sums(known_grams[1][np.searchsorted(known_grams[0], gram)][inverse], at)
    token, inverse = np.unique(w.hashes(), return_inverse=True)
    c = tokens[1][np.searchsorted(tokens[0], token)]
    end = float(tokens[1][np.searchsorted(tokens[0], np.array([END_TOKEN]).view(np.uint64))[0]])
    known = _sums((c > 0)[inverse].astype(np.int64), w.doc_start) + (end > 0)
    return score, known, _sums(np.log10(c + 1.0)[inverse], w.doc_start) + math.log10(end + 1)


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of each document's values; summed document by document, so that equal texts get equal sums."""
    out = np.zeros(len(bounds) - 1, values.dtype)
    full = np.flatnonzero(np.diff(bounds) > 0)
    if len(full):
        out[full] = np.add.reduceat(values, bounds[:-1][full])
    return out


def crc_remainder(doc_id, modulus: int) -> int:
    """The fold of an id, as in the query, for tests."""
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % modulus
