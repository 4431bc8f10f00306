r"""Near-duplicate documents by DartMinHash signatures and banded joining.

A document is the weighted set of its five-word shingles (words
``[^\x20\x09-\x0D]+``; a shorter text is one shingle). Darts are thrown by a
seeded hash into cells of the plane (weight, rank) above every element, a
Poisson(1) number into each cell, so all documents that hold an element see the
same darts. A document keeps the darts below its element's weight and of rank
below ``t / total weight``, about ``t = k ln k + 2k`` of them; a dart's hash names
its coordinate, and the earliest dart of a coordinate is its signature value.
Two documents agree on a coordinate with the probability of their weighted
Jaccard similarity. With ``weights="set"`` all weights are 1, which gives plain
Jaccard similarity of shingle sets; ``"count"`` weighs shingles by occurrences.

Joining. Texts with equal word sequences are one node. Nodes that share a band
(``rows`` coordinates) meet in a bucket; with 20 bands of 4 a pair at similarity
0.8 misses all of them with probability 3e-5. No bucket emits its pairs: each
node is compared with its buckets' centres, first with the best one. The centre
is the node with most neighbours, which in a family of edited copies is the
text nearest to all. Comparison is exact, on sets of 64-bit shingle hashes.
Buckets whose untried members lie in different components then take up to four new
centres from them for one round. What is still open after it is joined exactly: every node
of such a bucket gives the leading tokens of its set, rarest first (any order that all share
is right, so rarity is counted in hashed places), and pairs that share one by the prefix and
positional filters of set similarity joins are compared. These filters lose no pair at
``least`` or above, so no bucket is left with an untested pair between two components. The
rounds are linear in the bucket entries; the join grows with the pairs that pass the filters.

Components come from minimum labels with pointer jumping, one written table a
round. Joins on buckets, centres and copies run against written tables, so that
adaptive execution can split hot keys.

Edge cases: a null or empty text has no shingles and is a class of its own; a
null id counts as greater than all others, and a class of null ids only has a
null class id; repeated rows share a class, and of a keeper that is there twice
one stays; a very long text is hashed whole, by itself; an empty table gives an
empty result; other columns pass through (``keep_one``; names that begin with
``__`` are this operator's) or are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm._text import SPACE, Words, chunks, map_arrow, mix, span_hashes
from strandline.storage import materialize

#: Places in which the join of open buckets counts tokens.
_RARITY_BITS = 20

_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(16)])


def shingle_sets(w: Words, width: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document in rising order, their counts, and bounds by document."""
    at, h = w.windows(w.hashes(), width)
    doc = w.doc[at] if len(at) else np.zeros(0, np.int64)
    short = np.flatnonzero((w.count > 0) & (w.count < width))
    if len(short):
        h = np.concatenate([h, span_hashes(w.hashes(), w.doc_start[short], w.doc_start[short + 1])])
        doc = np.concatenate([doc, short])
    bounds = np.searchsorted(np.sort(doc), np.arange(w.texts.n + 1))
    order = np.argsort(doc, kind="stable")
    h = h[order]
    sets = [np.unique(h[a:b], return_counts=True) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    size = np.cumsum([0, *(len(s) for s, _ in sets)])
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate([none[0], *(s for s, _ in sets)]), np.concatenate([none[1], *(c for _, c in sets)]), size


def dart_signatures(elements: np.ndarray, weights: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Signature (documents x k) of weighted sets, and which coordinates got a dart."""
    n = len(bounds) - 1
    out, have = np.zeros((n, k), np.uint64), np.zeros((n, k), bool)
    best = np.full(n * k, np.inf)
    if not len(elements):
        return out, have
    doc = np.repeat(np.arange(n), np.diff(bounds))
    total = np.bincount(doc, weights, minlength=n)
    theta = (k * math.log(k) + 2 * k) / np.where(total > 0, total, 1.0)  # sets without weight have no cells
    rank_cells, weight_cells = np.ceil(theta).astype(np.int64)[doc], np.ceil(weights).astype(np.int64)
    cells = rank_cells * weight_cells
    for a, b in _slices(cells, 1 << 18):
        owner = np.repeat(np.arange(a, b), cells[a:b])
        cell = np.arange(len(owner)) - np.repeat(np.cumsum(cells[a:b]) - cells[a:b], cells[a:b])
        rank0, weight0 = cell % rank_cells[owner], cell // rank_cells[owner]
        h = mix(elements[owner] + mix((weight0 << 32 | rank0).astype(np.uint64) + np.uint64(0xDA27)))
        number = np.searchsorted(_POISSON, (h >> np.uint64(11)) * 2.0**-53, "right")
        dart = np.repeat(np.arange(len(owner)), number)
        turn = np.arange(len(dart)) - np.repeat(np.cumsum(number) - number, number)
        g = mix(h[dart] + (turn + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        rank = rank0[dart] + (g >> np.uint64(32)) * 2.0**-32
        height = weight0[dart] + (mix(g) >> np.uint64(32)) * 2.0**-32
        who = owner[dart]
        keep = (height < weights[who]) & (rank < theta[doc[who]])
        g, rank, who = g[keep], rank[keep], doc[who[keep]]
        _earliest(out, have, best, g, rank, who, k)
    return out, have


def _earliest(out, have, best, g, rank, who, k) -> None:
    """Keep the dart of least rank for each (document, coordinate), here and in earlier slices."""
    slot = who * k + (mix(g + np.uint64(0xC0)) % np.uint64(k)).astype(np.int64)
    order = np.lexsort((g, rank, slot))
    s = slot[order]
    lead = order[np.r_[True, s[1:] != s[:-1]]] if len(s) else order
    lead = lead[rank[lead] < best[slot[lead]]]
    out.reshape(-1)[slot[lead]] = g[lead]
    have.reshape(-1)[slot[lead]] = True
    best[slot[lead]] = rank[lead]


def _slices(cells: np.ndarray, limit: int):
    """Index ranges of about ``limit`` cells."""
    total, a = np.cumsum(cells), 0
    while a < len(cells):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + limit, "right")))
        yield a, b
        a = b


def band_keys(signature: np.ndarray, have: np.ndarray, rows: int) -> list[np.ndarray]:
    """For each document the keys of its bands; a band with an empty coordinate has none."""
    n, k = signature.shape
    key = np.zeros((n, k // rows), np.uint64)
    for r in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + signature[:, r::rows][:, : k // rows])
    key = mix(key + np.arange(k // rows, dtype=np.uint64))
    ok = np.logical_and.reduce([have[:, r::rows][:, : k // rows] for r in range(rows)])
    return [key[i][ok[i]].view(np.int64) for i in range(n)]


def _list(values: list[np.ndarray]) -> pa.Array:
    size = np.cumsum([0, *map(len, values)])
    return pa.ListArray.from_arrays(pa.array(size, pa.int32()), pa.array(np.concatenate([*values, np.zeros(0, np.int64)])))


def _signature_rows(keyed: DataFrame, width: int, bands: int, rows: int, weights: str) -> DataFrame:
    schema = T.StructType(
        [keyed.schema["doc_id"], keyed.schema["th"], T.StructField("fp", T.BinaryType()), T.StructField("n", T.IntegerType()), T.StructField("bands", T.ArrayType(T.LongType()))]
    )

    def run(batches):
        for batch in batches:
            for part in chunks(batch.column(2)):
                w = part.words(SPACE)
                h, count, bounds = shingle_sets(w, width)
                weight = np.ones(len(h)) if weights == "set" else count.astype(float)
                n = np.diff(bounds)
                signature, have = _by_chunks(h, weight, bounds, bands * rows)
                fp = [hashlib.blake2b(b" ".join(part.bytes_of(i).split()), digest_size=16).digest() if n[i] else None for i in range(part.n)]
                ids = batch.slice(part.first, part.n)
                yield pa.RecordBatch.from_arrays([ids.column(0), ids.column(1), pa.array(fp, pa.binary()), pa.array(n, pa.int32()), _list(band_keys(signature, have, rows))], names=schema.names)

    return map_arrow(keyed, run, schema)


def _by_chunks(h, weight, bounds, k):
    """Signatures of a whole chunk; sets are never cut between two slices of darts."""
    out, have = [], []
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, min(n, int(np.searchsorted(bounds, bounds[i] + (1 << 17), "right")) - 1))
        s, f = dart_signatures(h[bounds[i] : bounds[j]], weight[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], k)
        out.append(s)
        have.append(f)
        i = j
    return np.concatenate(out), np.concatenate(have)


def _set_rows(texts: DataFrame, width: int, weights: str) -> DataFrame:
    """(fp, shingles, counts): sorted 64-bit hashes (and counts, for weighted sets) as bytes."""
    schema = T.StructType([T.StructField("fp", T.BinaryType()), T.StructField("shingles", T.BinaryType()), T.StructField("counts", T.BinaryType())])

    def run(batches):
        for batch in batches:
            for part in chunks(batch.column(1)):
                h, count, bounds = shingle_sets(part.words(SPACE), width)
                count = count.astype(np.int32)
                cut = lambda x: [x[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                counts = cut(count) if weights == "count" else [None] * part.n
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.first, part.n), pa.array(cut(h), pa.binary()), pa.array(counts, pa.binary())], names=schema.names)

    return map_arrow(texts, run, schema)


def _similarity(a: bytes, b: bytes, ca: bytes | None, cb: bytes | None) -> float:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if ca is None:
        both = np.sort(np.concatenate([x, y]))
        shared = int((both[1:] == both[:-1]).sum())
        return shared / max(len(x) + len(y) - shared, 1)
    m, n = np.frombuffer(ca, np.int32), np.frombuffer(cb, np.int32)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    low = np.minimum(m[i], n[j]).sum()
    return low / max(m.sum() + n.sum() - low, 1)


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose similarity is ``least`` or more."""
    left, right = sets.toDF("a", "sa", "ca"), sets.toDF("b", "sb", "cb")
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "sa", "sb", "ca", "cb")
    schema = T.StructType([T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType())])

    def run(batches):
        for batch in batches:
            c = [x.to_pylist() for x in batch.columns[2:]]
            ok = [_similarity(*x) >= least for x in zip(*c, strict=True)]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return map_arrow(both, run, schema)


def components(links: DataFrame) -> DataFrame:
    """(fp, root) for each node with a link: root is the least node of its component."""
    edges = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("fp"), F.least("a", "m").alias("root")), "labels")
    while True:
        heard = edges.join(labels.toDF("a", "r"), "a").groupBy("b").agg(F.min("r").alias("r")).toDF("fp", "heard")
        lower = materialize(labels.join(heard, "fp").select("fp", F.col("root").alias("old"), F.least("root", "heard").alias("root")), "lower")
        jumped = lower.join(lower.select(F.col("fp").alias("root"), F.col("root").alias("up")), "root").select("fp", "old", F.least("root", "up").alias("root"))
        new = materialize(jumped, "labels")
        if new.where("old != root").isEmpty():
            return new.select("fp", "root")
        labels = new.select("fp", "root")


def _buckets(nodes: DataFrame) -> DataFrame:
    """(key, fp, n, score) for each bucket of two nodes or more; score adds up a node's bucket sizes."""
    entries = nodes.select("fp", "n", F.explode("bands").alias("key"))
    sizes = materialize(entries.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
    members = materialize(entries.join(sizes, "key"), "members")
    return materialize(members.join(members.groupBy("fp").agg(F.sum("size").alias("score")), "fp").select("key", "fp", "n", "score"), "buckets")


def _close(least: float):
    """Sets whose sizes differ more can't reach the similarity."""
    return F.least("n", "cn") >= least * F.greatest("n", "cn")


def _pairs_with(members: DataFrame, centres: DataFrame, least: float, weights: str) -> DataFrame:
    """Distinct (a, b, score of b): each member with its buckets' centre."""
    met = members.select("key", "fp", "n").join(centres, "key").where("fp != cfp")
    if weights == "set":
        met = met.where(_close(least))
    return met.groupBy(F.col("fp").alias("a"), F.col("cfp").alias("b")).agg(F.max("cscore").alias("cscore"))


def _centres(members: DataFrame) -> DataFrame:
    best = members.groupBy("key").agg(F.max(F.struct("score", "fp", "n")).alias("c"))
    return best.select("key", F.col("c.fp").alias("cfp"), F.col("c.n").alias("cn"), F.col("c.score").alias("cscore"))


def _delegates(members: DataFrame, slots: int = 4) -> DataFrame:
    """Of the components in each bucket, the best node of up to ``slots``: one for each hash slot."""
    best = members.groupBy("key", F.pmod(F.xxhash64("root"), F.lit(slots)).alias("slot")).agg(F.max(F.struct("score", "fp", "n")).alias("c"))
    return best.select("key", F.col("c.fp").alias("cfp"), F.col("c.n").alias("cn"), F.col("c.score").alias("cscore"))


def _across(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs whose ends are not yet in one component."""
    return pairs.join(roots.toDF("a", "ra"), "a").join(roots.toDF("b", "rb"), "b").where("ra != rb").select("a", "b")


def _merged(roots: DataFrame, links: DataFrame, singles: bool = False) -> DataFrame:
    """``roots`` after ``links``: the graph between components is all that is searched.

    With ``singles`` every node is still its own root.
    """
    if links.isEmpty():
        return roots
    if not singles:
        met = links.join(roots.toDF("a", "x"), "a").join(roots.toDF("b", "y"), "b")
        links = met.where("x != y").select(F.col("x").alias("a"), F.col("y").alias("b"))
    moved = components(links).toDF("old", "new")
    return materialize(roots.join(moved, roots["root"] == moved["old"], "left").select("fp", F.coalesce("new", "root").alias("root")), "roots")


def _tokens(shingles: bytes, counts: bytes | None) -> np.ndarray:
    """A set's hashes; an occurrence each where shingles are counted, so weighted similarity is that of plain sets."""
    h = np.frombuffer(shingles, np.uint64)
    if counts is None:
        return h
    n = np.frombuffer(counts, np.int32)
    turn = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return mix(np.repeat(h, n) + turn.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _place(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - _RARITY_BITS)).astype(np.int64)


def _rarity(sets: DataFrame) -> np.ndarray:
    """How many tokens of all sets fall into each place."""
    schema = T.StructType([T.StructField("place", T.IntegerType()), T.StructField("n", T.LongType())])

    def run(batches):
        n = np.zeros(1 << _RARITY_BITS, np.int64)
        for batch in batches:
            for s, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n += np.bincount(_place(_tokens(s, c)), minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at])], names=schema.names)

    found = map_arrow(sets.select("shingles", "counts"), run, schema).groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << _RARITY_BITS, np.int64)
    out[found.column("place").to_numpy()] = found.column("n").to_numpy()
    return out


def _prefixes(sets: DataFrame, least: float) -> DataFrame:
    """(token, fp, root, m, at, lead): the leading tokens of each set of m, rarest first; ``lead`` marks those against larger sets."""
    rarity = sets.sparkSession.sparkContext.broadcast(_rarity(sets))
    schema = T.StructType(
        [T.StructField("token", T.LongType()), T.StructField("fp", T.BinaryType()), T.StructField("root", T.BinaryType())]
        + [T.StructField("m", T.IntegerType()), T.StructField("at", T.IntegerType()), T.StructField("lead", T.BooleanType())]
    )
    need = 2 * least / (1 + least)

    def run(batches):
        for batch in batches:
            for fp, root, s, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                t = _tokens(s, c)
                m = len(t)
                k = m - math.ceil(least * m - 1e-9) + 1
                first = t[np.lexsort((t, rarity.value[_place(t)]))[:k]]
                lead = np.arange(len(first)) < m - math.ceil(need * m - 1e-9) + 1
                columns = [pa.array(first.view(np.int64)), pa.array([fp] * len(first), pa.binary()), pa.array([root] * len(first), pa.binary())]
                columns += [pa.array(np.full(len(first), m, np.int32)), pa.array(np.arange(len(first), dtype=np.int32)), pa.array(lead)]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return map_arrow(sets.select("fp", "root", "shingles", "counts"), run, schema)


def _similar_pairs(sets: DataFrame, least: float) -> DataFrame:
    """Distinct (a, b) between components, every one of similarity ``least`` or more among them."""
    entries = materialize(_prefixes(sets, least), "prefixes")
    x = entries.select("token", *(F.col(c).alias("x_" + c) for c in ("fp", "root", "m", "at")))
    y = entries.where("lead").select("token", *(F.col(c).alias("y_" + c) for c in ("fp", "root", "m", "at")))
    left = F.least(F.col("x_m") - F.col("x_at"), F.col("y_m") - F.col("y_at"))
    smaller = (F.col("y_m") < F.col("x_m")) | ((F.col("y_m") == F.col("x_m")) & (F.col("y_fp") < F.col("x_fp")))
    near = (F.col("y_m") >= least * F.col("x_m") - 1e-9) & (left >= least / (1 + least) * (F.col("x_m") + F.col("y_m")) - 1e-9)
    return x.join(y, "token").where(smaller & near & (F.col("x_root") != F.col("y_root"))).select(F.col("x_fp").alias("a"), F.col("y_fp").alias("b")).distinct()


def _open(buckets: DataFrame, tried: DataFrame, roots: DataFrame) -> DataFrame:
    """Members that were no centre of their bucket, where they lie in different components."""
    placed = materialize(buckets.join(tried.toDF("key", "fp"), ["key", "fp"], "left_anti").join(roots, "fp"), "placed")
    split = placed.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x != y").select("key")
    return materialize(placed.join(materialize(split, "split"), "key"), "open")


def _links(buckets: DataFrame, sets: DataFrame, least: float, weights: str) -> DataFrame:
    """(fp, root) of all nodes that share a bucket with another."""
    first = materialize(_centres(buckets), "centres")
    pairs = materialize(_pairs_with(buckets, first, least, weights), "pairs")
    best = pairs.groupBy("a").agg(F.max(F.struct("cscore", "b")).alias("x")).select("a", F.col("x.b").alias("b"))
    roots = materialize(buckets.select("fp").distinct().select("fp", F.col("fp").alias("root")), "roots")
    roots = _merged(roots, materialize(_verified(best, sets, least), "links"), singles=True)
    roots = _merged(roots, materialize(_verified(_across(pairs, roots), sets, least), "links"))
    tried = first.select("key", "cfp")
    open_ = _open(buckets, tried, roots)
    if open_.isEmpty():
        return roots
    fresh = materialize(_delegates(open_), "centres")
    more = materialize(_verified(_across(_pairs_with(open_, fresh, least, weights), roots), sets, least), "links")
    roots = _merged(roots, more)
    open_ = _open(open_.drop("root"), tried.unionByName(fresh.select("key", "cfp")), roots)
    if open_.isEmpty():
        return roots
    left = materialize(sets.join(open_.select("fp", "root").distinct(), "fp"), "open_sets")
    return _merged(roots, materialize(_verified(_similar_pairs(left, least), sets, least), "links"))


def _row_hash(docs: DataFrame, doc_id: str, text: str) -> Column:
    """128 bits of a row's id and text; null is not the empty string."""
    spelt = lambda c: F.md5(F.coalesce(F.concat(F.lit("s"), docs[c].cast("string")), F.lit("n")))
    return F.unhex(F.md5(F.concat(spelt(doc_id), spelt(text))))


def classify(docs: DataFrame, width: int = 5, least: float = 0.8, bands: int = 20, rows: int = 4, weights: str = "set", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, th, class_id (least id of its class), class_size, keeper, wordless.

    ``th`` identifies a row's id and text; the row(s) with ``keeper`` stand for the class.
    """
    keyed = docs.select(docs[doc_id].alias("doc_id"), _row_hash(docs, doc_id, text).alias("th"), docs[text].alias("text"))
    rows_ = materialize(_signature_rows(keyed, width, bands, rows, weights), "signatures")
    nodes = rows_.where(F.col("fp").isNotNull()).groupBy("fp").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")).alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.count("*").alias("copies")
    )
    nodes = materialize(nodes, "nodes")
    buckets = _buckets(nodes)
    candidates = nodes.join(buckets.select("fp").distinct(), "fp", "left_semi").select("fp", F.col("rep.th").alias("th"))
    texts = keyed.select("th", "text").join(candidates, "th").select("fp", "text")
    sets = _set_rows(texts, width, weights)
    if not rows_.groupBy("th").count().where("count > 1").isEmpty():  # rows that are there twice gave their set twice
        sets = sets.dropDuplicates(["fp"])
    sets = materialize(sets, "sets")
    roots = _links(buckets, sets, least, weights)

    placed = nodes.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "rep", "copies")
    classes = materialize(placed.groupBy("root").agg(F.min("rep").alias("rep"), F.sum("copies").alias("class_size")), "classes")
    of_node = materialize(placed.select("fp", "root").join(classes, "root").select(F.col("fp").alias("node"), F.col("rep.doc_id").alias("class_id"), F.col("rep.th").alias("keep_th"), "class_size"), "of_node")
    joined = rows_.join(of_node, F.col("fp") == F.col("node"), "left")
    alone = F.col("fp").isNull()
    return joined.select(
        "doc_id",
        "th",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).alias("class_size"),
        (alone | (F.col("th") == F.col("keep_th"))).alias("keeper"),
        alone.alias("wordless"),
    )


def keep_one(docs: DataFrame, width: int = 5, least: float = 0.8, bands: int = 20, rows: int = 4, weights: str = "set", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each class: the one of least id. Documents without words all stay."""
    found = classify(docs, width, least, bands, rows, weights, doc_id, text).where("keeper")
    kept = materialize(found.groupBy("th").agg(F.max("wordless").alias("wordless")).toDF("__th", "__wordless"), "kept")
    one = docs.withColumn("__th", _row_hash(docs, doc_id, text)).join(kept, "__th")
    alike = one.where("not __wordless").dropDuplicates(["__th"])  # a keeper that is there twice
    return one.where("__wordless").unionByName(alike).select(*docs.columns)
