r"""Toxicity scores by a character n-gram linear classifier scaled by naive Bayes ratios.

Features are the distinct character n-grams (``SIZES`` code points, A-Z
lower-cased, all white space a blank, one blank before and after the text) of a
whole text, hashed into ``2**BITS`` places. Over all labelled
training rows the number of documents of each class that hold a feature gives
its log-count ratio ``r = log((p + 1) / (P + 2)) - log((q + 1) / (Q + 2))``, P and Q
being the class sizes. Features whose ratio is far from 0 for its standard error
stay (``min_z``), all of them. Logistic regression with an L2
penalty on the features times r is fitted to at most ``max_rows`` distinct labelled
rows (a documented bound, those of least hash), with classes weighing as in all
rows, by L-BFGS until the gradient is ``tolerance`` of the first one. A document's score is the logistic of the sum over its features.

Only the text enters a score; labels come from rows outside the held-out fold.
The model that is broadcast has a fixed size (``2**BITS`` weights).

Edge cases: a null or empty text has no features and scores the intercept; a null
id hashes as the empty string; a null label is no label, of several labels of an
id the greatest counts; without labels of both classes every score is the share
of label 1, smoothed; repeated rows are scored each and count each in the ratios;
equal hashes of different texts are one row of the fit; a very long text is
processed whole, by itself; an empty table gives an empty result; other columns,
those named as ones of the result too, are ignored.
"""

from __future__ import annotations

from collections import deque
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm._text import SPACE, Texts, chunks, distinct, map_arrow, mix
from strandline.storage import materialize

SIZES, BITS = (4, 5, 6, 8), 20


def features(part: Texts, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, feature) pairs of some texts, in order; only features flagged in ``wanted``."""
    ends = np.sort(np.concatenate([part.offs[:-1], part.offs[1:]]))
    buf = np.insert(np.where(SPACE[part.buf], np.uint8(0x20), part.buf), ends, 0x20)
    lead = (buf & 0xC0) != 0x80
    bounds = np.append(0, np.cumsum(lead))[part.offs + 2 * np.arange(part.n + 1)]
    points = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    doc = np.repeat(np.arange(part.n), np.diff(bounds))
    code = mix(points.astype(np.uint64) + np.uint64(0xC4A2))
    g, n, found = code, 1, []
    for size in SIZES:
        while n < size:
            g = g[:-1] * np.uint64(0x9E3779B97F4A7C15) + code[n:]
            n += 1
        if not len(g):
            break
        f = (mix(g + np.uint64(size)) >> np.uint64(64 - BITS)).astype(np.int64)
        ok = doc[: len(g)] == doc[size - 1 :]
        if wanted is not None:
            ok &= wanted[f]
        at = np.flatnonzero(ok)
        found.append(doc[at] << BITS | f[at])
    pairs = distinct(np.concatenate([*found, np.zeros(0, np.int64)]))
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


def _fold(doc_id, modulus: int):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == 0


def _labelled(docs: DataFrame, labels: DataFrame, label: str, modulus: int, broadcast_rows: int) -> DataFrame:
    """(doc_id, text, y) of training rows."""
    marks = labels.where(F.col(label).isNotNull()).groupBy(F.col("doc_id").alias("__id")).agg(F.max(label).cast("int").alias("y"))
    marks = materialize(marks.where(~_fold(F.col("__id"), modulus)), "marks")
    if marks.count() <= broadcast_rows:
        marks = F.broadcast(marks)
    return docs.join(marks, docs["doc_id"] == F.col("__id")).select("doc_id", "text", "y")


def _document_counts(train: DataFrame) -> DataFrame:
    """(f, q, p): in how many documents of label 0 and 1 a feature occurs; row f = -1 counts documents."""
    schema = T.StructType([T.StructField("f", T.IntegerType()), T.StructField("q", T.LongType()), T.StructField("p", T.LongType())])

    def run(batches):
        n = np.zeros((2, (1 << BITS) + 1), np.int64)
        for batch in batches:
            y = (batch.column(1).to_numpy(zero_copy_only=False) > 0).astype(np.int64)
            for part in chunks(batch.column(0), lower=True):
                doc, f = features(part)
                of = y[part.first : part.first + part.n]
                for label in (0, 1):
                    n[label, :-1] += np.bincount(f[of[doc] == label], minlength=1 << BITS)
                    n[label, -1] += int((of == label).sum())
        some = np.flatnonzero(n.any(axis=0))
        f = np.where(some == 1 << BITS, -1, some).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(f), pa.array(n[0, some]), pa.array(n[1, some])], names=schema.names)

    return map_arrow(train.select("text", "y"), run, schema).groupBy("f").agg(F.sum("q").alias("q"), F.sum("p").alias("p"))


class Model:
    def __init__(self, weights: np.ndarray, intercept: float):
        self.weights, self.intercept, self.wanted = weights, intercept, weights != 0

    def score(self, part: Texts) -> np.ndarray:
        doc, f = features(part, self.wanted)
        z = self.intercept + np.bincount(doc, self.weights[f], minlength=part.n)
        return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def _ratios(counts: pa.Table, min_z: float) -> tuple[np.ndarray, int, int]:
    """Log-count ratio of each kept feature (0 elsewhere) and the class sizes (label 0, label 1)."""
    f, q, p = (counts.column(c).to_numpy() for c in ("f", "q", "p"))
    all_docs = f == -1
    n0, n1 = int(q[all_docs].sum()), int(p[all_docs].sum())
    f, q, p = f[~all_docs], q[~all_docs], p[~all_docs]
    ratio = np.log((p + 1) / (n1 + 2)) - np.log((q + 1) / (n0 + 2))
    z = np.abs(ratio) / np.sqrt(1 / (p + 1) + 1 / (q + 1))
    best = z >= min_z
    r = np.zeros(1 << BITS)
    r[f[best]] = ratio[best]
    return r, n0, n1


def _drawn(train: DataFrame, max_rows: int) -> DataFrame:
    """(text, y, h) of at most ``max_rows`` rows, half of them of each class where there are enough.

    Those of least hash of id and text; rows that are there twice count once.
    """
    marked = train.select(F.xxhash64("doc_id", "text", F.lit("fit")).alias("h"), "text", "y")
    label = (F.col("y") > 0).cast("int")
    bounds = []
    for y in (0, 1):
        least = marked.where(label == y).select("h").distinct().orderBy("h").limit(max_rows // 2)
        bounds.append(least.agg(F.max("h")).head()[0])
    within = F.lit(False)
    for y, bound in enumerate(bounds):
        if bound is not None:
            within = within | ((label == y) & (F.col("h") <= F.lit(bound)))
    return marked.where(within).dropDuplicates(["h", "y"]).select("text", "y", "h")


def _sample(train: DataFrame, r: np.ndarray, max_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kept features, bounds by row and label of the rows that are fitted."""
    wanted = train.sparkSession.sparkContext.broadcast(r != 0)
    schema = T.StructType([T.StructField("y", T.IntegerType()), T.StructField("f", T.ArrayType(T.IntegerType()))])

    def run(batches):
        for batch in batches:
            for part in chunks(batch.column(0), lower=True):
                doc, f = features(part, wanted.value)
                size = np.searchsorted(doc, np.arange(part.n + 1))
                of = batch.slice(part.first, part.n)
                lists = pa.ListArray.from_arrays(pa.array(size, pa.int32()), pa.array(f, pa.int32()))
                yield pa.RecordBatch.from_arrays([of.column(1), lists, of.column(2)], names=schema.names)

    schema = schema.add("h", T.LongType())
    table = map_arrow(_drawn(train, max_rows), run, schema).toArrow()
    # in the order of the hashes, so that reruns add up in the same order
    rows = [x.values.to_numpy()[i:j] for x in table.column("f").chunks for i, j in pairwise(x.offsets.to_numpy())]
    order = np.argsort(table.column("h").to_numpy(), kind="stable")
    f = np.concatenate([*(rows[i] for i in order), np.zeros(0, np.int32)])
    sizes = np.array([len(rows[i]) for i in order], np.int64)
    return f, np.append(0, np.cumsum(sizes)), (table.column("y").to_numpy()[order] > 0).astype(float)


class _Rows:
    """Sparse rows of the sample: the places of their features, four bytes each; products go by blocks of rows."""

    def __init__(self, col: np.ndarray, bounds: np.ndarray, ratio: np.ndarray, block: int = 1 << 20):
        self.col, self.bounds, self.ratio, self.blocks = col, bounds, ratio, []
        a, n = 0, len(bounds) - 1
        while a < n:
            b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + block, "right")) - 1)
            self.blocks.append((a, b))
            a = b

    def _places(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        return self.col[self.bounds[a] : self.bounds[b]], np.repeat(np.arange(b - a), np.diff(self.bounds[a : b + 1]))

    def times(self, w: np.ndarray) -> np.ndarray:
        u, out = w * self.ratio, np.zeros(len(self.bounds) - 1)
        for a, b in self.blocks:
            col, row = self._places(a, b)
            out[a:b] = np.bincount(row, u[col], minlength=b - a)
        return out

    def transposed_times(self, e: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.ratio))
        for a, b in self.blocks:
            col, row = self._places(a, b)
            out += np.bincount(col, e[a:b][row], minlength=len(out))
        return out * self.ratio


def fit(train: DataFrame, min_z: float = 4.0, max_rows: int = 10_000, penalty: float = 1e-4, steps: int = 400, tolerance: float = 1e-6) -> Model:
    counts = _document_counts(train).toArrow()
    r, n0, n1 = _ratios(counts, min_z)
    del counts
    if not n0 or not n1:
        return Model(np.zeros(1 << BITS), float(np.log((n1 + 1) / (n0 + 1))))
    f, bounds, y = _sample(train, r, max_rows)
    kept = np.flatnonzero(r)
    place = np.zeros(1 << BITS, np.int32)
    place[kept] = np.arange(len(kept), dtype=np.int32)
    f = f.astype(np.int32, copy=False)
    for a in range(0, len(f), 1 << 20):  # in pieces, since an index is copied to eight bytes a place
        f[a : a + (1 << 20)] = place[f[a : a + (1 << 20)]]
    rows = _Rows(f, bounds, r[kept])
    # each class weighs as it does in all rows
    weight = np.where(y > 0, n1 / max(y.sum(), 1), n0 / max((1 - y).sum(), 1)) / (n0 + n1)
    w, b = _descend(rows, y, weight, penalty, steps, tolerance)
    weights = np.zeros(1 << BITS)
    weights[kept] = w * r[kept]
    return Model(weights, b)


def _two_loop(g: np.ndarray, past: deque) -> np.ndarray:
    """The gradient times an estimate of the inverse Hessian, from past steps and changes of the gradient."""
    q, held = g.copy(), []
    for s, d in reversed(past):
        a = (s @ q) / (s @ d)
        q -= a * d
        held.append(a)
    if past:
        s, d = past[-1]
        q *= (s @ d) / (d @ d)
    for (s, d), a in zip(past, reversed(held), strict=True):
        q += (a - (d @ q) / (s @ d)) * s
    return q


def _descend(rows: _Rows, y, weight, penalty, steps, tolerance, memory: int = 6) -> tuple[np.ndarray, float]:
    """Logistic regression by L-BFGS; the intercept, the last place, is not penalised.

    Ends when the gradient is ``tolerance`` of the first one, or after ``steps`` steps. The scores along a step are
    linear in its length, so that a step reads the rows once each way whatever its line search tries.
    """
    sign = 2 * y - 1

    def loss(z, x):
        return weight @ np.logaddexp(0, -sign * z) + penalty / 2 * (x[:-1] @ x[:-1])

    def gradient(z, x):
        e = -weight * sign / (1 + np.exp(np.clip(sign * z, -700, 700)))
        return np.append(rows.transposed_times(e) + penalty * x[:-1], e.sum())

    x, z, past = np.zeros(len(rows.ratio) + 1), np.zeros(len(y)), deque(maxlen=memory)
    value, g = loss(z, x), gradient(z, x)
    enough = tolerance * np.linalg.norm(g)
    for _ in range(steps):
        if np.linalg.norm(g) <= enough:
            break
        d = -_two_loop(g, past)
        if not past:
            d /= max(1.0, float(np.linalg.norm(g)))
        slope, dz, t = float(g @ d), rows.times(d[:-1]) + d[-1], 1.0
        while t > 1e-10 and loss(z + t * dz, x + t * d) > value + 1e-4 * t * slope:
            t /= 2
        if t <= 1e-10:
            break
        x, z = x + t * d, z + t * dz
        value, before, g = loss(z, x), g, gradient(z, x)
        if (g - before) @ d > 0:
            past.append((t * d, g - before))
    return x[:-1], float(x[-1])


def score_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 5, broadcast_rows: int = 2_000_000, doc_id: str = "doc_id", text: str = "text", **fitting) -> DataFrame:
    """One row per document: doc_id, held_out (crc32 of the id mod ``modulus`` is 0), score, predicted."""
    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    train = _labelled(rows.where(~_fold(F.col("doc_id"), modulus)), labels.select(F.col("doc_id"), F.col(label)), label, modulus, broadcast_rows)
    model = docs.sparkSession.sparkContext.broadcast(fit(train, **fitting))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches):
        for batch in batches:
            for part in chunks(batch.column(2), lower=True):
                s = model.value.score(part)
                ids = batch.slice(part.first, part.n)
                yield pa.RecordBatch.from_arrays([ids.column(0), ids.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=schema.names)

    return map_arrow(rows.select("doc_id", _fold(F.col("doc_id"), modulus).alias("held_out"), "text"), run, schema)
