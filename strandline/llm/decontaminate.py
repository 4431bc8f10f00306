r"""Benchmark decontamination by a generalised suffix automaton of test items.

Texts and items are lower-cased (A-Z) and cut into words
``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``. A window is ``window`` consecutive words of
an item; a shorter item with words is one window. The automaton of all items
accepts every run of item words; streaming a document through it gives, at each
word, the longest suffix that occurs in an item, and the suffix links from there
lead to every window that ends at this word.

Words outside the items' vocabulary, and neighbours that are never neighbours
in an item, end every match. Both are found by array look-ups over a whole
batch, so only stretches that can hold a window are streamed word by word.

The items are read in blocks of about ``block_bytes`` of text (by a hash of the row).
The driver builds the automaton of a block once and broadcasts it as sorted arrays,
about 20 bytes for each byte of text, so what a worker holds is bounded; with more
than one block, documents pass once for each, written in between, and spans are
united. Edge cases: a very long text is scanned whole, by itself; a null or empty text has no words; an item
without words has no window; an item with a null id marks words but is never
listed; repeated items are listed once; rows with equal id and text are judged
alike and all returned; empty tables give no rows or no hits.
"""

from __future__ import annotations

import hashlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm._text import NOT_ALNUM, Words, chunks, distinct, map_arrow
from strandline.storage import materialize


class _Builder:
    """Generalised over integer sequences: each is inserted from the root, shared states are reused.

    An edge is one dictionary entry (state and word in one number) and a link in its state's chain of edges.
    """

    def __init__(self, words: int) -> None:
        self.words = max(words, 1)
        self.edges: dict[int, int] = {}
        self.word, self.before = array("i"), array("i")
        self.last, self.link, self.length = array("i", [-1]), array("i", [-1]), array("i", [0])

    def _state(self, length: int, link: int) -> int:
        self.last.append(-1)
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def _edge(self, state: int, word: int, target: int) -> None:
        key = state * self.words + word
        if key not in self.edges:
            self.word.append(word)
            self.before.append(self.last[state])
            self.last[state] = len(self.word) - 1
        self.edges[key] = target

    def next(self, state: int, word: int) -> int | None:
        return self.edges.get(state * self.words + word)

    def _split(self, parent: int, word: int, target: int) -> int:
        """The state for exactly ``length[parent] + 1`` words of ``target``'s class."""
        copy = self._state(self.length[parent] + 1, self.link[target])
        edge = self.last[target]
        while edge >= 0:
            self._edge(copy, self.word[edge], self.edges[target * self.words + self.word[edge]])
            edge = self.before[edge]
        self.link[target] = copy
        while parent >= 0 and self.next(parent, word) == target:
            self._edge(parent, word, copy)
            parent = self.link[parent]
        return copy

    def _extend(self, at: int, word: int) -> int:
        target = self.next(at, word)
        if target is not None:
            return target if self.length[target] == self.length[at] + 1 else self._split(at, word, target)
        state, parent = self._state(self.length[at] + 1, 0), at
        while parent >= 0 and self.next(parent, word) is None:
            self._edge(parent, word, state)
            parent = self.link[parent]
        if parent >= 0:
            target = self.next(parent, word)
            self.link[state] = target if self.length[target] == self.length[parent] + 1 else self._split(parent, word, target)
        return state

    def insert(self, words: list[int]) -> None:
        at = 0
        for w in words:
            at = self._extend(at, w)


class Automaton:
    """The built automaton in sorted arrays: 12 bytes an edge, 12 a state, 16 a mark."""

    def __init__(self, coded: list[list[int]], words: int, window: int):
        built = _Builder(words)
        for c in coded:
            built.insert(c)
        self.words, self.link, self.length = built.words, built.link, built.length
        keys = np.fromiter(built.edges.keys(), np.int64, len(built.edges))
        order = np.argsort(keys)
        self.keys = array("q", keys[order].tobytes())
        self.targets = array("i", np.fromiter(built.edges.values(), np.int32, len(keys))[order].tobytes())
        del built
        # a mark: the state of a window, its number of words, the item
        state, size, item = array("q"), array("i"), array("i")
        for i, c in enumerate(coded):
            for s, m in self._windows(c, window):
                state.append(s)
                size.append(m)
                item.append(i)
        marks = np.unique(np.stack([np.frombuffer(x, t).astype(np.int64) for x, t in ((state, np.int64), (size, np.int32), (item, np.int32))] if len(state) else np.zeros((3, 0), np.int64)), axis=1)
        self.mark_state = array("q", marks[0].tobytes())
        self.mark_words, self.mark_item = (array("i", x.astype(np.int32).tobytes()) for x in marks[1:])
        # the first state with a mark on each one's way to the root, itself included; links lead to shorter states
        nearest = np.zeros(len(self.length), np.int32)
        nearest[marks[0]] = marks[0]
        for s in np.argsort(np.frombuffer(self.length, np.int32), kind="stable")[1:].tolist():
            if not nearest[s]:
                nearest[s] = nearest[self.link[s]]
        self.nearest = array("i", nearest.tobytes())

    def _next(self, state: int, word: int) -> int:
        key = state * self.words + word
        at = bisect_left(self.keys, key)
        return self.targets[at] if at < len(self.keys) and self.keys[at] == key else 0

    def step(self, state: int, length: int, word: int) -> tuple[int, int]:
        """The longest match that ends at ``word``, given the one before it."""
        target = self._next(state, word)
        while state and not target:
            state = self.link[state]
            length = self.length[state]
            target = self._next(state, word)
        return (target, length + 1) if target else (0, 0)

    def _windows(self, words: list[int], window: int) -> Iterator[tuple[int, int]]:
        """(state, number of words) of each window of an item."""
        m = min(window, len(words))
        state = length = 0
        for i, w in enumerate(words):
            state, length = self.step(state, length, w)
            while self.length[self.link[state]] >= m:
                state = self.link[state]
                length = self.length[state]
            length = min(length, m)
            if i + 1 >= m:
                yield state, m

    def windows_at(self, state: int, length: int) -> Iterator[tuple[int, int]]:
        """(number of words, item) of each window that is a suffix of the current match."""
        state = self.nearest[state]
        while state > 0:
            at = bisect_left(self.mark_state, state)
            while at < len(self.mark_state) and self.mark_state[at] == state:
                if self.mark_words[at] <= length:
                    yield self.mark_words[at], self.mark_item[at]
                at += 1
            state = self.nearest[self.link[state]]


class Matcher:
    """The automaton of some items with the look-up tables that skip hopeless stretches."""

    def __init__(self, items: list[tuple[str | None, str]], window: int):
        column = pa.array([t for _, t in items], pa.large_string())
        coded: list[tuple[str | None, list[int]]] = []
        hashes: list[np.ndarray] = []
        for part in chunks(column, lower=True):
            w = part.words(NOT_ALNUM)
            h = w.hashes()
            for i in range(part.n):
                hashes.append(h[w.doc_start[i] : w.doc_start[i + 1]])
        self.vocabulary = distinct(np.concatenate([*hashes, np.zeros(0, np.uint64)]))
        for (item, _), h in zip(items, hashes, strict=True):
            coded.append((item, np.searchsorted(self.vocabulary, h).tolist()))
        coded = [(item, c) for item, c in coded if c]
        self.shortest = min([window, *(len(c) for _, c in coded)])
        pairs = [np.array(c[:-1], np.int64) * len(self.vocabulary) + np.array(c[1:], np.int64) for _, c in coded]
        self.pairs = distinct(np.concatenate([*pairs, np.zeros(0, np.int64)]))
        self.items = [item for item, _ in coded]
        self.automaton = Automaton([c for _, c in coded], len(self.vocabulary), window)

    def scan(self, w: Words) -> list[tuple[int, list[tuple[int, int]], set[str | None]]]:
        """(document, spans of word numbers in it, items) for each document with a hit."""
        if not len(self.vocabulary) or not len(w.start):
            return []
        ids, ok = _lookup(self.vocabulary, w.hashes())
        joined = np.zeros(len(ids) + 1, bool)
        both = ok[1:] & ok[:-1]
        _, known = _lookup(self.pairs, ids[:-1] * len(self.vocabulary) + ids[1:])
        joined[1:-1] = both & known
        joined[w.doc_start] = False  # a match never crosses documents
        first = np.flatnonzero(ok & ~joined[:-1])
        last = np.flatnonzero(ok & ~joined[1:])
        keep = last - first + 1 >= self.shortest
        found: dict[int, tuple[list[tuple[int, int]], set[str | None]]] = {}
        auto = self.automaton
        for a, b in zip(first[keep].tolist(), last[keep].tolist(), strict=True):
            state = length = 0
            for i, word in enumerate(ids[a : b + 1].tolist(), a):
                state, length = auto.step(state, length, word)
                if length < self.shortest:
                    continue
                for m, item in auto.windows_at(state, length):
                    doc = int(np.searchsorted(w.doc_start, i, "right")) - 1
                    spans, names = found.setdefault(doc, ([], set()))
                    spans.append((i - m + 1, i + 1))
                    names.add(self.items[item])
        return [(d, unite([(s - int(w.doc_start[d]), e - int(w.doc_start[d])) for s, e in spans]), names) for d, (spans, names) in found.items()]


def _lookup(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def unite(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


_SPANS = T.ArrayType(T.StructType([T.StructField("s", T.IntegerType()), T.StructField("e", T.IntegerType())]))


def _blocks(items: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[list[tuple[str | None, str]]]:
    """The items, block by block; what the driver holds at once is bounded by the block size."""
    rows = items.select(F.col(item_id).cast("string").alias("item"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    n = max(1, -(-total // block_bytes))
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        yield [(r.item, r.text) for r in part.collect()]


def find_spans(docs: DataFrame, items: DataFrame, window: int = 10, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = 4 << 20) -> DataFrame:
    """All columns of ``docs`` and __n_words, __spans (word ranges hit), __items (ids with an occurring window)."""
    spark, n = docs.sparkSession, len(docs.columns)
    extra = [T.StructField("__n_words", T.LongType()), T.StructField("__spans", _SPANS), T.StructField("__items", T.ArrayType(T.StringType()))]
    schema = T.StructType([*docs.schema.fields, *extra])
    at = docs.columns.index(text)
    arrow = [pa.int64(), pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])), pa.list_(pa.string())]

    def scan_with(block, more):
        """Adds one block's findings to rows that, with ``more``, already carry those of earlier blocks."""
        shared = spark.sparkContext.broadcast(Matcher(block, window))

        def run(batches):
            matcher = shared.value
            for batch in batches:
                for part in chunks(batch.column(at), lower=True):
                    rows = batch.slice(part.first, part.n)
                    w = part.words(NOT_ALNUM)
                    spans = rows.column(n + 1).to_pylist() if more else [[] for _ in range(part.n)]
                    names = rows.column(n + 2).to_pylist() if more else [[] for _ in range(part.n)]
                    for d, s, found in matcher.scan(w):
                        s = unite([*s, *((x["s"], x["e"]) for x in spans[d])])
                        spans[d] = [{"s": a, "e": b} for a, b in s]
                        names[d] = sorted({*names[d], *(x for x in found if x is not None)})
                    new = [pa.array(w.count, arrow[0]), pa.array(spans, arrow[1]), pa.array(names, arrow[2])]
                    yield pa.RecordBatch.from_arrays([*rows.columns[:n], *new], names=schema.names)

        return run

    out, more = docs, False
    for block in _blocks(items, item_id, item_text, block_bytes):
        # each pass but the last is written, so that a task never holds two automata
        out = materialize(out, "spans") if more else out
        out, more = map_arrow(out, scan_with(block, more), schema), True
    return out


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = 4 << 20) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = find_spans(docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")), items, window, "text", item_id, item_text, block_bytes)
    schema = T.StructType(
        [found.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in ("n_words", "n_hit", "n_items")), T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType())]
    )

    def digest(batches):
        for batch in batches:
            spans, names = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            hit = [sum(x["e"] - x["s"] for x in s) for s in spans]
            sha = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in names]
            columns = [batch.column(0), batch.column(1), pa.array(hit, pa.int64()), pa.array([len(x) for x in names], pa.int64()), pa.array(sha), pa.array([h > 0 for h in hit])]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return map_arrow(found.select("doc_id", "__n_words", "__spans", "__items"), digest, schema)


def remove_contamination(docs: DataFrame, items: DataFrame, window: int = 10, max_coverage: float = 0.5, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = 4 << 20) -> DataFrame:
    """``docs`` without the words inside a window; a document loses its row when more than ``max_coverage`` of its words are hit.

    Untouched texts stay as they are, white space included; elsewhere the bytes
    from the first to the last word of each hit span go.
    """
    found = find_spans(docs, items, window, text, item_id, item_text, block_bytes)
    own = docs.columns
    at, n = own.index(text), len(own)

    def cut(batches):
        for batch in batches:
            texts, spans, words = batch.column(at).to_pylist(), batch.column(n + 1).to_pylist(), batch.column(n).to_pylist()
            keep = []
            for i, s in enumerate(spans):
                merged = [(x["s"], x["e"]) for x in s]
                keep.append(sum(b - a for a, b in merged) <= max_coverage * words[i])
                if merged and keep[-1]:
                    texts[i] = _without(texts[i], merged)
            columns = [pa.array(texts, c.type) if k == at else c for k, c in enumerate(batch.columns[:n])]
            yield pa.RecordBatch.from_arrays(columns, names=own).filter(pa.array(keep))

    return map_arrow(found, cut, docs.schema)


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    (part,) = chunks(pa.array([text], pa.large_string()), lower=True)
    w = part.words(NOT_ALNUM)
    raw, out, at = text.encode(), [], 0
    for a, b in spans:
        out.append(raw[at : w.start[a]])
        at = int(w.end[b - 1])
    return b"".join([*out, raw[at:]]).decode()
