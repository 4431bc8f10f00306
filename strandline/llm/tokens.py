"""Token counts by rank-synchronous merging of ragged arrays.

``WordBpe`` reads a ``tokenizers`` file of the kind "byte-level BPE with word
ends" (NFC, white space collapsed, lower case; contractions, letter runs, single
numbers and runs of other characters as pre-tokens). Texts are cut into
pre-tokens by array operations over code points; the distinct pre-tokens of a
chunk that are not in the worker's cache are merged together: one flat array of
symbols and one of sequence numbers. In each round every sequence applies its
own lowest-ranked pair wherever it occurs (left to right where occurrences
overlap), until no sequence has a known pair. The surviving symbols are counted.

A pre-token is identified by its 64-bit hash and length; the cache is a sorted
array of at most ``CACHE_ENTRIES`` and is emptied when full, so memory is
bounded. Edge cases: null is the empty text (0 bytes, 0 tokens); the strings of
special tokens inside a text are one token each, as the library does by default;
there is no truncation, however long a text is; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Tokenizer

from strandline.llm._text import chunks, map_arrow, mix, span_hashes

CACHE_ENTRIES = 1_000_000
SPACE, LETTER, NUMBER, OTHER = range(4)
#: What may follow an apostrophe at the start of a pre-token (fixed by the vocabulary's pattern).
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def _classes(library: Tokenizer) -> tuple[np.ndarray, dict[int, str]]:
    """Class of each code point by its general category, and lower cases that this Python lacks.

    Unicode versions differ: code points that are unassigned here are classed and
    lower-cased as the library's own normaliser and pre-tokenizer do.
    """
    by_category = {"L": LETTER, "N": NUMBER}
    categories = [unicodedata.category(chr(c)) for c in range(0x110000)]
    out = np.array([by_category.get(c[0], OTHER) for c in categories], np.uint8)
    out[[c for c in range(0x3001) if chr(c).isspace() and not 0x1C <= c <= 0x1F]] = SPACE
    unknown = [c for c in range(0x40000) if categories[c] == "Cn"]
    pieces = Counter(at[0] // 5 for _, at in library.pre_tokenizer.pre_tokenize_str("".join(f"a{chr(c)}{chr(c)}b " for c in unknown)))
    for i, c in enumerate(unknown):
        out[c] = {1: LETTER, 3: OTHER, 4: NUMBER}[pieces[i]]
    lowered = library.normalizer.normalize_str(" ".join(map(chr, unknown))).split(" ")
    return out, {c: x for c, x in zip(unknown, lowered, strict=True) if x != chr(c)}


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    known = {b: chr(b) for b in shown}
    return [known[b] if b in known else chr(next(spare)) for b in range(256)]


class WordBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        symbols = _byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.final = np.array([vocab[s + suffix] for s in symbols], np.int64)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.uint64)
        order = np.argsort(keys)
        self.keys, self.rank = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]))
        self.marks = [t["content"] for t in spec["added_tokens"]]
        self.classes, self.lower = _classes(Tokenizer.from_file(path))
        self._forget()

    def _forget(self) -> None:
        self.known, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    # -- merging -----------------------------------------------------------

    def merge_counts(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Number of tokens of each byte sequence ``data[start:end]`` (none is empty)."""
        size = end - start
        seq = np.repeat(np.arange(len(size)), size)
        first = np.cumsum(size) - size
        byte = data[np.arange(len(seq)) - np.repeat(first - start, size)]
        sym = self.inner[byte]
        last = first + size - 1
        sym[last] = self.final[byte[last]]
        out = np.zeros(len(size), np.int64)
        while len(sym):
            rank = self._ranks(sym, seq)
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            best = np.minimum.reduceat(rank, starts)
            length = np.diff(np.r_[starts, len(seq)])
            done = best == _NONE
            if done.any():
                out[seq[starts[done]]] = length[done]
                keep = np.repeat(~done, length)
                sym, seq, rank = sym[keep], seq[keep], rank[keep]
                best, length = best[~done], length[~done]
                if not len(sym):
                    break
            hit = rank == np.repeat(best, length)
            left = self._non_overlapping(hit, rank)
            sym[left] = self.merged[rank[left]]
            keep = np.ones(len(sym), bool)
            keep[left + 1] = False
            sym, seq = sym[keep], seq[keep]
        return out

    def _ranks(self, sym: np.ndarray, seq: np.ndarray) -> np.ndarray:
        """Rank of the pair that begins at each symbol; ``_NONE`` where there is none."""
        rank = np.full(len(sym), _NONE)
        if len(sym) > 1:
            key = (sym[:-1] << 32 | sym[1:]).astype(np.uint64)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = (self.keys[at] == key) & (seq[:-1] == seq[1:])
            rank[:-1][ok] = self.rank[at[ok]]
        return rank

    @staticmethod
    def _non_overlapping(hit: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Of neighbouring hits of one pair, every second: only runs of one symbol overlap."""
        at = np.flatnonzero(hit)
        chained = np.r_[False, (np.diff(at) == 1) & (rank[at[1:]] == rank[at[:-1]])]
        place = np.arange(len(at))
        head = np.maximum.accumulate(np.where(chained, 0, place))
        return at[(place - head) % 2 == 0]

    # -- pre-tokens ----------------------------------------------------------

    def normalise(self, text: str) -> str:
        """NFC and lower case, character by character (a final sigma is not special)."""
        if text.isascii():
            return text.lower()
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower().translate(self.lower)

    def bounds(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each pre-token of an array of code points that ends in white space."""
        kind = self.classes[points]
        begin = np.zeros(len(points) + 1, bool)
        begin[1:-1] = kind[1:] != kind[:-1]
        begin[0] = begin[-1] = True
        begin[:-1] |= kind == NUMBER
        quotes = np.flatnonzero(points == 0x27)
        if len(quotes):
            # an apostrophe that starts a run of other characters may open a contraction
            quotes = quotes[begin[quotes]]
            padded = np.concatenate([points, np.zeros(2, points.dtype)])
            free = np.ones(len(quotes), bool)
            for tail in CONTRACTIONS:
                match = free.copy()
                for i, c in enumerate(tail):
                    match &= padded[quotes + 1 + i] == ord(c)
                free &= ~match
                q = quotes[match]
                begin[q + 1] = False
                begin[q + 1 + len(tail)] = True
        edges = np.flatnonzero(begin)
        start, end = edges[:-1], edges[1:]
        keep = kind[start] != SPACE
        return start[keep], end[keep]

    def counts_of(self, texts: list[str]) -> np.ndarray:
        """Number of tokens of each text."""
        total = np.zeros(len(texts), np.int64)
        pieces, owner = [], []
        for i, text in enumerate(texts):
            if any(m in text for m in self.marks):
                parts = self.special.split(text)
                total[i] += len(parts) - 1
            else:
                parts = [text]
            pieces += [self.normalise(p) + "\n" for p in parts]
            owner += [i] * len(parts)
        points = np.frombuffer("".join(pieces).encode("utf-32-le"), np.uint32)
        if not len(points):
            return total
        start, end = self.bounds(points)
        if not len(start):
            return total
        limits = np.cumsum([len(p) for p in pieces])
        doc = np.asarray(owner)[np.searchsorted(limits, start, "right")]
        key = span_hashes(mix(points.astype(np.uint64) + np.uint64(1)), start, end)
        distinct, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        n = self._distinct_counts(distinct, points, start[first], end[first])
        total += np.bincount(doc, n[inverse], minlength=len(texts)).astype(np.int64)
        return total

    def _distinct_counts(self, keys: np.ndarray, points: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.known, keys), max(len(self.known) - 1, 0))
        have = self.known[at] == keys if len(self.known) else np.zeros(len(keys), bool)
        out[have] = self.counts[at[have]]
        new = np.flatnonzero(~have)
        if len(new):
            size = end[new] - start[new]
            first = np.cumsum(size) - size
            chars = points[np.arange(size.sum()) - np.repeat(first - start[new], size)]
            data = np.frombuffer(chars.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
            width = 1 + (chars > 0x7F).astype(np.int64) + (chars > 0x7FF) + (chars > 0xFFFF)
            edge = np.concatenate([[0], np.cumsum(width)])
            out[new] = self.merge_counts(data, edge[first], edge[first + size])
            if len(self.known) + len(new) > CACHE_ENTRIES:
                self._forget()
            keep = new[:CACHE_ENTRIES]
            where = np.searchsorted(self.known, keys[keep])
            self.known, self.counts = np.insert(self.known, where, keys[keep]), np.insert(self.counts, where, out[keep])
        return out


_NONE = np.iinfo(np.int64).max


@lru_cache(maxsize=2)
def counter(path: str) -> WordBpe:
    """One counter per worker process and vocabulary; its cache lives as long as the worker."""
    return WordBpe(path)


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 2048, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens).

    ``vocabulary`` is a path that every executor can open.
    """
    id_type = docs.schema[doc_id].dataType
    schema = T.StructType(
        [T.StructField("doc_id", id_type), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
    )

    def run(batches):
        bpe = counter(vocabulary)
        for batch in batches:
            for part in chunks(batch.column(1), limit=1 << 20):
                texts = [part.bytes_of(i).decode("utf-8") for i in range(part.n)]
                n = bpe.counts_of(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(part.first, part.n), pa.array(np.diff(part.offs), pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)], names=schema.names
                )

    return map_arrow(docs.select(docs[doc_id], docs[text]), run, schema)
