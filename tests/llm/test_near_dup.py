import random

import numpy as np
import pytest

from strandline.llm import near_dup
from tests.llm import brute


def corpus():
    r = random.Random(21)
    vocab = [f"w{i}" for i in range(3000)]
    some = lambda n: [r.choice(vocab) for _ in range(n)]
    texts = [some(r.randrange(20, 200)) for _ in range(60)]
    rows = [" ".join(t) for t in texts]
    for t in texts[:25]:  # families of edits about the border of 0.8
        for _ in range(6):
            e = list(t)
            for _ in range(r.randrange(0, max(2, len(t) // 25))):
                e[r.randrange(len(e))] = r.choice(vocab)
            rows.append(" ".join(e))
    hub = some(300)
    for i in range(60):  # a family whose members are nearer to its origin than to each other
        e = list(hub)
        for j in range(5):
            e[(i * 37 + j * 53) % 300] = f"x{i}_{j}"
        rows.append(" ".join(e))
    rows += [" ".join(hub)] * 3 + [rows[0].replace(" ", "\n ")] + ["a b c", "a b c", "a b d", "", " ", None, None]
    out = [(i * 3 % 1009, t) for i, t in enumerate(rows)]
    return out + [(None, rows[5]), (None, None), out[7], out[7]]


def brute_classes(rows, least=0.8):
    sets = [brute.shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    classes = {}
    for i in range(len(rows)):
        classes.setdefault(find(i), []).append(i)
    return list(classes.values())


def test_classes_match_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*x, "c", 1) for x in rows], "doc_id long, text string, fp string, n int")
    got = near_dup.classify(docs).collect()
    assert len(got) == len(rows)
    want = []
    for members in brute_classes(rows):
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        want += [(rows[i][0], min(ids, default=None), len(members)) for i in members]
    key = lambda x: tuple(str(y) for y in x)
    assert sorted(((r.doc_id, r.class_id, r.class_size) for r in got), key=key) == sorted(want, key=key)
    kept = near_dup.keep_one(docs)
    assert kept.columns == docs.columns
    with_words = [c for c in brute_classes(rows) if brute.words(rows[c[0]][1])]
    assert sum(1 for r in kept.collect() if brute.words(r.text)) == len(with_words)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert near_dup.classify(docs).collect() == [] and near_dup.keep_one(docs).collect() == []


@pytest.mark.parametrize("weighted", [False, True])
def test_signatures_estimate_similarity(weighted):
    """Coordinates agree as often as the (weighted) Jaccard similarity says."""
    rng = np.random.default_rng(4)
    elements = np.sort(rng.integers(0, 2**63, 900).astype(np.uint64))
    a, b = elements[:600], elements[200:]
    wa = rng.integers(1, 6, 600).astype(float) if weighted else np.ones(600)
    wb = rng.integers(1, 6, 700).astype(float) if weighted else np.ones(700)
    k = 2000
    s, have = near_dup.dart_signatures(np.concatenate([a, b]), np.concatenate([wa, wb]), np.array([0, 600, 1300]), k)
    assert have.mean() > 0.99
    full_a, full_b = np.zeros(900), np.zeros(900)
    full_a[:600], full_b[200:] = wa, wb
    want = np.minimum(full_a, full_b).sum() / np.maximum(full_a, full_b).sum()
    both = have.all(axis=0)
    assert abs((s[0] == s[1])[both].mean() - want) < 0.04


def test_signatures_do_not_depend_on_slices(monkeypatch):
    rng = np.random.default_rng(5)
    elements = rng.integers(0, 2**63, 5000).astype(np.uint64)
    bounds = np.array([0, 3, 3, 4000, 5000])
    whole = near_dup.dart_signatures(elements, np.ones(5000), bounds, 80)
    slices = near_dup._slices
    monkeypatch.setattr(near_dup, "_slices", lambda cells, limit: slices(cells, 97))
    parts = near_dup.dart_signatures(elements, np.ones(5000), bounds, 80)
    assert all(np.array_equal(x, y) for x, y in zip(whole, parts, strict=True))


def test_weighted_similarity(spark):
    rows = [(1, "a b c d e " * 40 + "tail one two three four"), (2, "a b c d e " * 36 + "tail one two three four"), (3, "a b c d e " * 10 + "tail one two three four")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dup.classify(docs, weights="count").collect()}
    assert got == {1: 1, 2: 1, 3: 3}
    assert {r.class_id for r in near_dup.classify(docs).collect()} == {1}


def hot_corpus():
    """Texts with two thirds of their words from one template, and pairs that differ in a few words of it."""
    r = random.Random(31)
    template = [f"t{i}" for i in range(100)]
    rows = []
    for i in range(240):
        own = template + [f"u{i}_{j}" for j in range(50)]
        rows.append(" ".join(own))
        if i % 30 == 0:
            own[r.randrange(100)] = own[r.randrange(100, 150)] = "edited"
            rows.append(" ".join(own))
    return list(enumerate(rows))


@pytest.mark.parametrize("weights", ["set", "count"])
def test_no_link_is_missed_in_a_hot_bucket(spark, weights):
    rows = hot_corpus()
    sets = [brute.shingles(t) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    name = lambda i: b"%04d" % (i * 7919 % 9973)
    texts = spark.createDataFrame([(name(i), t) for i, t in rows], "fp binary, text string")
    buckets = spark.createDataFrame([(1, name(i), len(s), len(rows)) for i, s in enumerate(sets)], "key long, fp binary, n int, score long")
    found = near_dup._links(buckets, near_dup.materialize(near_dup._set_rows(texts, 5, weights), "sets"), 0.8, weights)
    root = {bytes(r.fp): bytes(r.root) for r in found.collect()}
    missed = sum(root[name(a)] != root[name(b)] for a, b in links)
    print(f"missed {missed} of {len(links)} links")
    assert len(links) == 8 and missed == 0 and len(set(root.values())) == len(rows) - 8


def test_documents_without_words_all_stay(spark):
    rows = [(1, ""), (1, ""), (None, None), (None, None), (2, "a b"), (2, "a b"), (3, "word " * 100_000)]
    kept = near_dup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), (r.text or "")[:4]) for r in kept) == [("1", ""), ("1", ""), ("2", "a b"), ("3", "word"), ("None", ""), ("None", "")]
