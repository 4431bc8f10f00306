import random

import numpy as np
import pytest

from strandline.llm import substring
from strandline.llm._text import mix, window_starts
from tests.llm import brute


def corpus():
    r = random.Random(11)
    vocab = [f"w{i}" for i in range(400)] + ["é", "x\x1cy", "😀"]
    some = lambda n: [r.choice(vocab) for _ in range(n)]
    passages = [some(n) for n in (49, 50, 51, 70, 200)] + [["run"] * 120, ["a", "b"] * 60, ["p", "q", "r", "s", "t"] * 30]
    rows = []
    for i in range(120):
        w = some(r.randrange(0, 150))
        for _ in range(r.randrange(3)):
            p = r.choice(passages)
            w += p[r.randrange(0, 8) :] + some(r.randrange(60))
        rows.append((i, r.choice([" ", "\n", "  ", "\t"]).join(w)))
    rows += [(200 + i, rows[3][1]) for i in range(5)] + [(7, rows[20][1]), (7, rows[20][1]), (300, None), (301, ""), (None, rows[4][1]), (None, None)]
    rows += [(-5, " ".join(passages[4])), (400, " ".join(some(3000) * 20)), (401, " ".join(["run"] * 1000)), (402, "run " * 49), (403, "run " * 50)]
    r.shuffle(rows)
    return rows


def test_against_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*x, "c", 1) for x in rows], "doc_id long, text string, th string, key int")
    got = sorted(map(tuple, substring.digest_kept(docs).collect()), key=str)
    assert got == sorted(brute.substring_dedup(rows), key=str)
    texts = sorted((r.doc_id, r.text) for r in substring.remove_repeats(docs).collect() if r.doc_id is not None)
    want = {(d, n, m, s) for d, n, m, s in brute.substring_dedup(rows) if d is not None and (m == 0 or m < n)}
    assert len(texts) == sum(1 for d, n, m, _ in brute.substring_dedup(rows) if d is not None and (m == 0 or m < n))
    assert {d for d, _ in texts} == {d for d, *_ in want}


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert substring.digest_kept(docs).collect() == [] and substring.remove_repeats(docs).collect() == []


@pytest.mark.parametrize("alphabet", [2, 3, 50, 5000])
def test_equal_windows_pick_equal_symbols(alphabet):
    """Two texts that share a stretch agree on the pick of every window inside it."""
    r = np.random.default_rng(alphabet)
    for k in (10, 50):
        shared = mix(r.integers(0, alphabet, 180).astype(np.uint64))
        texts = [np.concatenate([mix(r.integers(0, alphabet, r.integers(0, 90)).astype(np.uint64)), shared, mix(r.integers(0, alphabet, r.integers(0, 90)).astype(np.uint64))]) for _ in range(6)]
        starts = np.cumsum([0, *map(len, texts)])
        at, key = substring.window_anchors(np.concatenate(texts), starts, k)
        assert np.array_equal(at, window_starts(starts, k))
        seen = {}
        codes = np.concatenate(texts)
        for p, q in zip(at, key, strict=True):
            assert seen.setdefault(codes[p : p + k].tobytes(), q) == q
