import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from strandline.llm import tokens

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def both(library, texts):
    got = tokens.counter(PATH).counts_of(texts)
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    return [(t[:60], int(g), w) for t, g, w in zip(texts, got, want) if g != w]


def test_hand_made(library):
    texts = ["", " ", "Hello World", "don't can'tve we'll I'd !'s x's 's 'S 'RE ''s 'x", "aaaaaaaaaaa", "12345 ½ Ⅷ x2y", "<|endoftext|>", "a<|startoftext|>'s<|endoftext|><|endoftext|> b", "<|ENDOFTEXT|>"]
    texts += ["ΑΣΑΣ Σ", "İstanbul ẞß", "é é ́a", "Å Å", "a\u0085b c​d e\x1cf\x00g", "😀😀 👨‍👩‍👧", "日本語テスト", "ﬁ ﷺ", "x" * 5000, "!?" * 900]
    assert not both(library, texts)


def test_every_code_point(library):
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["a%sb %s" % (chr(c), chr(c)) for c in points[::7]]
    bad = both(library, texts)
    assert not bad, (len(bad), bad[:10])


def test_random_texts(library):
    r = random.Random(3)
    parts = ["the", "ing", "aa", "a", "'", "s", "ll", " ", "\n", "é", "Σ", "7", "!", "###", "<|endoftext|>", "́", "Zürich", "ñandú", "。"]
    assert not both(library, ["".join(r.choice(parts) for _ in range(r.randrange(60))) for _ in range(3000)])


def test_query_and_edges(spark, library):
    rows = [(1, None, 5), (None, "", 5), (2, "some words here", 5), (2, "some words here", 5), (3, "word " * 2048, 5), (4, "word " * 2049, 5), (5, "ab " * 300_000, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.count_tokens(docs, PATH).collect()}
    assert got == {(1, 0, 0, False), (None, 0, 0, False), (2, 15, 3, False), (3, 10240, 2048, False), (4, 10245, 2049, True), (5, 900_000, 300_000, True)}
    assert tokens.count_tokens(docs.limit(0), PATH).collect() == []


def test_cache_is_bounded(library, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_ENTRIES", 50)
    bpe = tokens.WordBpe(PATH)
    texts = [f"word{i} thing{i * 7}" for i in range(200)]
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):
        assert [int(bpe.counts_of([t])[0]) for t in texts] == want
        assert len(bpe.known) <= 50
