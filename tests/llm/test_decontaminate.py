import pickle
import random

from strandline.llm.decontaminate import Matcher, contamination, find_spans, remove_contamination
from tests.llm import brute

ITEMS = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"),
    (2, "one two three"),
    (3, ""),
    (4, None),
    (None, "nil nil item"),
    (10, "Beta gamma delta epsilon zeta eta theta iota kappa LAMBDA!"),
    (10, "solo"),
    (5, "a a a a a a a a a a a a"),
    (6, "ünï code wörds"),
]


def items(spark, rows=ITEMS):
    return spark.createDataFrame(rows, "item_id long, text string")


def corpus():
    r = random.Random(5)
    rows = [(0, None), (1, ""), (2, "x alpha beta gamma delta epsilon zeta eta theta iota kappa y"), (3, "one-two,THREE one two three"), (3, "solo"), (None, "nil nil item"), (4, "a " * 40), (5, "ünï code wörds. ÜNÏ"), (6, "one two")]
    vocab = " ".join(t for _, t in ITEMS if t).split() + ["out"]
    rows += [(100 + i, " ".join(r.choice(vocab[:14]) if r.random() < 0.3 else vocab[(i + j) % len(vocab)] for j in range(r.randrange(80)))) for i in range(150)]
    rows += [(900, "filler words " * 40_000 + " one two three " + "more text " * 40_000)]
    return rows


def check(spark, rows, item_rows, **kw):
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, n_words string")
    got = sorted(map(tuple, contamination(docs, items(spark, item_rows), **kw).collect()), key=str)
    assert got == sorted(brute.contamination(rows, item_rows), key=str)


def test_against_brute_force(spark):
    check(spark, corpus(), ITEMS)


def test_blocks_give_the_same(spark):
    check(spark, corpus()[:60], ITEMS, block_bytes=60)


def test_one_python_stage_holds_one_block(spark):
    docs = spark.createDataFrame(corpus()[:9], "doc_id long, text string")
    many = find_spans(docs, items(spark), block_bytes=20)
    assert many._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_automaton_is_compact():
    r = random.Random(4)
    words = [f"word{i}" for i in range(20_000)]
    rows = [(str(i), " ".join(r.choice(words) for _ in range(100))) for i in range(300)]
    size = sum(len(t) for _, t in rows)
    assert len(pickle.dumps(Matcher(rows, 10))) < 40 * size


def test_many_random_items(spark):
    r = random.Random(9)
    words = [f"w{i}" for i in range(6)]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randrange(1, 24)))) for i in range(60)]
    texts = [(i, " ".join(r.choice(words) for _ in range(r.randrange(300)))) for i in range(40)]
    check(spark, texts, rows)


def test_empty_tables(spark):
    check(spark, [], ITEMS)
    check(spark, corpus()[:9], [])


def test_removal(spark):
    docs = spark.createDataFrame([(1, "keep  this\nalpha, beta gamma delta epsilon zeta eta theta iota kappa! and all of these other words here too ok", "x"), (2, "solo", "x"), (3, "clean  text", "x"), (4, None, "x")], "doc_id long, text string, __x string")
    got = {r.doc_id: r.text for r in remove_contamination(docs, items(spark)).collect()}
    assert got == {1: "keep  this\n! and all of these other words here too ok", 3: "clean  text", 4: None}
