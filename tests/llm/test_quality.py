import random

import pytest
from pyspark.sql import functions as F

from strandline.llm import quality
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_words string"


def corpus():
    r = random.Random(7)
    vocab = ["ab", "c#", "été", "x|y", "a", "b", "zz%", "😀k"]
    texts = [None, "", " \n\t ", "a a a a a", "l\nl\n \n\nl", "x y z", "a\rb\x0bc\x0cd", "\n", "a\n\n"]
    texts += ["".join(r.choice(vocab) + r.choice([" ", "\n", "  ", "\t"]) for _ in range(r.randrange(1, 120))) for _ in range(80)]
    texts += [" ".join(f"w{i % 5000}" for i in range(60_000))]
    return [(None if i == 5 else i // 2, t, r.choice(["en", None]), r.choice(["s", None]), "clash") for i, t in enumerate(texts)]


def test_counts_match_brute_force(spark):
    rows = corpus()
    got = quality.measure(spark.createDataFrame(rows, SCHEMA), "text", "q_").collect()
    assert sorted((tuple(r[f"q_{c}"] for c in quality.COUNTS) for r in got)) == sorted(brute.quality_counts(r[1]) for r in rows)
    assert {r["n_words"] for r in got} == {"clash"}


def test_verdicts(spark):
    clean = [(i, " ".join(f"word{(i * 131 + j * j) % 9973}" for j in range(200)), "en", "s" + str(i % 3)) for i in range(400)]
    junk = [(1000 + i, " ".join(f"w{i}{j}###" for j in range(100)), "en", "s0") for i in range(10)]
    docs = spark.createDataFrame(clean + junk + [(2000, None, None, None)], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality.score_documents(docs).collect()}
    assert all(got[i].kept for i, *_ in clean)
    assert not any(got[i].kept for i, *_ in junk) and not any(got[i].base_failed for i, *_ in junk)
    assert got[2000].base_failed and not got[2000].kept
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}


def test_sketch_is_close_to_exact(spark):
    measured = spark.range(5000).select(F.lit("en").alias("lang"), F.lit(1000).cast("long").alias("n_words"), *(F.col("id").alias(c) for c in quality.COUNTS[1:]))
    rules = quality.Rules()
    q = {r.ratio: r for r in quality._quantiles(quality.sketches(measured, ["lang"], rules), ["lang"], rules).collect()}
    assert abs(q["symbols"].q25 / 1.2495 - 1) < 0.011 and abs(q["symbols"].q75 / 3.7495 - 1) < 0.011


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert quality.score_documents(docs).count() == 0 and quality.keep_good(docs).count() == 0


def test_own_distribution_sets_the_fence(spark):
    text = lambda i, n: " ".join(f"word{(i * 131 + j * j) % 9973}" + "#" * (j < n) for j in range(200))
    plain = [(i, text(i, 0), "en", "plain") for i in range(300)] + [(1000, text(1000, 16), "en", "plain")]
    marked = [(2000 + i, text(i, i % 40), "en", "marked") for i in range(300)] + [(3000, text(3000, 16), "en", "marked")]
    lines = [" ".join(f"line{k}_{j}" for j in range(9)) for k in range(13)]
    again = [(4000, "\n".join(lines + lines[:7]), "en", "plain"), (4001, "\n".join(lines), "en", "plain")]
    docs = spark.createDataFrame(plain + marked + again, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality.score_documents(docs, quality.Rules(max_repeat_percent=80)).collect()}
    assert all(got[i].kept for i in range(300)) and not got[1000].kept and got[3000].kept  # 0.08 symbols a word
    assert (got[4000].n_lines, got[4000].n_dup_lines) == (20, 7) and got[4001].kept and not got[4000].base_failed


def test_repeated_lines_are_a_share_of_lines(spark):
    """35 % of the lines repeated, all other ratios out of play."""
    lines = [" ".join(f"w{k}_{j}" for j in range(9)) for k in range(13)]
    rows = [(i, " ".join(f"w{i}_{j}" for j in range(200)), "en", "s") for i in range(250)] + [(900, "\n".join(lines + lines[:7]), "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    rules = quality.Rules(max_repeat_percent=100, high={"dup_lines": quality.Rules().high["dup_lines"]}, low={})
    got = {r.doc_id: r.kept for r in quality.score_documents(docs, rules).collect()}
    assert all(got[i] for i in range(250)) and not got[900]


def test_groups_need_opposite_verdicts_and_names_are_kept_apart(spark):
    """The share of symbols that is usual in one source is far out in another; small groups lean on their language."""
    text = lambda i, n: " ".join(f"word{(i * 131 + j * j) % 9973}" + "#" * (j < n) for j in range(200))
    rows = [(i, text(i, 0), "en", "plain") for i in range(2000)] + [(5000 + i, text(i, 30 + i % 20), "en", "code") for i in range(2000)]
    rows += [(9000, text(1, 45), "en", "plain"), (9001, text(1, 45), "en", "code"), (9002, text(1, 200), "en", "tiny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.kept for r in quality.score_documents(docs).collect()}
    assert not got[9000] and got[9001] and not got[9002]
    measured = quality.measure(docs).drop("text")
    fence = {r.source: r["__hi_symbols"] for r in quality.thresholds(measured, ["lang", "source"], quality.Rules()).collect()}
    assert fence["plain"] < fence["code"]
    with pytest.raises(ValueError):
        quality.keep_good(docs.withColumn("__q_x", F.lit(1)))
