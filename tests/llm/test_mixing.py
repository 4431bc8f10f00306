from pyspark.sql import functions as F

import corpus_pipeline
from strandline.llm.mixing import mix_documents, mix_sources
from tests.llm import brute


def run(spark, rows, **kw):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    return mix_sources(docs, **kw).collect()


def test_targets_and_cut(spark):
    rows = [(i, "w " * (i % 7), s, "x") for i, s in enumerate(["a", "b", "c", None] * 50)] + [(3, None, "a", "x"), (4, "", None, "x"), (5, "p q", "a", "x"), (5, "p q", "a", "x")]
    got = run(spark, rows)
    assert len(got) == len(rows)
    total = sum(r["size"] for r in got)
    by = {}
    for r in got:
        by.setdefault(r["source"], []).append(r)
    assert abs(sum(v[0].target for v in by.values()) - 1.5 * total) < 1e-6
    for v in by.values():
        assert sum(r["taken"] for r in v) == int(v[0].target)
        assert v[0].source_size == sum(r["size"] for r in v) and v[0].target <= 2 * v[0].source_size
        assert all(0 <= r["taken"] <= 2 * r["size"] for r in v)
    # a: weight 3, b: 1, c: 2, null: 3; uncapped sources share by weight
    level = {s: v[0].target / w for (s, v), w in zip(sorted(by.items(), key=lambda x: (x[0] is None, x[0] or "")), (3, 1, 2, 3)) if v[0].target < 2 * v[0].source_size}
    assert max(level.values()) - min(level.values()) < 1e-6
    assert sorted(map(str, got)) == sorted(map(str, run(spark, rows[::-1])))


def test_no_words_and_empty(spark):
    assert [r["taken"] for r in run(spark, [(1, None, None, ""), (2, " ", "a", "")])] == [0, 0]
    assert run(spark, []) == []


def test_mixed_documents(spark):
    rows = [(i, " \n".join(f"w{i}_{j}" for j in range(i % 7)) + "\n", s, "x") for i, s in enumerate(["a", "b", "c", None] * 50)] + [(500, None, "a", "x"), (501, "", None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    got = mix_documents(docs).collect()
    assert set(got[0].asDict()) == {*docs.columns, "epoch"} and {r["size"] for r in got} == {"x"}
    taken = {r["doc_id"]: (r["taken"], r["size"]) for r in mix_sources(docs).collect()}
    copies = {}
    for r in got:
        copies.setdefault(r.doc_id, {})[r.epoch] = r.text
    assert len(got) == sum(map(len, copies.values())) and set(copies) == {i for i, (t, _) in taken.items() if t}
    text, cut = {r[0]: r[1] for r in rows}, {}
    for i, own in copies.items():
        assert sorted(own) == list(range(len(own))) and sum(len(brute.words(x)) for x in own.values()) == taken[i][0]
        partial = [x for x in own.values() if x != text[i]]
        assert all(text[i].startswith(x) and brute.words(x) for x in partial)
        cut[rows[i][2]] = cut.get(rows[i][2], 0) + len(partial)
    assert max(cut.values()) == 1 and any(len(own) > 1 for own in copies.values())
    assert mix_documents(docs.limit(0)).collect() == []


def test_pipeline_gives_documents(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert len(got) > 50 and all(brute.words(r.text) and r.n_chars == len(r.text) and r.epoch >= 0 for r in got)


def test_reruns_agree_on_equal_ids(spark):
    """Rows of one id (or none) with different texts, in other orders and with columns named as the operator's."""
    rows = [(i % 5 if i % 3 else None, " ".join(f"w{i}_{j}" for j in range(1 + i % 9)), "ab"[i % 2], "x") for i in range(90)] + [(1, "long " * 100_000, "a", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, key string").withColumn("bucket", F.lit("b"))
    spelt = lambda df: sorted(str((r["doc_id"], r["size"], r["taken"])) for r in mix_sources(df).collect())
    words = lambda df: sorted(str(tuple(r)) for r in mix_documents(df).collect())
    first, mixed = spelt(docs), words(docs)
    assert len(first) == len(rows)
    for n in (1, 7):
        other = docs.orderBy(F.xxhash64("text", F.lit(n))).repartition(n)
        assert spelt(other) == first and words(other) == mixed
