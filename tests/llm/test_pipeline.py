"""The pipeline's stages on a small corpus with planted cases, each judged on its own input."""

import random

import corpus_pipeline
from strandline.llm import mixing, quality
from tests.llm import brute

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(r):
    vocab = [f"word{i}" for i in range(4000)]
    some = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    item = some(30)
    shared = some(80)
    rows = [(i, some(r.randrange(80, 300)), "en", f"s{i % 3}") for i in range(300)]
    near = rows[0][1].split()
    near[3] = "changed"
    rows += [(400, rows[0][1], "en", "s0"), (401, " ".join(near), "en", "s1"), (402, "### " * 90, "en", "s0"), (403, "short text", "en", "s0"), (404, None, "en", None)]
    rows += [(500 + i, some(90) + " " + shared + " " + some(90), "en", "s2") for i in range(4)]
    rows += [(600, some(100) + " " + item + " " + some(100), "en", None), (601, item + " " + item.upper() + " " + some(20), "en", "s1")]
    rows += [(700, rows[7][1], "en", "s1")] * 2
    return [(*x, len(x[1] or "")) for x in rows], item


def test_stages(spark, tmp_path):
    rows, item = corpus(random.Random(6))
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, "never seen words in here")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    at = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        at[name] = (before.collect(), docs.collect())
        if name != "mixing_sources":
            assert docs.columns == before.columns and docs.schema == before.schema

    before, after = at["quality_rules"]
    verdicts = {r.doc_id: r.kept for r in quality.score_documents(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()}
    assert {r.doc_id for r in after} == {i for i, k in verdicts.items() if k} and not {402, 403, 404} & {r.doc_id for r in after}
    assert len(after) == sum(verdicts[r.doc_id] for r in before)

    before, after = at["minhash_near_dedup"]
    left = sorted(r.doc_id for r in after)
    sets = {r.doc_id: brute.shingles(r.text) for r in before}
    assert len(left) == len(set(left)) and not {400, 401, 700} & set(left)
    for d, s in sets.items():  # everything that went has a smaller relative that stayed
        assert d in left or any(k < d and len(s & sets[k]) >= 0.8 * len(s | sets[k]) for k in left)
    assert all(len(sets[a] & sets[b]) < 0.8 * len(sets[a] | sets[b]) for i, a in enumerate(left) for b in left[:i])

    before, after = at["substring_dedup"]
    want = {d: n - m for d, n, m, _ in brute.substring_dedup([(r.doc_id, r.text) for r in before])}
    assert {r.doc_id: len(brute.words(r.text)) for r in after} == {d: n for d, n in want.items() if n}
    assert want[501] == want[500] - 80
    assert all(r.n_chars == len(r.text) for r in after)

    before, after = at["benchmark_decontamination"]
    hits = {d: (n, h) for d, n, h, *_ in brute.contamination([(r.doc_id, r.text) for r in before], [(1, item), (2, "never seen words in here")])}
    assert {r.doc_id for r in after} == {d for d, (n, h) in hits.items() if h <= 0.5 * n}
    assert {r.doc_id: len(brute.words(r.text)) for r in after} == {r.doc_id: len(brute.words(r.text)) - hits[r.doc_id][1] for r in before if hits[r.doc_id][1] <= 0.5 * hits[r.doc_id][0]}
    assert hits[600][1] == 30

    before, after = at["mixing_sources"]
    plan = {r.doc_id: r for r in mixing.mix_sources(spark.createDataFrame(before)).collect()}
    took = {}
    for r in after:
        took[r.doc_id] = took.get(r.doc_id, 0) + len(brute.words(r.text))
        assert r.n_chars == len(r.text) and set(r.asDict()) == {*before[0].asDict(), "epoch"}
    assert took == {d: r.taken for d, r in plan.items() if r.taken}
    for source in {r.source for r in before}:
        own = [r for r in plan.values() if r.source == source]
        assert sum(r.taken for r in own) == int(own[0].target)


def test_run(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert len({r.doc_id for r in rows}) > 50 and len({(r.doc_id, r.epoch) for r in rows}) == len(rows)
