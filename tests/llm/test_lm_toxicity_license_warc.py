import gzip
import hashlib
import math
import random
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandline.llm import licenses, lm, toxicity, warc
from strandline.llm._text import NOT_ALNUM, chunks
from strandline.storage import scratch_path
from tests.llm import brute


# -- language model ---------------------------------------------------------------


def lm_rows():
    r = random.Random(2)
    vocab = ["Ab", "ab", "c", "été", "x\x1cy", "😀", "longerword", "zz"]
    rows = [(i, " ".join(r.choice(vocab) for _ in range(r.randrange(0, 40)))) for i in range(60)]
    return rows + [(None, "ab c"), (70, None), (71, ""), (71, " \n"), (72, "unseen tokens ñ"), (5, rows[5][1])]


def ppm(rows, order=lm.ORDER):
    """The definition, symbol by symbol, with explicit exclusion sets."""
    spelt = [" ".join(brute.words(brute.lower(t))).encode() + bytes([lm.END]) for _, t in rows]
    follow = defaultdict(Counter)
    for (d, _), s in zip(rows, spelt):
        if lm.crc_remainder(d, 7) != 2:
            full = bytes([lm.START]) * order + s
            for i in range(order, len(full)):
                for k in range(order + 1):
                    follow[full[i - k : i]][full[i]] += 1
    out = []
    for s in spelt:
        full, total = bytes([lm.START]) * order + s, 0.0
        for i in range(order, len(full)):
            excluded = set()
            for k in range(order, -1, -1):
                seen = {c: n for c, n in follow.get(full[i - k : i], {}).items() if c not in excluded}
                if not seen:
                    continue
                mass = sum(seen.values()) + len(seen)
                if full[i] in seen:
                    total += math.log10(seen[full[i]] / mass)
                    break
                total += math.log10(len(seen) / mass)
                excluded |= set(seen)
            else:
                total -= math.log10(256 - len(excluded))
        out.append(total)
    return out


@pytest.mark.parametrize("chunk_bytes", [16 << 20, 300])
def test_lm_matches_definition(spark, chunk_bytes):
    rows = lm_rows()
    docs = spark.createDataFrame([(*x, "c") for x in rows], "doc_id long, text string, score string")
    got = lm.score_texts(docs, chunk_bytes=chunk_bytes).collect()
    train = Counter()
    for d, t in rows:
        if lm.crc_remainder(d, 7) != 2:
            train.update(brute.words(brute.lower(t)) + [None])
    n, v = sum(train.values()), len(train)
    want = []
    for (d, t), score in zip(rows, ppm(rows)):
        tokens = brute.words(brute.lower(t)) + [None]
        base = sum(math.log10((train[x] + 1) / (n + v + 1)) for x in tokens)
        want.append((str(d), lm.crc_remainder(d, 7) == 2, len(tokens), sum(train[x] > 0 for x in tokens), n, round(base, 8), round(score, 8)))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 8), round(r.score, 8)) for r in got) == sorted(want)


def test_lm_empty_and_untrained(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score_texts(docs).collect() == []
    held = next(i for i in range(100) if lm.crc_remainder(i, 7) == 2)
    (r,) = lm.score_texts(spark.createDataFrame([(held, "ab")], docs.schema)).collect()
    assert r.train_tokens == 0 and r.n_known == 0 and abs(r.score + 3 * math.log10(256)) < 1e-9


# -- toxicity ----------------------------------------------------------------------


def test_toxicity_learns_from_training_fold(spark):
    r = random.Random(3)
    vocab = [f"{a}{b}{c}" for a in ("than", "hes", "rion") for b in ("ed", "ou", "ble") for c in ("st", "wh", "ty")]
    rows, labels = [], []
    for i in range(1200):
        words = [r.choice(vocab) for _ in range(r.randrange(5, 120))]
        toxic = r.random() < 0.3
        if toxic:
            words.insert(r.randrange(len(words)), r.choice(["Badword", "horrid", "VILE-thing"]))
        rows.append((i, " ".join(words), "t"))
        labels += [(i, int(toxic))] * (1 + i % 2)
    rows += [(5000, None, "t"), (5001, "", "t"), (None, "some text", "t"), (5002, "horrid " * 20_000, "t")]
    labels += [(5000, None), (None, 1), (9999, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {x.doc_id: x for x in toxicity.score_toxicity(docs, marks).collect()}
    assert len(got) == len(rows) and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in got.values())
    truth = dict(x for x in labels if x[0] is not None and x[0] < 1200)
    held = [x for x in got.values() if x.held_out and x.doc_id in truth]
    assert len(held) > 150 and sum(x.predicted == truth[x.doc_id] for x in held) / len(held) > 0.97
    assert got[5001].predicted == 0 and got[5002].predicted == 1
    # labels of held-out rows change nothing
    flipped = marks.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {x.doc_id: x.score for x in toxicity.score_toxicity(docs, flipped).collect()}
    assert all(abs(again[i] - x.score) < 1e-9 for i, x in got.items())


def test_toxicity_without_labels_or_documents(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity.score_toxicity(docs, none).collect()] == [0.5]
    assert toxicity.score_toxicity(docs.limit(0), none).collect() == []


# -- licences ----------------------------------------------------------------------


def license_truth(text, least=0.8):
    """Best containment of each licence in a window of three template lengths, by brute force; those that explain more hide what they overlap."""
    w = [x.encode() for x in brute.ALNUM.findall(brute.lower(text))]
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    where = defaultdict(list)
    for i, g in enumerate(grams):
        where[g].append(i)
    hits = set()
    for name, templates in licenses.TEMPLATES.items():
        for t in templates:
            tw = [x.encode() for x in brute.ALNUM.findall(brute.lower(t))]
            s = {tuple(tw[i : i + 5]) for i in range(len(tw) - 4)}
            n = licenses.window_length(len(s))
            at = sorted(i for g in s for i in where.get(g, ()))
            for i in at:
                near = [j for j in at if i <= j < i + 3 * n]
                share = len({grams[j] for j in near}) / len(s)
                if share >= least:
                    hits.add((share, round(len(s) * share), near[0], near[-1] + 1, name))
    kept = []
    for h in sorted(hits, key=lambda x: (-x[1], -x[0], x[2:])):
        if not any(x[2] < h[3] and h[2] < x[3] and (x[:2] != h[:2] or x[4] == h[4]) for x in kept):
            kept.append(h)
    return {h[4] for h in kept}


def test_licenses(spark):
    r = random.Random(8)
    noise = lambda n: " ".join(r.choice(["alpha", "beta", "gamma", "the", "license", "under"]) for _ in range(n))
    flat = [t for ts in licenses.TEMPLATES.values() for t in ts]
    rows = [(0, None), (1, ""), (2, "the MIT License"), (3, noise(500))]
    for i, t in enumerate(flat * 6):
        body = t.split()
        if len(body) > 20:  # one edited word leaves over 0.8 of a long template
            body[r.randrange(len(body))] = "edited"
        rows.append((10 + i, noise(r.randrange(0, 60)) + "\n" + r.choice([str, str.upper])(" ".join(body)) + "\n" + noise(r.randrange(0, 60))))
    rows += [(900, noise(50_000) + " released under the MIT license " + noise(50_000)), (900, "Licensed under CC BY-NC 4.0. Released under the MIT License.")]
    docs = spark.createDataFrame([(*x, "c") for x in rows], "doc_id long, text string, licenses string")
    got = licenses.scan_licenses(docs).collect()
    assert len(got) == len(rows)
    by_text = Counter((r.doc_id, r.licenses) for r in got)
    want = Counter((d, ",".join(sorted(license_truth(t))) or None) for d, t in rows)
    assert by_text == want
    assert all((x.n_licenses == 0) == (x.licenses is None) and (x.containment or 0.8) >= 0.8 for x in got)
    assert licenses.scan_licenses(docs.limit(0)).collect() == []


def scanned(text, least=0.8):
    part = next(iter(chunks(pa.array([text]), lower=True)))
    w = part.words(NOT_ALNUM)
    at, h = w.windows(w.hashes(), licenses.WIDTH)
    return set(licenses.Scanner(licenses.TEMPLATES, least).scan(h, w.doc[at]).get(0, {}))


def test_family_members_are_told_apart():
    for name, templates in licenses.TEMPLATES.items():
        for t in templates:
            assert scanned("some words before this. " + t + ". and some words after it") == {name} or t in (licenses._ISC + ". " + licenses._ISC_WARRANTY,), (name, t)
    gnu = "This program is free software: " + licenses._gnu("General Public License", "2", True) + "."
    assert scanned(gnu) == {"GPL-2.0-or-later"} and scanned(gnu.replace("version 2", "version 3")) == {"GPL-3.0-or-later"}


def test_lower_thresholds_lose_nothing():
    t = {"x": ("one two three four five six seven eight",)}
    part = next(iter(chunks(pa.array(["zero one two three four five six seven other"]))))
    w = part.words(NOT_ALNUM)
    at, h = w.windows(w.hashes(), licenses.WIDTH)
    assert licenses.Scanner(t, 0.7).scan(h, w.doc[at]) == {0: {"x": 0.75}}


def test_short_template_is_refused():
    with pytest.raises(ValueError):
        licenses.Scanner({"x": ("four words are few",)}, 0.8)


# -- WARC ---------------------------------------------------------------------------


def pages():
    big, other = "é<p>WARC/1.1\r\n\r\n" * 100, "y" * 1000
    rows = [(1, "http://a", big), (2, "http://b", big), (9, "http://c", big), (3, None, None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (7, "x\r\ny", other), (8, "v", other), (8, "v", other), (10, "z", "a\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\nabc")]
    return rows


def expected(rows):
    top = {}
    for i, _, h in rows:
        top[h or ""] = max(top.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        again = len(raw) >= 1000 and top[h] != i
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", top[h] if again else None))
    return sorted(out, key=str)


def test_warc_round_trip(spark):
    docs = spark.createDataFrame([(*x, "c") for x in pages()], "page_id long, url string, html string, digest string")
    got = warc.round_trip(docs)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, got.collect()), key=str) == expected(pages())
    assert sorted(map(tuple, warc.round_trip(docs, file_bytes=500).collect()), key=str) == expected(pages())
    assert warc.round_trip(docs.limit(0)).collect() == []


def test_captures_are_assembled(spark):
    docs = spark.createDataFrame(pages(), "page_id long, url string, html string")
    path = scratch_path(spark, "warc-test")
    warc.write_archives(docs, path, compression="none")
    records = warc.read_archives(spark, path)
    assert {r.warc_type: r.n for r in records.groupBy("warc_type").agg(F.count("*").alias("n")).collect()} == {"request": 11, "metadata": 11, "response": 8, "revisit": 3}
    captures = warc.assemble(records).collect()
    assert len(captures) == 11
    for c in captures:
        assert c.request.payload == bytearray(b"") or c.request.payload is not None
        assert c.response.target_uri == c.request.target_uri == c.metadata.target_uri
        if c.response.warc_type == "response":
            assert hashlib.sha1(bytes(c.response.payload)).hexdigest() == c.response.payload_digest
    # records without the others
    partial = warc.assemble(records.where("warc_type in ('request', 'revisit')")).collect()
    assert len(partial) == 11 and sum(c.response is None for c in partial) == 8 and all(c.metadata is None for c in partial)


def test_frames_of_strict_archive():
    one = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\nContent-Length: 7\r\n\r\nWARC/1.\r\n\r\n"
    two = gzip.compress(one) + gzip.compress(one)
    assert [b for _, b in warc.frame(warc._gunzip(two))] == [b"WARC/1.", b"WARC/1."]
    with pytest.raises(ValueError):
        list(warc.frame(one[:-8]))
