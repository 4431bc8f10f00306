"""Plain Python versions that the operators are held against."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def quality_counts(text):
    text = text or ""
    w = words(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    triples = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(triples)
    covered = {j for i, t in enumerate(triples) if n[t] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def substring_dedup(docs, k=50):
    """docs: list of (doc_id, text). Rows (doc_id, n_words, n_removed, sha256)."""
    first = {}
    for d, text in docs:
        w = words(text)
        for i in range(len(w) - k + 1):
            key = tuple(w[i : i + k])
            if d is not None:
                first[key] = min(first.get(key, d), d)
    out = []
    for d, text in docs:
        w = words(text)
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            if d is not None and first[tuple(w[i : i + k])] < d:
                gone[i : i + k] = [True] * k
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def contamination(docs, items, n=10):
    windows = defaultdict(set)
    for item, text in items:
        w = ALNUM.findall(lower(text))
        for i in range(max(1, len(w) - n + 1)) if w else ():
            windows[tuple(w[i : i + n])].add(item)
    lengths = {len(x) for x in windows}
    out = []
    for d, text in docs:
        w = ALNUM.findall(lower(text))
        hit, found = set(), set()
        for i in range(len(w)):
            for m in lengths:
                if (t := tuple(w[i : i + m])) in windows and len(t) == m:
                    hit.update(range(i, i + m))
                    found |= windows[t]
        ids = sorted(str(x) for x in found if x is not None)
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return out


def shingles(text, k=5):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
