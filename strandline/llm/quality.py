r"""Quality rules with thresholds that adapt to each language and source.

``measure`` computes, for every whole text, counts over words
``[^\x20\x09-\x0D]+``. ``thresholds`` summarises four ratios of every
``(lang, source)`` by a mergeable quantile sketch: a histogram on a logarithmic
grid with a relative error of at most 1 % (buckets add up, so partial sketches
combine before the shuffle and groups merge into their language or the whole
corpus). The fence of a ratio is ``q75 + max(step, 3 (q75 - q25))`` (and the mirror
below for mean word length); the step is a small least distance from the group's own
quartile, for groups that don't spread. Repeated lines are a share of the lines
with words, the others are divided by words. Quartiles lean on those of the language,
and these on the corpus's, as if a group had ``prior`` more documents of its parent,
so that small groups are not judged by their own few. ``with_verdict`` joins fences to
the documents.

Edge cases: a null text has no words and fails the base rule; null lang or
source form groups of their own; an empty table gives an empty result; repeated
rows each count and each get a verdict; a value equal to a fence passes it; a very long
text is measured whole, by itself; other columns pass through untouched, those with a
prefix of this module (``__q_``, ``__hi_``, ``__lo_``, ``__f_``) are refused with an error.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm._text import BYTE_CODE, SPACE, chunks, cover, distinct, map_arrow, mix, per_doc, repeated, span_hashes
from strandline.storage import materialize

#: Characters that count as symbols (fixed by the query's contract).
SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Counts that ``measure`` adds besides.
LINES = "n_lines"
#: Ratio: (count, divided by).
RATIOS = {"symbols": ("n_symbols", "n_words"), "dup_lines": ("n_dup_lines", LINES), "repeats": ("n_repeat_words", "n_words"), "word_length": ("word_chars", "n_words")}
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    max_repeat_percent: int = 50
    #: A fence lies at least this far above (``high``) or below (``low``) the group's quartile.
    high: dict[str, float] = field(default_factory=lambda: {"symbols": 0.02, "dup_lines": 0.2, "repeats": 0.2, "word_length": 1.0})
    low: dict[str, float] = field(default_factory=lambda: {"word_length": 1.0})
    spread: float = 3.0
    #: Weight of the parent's quartiles, in documents.
    prior: float = 20.0
    #: Buckets grow by this factor: 1.02 bounds the relative error by 1 %.
    growth: float = 1.02
    #: Fences are broadcast only up to so many groups.
    broadcast_groups: int = 20_000


def _own_names(docs: DataFrame) -> None:
    taken = [c for c in docs.columns if c.startswith(("__q_", "__hi_", "__lo_", "__f_"))]
    if taken:
        raise ValueError(f"columns {taken} have names of this operator")


def _counts(texts) -> dict[str, np.ndarray]:
    w = texts.words(SPACE)
    buf, offs = texts.buf, texts.offs
    lead = (buf & 0xC0) != 0x80
    chars = per_doc((lead & ~SPACE[buf]).astype(np.int64), offs)
    symbols = per_doc(_IS_SYMBOL[buf].astype(np.int64), offs)

    # lines: one begins at each document and after each \n
    breaks = np.flatnonzero(buf == 10)
    begins = distinct(np.concatenate([offs[:-1], breaks + 1]))
    begins = begins[begins < offs[-1]]
    line_doc = np.searchsorted(offs, begins, "right") - 1
    nxt = np.append(breaks, offs[-1])[np.searchsorted(breaks, begins)]
    ends = np.minimum(nxt, offs[line_doc + 1])
    first_word = np.searchsorted(w.start, begins)
    has_word = np.searchsorted(w.start, ends) > first_word
    begins, ends, line_doc = begins[has_word], ends[has_word], line_doc[has_word]
    keys = span_hashes(BYTE_CODE[buf], begins, ends) ^ mix(line_doc.astype(np.uint64) + np.uint64(1))
    order = np.argsort(keys)
    again = order[1:][keys[order][1:] == keys[order][:-1]]
    dup_lines = np.bincount(line_doc[again], minlength=texts.n)

    at, triple = w.windows(w.hashes(), 3)
    doc = w.doc
    twice = at[repeated(triple ^ mix(doc[at].astype(np.uint64) + np.uint64(1)))]
    repeats = per_doc(cover(len(w.start), twice, 3).astype(np.int64), w.doc_start)
    return dict(zip((*COUNTS, LINES), (w.count, chars, symbols, dup_lines, repeats, np.bincount(line_doc, minlength=texts.n)), strict=True))


def measure(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """All columns of ``docs`` the five counts and the number of lines with words, each named with ``prefix``."""
    schema = T.StructType([f for f in docs.schema.fields] + [T.StructField(prefix + c, T.LongType()) for c in (*COUNTS, LINES)])
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            for texts in chunks(batch.column(at)):
                part = batch.slice(texts.first, texts.n)
                found = _counts(texts)
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(found[c], pa.int64()) for c in (*COUNTS, LINES))], names=schema.names)

    return map_arrow(docs, run, schema)


def _ratios(columns: list[str], prefix: str = "") -> dict[str, Column]:
    """The ratios whose counts are among ``columns``."""
    return {k: F.col(prefix + a) / F.greatest(F.col(prefix + b), F.lit(1)) for k, (a, b) in RATIOS.items() if {prefix + a, prefix + b} <= set(columns)}


def base_failed(rules: Rules, prefix: str = "") -> Column:
    n, r = F.col(prefix + "n_words"), F.col(prefix + "n_repeat_words")
    return (n < rules.min_words) | (100 * r > rules.max_repeat_percent * n)


def sketches(measured: DataFrame, groups: list[str], rules: Rules) -> DataFrame:
    """The histogram (group, ratio, bucket, n); adding up n merges sketches."""
    ratios = _ratios(measured.columns)
    log_growth = math.log(rules.growth)
    bucket = F.when(F.col("v") <= 0, F.lit(-(1 << 30))).otherwise(F.ceil(F.log("v") / log_growth)).cast("int")
    stacked = measured.where(F.col("n_words") > 0).select(
        *groups, F.explode(F.array(*(F.struct(F.lit(k).alias("ratio"), v.cast("double").alias("v")) for k, v in ratios.items()))).alias("s")
    )
    return stacked.select(*groups, "s.ratio", F.col("s.v").alias("v")).select(*groups, "ratio", bucket.alias("bucket")).groupBy(*groups, "ratio", "bucket").agg(F.count("*").alias("n"))


def _quantiles(sketch: DataFrame, by: list[str], rules: Rules) -> DataFrame:
    key = Window.partitionBy(*by, "ratio")
    upto = key.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    merged = sketch.groupBy(*by, "ratio", "bucket").agg(F.sum("n").alias("n"))
    value = F.when(F.col("bucket") == -(1 << 30), F.lit(0.0)).otherwise(2 * F.pow(F.lit(rules.growth), F.col("bucket")) / (rules.growth + 1))
    ranked = merged.select(*by, "ratio", value.alias("v"), F.sum("n").over(upto).alias("c"), F.sum("n").over(key).alias("total"))
    return ranked.groupBy(*by, "ratio").agg(
        F.max("total").alias("total"),
        F.min(F.when(F.col("c") >= 0.25 * F.col("total"), F.col("v"))).alias("q25"),
        F.min(F.when(F.col("c") >= 0.75 * F.col("total"), F.col("v"))).alias("q75"),
    )


def thresholds(measured: DataFrame, groups: list[str], rules: Rules) -> DataFrame:
    """One row per group: the highest (and lowest) value that each ratio may take.

    Groups without words have no row; their documents all fail the base rule.
    """
    sketch = materialize(sketches(measured, groups, rules), "sketch")
    out = _quantiles(sketch, [], rules)
    for depth in range(1, len(groups) + 1):
        wider = out.select(*(F.col(g).alias(f"__w_{g}") for g in groups[: depth - 1]), F.col("ratio").alias("__ratio"), *(F.col(c).alias(f"__w_{c}") for c in ("q25", "q75")))
        on = F.col("ratio") == F.col("__ratio")
        for g in groups[: depth - 1]:
            on = on & F.col(g).eqNullSafe(F.col(f"__w_{g}"))
        share = F.col("total") / (F.col("total") + rules.prior)
        leaning = [(share * F.col(c) + (1 - share) * F.col(f"__w_{c}")).alias(c) for c in ("q25", "q75")]
        out = _quantiles(sketch, groups[:depth], rules).join(wider, on).select(*groups[:depth], "ratio", "total", *leaning)
    spread = rules.spread * (F.col("q75") - F.col("q25"))
    own = lambda k, c: F.max(F.when(F.col("ratio") == k, c))
    wide = [own(k, F.col("q75") + F.greatest(F.lit(v), spread)).alias(f"__hi_{k}") for k, v in rules.high.items()]
    wide += [own(k, F.col("q25") - F.greatest(F.lit(v), spread)).alias(f"__lo_{k}") for k, v in rules.low.items()]
    return materialize(out.groupBy(*groups).agg(*wide), "fences")


def with_verdict(measured: DataFrame, fences: DataFrame, groups: list[str], rules: Rules, prefix: str = "") -> DataFrame:
    """Adds ``base_failed`` and ``kept`` (both with ``prefix``) by a join with the fences."""
    fences = fences.select(*(F.col(g).alias(f"__f_{g}") for g in groups), *(c for c in fences.columns if c not in groups))
    if fences.count() <= rules.broadcast_groups:
        fences = F.broadcast(fences)
    on = F.lit(True)
    for g in groups:
        on = on & F.col(g).eqNullSafe(F.col(f"__f_{g}"))
    ratios = _ratios(measured.columns, prefix)
    bad = F.lit(False)
    for k in rules.high:
        bad = bad | (ratios[k] > F.col(f"__hi_{k}"))
    for k in rules.low:
        bad = bad | (ratios[k] < F.col(f"__lo_{k}"))
    failed = base_failed(rules, prefix)
    return measured.join(fences, on, "left").select(*measured.columns, failed.alias(prefix + "base_failed"), (~failed & ~F.coalesce(bad, F.lit(False))).alias(prefix + "kept"))


def score_documents(docs: DataFrame, rules: Rules = Rules(), doc_id: str = "doc_id", text: str = "text", groups: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """One row per document: ids, groups, counts, ``base_failed`` and ``kept``."""
    groups = list(groups)
    _own_names(docs.select(doc_id, *groups, text))
    measured = materialize(measure(docs.select(doc_id, *groups, text), text).drop(text), "measured")
    return with_verdict(measured, thresholds(measured, groups, rules), groups, rules)


def keep_good(docs: DataFrame, rules: Rules = Rules(), text: str = "text", groups: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns only.

    Counts are taken twice, once for the sketches and once beside the text, so
    that no text is shuffled.
    """
    groups, p = list(groups), "__q_"
    _own_names(docs)
    fences = thresholds(measure(docs.select(*groups, text), text).drop(text), groups, rules)
    return with_verdict(measure(docs, text, p), fences, groups, rules, p).where(p + "kept").select(*docs.columns)
