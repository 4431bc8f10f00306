"""Batches that workers get: bounded bytes, nothing lost, the session's own bound stays."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandline.llm import _text


@pytest.fixture
def bound(spark):
    before = spark.conf.getAll.get(_text._BATCH_BOUND)
    spark.conf.unset(_text._BATCH_BOUND)
    yield _text._BATCH_BOUND
    spark.conf.unset(_text._BATCH_BOUND) if before is None else spark.conf.set(_text._BATCH_BOUND, before)


def sizes(rows):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "size"])

    return [tuple(r) for r in _text.map_arrow(rows, run, "n long, size long").collect()]


def test_batches_are_bounded(spark, bound):
    rows = spark.range(0, 3000, 1, 1).select("id", F.repeat(F.lit("abcdefgh"), 1000).alias("text"))
    found = sizes(rows)
    assert sum(n for n, _ in found) == 3000 and len(found) > 4
    assert max(size for _, size in found) < _text.BATCH_BYTES * 1.1


def test_row_beyond_the_bound_comes_whole(spark, bound):
    rows = spark.range(0, 3, 1, 1).select(F.repeat(F.lit("abcdefgh"), 1 << 20).alias("text"))
    assert [n for n, _ in sizes(rows)] == [1, 1, 1]


def test_empty_table(spark, bound):
    assert sum(n for n, _ in sizes(spark.range(0).select("id"))) == 0


def test_own_bound_stays(spark, bound):
    spark.conf.set(bound, "65536")
    sizes(spark.range(10).select("id"))
    assert spark.conf.get(bound) in ("65536", "65536b")
