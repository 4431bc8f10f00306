import pytest
from pyspark.sql import functions as F

from strandline.functions import paths

GOOD = {
    "$.a": ["a"],
    "$.a.@.b[0].c": None,
    '$.["a b"]': None,
    '$.[""]': None,
    '$.a.@.["x.y"]': None,
    '$.["é\\n\\u000b\\"\\\\"]': None,
    "$[0][10]": None,
    '$.["😀"]': None,
}
BAD = ["", "a", "$.", "$.a.", "$[01]", "$[-1]", "$.1a", '$.["a"]', '$.["a]', '$.["\\u0041"]', '$.["\\u0008"]', '$.["\\u001F"]', '$.["\\/"]', '$.["\\ud800"]', "$.a\n", "$.@.", "$ .a", "$.a..b", "$.é"]


def one(spark, path, *exprs):
    return spark.createDataFrame([(path,)], "p string").select(*exprs).head()


@pytest.mark.parametrize("path", [*GOOD, "$"])
def test_canonical(spark, path):
    assert one(spark, path, paths.is_canonical(F.col("p")))[0]
    segs = one(spark, path, paths.segments(F.col("p")))[0]
    assert "$" + "".join(segs) == path
    prefixes = one(spark, path, paths.prefixes(paths.segments(F.col("p"))))[0]
    assert len(prefixes) == len(segs) and (not segs or prefixes[-1] == path)


@pytest.mark.parametrize("path", BAD)
def test_not_canonical(spark, path):
    assert not one(spark, path, paths.is_canonical(F.col("p")))[0]


def test_parts(spark):
    s = paths.segments(F.col("p"))
    r = one(spark, '$.a.@.b.@.["c\\n😀"][3]', paths.parent(F.col("p"), s), paths.attribute_depth(s), F.transform(s, paths.key_length), F.transform(s, paths.segment_type))
    assert list(r) == ['$.a.@.b.@.["c\\n😀"]', 2, [1, 1, 3, None], ["member", "attribute", "attribute", "index"]]


def test_shared_prefix(spark):
    df = spark.createDataFrame([("né$x", "né$y"), ("", "a"), ("ab", "ab"), ("abc", "ab")], "a string, b string")
    assert [r[0] for r in df.select(paths.shared_prefix_codepoints(F.col("a"), F.col("b"))).collect()] == [3, 0, 2, 2]


def test_very_long_path(spark):
    path = "$" + ".abc[0]" * 5000
    assert one(spark, path, paths.is_canonical(F.col("p")), F.size(paths.segments(F.col("p"))))[:] == (True, 10000)
