from pyspark.sql import functions as F

from strandline.operators import shape
from strandline.sources import delta


def events(spark):
    rows = [("a", [{"path": f"$.k{i // 3}.é{i}", "kind": "StringLiteral", "value": str(i)} | ({"identity": f"i{i}"} if i % 2 else {}) for i in range(600)]), ("b", [{"header": '$.["aeon:x"]', "kind": "NullLiteral", "value": ""}, {"path": "$.z", "kind": "ObjectNode"}])]
    return shape.events_from_records(spark, rows)


def rows(df):
    return sorted(map(str, df.select(*df.columns[:-1]).collect()))


def test_round_trip_and_blocks(spark):
    df = events(spark)
    for block in (delta.BLOCK, 7, None):
        enc = delta.encode(df, block)
        assert rows(delta.decode(enc)) == rows(df)
    enc = delta.encode(df)
    index = {(r.stream_id, r.block): (r.first_record, r.records) for r in delta.block_index(enc).collect()}
    assert index == {("a", 0): (0, 256), ("a", 1): (256, 256), ("a", 2): (512, 88), ("b", 0): (0, 2)}
    assert rows(delta.read_block(enc, "a", 1)) == rows(df.where("stream_id = 'a' and ordinal between 256 and 511"))
    assert enc.agg(F.sum(F.octet_length("suffix"))).head()[0] < df.agg(F.sum(F.octet_length(F.coalesce("path", "header")))).head()[0] / 2


def test_compact(spark):
    c = delta.compact(events(spark))
    r = c.where("stream_id = 'a'").select(delta.address_at(F.lit(4)).alias("x"), F.size("identity").alias("n"), F.col("identity")[5].alias("i")).head()
    assert (r.x, r.n, r.i) == ("$.k1.é4", 300, "i5")
