"""Files of encoded streams: names, bytes and refusals."""

from pyspark.sql import functions as F

from strandline.sources import binary_format, files, text_format

IDS = ["", "a", "a b+c", "é/ü%41~", "_x", ".y", "s-.z", "007", "a\nb"]
SCHEMA = "stream_id string, text string, error string"


def test_text_files(spark, tmp_path):
    rows = [(i, f"telex.aes=1\n\npath=$.a\nkind=StringLiteral\nvalue={n}\n", None) for n, i in enumerate(IDS)]
    refused = files.write(spark.createDataFrame([*rows, ("bad", None, "max_events"), (None, "x", None), ("é" * 100, "x", None)], SCHEMA), str(tmp_path / "t"))
    assert {(r.stream_id, r.error) for r in refused.collect()} == {("bad", "max_events"), (None, files.REFUSED), ("é" * 100, files.REFUSED)}
    back = spark.read.text(str(tmp_path / "t"), wholetext=True).select(files.stream_id(F.col("_metadata.file_path")), "value").collect()
    assert {tuple(r) for r in back} == {(i, t) for i, t, _ in rows}
    events = text_format.events_of(text_format.read(spark, str(tmp_path / "t"))).withColumn("stream_id", files.stream_id(F.col("stream_id")))
    assert {(r.stream_id, r.value) for r in events.collect()} == {(i, str(n)) for n, i in enumerate(IDS)}


def test_binary_files_written_twice(spark, tmp_path):
    texts = spark.createDataFrame([(i, "telex.aes=1\n\npath=$.a\nkind=StringLiteral\nvalue=x\n") for i in IDS], "stream_id string, text string")
    blobs = binary_format.from_text(texts).cache()
    for _ in range(2):
        assert files.write(blobs, str(tmp_path / "b")).isEmpty()
    assert (tmp_path / "b" / "_SUCCESS").exists()
    assert len([p for p in (tmp_path / "b").iterdir() if not p.name.startswith("_")]) == len(IDS)
    want = {(r.stream_id, bytes(r.bytes)) for r in blobs.collect()}
    back = spark.read.format("binaryFile").load(str(tmp_path / "b")).select(files.stream_id(F.col("path")), "content").collect()
    assert {(i, bytes(c)) for i, c in back} == want


def test_no_streams(spark, tmp_path):
    assert files.write(spark.createDataFrame([], SCHEMA), str(tmp_path / "e")).isEmpty()
    assert [p.name for p in (tmp_path / "e").iterdir()] == ["_SUCCESS"]


def test_packs(spark, tmp_path):
    """Thousands of streams in a few files, all back; refused ones are told, tasks without streams leave no pack."""
    rows = [(f"s{i}/é", bytes([i % 256]) * (i % 300), None) for i in range(5000)] + [("big", b"x" * (3 << 20), None), ("empty", b"", None), ("no", None, "FILM_AES_INVALID"), (None, b"x", None)]
    encoded = spark.createDataFrame(rows, "stream_id string, bytes binary, error string").repartition(3)
    path = f"file://{tmp_path}/packs"
    told = files.write_packs(encoded, path)
    assert sorted(map(tuple, told.collect()), key=str) == [("no", "FILM_AES_INVALID"), (None, "FILE_NAME")]
    assert len(list((tmp_path / "packs").glob("*.pack.gz"))) <= 3 and not list((tmp_path / "packs").glob("_[0-9a-f]*"))
    got = {r.stream_id: bytes(r.bytes) for r in files.read_packs(spark, path).collect()}
    assert got == {s: b for s, b, e in rows if s is not None and e is None}
