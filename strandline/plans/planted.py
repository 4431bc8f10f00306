"""Small streams with one planted property each, one stream for each order.

Order ``k`` gets case ``k % n`` of a list of templates, in which ``{k}`` stands for its key. The
templates are a constant table of a few rows, joined by case number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline import schema, wire
from strandline.config import Limits
from strandline.operators.shape import event_row

DOC, PART, WHOLE = wire.DOCUMENT_PROJECTION, wire.PARTIAL_PROFILE, wire.COMPLETE_PROFILE
STR, OBJ, LIST, TUPLE, NODE, HEAD, POINT = "StringLiteral", "ObjectNode", "ListNode", "TupleLiteral", "NodeLiteral", "NodeHead", "PointerReference"
REGISTERED = ("x.known.a",)
#: Small enough that the planted rows pass some of them, depending on the key.
EVENT_LIMITS = Limits(
    max_path_depth=3, max_path_characters=16, max_key_segment_codepoints=8, max_string_codepoints=12, max_generic_arguments=2, max_datatype_components=4
)
_ORIGIN = "sha256:" + "0f" * 32
_TYPED = {"path": "$.t{k}", "kind": "NullLiteral", "value": "", "datatype": "a", "generics": [], "clarifiers": []}


def _type(name: str, *generics: dict) -> dict:
    return {"datatype": name, "generics": list(generics), "clarifiers": []}


#: One event a case.
EVENT_CASES: list[dict] = [
    {"path": "$.o{k}", "kind": STR, "value": "{k}"},
    {"path": "$.o{k}", "kind": STR, "value": "{k}", "x.own.note": "1", "x.known.a": "2"},
    {"path": "$.o{k}", "kind": STR, "value": "{k}", "x.known.a": "2"},
    {"kind": STR, "value": "{k}"},
    {"path": "$.o{k}", "header": '$.["aeon:h"]', "kind": STR, "value": "{k}"},
    {"path": "$.o{k}", "value": "{k}"},
    {"path": "o{k}", "kind": STR, "value": ""},
    {"path": '$.["plain{k}"]', "kind": STR, "value": ""},
    {"path": '$.["w {k}"]', "kind": STR, "value": ""},
    {"path": "$", "kind": STR, "value": ""},
    {"header": "$.o{k}", "kind": STR, "value": ""},
    {"header": '$.["aeon:h{k}"]', "kind": STR, "value": ""},
    {"path": "$.o{k}", "kind": "Other", "value": ""},
    {"path": "$.o{k}", "kind": LIST, "value": "{k}"},
    {"path": "$.o{k}", "kind": "NullLiteral"},
    {"path": "$.o{k}", "kind": STR, "value": "{k}{k}{k}"},
    {"path": "$.o{k}", "kind": "HexLiteral", "value": "AB{k}"},
    {"path": "$.o{k}", "kind": "HexLiteral", "value": "ab{k}"},
    {"path": "$.o{k}", "kind": "BooleanLiteral", "value": "True"},
    {"path": "$.o{k}", "kind": "ToggleLiteral", "value": "maybe"},
    {"path": "$.o{k}", "kind": "NaNLiteral", "value": "nan"},
    {"path": "$.o{k}", "kind": "InfinityLiteral", "value": "+Infinity"},
    {"path": "$.o{k}", "kind": "SymbolicLiteral", "value": ""},
    {"path": "$.o{k}", "kind": HEAD, "value": ""},
    {"path": "$.o{k}", "kind": HEAD, "value": "head{k}"},
    {"path": "$.o{k}", "kind": "WTCDateTimeLiteral", "value": "2024-01-01T00:00:00Z&Local"},
    {"path": "$.o{k}", "kind": "WTCDateTimeLiteral", "value": "2024-01-01T00:00:00Z&local"},
    {"path": "$.o{k}", "kind": "CloneReference", "value": "o{k}"},
    {"path": "$.o{k}", "kind": POINT, "value": "$.a.b.c.d{k}"},
    {"path": "$.o{k}", "kind": POINT, "value": "$.a.@.b.@.c"},
    {"path": "$.o{k}", "kind": STR, "value": "", "datatype": "", "generics": [], "clarifiers": []},
    {"path": "$.o{k}", "kind": STR, "value": "", "identity": ""},
    {"path": "$.o{k}", "kind": STR, "value": "", "generics": []},
    {"path": "$.o{k}", "kind": STR, "value": "", "datatype": "a", "generics": []},
    {"path": "$.o{k}", "kind": STR, "value": "", "origin": "sha256:0F"},
    {"path": "$.o{k}", "kind": STR, "value": "", "span": "0:{k}"},
    {"path": "$.o{k}", "kind": STR, "value": "", "origin": _ORIGIN, "span": "{k}:100"},
    {"path": "$.o{k}", "kind": STR, "value": "", "origin": _ORIGIN, "span": "01:{k}"},
    {"path": "$.a.@.b.@.c", "kind": STR, "value": "{k}"},
    {"path": "$.a.key{k}", "kind": STR, "value": ""},
    {"path": '$.["é \\"{k}"][0]', "kind": STR, "value": ""},
    {"path": "$.a[0][{k}][2]", "kind": STR, "value": ""},
    _TYPED | {"generics": [_type("b", _type("c", _type("d")))]},
    _TYPED | {"generics": [_type("b"), _type("c"), _type("d")]},
    _TYPED | {"clarifiers": [{"kind": "NumberLiteral", "value": "1"}, {"kind": "NumberLiteral", "value": "2"}]},
    _TYPED | {"clarifiers": [{"kind": "NumberLiteral", "value": "1.{k}e"}]},
    _TYPED | {"clarifiers": [{"kind": "StringLiteral", "value": "text {k}{k}"}]},
    _TYPED | {"datatype": "1a"},
    _TYPED | {"generics": [_type("b", _type("c")), _type("d", _type("e"))]},
    _TYPED | {"clarifiers": [{"kind": "NumberLiteral", "value": "-1.{k}e3"}]},
]


def _s(path: str, **more) -> dict:
    return {"path": path, "kind": STR, "value": "x"} | more


def _o(path: str, kind: str = OBJ, **more) -> dict:
    return {"path": path, "kind": kind} | more


STREAM_LIMITS = Limits(max_events=5, max_value_nesting_depth=2, max_list_items=2, max_tuple_items=1)
_H = {"header": '$.["aeon:h{k}"]', "kind": STR, "value": "x"}
#: (profile, projection, records): one stream a case.
STREAM_CASES: list[tuple[str, str | None, list[dict]]] = [
    (WHOLE, DOC, [_H, _o("$.a{k}"), _s("$.a{k}.b", identity="i"), _s("$.a{k}.@.c")]),
    ("other.{k}", None, [_s("$.a")]),
    (PART, "other", [_s("$.a")]),
    (WHOLE, None, [_s("$[{k}]"), _s("$.@.a")]),
    (WHOLE, None, [_s("$.a{k}"), _s("$.b"), _s("$.a{k}")]),
    (PART, None, [_s("$.a{k}"), _s("$.b"), _s("$.a{k}")]),
    (PART, DOC, [_H, _H]),
    (PART, None, [_H, _H]),
    (WHOLE, None, [_s("$.a{k}.b")]),
    (WHOLE, None, [_o("$.a", LIST), _s("$.a.b{k}"), _s("$.a[0]")]),
    (WHOLE, None, [_o("$.a", TUPLE), _s("$.a[0]"), _s("$.a[{k}0]")]),
    (WHOLE, None, [_o("$.a", NODE), _o("$.a[0]", HEAD, value="h{k}"), _s("$.a[1]"), _s("$.a[0][0]")]),
    (WHOLE, None, [_o("$.a{k}", HEAD, value="h")]),
    (WHOLE, None, [_s("$.a", identity="i{k}"), _s("$.b", identity="i{k}"), _s("$.c", identity="")]),
    (WHOLE, DOC, [_H | {"identity": "i{k}"}, _s("$.b", identity="i{k}")]),
    (WHOLE, None, [_o("$.a", POINT, value="$.b{k}"), _o("$.c", "CloneReference", value="$.a")]),
    (WHOLE, DOC, [_H | {"kind": POINT, "value": "$.gone{k}"}, _s("$.a")]),
    (PART, DOC, [_s("$.a{k}"), _H]),
    (PART, None, [_o("$.a"), _o("$.a.b", LIST), _o("$.a.b[0]", TUPLE), _s("$.a.b[0][0]")]),
    (PART, None, [_s("$.a{k}"), _s("$.b"), _s("$.c"), _s("$.d"), _s("$.e"), _s("$.f")]),
    (PART, None, [_o("$.a", LIST), _s("$.a[0]"), _s("$.a[1]"), _s("$.a[{k}0]"), _s("$.a[0]")]),
    (PART, None, []),
]
_HEAD = "telex.aes=1\n"
TEXT_LIMITS = Limits(max_input_bytes=400, max_line_bytes=60, max_fields_per_event=4, max_events=2, max_decoded_payload_bytes=100)
_E = "path=$.o{k}\nkind=ObjectNode\n"
#: One text a case.
TEXT_CASES: list[str] = [
    _HEAD + "\n" + _E,
    "\ufeff" + _HEAD + "\n" + _E,
    _HEAD + "\n" + _E.replace("\n", "\r") + "\n",
    (_HEAD + "\n" + _E).replace("\n", "\r\n"),
    _HEAD + "profile=\n\n" + _E,
    _HEAD + "projection=\n\n" + _E,
    _HEAD + "profile=a\nprofile=b\n\n" + _E,
    _HEAD + "projection=b{k}\nprofile=a\n\n" + _E,
    _HEAD + "profile=a\nprojection=b{k}\n\n" + _E,
    _HEAD + "\n" + _E + "value=" + "v" * 55 + "\n",
    _HEAD + "\n" + _E + "value=1\nidentity={k}\nx.a.b=5\n",
    _HEAD + "\n" + "\n".join([_E, _E, _E]),
    _HEAD + "\n" + "\n".join([_E + "value=" + "v" * 50 + "\n", _E + "value=" + "w" * 50 + "\n"]),
    _HEAD + "\n" + "".join(f"x.f{i}=" + "v" * 50 + "\n" for i in range(8)),
    _HEAD + "\n" + _E + "\n",
    _HEAD + "\n\n" + _E,
    _HEAD + "\nkind=ObjectNode\npath=$.o{k}\n",
    _HEAD + "\n" + _E + "value=\\u{061}\\n\\0\n",
    _HEAD + "\n" + _E + "value=\\u{1}\\u{7f}\n",
    _HEAD + "\n" + _E + "value=\\u{D800}\n",
    _HEAD + "\n" + _E + "value=\\u{}\n",
    _HEAD + "\n" + _E + "datatype=list < a{k} ,b >\n",
    _HEAD + "\n" + _E + "datatype=a<b<c<d>>>\n",
    _HEAD + "\n" + _E + "datatype=a[1, 2]\n",
    _HEAD + "\n" + _E + "generics=[]\n",
    _HEAD,
    _HEAD[:-1],
    "",
]


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").cast("long").alias("k"))


def _keyed(c: Column) -> Column:
    return F.replace(c, F.lit("{k}"), F.col("k").cast("string"))


def _chosen(spark: SparkSession, sf_dir: str, n: int, table: DataFrame) -> DataFrame:
    """Each order with the rows of its case; the table has a handful of rows a case, whatever the data."""
    return orders(spark, sf_dir).withColumn("case", F.pmod("k", F.lit(n)).cast("int")).join(F.broadcast(table), "case")


def _records(spark: SparkSession, sf_dir: str, cases: list[list[dict]], stream: Column, ordinal: Column) -> DataFrame:
    rows = [(i, *event_row("", j, r)) for i, records in enumerate(cases) for j, r in enumerate(records)]
    table = spark.createDataFrame(rows, "case int, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.EVENTS.fields))
    filled = {c: _keyed(F.col(c)) for c in schema.EVENTS.fieldNames() if c not in ("stream_id", "ordinal", "ext")}
    met = _chosen(spark, sf_dir, len(cases), table).withColumns(filled).withColumns({"stream_id": stream, "ordinal": ordinal})
    return met.select(*schema.EVENTS.fieldNames())


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVENTS of ``EVENT_CASES``, in 16 streams."""
    return _records(spark, sf_dir, [[r] for r in EVENT_CASES], F.concat(F.lit("v"), (F.col("k") % 16).cast("string")), F.col("k"))


def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir, [r for _, _, r in STREAM_CASES], F.concat(F.lit("t"), F.col("k").cast("string")), F.col("ordinal"))


def stream_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.createDataFrame([(i, p, j) for i, (p, j, _) in enumerate(STREAM_CASES)], "case int, profile string, projection string")
    return _chosen(spark, sf_dir, len(STREAM_CASES), table).select(
        F.concat(F.lit("t"), F.col("k").cast("string")).alias("stream_id"),
        _keyed(F.col("profile")).alias("profile"),
        F.lit(True).alias("profile_explicit"),
        "projection",
        F.col("projection").isNotNull().alias("projection_explicit"),
        F.lit(True).alias("canonical"),
    )


def texts(spark: SparkSession, sf_dir: str, cases: list[str] = TEXT_CASES) -> DataFrame:
    table = spark.createDataFrame(list(enumerate(cases)), "case int, text string")
    return _chosen(spark, sf_dir, len(cases), table).select(F.col("k").cast("string").alias("stream_id"), "case", _keyed(F.col("text")).alias("text"))
