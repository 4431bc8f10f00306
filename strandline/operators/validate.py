"""Validation of event streams: one row of DIAGNOSTICS for everything that is wrong.

Checks of a single event are expressions over its row, collected in an array that is
exploded where it has entries. Checks between events are joins and aggregations on
(stream, plane, address) or (stream, identity), so a large stream spreads over the
cluster; no window ranges over a whole stream. Sums and firsts combine before each
shuffle. A stream's profile and projection decide which of them apply.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline import schema, wire
from strandline.config import Limits
from strandline.functions import datatypes, paths
from strandline.operators.shape import addressed
from strandline.storage import materialize

_KEY = ["stream_id", "plane", "address"]


def _finding(code: str, field: Column | str | None = None, required: Column | None = None, counter: str | None = None, observed: Column | None = None, limit: int | None = None) -> Column:
    text = lambda x: (F.lit(x) if not isinstance(x, Column) else x).cast("string")
    return F.struct(
        F.lit(code).alias("code"),
        text(field).alias("field"),
        text(required).alias("required_path"),
        F.lit(None).cast("long").alias("first_record"),
        text(counter).alias("counter"),
        (F.lit(None) if observed is None else observed).cast("long").alias("observed"),
        F.lit(limit).cast("long").alias("lim"),
    )


def _when(condition: Column, finding: Column) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), finding)


def _over(observed: Column, counter: str, limits: Limits, field: Column | str) -> Column:
    limit = getattr(limits, counter)
    return _when(observed > limit, _finding("AES_LIMIT_EXCEEDED", field, counter=counter, observed=observed, limit=limit))


def _path_limits(path: Column, segs: Column, limits: Limits, field: Column | str) -> list[Column]:
    """Limits of a canonical address; too long keys are one finding each, hence an array."""
    return [
        _over(F.size(segs), "max_path_depth", limits, field),
        _over(F.when(segs.isNotNull(), F.char_length(path)), "max_path_characters", limits, field),
        _over(paths.attribute_depth(segs), "max_attribute_depth", limits, field),
    ]


def _long_keys(segs: Column, limits: Limits, field: Column | str) -> Column:
    lengths = F.filter(F.transform(segs, paths.key_length), lambda n: n > limits.max_key_segment_codepoints)
    make = lambda n: _finding("AES_LIMIT_EXCEEDED", field, counter="max_key_segment_codepoints", observed=n, limit=limits.max_key_segment_codepoints)
    return F.coalesce(F.transform(lengths, make), F.array().cast(_FINDINGS))


_FINDINGS = "array<struct<code:string,field:string,required_path:string,first_record:bigint,counter:string,observed:bigint,lim:bigint>>"


def address_findings() -> list[Column]:
    has_path, has_header = F.col("path").isNotNull(), F.col("header").isNotNull()
    plane = F.col("plane")
    bad = _when(plane.isNotNull() & ~F.col("canonical"), F.when(plane == "header", _finding("AES_INVALID_HEADER_PATH", plane)).otherwise(_finding("AES_INVALID_PATH", plane)))
    return [
        _when(~has_path & ~has_header, _finding("AES_MISSING_ADDRESS")),
        _when(has_path & has_header, _finding("AES_MULTIPLE_ADDRESSES")),
        _when(F.col("kind").isNull(), _finding("AES_MISSING_FIELD", "kind")),
        bad,
        _when((plane == "header") & ~F.col("projection").eqNullSafe(wire.DOCUMENT_PROJECTION), _finding("AES_HEADER_REQUIRES_PROJECTION", "header")),
        _when((plane == "header") & F.col("canonical") & ~F.col("path_ok"), _finding("AES_INVALID_HEADER_PATH", "header")),
        _when(~F.col("kind").isin(*wire.KINDS), _finding("AES_UNKNOWN_KIND", "kind")),
    ]


def value_findings(limits: Limits) -> list[Column]:
    kind, value = F.col("kind"), F.col("value")
    scalar = kind.isin(*(k for k in wire.KINDS if k not in wire.CONTAINERS))
    invalid = _finding("AES_INVALID_VALUE", "value")
    reference = kind.isin(*wire.REFERENCES) & value.isNotNull()
    tail = F.regexp_extract(value, r"(?s)&([^&]*)\z", 1)
    segs = F.when(reference & F.col("target_ok"), paths.segments(value))
    return [
        _when(kind.isin(*wire.CONTAINERS) & value.isNotNull(), _finding("AES_UNEXPECTED_VALUE", "value")),
        _when(scalar & value.isNull(), _finding("AES_MISSING_VALUE", "value")),
        _when(kind == "StringLiteral", _over(F.char_length(value), "max_string_codepoints", limits, "value")),
        *(_when((kind == k) & ~value.isin(*allowed), invalid) for k, allowed in wire.EXACT_VALUES.items()),
        _when((kind == "HexLiteral") & ~value.rlike(r"\A[0-9a-f]+\z"), invalid),
        _when(kind.isin("NodeHead", "SymbolicLiteral") & (value == ""), invalid),
        _when(kind == "NodeHead", _over(F.char_length(value), "max_key_segment_codepoints", limits, "value")),
        _when((kind == "WTCDateTimeLiteral") & value.contains("&") & (F.lower(tail) == "local") & (tail != "local"), invalid),
        _when(reference & ~F.col("target_ok"), _finding("AES_INVALID_REFERENCE", "value")),
        *_path_limits(value, segs, limits, "value"),
    ]


def optional_findings() -> list[Column]:
    span = F.col("span")
    start, end = F.regexp_extract(span, rf"\A{wire.SPAN}\z", 1), F.regexp_extract(span, rf"\A{wire.SPAN}\z", 2)
    by_size = lambda x: F.struct(F.char_length(x), x)  # noqa: E731  canonical decimals compare by length, then text
    has_type, has_generics, has_clarifiers = (F.col(c).isNotNull() for c in ("datatype", "generics", "clarifiers"))
    partial = (~has_type & (has_generics | has_clarifiers)) | (has_type & ~(has_generics & has_clarifiers))
    which = F.when(has_type == has_generics, "clarifiers").otherwise("generics")
    return [
        *(_when(F.col(c) == "", _finding("AES_EMPTY_FIELD", c)) for c in ("datatype", "identity")),
        _when(partial, _finding("AES_DATATYPE_COMPONENTS", which)),
        _when(~F.col("origin").rlike(rf"\A{wire.ORIGIN}\z"), _finding("AES_INVALID_ORIGIN", "origin")),
        _when(span.isNotNull() & F.col("origin").isNull(), _finding("AES_SPAN_REQUIRES_ORIGIN", "span")),
        _when(span.isNotNull() & ((start == "") | (by_size(start) >= by_size(end))), _finding("AES_INVALID_SPAN", "span")),
    ]


def _report(df: DataFrame, *more: str) -> DataFrame:
    """DIAGNOSTICS from rows with a column ``finding`` (or fields of one)."""
    return df.select("stream_id", F.col("ordinal").alias("record"), F.col("address").alias("path"), "finding.*", *more)


def event_diagnostics(rows: DataFrame, limits: Limits, registered: tuple[str, ...] = ()) -> DataFrame:
    """Checks of each event by itself. ``rows`` are addressed events with their stream's projection."""
    rows = rows.withColumn("target_ok", paths.is_event_path(F.col("value")))
    canonical_segs = F.when(F.col("canonical"), F.col("segs"))
    single = [*address_findings(), *_path_limits(F.col("address"), canonical_segs, limits, F.col("plane")), *value_findings(limits), *optional_findings()]
    found = F.filter(F.array(*single).cast(_FINDINGS), lambda x: x.isNotNull())
    unknown = F.transform(F.filter("ext", lambda e: ~e["name"].isin(*registered) if registered else F.lit(True)), lambda e: _finding("AES_UNKNOWN_FIELD", e["name"]))
    target_segs = F.when(F.col("kind").isin(*wire.REFERENCES) & F.col("target_ok"), paths.segments(F.col("value")))
    everything = F.concat(
        found,
        F.coalesce(unknown, F.array()).cast(_FINDINGS),
        _long_keys(canonical_segs, limits, F.col("plane")),
        _long_keys(target_segs, limits, "value"),
    )
    plain = _report(rows.select("stream_id", "ordinal", "address", F.explode(everything).alias("finding")))
    return plain.unionByName(datatype_diagnostics(rows, limits))


def datatype_diagnostics(rows: DataFrame, limits: Limits) -> DataFrame:
    """Descriptors with all three parts; bare names are known to be good and skip the UDF."""
    parts = [F.col(c) for c in ("datatype", "generics", "clarifiers")]
    hard = rows.where(reduce(Column.__and__, [p.isNotNull() for p in parts]) & ~datatypes.plain(*parts))
    found = hard.select("stream_id", "ordinal", "address", F.explode(datatypes.findings_udf(limits)(*parts)).alias("f"))
    return found.select(
        "stream_id", F.col("ordinal").alias("record"), F.col("address").alias("path"), "f.code", "f.field", F.lit(None).cast("string").alias("required_path"),
        F.lit(None).cast("long").alias("first_record"), "f.counter", "f.observed", "f.lim",
    )


def header_order(rows: DataFrame) -> DataFrame:
    """Header events after a body event: the first body event of each stream, met by the headers only."""
    first = rows.where("plane = 'path'").groupBy("stream_id").agg(F.min("ordinal").alias("first_body"))
    late = rows.where("plane = 'header'").join(first, "stream_id").where("ordinal > first_body")
    return _report(late.withColumn("finding", _finding("AES_HEADER_ORDER", "header")))


def first_index(rows: DataFrame, *more: Column) -> DataFrame:
    """(stream_id, plane, address, first, first_kind, times) of each well-formed address, and what ``more`` asks for."""
    return rows.where("path_ok").groupBy(*_KEY).agg(F.min("ordinal").alias("first"), F.min_by("kind", "ordinal").alias("first_kind"), F.count("*").alias("times"), *more)


def duplicate_paths(rows: DataFrame, index: DataFrame) -> DataFrame:
    """Each later event of an address that occurs twice or more."""
    again = rows.where("path_ok").join(index.where("times > 1").select(*_KEY, "first"), _KEY).where("ordinal > first")
    return _report(again.withColumn("finding", _finding("AES_DUPLICATE_PATH").withField("first_record", F.col("first"))), "plane")


def parents(rows: DataFrame, index: DataFrame) -> DataFrame:
    """Missing and incompatible parents and misplaced node heads, from one left join of children with the index."""
    kind, segs = F.col("kind"), F.col("segs")
    child = rows.where("path_ok").select("stream_id", "plane", "ordinal", "address", "kind", paths.segment_type(paths.last_segment(segs)).alias("segment"), F.size("segs").alias("depth"), paths.parent(F.col("address"), segs).alias("parent"))
    up = index.select("stream_id", "plane", F.col("address").alias("parent"), F.col("first_kind").alias("parent_kind"), F.lit(True).alias("found"))
    met = child.where("depth > 1").join(up, ["stream_id", "plane", "parent"], "left")
    required = F.col("parent")
    parent_kind = F.coalesce("parent_kind", F.lit(""))
    found = F.coalesce("found", F.lit(False))
    wants_object = (F.col("segment") == "member") & (parent_kind != "ObjectNode")
    node_child = (F.col("segment") == "index") & (parent_kind == "NodeLiteral") & ~kind.eqNullSafe("NodeHead")
    wants_list = (F.col("segment") == "index") & ~parent_kind.isin("NodeLiteral", *wire.INDEXED)
    misplaced = kind.eqNullSafe("NodeHead") & ~((F.col("segment") == "index") & (parent_kind == "NodeLiteral"))
    below = F.array(
        _when(~found, _finding("AES_MISSING_PARENT", required=required)),
        _when(found & (wants_object | node_child | wants_list), _finding("AES_INCOMPATIBLE_PARENT", required=required)),
        _when(found & misplaced, _finding("AES_INVALID_NODE_HEAD")),
    )
    top = F.array(
        _when(F.col("segment") != "member", _finding("AES_MISSING_PARENT", required=F.lit("$"))),
        _when(kind == "NodeHead", _finding("AES_INVALID_NODE_HEAD")),
    )
    some = lambda a: F.explode(F.filter(a, lambda x: x.isNotNull())).alias("finding")
    keep = ["stream_id", "plane", "ordinal", "address"]
    return _report(met.select(*keep, some(below)).unionByName(child.where("depth = 1").select(*keep, some(top))), "plane")


def missing_references(rows: DataFrame, index: DataFrame) -> DataFrame:
    """References whose target no body event has."""
    wanted = rows.where(F.col("kind").isin(*wire.REFERENCES) & paths.is_event_path(F.col("value")) & F.col("plane").isNotNull())
    body = index.where("plane = 'path'").select(F.col("stream_id"), F.col("address").alias("value"))
    missing = wanted.join(body, ["stream_id", "value"], "left_anti")
    return _report(missing.withColumn("finding", _finding("AES_MISSING_REFERENCE_TARGET", "value", required=F.col("value"))), "plane")


def duplicate_identities(rows: DataFrame) -> DataFrame:
    """Later holders of an identity, body before header. ``rows`` are the events that count."""
    held = rows.where((F.col("identity") != "") & F.col("plane").isNotNull()).withColumn("place", F.struct((F.col("plane") == "header").alias("late"), "ordinal"))
    first = held.groupBy("stream_id", "identity").agg(F.min("place").alias("first"), F.count("*").alias("times")).where("times > 1").drop("times")
    again = held.join(first, ["stream_id", "identity"]).where("place > first")
    return _report(again.withColumn("finding", _finding("AES_DUPLICATE_IDENTITY", "identity").withField("first_record", F.col("first.ordinal"))))


def nesting(rows: DataFrame, index: DataFrame, limits: Limits) -> DataFrame:
    """Containers inside more containers than allowed, themselves included.

    Only containers with that many segments can be; the prefixes of others are never exploded.
    """
    deep = index.where(F.col("first_kind").isin(*wire.CONTAINERS)).select(*_KEY, "first", paths.segments(F.col("address")).alias("segs")).where(F.size("segs") > limits.max_value_nesting_depth)
    up = deep.select("stream_id", "plane", "first", F.col("address").alias("of"), F.explode(paths.prefixes(F.col("segs"))).alias("address"))
    holders = index.where(F.col("first_kind").isin(*wire.CONTAINERS)).select(*_KEY)
    depth = up.join(holders, _KEY).groupBy("stream_id", "plane", "of", "first").agg(F.count("*").alias("n"))
    over = depth.select("stream_id", F.col("of").alias("address"), F.col("first").alias("ordinal"), _over(F.col("n"), "max_value_nesting_depth", limits, F.col("plane")).alias("finding"))
    return _report(over.where("finding is not null"))


def item_counts(index: DataFrame, limits: Limits) -> DataFrame:
    """Lists and tuples with more direct items than allowed."""
    segs = paths.segments(F.col("address"))
    items = index.select("stream_id", "plane", paths.parent(F.col("address"), segs).alias("address"), paths.last_segment(segs).alias("seg"), F.size(segs).alias("depth"))
    counted = items.where(F.col("seg").startswith("[") & (F.col("depth") > 1)).groupBy(*_KEY).agg(F.count("*").alias("n"))
    held = counted.where(F.col("n") > min(limits.max_list_items, limits.max_tuple_items)).join(index.select(*_KEY, "first", "first_kind"), _KEY)
    over = F.when(F.col("first_kind") == "ListNode", _over(F.col("n"), "max_list_items", limits, F.col("plane"))).when(F.col("first_kind") == "TupleLiteral", _over(F.col("n"), "max_tuple_items", limits, F.col("plane")))
    return _report(held.select("stream_id", "address", F.col("first").alias("ordinal"), over.alias("finding")).where("finding is not null"))


def stream_diagnostics(streams: DataFrame, rows: DataFrame, limits: Limits) -> DataFrame:
    """Unsupported contexts and streams with too many events."""
    bare = {"ordinal": F.lit(None).cast("long"), "address": F.lit(None).cast("string")}
    context = F.array(
        _when(~F.col("profile").isin(wire.COMPLETE_PROFILE, wire.PARTIAL_PROFILE), _finding("AES_UNSUPPORTED_PROFILE")),
        _when(F.col("projection") != wire.DOCUMENT_PROJECTION, _finding("AES_UNSUPPORTED_PROJECTION")),
    )
    odd = streams.select("stream_id", F.explode(F.filter(context, lambda x: x.isNotNull())).alias("finding")).withColumns(bare)
    many = rows.groupBy("stream_id").agg(F.count("*").alias("n")).select("stream_id", _over(F.col("n"), "max_events", limits, F.lit(None).cast("string")).alias("finding")).where("finding is not null").withColumns(bare)
    return _report(odd).unionByName(_report(many))


def plainly_sound(limits: Limits, of: Callable[[str], Column] = F.col) -> Column:
    """Whether a body event is sound at sight: no check of single events finds anything. Others may be sound too.

    ``of`` gives the event's fields by name.
    """
    most = min(limits.max_path_characters, 2 * limits.max_path_depth, limits.max_key_segment_codepoints)
    again = r"\.@\.[A-Za-z0-9_]+\.@\." if limits.max_attribute_depth else r"\.@\."

    def simple(c: Column) -> Column:
        return (F.octet_length(c) <= most) & c.rlike(paths.SIMPLE) & ~c.rlike(again)

    kind, value = of("kind"), of("value")
    free = [k for k in wire.KINDS if k not in (*wire.CONTAINERS, *wire.REFERENCES, *wire.EXACT_VALUES, "StringLiteral", "HexLiteral", "NodeHead", "SymbolicLiteral", "WTCDateTimeLiteral")]
    good = F.when(kind.isin(*wire.CONTAINERS), value.isNull()).when(kind.isin(*free), value.isNotNull())
    good = good.when(kind == "StringLiteral", F.octet_length(value) <= limits.max_string_codepoints).when(kind.isin(*wire.REFERENCES), simple(value))
    for k, allowed in wire.EXACT_VALUES.items():
        good = good.when(kind == k, value.isin(*allowed))
    bare = reduce(Column.__and__, [of(c).isNull() for c in ("header", "datatype", "generics", "clarifiers", "origin", "span")])
    return F.coalesce(bare & (F.coalesce(F.size(of("ext")), F.lit(0)) <= 0) & (F.coalesce(of("identity"), F.lit("x")) != "") & good & simple(of("path")), F.lit(False))


def sound_together(events: Column, profile: Column, projection: Column, limits: Limits) -> Column:
    """Whether a stream whose events are the array ``events`` is sound at sight, by itself: ``validate`` finds nothing in it. Others may be sound too.

    All its events are sound at sight, so they are body events under simple paths and none is a node head.
    """
    n = F.size(events)
    paths_of = lambda es: F.transform(es, lambda e: e["path"])
    none_but = lambda found, allowed: F.size(F.array_except(found, allowed)) == 0
    under = lambda like: F.transform(F.filter(events, lambda e: like(e["path"])), lambda e: F.regexp_replace(e["path"], paths.SIMPLE_LAST, ""))
    of_kind = lambda *kinds: paths_of(F.filter(events, lambda e: e["kind"].isin(*kinds)))
    attribute = lambda p: p.rlike(paths.SIMPLE_ATTRIBUTE)
    identities = F.transform(F.filter(events, lambda e: e["identity"].isNotNull()), lambda e: e["identity"])
    targets = F.transform(F.filter(events, lambda e: e["kind"].isin(*wire.REFERENCES)), lambda e: e["value"])
    known = paths_of(events)
    related = [
        F.size(F.array_distinct(known)) == n,
        F.size(F.array_distinct(identities)) == F.size(identities),
        none_but(targets, known),
        none_but(under(lambda p: ~p.endswith("]") & ~attribute(p)), F.concat(F.array(F.lit("$")), of_kind("ObjectNode"))),
        none_but(under(lambda p: p.endswith("]")), of_kind("ListNode", "TupleLiteral")),
        none_but(under(attribute), known),
    ]
    single = F.forall(events, lambda e: plainly_sound(limits, lambda name: e[name]) & (F.octet_length(e["path"]) <= 2 * limits.max_value_nesting_depth))
    context = profile.isin(wire.COMPLETE_PROFILE, wire.PARTIAL_PROFILE) & F.coalesce(projection == wire.DOCUMENT_PROJECTION, F.lit(True))
    few = n <= min(limits.max_events, limits.max_list_items, limits.max_tuple_items)
    return F.coalesce(context & few & single & ((profile == wire.PARTIAL_PROFILE) | reduce(Column.__and__, related)), F.lit(False))


def alone_together(events: Column, profile: Column, projection: Column, limits: Limits) -> Column:
    """Whether no check between events can find anything in a stream, by itself, whose events are the array ``events``; see ``_alone``."""
    small = min(limits.max_events, limits.max_list_items, limits.max_tuple_items)
    short = lambda e: e["header"].isNull() & (F.coalesce(F.octet_length(e["path"]), F.lit(0)) <= 2 * limits.max_value_nesting_depth)
    return F.coalesce((profile == wire.PARTIAL_PROFILE) & projection.isNull() & (F.size(events) <= small) & F.forall(events, short), F.lit(False))


def _alone(events: DataFrame, streams: DataFrame, limits: Limits) -> DataFrame:
    """(stream_id, profile, projection, alone): whether no check between events can find anything in a stream.

    So it is with body events of a partial profile, where the stream has too few events
    and too short paths to pass a limit.
    """
    small = min(limits.max_events, limits.max_list_items, limits.max_tuple_items)
    met = events.groupBy("stream_id").agg(
        F.count("*").alias("n"), F.count("header").alias("headers"), F.max(F.octet_length("path")).alias("longest")
    )
    alone = (F.col("profile") == wire.PARTIAL_PROFILE) & F.col("projection").isNull() & F.coalesce((F.col("n") <= small) & (F.col("headers") == 0) & (F.coalesce("longest", F.lit(0)) <= 2 * limits.max_value_nesting_depth), F.col("n").isNull())
    partial = streams.select("stream_id", "profile", "projection")
    return partial.join(met.hint("merge"), "stream_id", "left").select("stream_id", "profile", "projection", F.coalesce(alone, F.lit(False)).alias("alone"))


def validate(events: DataFrame, streams: DataFrame, limits: Limits = Limits(), registered: tuple[str, ...] = ()) -> DataFrame:
    """DIAGNOSTICS of all streams; a stream without a row is valid.

    Streams in which only checks of single events apply are told apart by counts first; of them
    only the events go on that are not sound at sight. ``events`` is read more than once.
    """
    if not streams.where(F.col("profile").eqNullSafe(wire.PARTIAL_PROFILE) & F.col("projection").isNull()).take(1):
        return _validate(events, streams, limits, registered)
    return validate_told(events, materialize(_alone(events, streams, limits), "alone"), limits, registered)


def validate_told(events: DataFrame, told: DataFrame, limits: Limits = Limits(), registered: tuple[str, ...] = ()) -> DataFrame:
    """The same for streams of which ``alone`` is known already (stream_id, profile, projection, alone).

    Joins with streams are shuffled: files that compress well look small enough to be broadcast whatever their rows.
    """
    odd = events.where(~plainly_sound(limits)).join(told.where("alone").drop("alone").hint("merge"), "stream_id")
    found = event_diagnostics(materialize(addressed(odd), "odd"), limits, registered).select(*schema.DIAGNOSTICS.fieldNames())
    rest = told.where("not alone").drop("alone")
    if not rest.take(1):
        return found
    own = events.join(rest.select("stream_id"), "stream_id", "left_semi")
    return found.unionByName(_validate(own, rest, limits, registered))


def _validate(events: DataFrame, streams: DataFrame, limits: Limits, registered: tuple[str, ...]) -> DataFrame:
    """The addressed events and their index are written once; the branches read the columns that they need."""
    context = streams.select("stream_id", "profile", "projection")
    documents = F.col("projection").eqNullSafe(wire.DOCUMENT_PROJECTION)
    complete = F.col("profile").eqNullSafe(wire.COMPLETE_PROFILE)
    rows = materialize(addressed(events).join(context, "stream_id"), "addressed")
    marks = [F.first(c).alias(c) for c in ("profile", "projection")]  # the same in a whole stream
    index = materialize(first_index(rows, *marks), "index")
    # a body finding needs the complete profile; a header finding the projection, and for references both
    own = lambda df: df.where(F.when(F.col("plane") == "path", complete).otherwise(documents))
    counted, known = own(rows), own(index).drop("profile", "projection")
    parts = [
        stream_diagnostics(streams, rows, limits),
        event_diagnostics(rows, limits, registered),
        header_order(rows),
        duplicate_paths(counted, known),
        parents(counted, known),
        missing_references(counted.where(complete), known),
        duplicate_identities(counted),
        nesting(rows, index, limits),
        item_counts(index, limits),
    ]
    return reduce(DataFrame.unionByName, [p.select(*schema.DIAGNOSTICS.fieldNames()) for p in parts])


def verdicts(streams: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """(stream_id, profile, valid, n_diagnostics)."""
    n = diagnostics.groupBy("stream_id").agg(F.count("*").alias("n"))
    joined = streams.select("stream_id", "profile").join(n, "stream_id", "left")
    return joined.select("stream_id", "profile", F.col("n").isNull().alias("valid"), F.coalesce("n", F.lit(0)).alias("n_diagnostics"))
