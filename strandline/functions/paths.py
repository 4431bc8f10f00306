r"""Canonical addresses as column expressions.

An address is ``$`` and segments: a member ``.name`` or ``.["…"]``, an attribute
``.@.name`` or ``.@.["…"]``, an index ``[n]``. Quoted members use the canonical JSON
spelling and must not be spellable as a bare name. All of it is one regular
expression, so that parsing stays in generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BARE = r"[A-Za-z_][A-Za-z0-9_]*+"
#: Canonical JSON: short escapes where there are any, else \u00xx in lower case for controls, nothing else escaped.
_QUOTED = r'\["(?![A-Za-z_][A-Za-z0-9_]*"\])(?:[^"\\\x00-\x1f]|\\["\\bfnrt]|\\u00(?:0[0-7bef]|1[0-9a-f]))*+"\]'
SEGMENT = rf"(?:(?:\.@)?\.(?:{_BARE}|{_QUOTED})|\[(?:0|[1-9][0-9]*+)\])"
#: Canonical event paths without quoted members; the others need ``_WHOLE``.
SIMPLE = rf"\A\$(?:(?:\.@)?\.{_BARE}|\[(?:0|[1-9][0-9]*+)\])++\z"
#: The last segment of such a path, and whether it is an attribute.
SIMPLE_LAST = rf"(?:(?:\.@)?\.{_BARE}|\[(?:0|[1-9][0-9]*+)\])\z"
SIMPLE_ATTRIBUTE = rf"\.@\.{_BARE}\z"
_WHOLE = rf"\A\$(?:{SEGMENT})*+\z"


def is_canonical(path: Column) -> Column:
    """Whether the address is canonical; the root ``$`` is."""
    return path.rlike(_WHOLE)


def is_event_path(path: Column) -> Column:
    """Canonical and not the root, which no event may have."""
    return path.rlike(_WHOLE) & (path != "$")


def segments(path: Column) -> Column:
    """The segments of a canonical address, as spelt."""
    return F.regexp_extract_all(path, F.lit(f"({SEGMENT})"), F.lit(0))


def prefixes(segs: Column) -> Column:
    """Every non-root prefix, the shortest first and the address itself last."""
    upto = lambda acc, s: F.concat(acc, F.array(F.concat(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("$")), s)))
    return F.aggregate(segs, F.array().cast("array<string>"), upto)


def last_segment(segs: Column) -> Column:
    return F.try_element_at(segs, F.lit(-1))


def parent(path: Column, segs: Column) -> Column:
    """The address without its last segment; ``$`` for a root child."""
    return F.substring(path, F.lit(1), F.char_length(path) - F.char_length(last_segment(segs)))


def segment_type(seg: Column) -> Column:
    return F.when(seg.startswith("["), "index").when(seg.startswith(".@."), "attribute").otherwise("member")


def key_length(seg: Column) -> Column:
    """Code points of a member's or attribute's decoded name; null for an index."""
    name = F.regexp_replace(seg, r"^(?:\.@)?\.", "")
    decoded = F.regexp_replace(F.substring(name, F.lit(3), F.char_length(name) - 4), r"\\(?:u[0-9a-f]{4}|.)", "_")
    length = F.when(name.startswith("["), F.char_length(decoded)).otherwise(F.char_length(name))
    return F.when(~seg.startswith("["), length)


def attribute_depth(segs: Column) -> Column:
    """The longest run of attribute segments."""
    step = lambda acc, s: F.struct(
        F.when(s.startswith(".@."), acc["run"] + 1).otherwise(0).alias("run"),
        F.greatest(acc["most"], F.when(s.startswith(".@."), acc["run"] + 1).otherwise(0)).alias("most"),
    )
    return F.aggregate(segs, F.struct(F.lit(0).alias("run"), F.lit(0).alias("most")), step)["most"]


def shared_prefix_codepoints(a: Column, b: Column) -> Column:
    """Length in code points of the longest common prefix of two strings."""
    n = F.least(F.char_length(a), F.char_length(b))
    differ = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    return F.when(n == 0, F.lit(0)).otherwise(F.coalesce(F.try_element_at(differ, F.lit(1)) - 1, n))


def address(keys: Column) -> Column:
    """The canonical address of an array of structs (kind, key): members and attributes by raw name, indexes by number.

    A name that is no bare one is quoted in canonical JSON spelling. A null or unknown
    kind, a null key or an index that is no canonical number gives null.
    """

    def name(key: Column) -> Column:
        out = F.replace(F.replace(key, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
        short = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}
        for code in range(0x20):
            out = F.replace(out, F.lit(chr(code)), F.lit(short.get(code, f"\\u{code:04x}")))
        return F.when(key.rlike(rf"\A{_BARE}\z"), key).otherwise(F.concat(F.lit('["'), out, F.lit('"]')))

    def segment(k: Column) -> Column:
        number = F.when(k["key"].rlike(r"\A(0|[1-9][0-9]*)\z"), F.concat(F.lit("["), k["key"], F.lit("]")))
        named = F.when(k["kind"] == "member", F.concat(F.lit("."), name(k["key"]))).when(k["kind"] == "attribute", F.concat(F.lit(".@."), name(k["key"])))
        return F.when(k["kind"] == "index", number).otherwise(named)

    segs = F.transform(keys, segment)
    return F.when(~F.exists(segs, lambda s: s.isNull()), F.concat(F.lit("$"), F.array_join(segs, "")))
