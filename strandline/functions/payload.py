r"""Payload escapes of the text format: ``\\ \n \r \t \0`` and ``\u{H…}``."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters with a short escape.
SHORT = {"\\": "\\", "n": "\n", "r": "\r", "t": "\t", "0": "\0"}
_SPELT = {ord(v): "\\" + k for k, v in SHORT.items()}
_ESCAPED = _SPELT | {c: f"\\u{{{c:X}}}" for c in (*range(0x20), 0x7F) if c not in _SPELT}
_TOKEN = re.compile(r"[^\\\x00-\x1f\x7f\ud800-\udfff]+|\\[\\nrt0]|\\u\{([0-9A-Fa-f]{1,6})\}")


class PayloadError(Exception):
    def __init__(self, code: str):
        self.code = code


def decode(payload: str) -> tuple[str, bool]:
    """The value and whether every escape has its canonical spelling."""
    if "\\" not in payload and payload.isprintable():
        return payload, True
    out, canonical, at = [], True, 0
    while at < len(payload):
        m = _TOKEN.match(payload, at)
        if m is None:
            raise PayloadError(_fault(payload, at))
        if m[1] is not None:
            scalar = int(m[1], 16)
            if scalar > 0x10FFFF or 0xD800 <= scalar < 0xE000:
                raise PayloadError("TELEX_INVALID_UNICODE_SCALAR")
            canonical &= m[1] == f"{scalar:X}" and scalar not in (0, 9, 10, 13)
            out.append(chr(scalar))
        elif m[0][0] == "\\":
            out.append(SHORT[m[0][1]])
        else:
            out.append(m[0])
        at = m.end()
    return "".join(out), canonical


def _fault(payload: str, at: int) -> str:
    """Why no token starts at ``at``."""
    rest = payload[at:]
    if rest[0] != "\\":
        return "TELEX_INVALID_UNICODE_SCALAR" if "\ud800" <= rest[0] <= "\udfff" else "TELEX_UNESCAPED_CONTROL"
    if len(rest) == 1:
        return "TELEX_INCOMPLETE_ESCAPE"
    if not rest.startswith("\\u{"):
        return "TELEX_UNKNOWN_ESCAPE"
    return "TELEX_INVALID_UNICODE_ESCAPE" if "}" in rest else "TELEX_UNTERMINATED_UNICODE_ESCAPE"


def encode(value: str) -> str:
    return value.translate(_ESCAPED)


# -- as expressions ------------------------------------------------------------


def encoded(value: Column) -> Column:
    """``encode`` in generated code: the backslash first, then the other characters that need an escape."""
    out = F.replace(value, F.lit("\\"), F.lit("\\\\"))
    plain = ~value.rlike(r"[\x00-\x1f\x7f]")
    full = out
    for code, spelt in sorted(_ESCAPED.items()):
        if code != ord("\\"):
            full = F.replace(full, F.lit(chr(code)), F.lit(spelt))
    return F.when(plain, out).otherwise(full)


_PIECE = r"[^\\]+|\\u\{[0-9A-Fa-f]{1,6}\}|\\[\\nrt0]"


def well_formed(payload: Column) -> Column:
    return payload.rlike(rf"\A(?:[^\\\x00-\x1f\x7f]|\\[\\nrt0]|\\u\{{(?!0{{0,2}}[dD][89a-fA-F][0-9a-fA-F]{{2}}\}})(?:0?[0-9A-Fa-f]{{1,5}}|10[0-9A-Fa-f]{{4}})\}})*+\z")


def decoded(payload: Column) -> Column:
    """``decode`` of a well-formed payload in generated code."""

    def piece(p: Column) -> Column:
        scalar = F.decode(F.unhex(F.lpad(F.regexp_extract(p, r"\{([0-9A-Fa-f]+)\}", 1), 8, "0")), "UTF-32")
        out = F.when(p.startswith("\\u"), scalar)
        for k, v in SHORT.items():
            out = out.when(p == "\\" + k, F.lit(v))
        return out.otherwise(p)

    pieces = F.regexp_extract_all(payload, F.lit(f"({_PIECE})"), F.lit(0))
    return F.when(F.instr(payload, "\\") == 0, payload).otherwise(F.array_join(F.transform(pieces, piece), ""))
