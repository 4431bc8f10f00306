"""Limits that a consumer selects. They become literals of a plan and are never read from data."""

from __future__ import annotations

from dataclasses import dataclass, fields

#: Older names of datatype limits.
ALIASES = {"max_depth": "max_generic_depth", "max_items": "max_datatype_components"}
_SAFE = 2**53 - 1


@dataclass(frozen=True)
class Limits:
    """Counters of the text format and of events; the defaults are fixed values."""

    max_input_bytes: int = 67_108_864
    max_line_bytes: int = 1_048_576
    max_fields_per_event: int = 64
    max_events: int = 100_000
    max_decoded_payload_bytes: int = 33_554_432
    max_path_depth: int = 1_024
    max_path_characters: int = 8_192
    max_attribute_depth: int = 1
    max_value_nesting_depth: int = 256
    max_string_codepoints: int = 1_048_576
    max_key_segment_codepoints: int = 1_024
    max_list_items: int = 65_536
    max_tuple_items: int = 65_536
    max_generic_depth: int = 1
    max_generic_arguments: int = 32
    max_clarifier_values: int = 1
    max_datatype_components: int = 64

    def __post_init__(self):
        _check(self)

    @classmethod
    def of(cls, **given: int) -> Limits:
        """From names as above; an older name gives way to the current one."""
        return _build(cls, given)


@dataclass(frozen=True)
class BinaryLimits:
    """Counters of the binary format; the defaults are fixed values."""

    max_input_bytes: int = 67_108_864
    max_record_bytes: int = 16_777_216
    max_field_bytes: int = 4_194_304
    max_buffered_bytes: int = 16_777_216

    def __post_init__(self):
        _check(self)

    @classmethod
    def of(cls, **given: int) -> BinaryLimits:
        return _build(cls, given)


def _check(limits) -> None:
    for f in fields(limits):
        v = getattr(limits, f.name)
        if isinstance(v, bool) or not isinstance(v, int) or not 0 <= v <= _SAFE:
            raise ValueError(f"{f.name} must be a non-negative safe integer")


def _build(cls, given: dict[str, int]):
    known = {f.name for f in fields(cls)}
    named = {ALIASES[k]: v for k, v in given.items() if k in ALIASES and ALIASES[k] in known}
    return cls(**named | {k: v for k, v in given.items() if k in known})
