"""Metatags: JSON objects with a schema for each kind of document."""

from __future__ import annotations

import json

#: What a value of each type must be; a boolean is no number.
_IS = {
    "string": lambda v: isinstance(v, str),
    "integer": lambda v: isinstance(v, int) and not isinstance(v, bool),
    "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
    "boolean": lambda v: isinstance(v, bool),
    "array": lambda v: isinstance(v, list),
    "object": lambda v: isinstance(v, dict),
}


def validate(metatags: dict, fields: dict[str, str], required: tuple[str, ...] = (), allow_extra: bool = True) -> None:
    """Raises ValueError on what the schema refuses: a missing or further key, a value of another type."""
    if missing := [k for k in required if k not in metatags]:
        raise ValueError(f"missing metatags: {', '.join(missing)}")
    if not allow_extra and (further := sorted(set(metatags) - set(fields))):
        raise ValueError(f"unexpected metatags: {', '.join(further)}")
    for key, kind in fields.items():
        if key in metatags and not _IS[kind](metatags[key]):
            raise ValueError(f"metatag {key} must be of type {kind}")


def parsed(text: str | None) -> dict:
    """A JSON object, and {} for anything that is none."""
    try:
        value = json.loads(text or "{}")
    except ValueError:
        return {}
    return value if isinstance(value, dict) else {}
