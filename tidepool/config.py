"""Settings in a TOML file, with profiles laid over them."""

from __future__ import annotations

import os
import tempfile
import tomllib
from pathlib import Path

EXAMPLE = {
    "search": {"limit": 20, "budget_tokens": 800},
    "chunks": {"size": 400, "overlap": 50},
    "filesystem": {"max_file_size": 1_000_000, "ignore": []},
    "provider": {"external": False, "projects": []},
    "memory": {"batch": 10, "interval_seconds": 60, "max_facts": 20},
}


def overlaid(base: dict, over: dict) -> dict:
    """Tables merge key by key, other values are replaced."""
    out = dict(base)
    for key, value in over.items():
        out[key] = overlaid(out[key], value) if isinstance(out.get(key), dict) and isinstance(value, dict) else value
    return out


def load_raw(path: str | Path) -> dict:
    return tomllib.loads(Path(path).read_text()) if Path(path).exists() else {}


def load(path: str | Path, profile: str | None = None) -> dict:
    """Defaults, the file, and the profile's table of it, each over the one before."""
    raw = load_raw(path)
    profiles = raw.pop("profiles", {})
    if profile is not None and profile not in profiles:
        raise KeyError(f"no profile {profile}")
    return overlaid(overlaid(EXAMPLE, raw), profiles.get(profile, {}))


def _toml(value: object) -> str:
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, str):
        return '"' + value.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'
    if isinstance(value, list):
        return "[" + ", ".join(map(_toml, value)) + "]"
    return repr(value)


def dumps(table: dict, name: str = "") -> str:
    plain = [f"{k} = {_toml(v)}" for k, v in table.items() if not isinstance(v, dict)]
    below = [dumps(v, f"{name}.{k}" if name else k) for k, v in table.items() if isinstance(v, dict)]
    return "\n".join([*([f"[{name}]"] if name else []), *plain, "", *below])


def save(path: str | Path, table: dict) -> None:
    """Replaces the file in one step."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=path.parent, prefix=path.name)
    with os.fdopen(handle, "w") as out:
        out.write(dumps(table))
    os.replace(name, path)


def init(path: str | Path) -> bool:
    """Writes the defaults where there is no file yet."""
    if Path(path).exists():
        return False
    save(path, EXAMPLE)
    return True


def get(path: str | Path, key: str, profile: str | None = None) -> object:
    value: object = load(path, profile)
    for part in key.split("."):
        if not isinstance(value, dict) or part not in value:
            raise KeyError(key)
        value = value[part]
    return value


def set_(path: str | Path, key: str, text: str) -> object:
    """Sets a known key from text, as a value of the type it has."""
    old = get(path, key)
    if isinstance(old, bool):
        if text.lower() not in ("true", "false"):
            raise ValueError(f"{key} is true or false")
        value: object = text.lower() == "true"
    elif isinstance(old, (int, float)):
        value = type(old)(text)
    elif isinstance(old, list):
        value = [x.strip() for x in text.split(",") if x.strip()]
    else:
        value = text
    raw = load_raw(path)
    at = raw
    *tables, last = key.split(".")
    for part in tables:
        at = at.setdefault(part, {})
    at[last] = value
    save(path, raw)
    return value
