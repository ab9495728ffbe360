"""Commands: ``python -m tidepool.cli --root DIR COMMAND [--name value ...]``; the answer is one JSON envelope.

A command is an operation of the engine, its words joined by spaces or underscores (``notes add`` and the like have their own
names). Arguments are the operation's, by name; values are read as JSON where they can be.
"""

from __future__ import annotations

import inspect
import json
import sys
import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from . import config
from .engine import Engine, EngineError
from .plans.search import SearchQuery

#: Commands that are an operation with something filled in.
NAMED = {
    "notes add": ("add", {"kind": "note"}), "notes update": ("update", {}), "notes list": ("list", {"kind": "note"}), "notes get": ("get", {}), "notes delete": ("delete", {}), "notes search": ("search", {"types": ["notes"]}),
    "history append": ("append_history", {}), "history update": ("update", {}), "history search": ("search", {"types": ["history"]}), "history delete": ("delete", {}),
    "tasks add": ("add", {"kind": "task"}), "tasks update": ("update", {}), "tasks get": ("get", {}), "tasks get-by-external-key": ("get_by_external_key", {}), "tasks list": ("list", {"kind": "task"}), "tasks search": ("search", {"types": ["tasks"]}),
    "tasks done": ("done", {}), "tasks status": ("set_status", {}), "tasks upsert": ("upsert_task", {}), "tasks delete": ("delete", {}),
    "files index": ("index_files", {}), "files reindex": ("reindex_files", {}), "files get": ("get_file", {}), "files list": ("list", {"kind": "file"}), "files search": ("search", {"types": ["files"]}), "files delete": ("delete", {}),
    "links add": ("link", {}), "links list": ("links", {}), "links delete": ("unlink", {}),
    "memory capture": ("capture", {}), "memory search": ("search_facts", {}), "memory recall": ("recall", {}), "memory context": ("context", {}), "memory extract": ("extract", {}), "memory flush": ("flush", {}), "memory preview": ("preview", {}),
    "memory promote": ("promote", {}), "memory status": ("set_fact_status", {}), "memory scenarios": ("search_scenarios", {}), "memory conflicts": ("conflicts", {}), "memory metrics": ("metrics", {}), "memory evidence": ("evidence", {}),
    "search": ("search", {}), "projects list": ("projects", {}), "health": ("health", {}), "db migrate": ("migrate", {}), "db compact": ("compact", {}), "capabilities": ("capabilities", {}),
}
SETTINGS = {"config get": config.get, "config set": config.set_, "config init": config.init}


def success(command: str, data: object, seconds: float = 0.0) -> dict:
    return {"ok": True, "command": command, "data": data, "meta": {"duration_ms": round(seconds * 1000)}}


def failure(command: str, error: Exception) -> dict:
    code = error.code if isinstance(error, EngineError) else "not_found" if isinstance(error, KeyError) else "invalid"
    return {"ok": False, "command": command, "error": {"code": code, "message": str(error)}}


def value(text: str) -> object:
    try:
        return json.loads(text)
    except ValueError:
        return text


def parsed(words: Sequence[str]) -> tuple[str, dict]:
    """The command and its arguments by name; dashes in names are underscores."""
    command: list[str] = []
    given: dict = {}
    words = list(words)
    while words:
        word = words.pop(0)
        if not word.startswith("--"):
            command.append(word)
        elif not words:
            raise ValueError(f"{word} needs a value")
        else:
            given[word[2:].replace("-", "_")] = value(words.pop(0))
    return " ".join(command), given


def plain(result: object) -> object:
    """An operation's result as JSON can hold it; tables are pages here."""
    if isinstance(result, DataFrame):
        return [r.asDict(recursive=True) for r in result.limit(100).collect()]
    if isinstance(result, tuple) and len(result) == 2:
        return {"count": len(result[0]), "items": result[0], "next_cursor": result[1]}
    return result


def call(engine: Engine, command: str, given: dict) -> object:
    if command not in NAMED:
        raise ValueError(f"unknown command {command!r}")
    name, fixed = NAMED[command]
    operation: Callable = getattr(engine, name)
    given = fixed | given
    if name == "search":
        fields = {k: given.pop(k) for k in ("limit", "budget", "weights", "cursor") if k in given}
        query = SearchQuery(str(given.pop("query")), types=tuple(given.pop("types", ()) or ("notes", "tasks", "history", "files")), **fields)
        projects = given.pop("projects", None) or [given.pop("project")]
        return plain(operation(query, projects, **given))
    given = {k: tuple(v) if isinstance(v, list) and k in ("evidence", "clear", "statuses") else v for k, v in given.items()}
    try:
        inspect.signature(operation).bind(**given)
    except TypeError as error:
        raise ValueError(f"{command}: {error}") from None
    return plain(operation(**given))


def run(words: Sequence[str], spark: SparkSession | None = None) -> dict:
    command = " ".join(words)
    began = time.time()
    try:
        command, given = parsed(words)
        root = str(given.pop("root", "."))
        if command in SETTINGS:
            return success(command, SETTINGS[command](f"{root}/config.toml", **given), time.time() - began)
        spark = spark or SparkSession.builder.getOrCreate()
        return success(command, call(Engine(spark, root), command, given), time.time() - began)
    except (EngineError, ValueError, KeyError, TypeError) as error:
        return failure(command, error)


if __name__ == "__main__":
    envelope = run(sys.argv[1:])
    print(json.dumps(envelope, ensure_ascii=False, default=str))
    sys.exit(0 if envelope["ok"] else 1)
