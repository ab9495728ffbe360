"""Chunks of texts: whole bodies, and files as segments packed greedily to a token size, with overlap."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import count_tokens

_TOKEN = re.compile(r"[^\W_]+(?:[-'][^\W_]+)*")
# Where segments of a language begin.
_STARTS = {"python": re.compile(r"^(?:async\s+def\s+|def\s+|class\s+)"), "markdown": re.compile(r"^#{1,6}\s+"), "md": re.compile(r"^#{1,6}\s+")}
NAMES = ["chunk_index", "chunk_text", "token_count", "start_line", "end_line"]


def tokens(text: str) -> int:
    return len(_TOKEN.findall(text))


def body_chunks(documents: DataFrame, key: str, body: Column) -> DataFrame:
    """(key, chunk_index, chunk_text, token_count): one chunk, the stripped body; none where nothing is left."""
    text = F.regexp_replace(body, r"(?U)^\s+|\s+$", "")
    rows = documents.select(key, F.lit(0).alias("chunk_index"), text.alias("chunk_text")).where(F.length("chunk_text") > 0)
    return rows.withColumn("token_count", F.greatest(count_tokens(F.col("chunk_text")), F.lit(1)).cast("bigint"))


def segments(lines: list[str], language: str) -> list[tuple[int, int]]:
    """Half-open line ranges: from one definition or heading to the next, or line by line."""
    start = _STARTS.get(language)
    if start is None:
        return [(i, i + 1) for i in range(len(lines))]
    cuts = [0, *[i for i, line in enumerate(lines) if i and start.match(line)], len(lines)]
    return list(zip(cuts, cuts[1:], strict=False))


class _Pack:
    """What a chunk in the making holds: line numbers, and the tokens counted so far."""

    def __init__(self, rows: list[int], held: int):
        self.rows, self.held = rows, held

    def done(self, lines: list[str], index: int, first: int) -> tuple[int, str, int, int, int]:
        body = "\n".join(lines[i] for i in self.rows).strip()
        return index, body, max(1, tokens(body)), first + 1, first + len(self.rows)

    def tail(self, lines: list[str], overlap: int) -> _Pack:
        """The last lines that hold ``overlap`` tokens together, or all."""
        held, at = 0, len(self.rows)
        while at and held < overlap:
            at -= 1
            held += tokens(lines[self.rows[at]])
        return _Pack(self.rows[at:], held)


def chunk(text: str, language: str = "text", size: int = 400, overlap: int = 50, ahead: bool = False) -> Iterator[tuple[int, str, int, int, int]]:
    """(index, text, tokens, first line, last line), lines from 1; nothing for a blank text.

    Segments without text are passed over. A segment is never split: one that would take the chunk above ``size`` tokens
    starts the next, which repeats the last lines of the one before that hold ``overlap`` tokens. The first line is that of
    the first line held; with ``ahead`` it is counted back from the segment's end, as older indexes have it, and so runs
    ahead after an overlap.
    """
    if not text.strip():
        return
    lines = text.splitlines()
    pack, first, index = _Pack([], 0), 0, 0
    for a, b in segments(lines, language):
        own = tokens("\n".join(lines[a:b]))
        if not any(line.strip() for line in lines[a:b]):
            continue
        if pack.rows and pack.held + own > size:
            yield pack.done(lines, index, first)
            index += 1
            pack = pack.tail(lines, overlap)
            first = max(0, b - len(pack.rows)) if ahead else pack.rows[0] if pack.rows else a
        if not pack.rows:
            first = a
        pack.rows.extend(range(a, b))
        pack.held += own
    if pack.rows:
        yield pack.done(lines, index, first)


def chunk_files(files: DataFrame, size: int = 400, overlap: int = 50, key: str = "path") -> DataFrame:
    """Chunks of every file (key, text, language), a fold over each file's lines."""
    import pandas as pd

    def run(batches):
        for batch in batches:
            rows = [(k, *c) for k, t, g in zip(batch[key], batch["text"], batch["language"], strict=True) for c in chunk(t or "", g or "text", size, overlap)]
            yield pd.DataFrame(rows, columns=[key, *NAMES])

    kind = dict(files.dtypes)[key]
    return files.select(key, "text", "language").mapInPandas(run, f"{key} {kind}, chunk_index int, chunk_text string, token_count int, start_line int, end_line int")
