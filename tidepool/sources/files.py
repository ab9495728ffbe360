"""File trees as tables: size cap, text only, ignore patterns, languages, hashes."""

from __future__ import annotations

import fnmatch
import os
import re
import stat
from collections.abc import Iterator
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import language_of
from .work import hadoop, kept

#: Bytes of a file, at most; bytes that the driver reads at once.
MOST_BYTES, BATCH_BYTES = 1_000_000, 32_000_000


def pattern_regex(pattern: str) -> str:
    """An ignore pattern as a regular expression over the path below the root.

    ``dir/`` is a prefix of the path, a pattern with a slash inside a glob of the whole path, any other a glob of the name or
    of the whole path. A star crosses slashes; there is no negation.
    """
    pattern = pattern.strip()
    if not pattern:
        return r"\b\B"  # nothing
    if pattern.endswith("/"):
        return rf"^{re.escape(pattern.rstrip('/'))}"
    glob = fnmatch.translate(pattern).replace(r"\Z", "").replace(r"\z", "")
    return rf"^{glob}$" if "/" in pattern else rf"^(.*/)?{glob}$"


def ignored(path: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | path.rlike(pattern_regex(p))
    return out


def hidden(spark: SparkSession, root: str) -> Iterator[tuple[str, int, int]]:
    """(path, size, time) of the files that Spark's sources pass over: below the root, with a name, their own or a folder's,
    that begins with a dot or an underscore."""
    fs, path = hadoop(spark, root)
    start = len(fs.getFileStatus(path).getPath().toString().rstrip("/")) + 1
    found = fs.listFiles(path, True)
    while found.hasNext():
        status = found.next()
        name = status.getPath().toString()
        if re.search(r"(^|/)[._]", name[start:]):
            yield name, status.getLen(), status.getModificationTime()


def content(spark: SparkSession, path: str) -> bytes:
    fs, at = hadoop(spark, path)
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes())
    finally:
        stream.close()


def hidden_files(spark: SparkSession, root: str, most_bytes: int) -> DataFrame:
    """Those files as the binary source would give them, read by the driver and written on, BATCH_BYTES at a time."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    out = spark.createDataFrame([], schema)
    rows: list[tuple] = []
    for path, size, time in hidden(spark, root):
        if size <= most_bytes:
            rows.append((path, datetime.fromtimestamp(time / 1000, UTC), size, bytearray(content(spark, path))))
        if sum(r[2] for r in rows) >= BATCH_BYTES:
            out, rows = out.union(kept(spark.createDataFrame(rows, schema), "hidden-files")), []
    return out.union(kept(spark.createDataFrame(rows, schema), "hidden-files")) if rows else out


def gitignores(spark: SparkSession, root: str, most_bytes: int = MOST_BYTES) -> list[tuple[str, str]]:
    """(folder, pattern) of every .gitignore below the root, its folder relative to it, "" for the root itself."""
    fs, path = hadoop(spark, root)
    start = len(fs.getFileStatus(path).getPath().toString().rstrip("/")) + 1
    out = []
    for name, size, _ in hidden(spark, root):
        if name.endswith("/.gitignore") and size <= most_bytes:
            text = content(spark, name).decode("utf-8", "replace")
            lines = [line.strip() for line in text.splitlines()] if "\0" not in text[:4096] and "\ufffd" not in text else []
            out += [(name[start : -len("/.gitignore")], line) for line in lines if line and not line.startswith("#")]
    return out


def relative(path: str, root: str) -> Column:
    base = re.escape(root.rstrip("/"))
    return F.regexp_replace(path, rf"^[a-z]+:/*(?=/){base}/|^{base}/", "")


def linked(root: str) -> list[str]:
    """Relative paths below a local root that are reached through symbolic links, or are links, or have several names.

    Only local trees have links. Names alone are walked, on the driver, one folder at a time.
    """
    out, stack = [], [Path(root)]
    while stack:
        for entry in os.scandir(stack.pop()):
            at = Path(entry.path)
            if entry.is_symlink():
                out.append(at.relative_to(root).as_posix())
            elif entry.is_dir():
                stack.append(at)
            elif not stat.S_ISREG((status := entry.stat()).st_mode) or status.st_nlink != 1:
                out.append(at.relative_to(root).as_posix())
    return out


def scan(spark: SparkSession, root: str, ignore: list[str] | None = None, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(path, root_path, relative, language, file_size, mtime, content_hash, text) of a tree's text files.

    Sizes are pruned before contents are read. Left out are files that a pattern or a .gitignore of a folder above them
    names, that are no valid UTF-8 or hold a NUL in the first 4096 bytes, and on local trees links and files with several
    names. Patterns of all .gitignore files count against the path below the root, and only for files below their folder.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(F.col("length") <= most_bytes)
    rows = rows.select("path", "modificationTime", "length", "content").union(hidden_files(spark, root, most_bytes))
    rows = rows.withColumn("relative", relative("path", root)).where(~ignored(F.col("relative"), ignore or []))
    for folder, pattern in gitignores(spark, root):  # as many as the tree's owners wrote
        below = F.col("relative").startswith(f"{folder}/") if folder else F.lit(True)
        rows = rows.where(~(below & ignored(F.col("relative"), [pattern])))
    local = Path(root)
    for name in linked(root) if local.is_dir() else ():
        rows = rows.where((F.col("relative") != name) & ~F.col("relative").startswith(f"{name}/"))
    binary = F.hex(F.substring("content", 1, 4096)).rlike("^(..)*00")
    text = F.when(~binary & F.is_valid_utf8(F.col("content").cast("string")), F.decode("content", "UTF-8"))
    rows = rows.withColumn("text", text).where(F.col("text").isNotNull())
    return rows.select(
        F.concat(F.lit(root.rstrip("/") + "/"), "relative").alias("path"), F.lit(root.rstrip("/")).alias("root_path"), "relative",
        language_of(F.col("relative")).alias("language"), F.col("length").alias("file_size"), F.col("modificationTime").cast("string").alias("mtime"),
        F.sha2("content", 256).alias("content_hash"), "text",
    )
