"""Versioned tables: commits of appended rows, latest rows, guarded changes, marks, change detection."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .work import hadoop, kept

# The life of a task, from each state to the next ones.
TRANSITIONS = {
    "open": ("open", "in_progress", "blocked", "done"),
    "in_progress": ("in_progress", "blocked", "done"),
    "blocked": ("blocked", "in_progress", "done"),
    "done": ("done", "closed"),
    "closed": ("closed",),
}


class Conflict(Exception):
    """Another writer committed first."""


class VersionedTable:
    """Rows appended by commits. A commit is a folder of files and one record, numbered, that names it.

    The record is created only if its number is free, so of two writers that read the same state one fails (``Conflict``),
    and a writer that stops in between leaves files that no record names, or an empty record, which commits nothing. A
    snapshot's record makes readers pass over all commits before it; the files of those stay until ``vacuum``, so that
    readers of an older state are not cut off. A writer that works through numbered batches names itself and the batch in the
    commit's record; a batch that is there already is not written again.

    Claiming a number takes a file system that creates a file only if there is none: HDFS and local ones do. Object stores
    whose clients check first and put later don't; tables there need one writer at a time.
    """

    #: Milliseconds after which a record without content counts as given up by its writer.
    PATIENCE = 60_000

    #: Rows of a snapshot's file, about: what a lookup of one key reads at most, but for what was committed since.
    FILE_ROWS = 1_000_000
    #: Distinct values that a list of them may have to be passed to the scan (Spark's own threshold).
    LISTED = 10

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: list[str], lookups: tuple[str, ...] = ()):
        self.spark, self.path, self.schema, self.key, self.lookups = spark, path.rstrip("/"), schema, key, lookups

    def _read(self, name: str) -> str:
        fs, path = hadoop(self.spark, f"{self.path}/_log/{name}")
        stream = fs.open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _records(self) -> list[tuple[int, dict]]:
        """(number, record) from the last snapshot on; a record given up is {}."""
        fs, path = hadoop(self.spark, f"{self.path}/_log")
        if not fs.exists(path):
            return []
        status = {s.getPath().getName(): s for s in fs.listStatus(path)}
        first = self._read("snapshot") if "snapshot" in status else ""
        out = []
        for name in sorted(n for n in status if n.endswith(".json") and n >= first):
            text = self._read(name)
            if not text and status[name].getModificationTime() + self.PATIENCE > self.spark.sparkContext._jvm.java.lang.System.currentTimeMillis():
                raise Conflict(f"{self.path}: commit {name} is being written")
            record = json.loads(text) if text else {}
            out = [] if record.get("snapshot") else out
            out.append((int(name.split(".")[0]), record))
        return out

    def head(self) -> int:
        """The number of the last commit, 0 before the first."""
        return max((n for n, _ in self._records()), default=0)

    def log(self, upto: int | None = None) -> DataFrame:
        """All rows since the last snapshot, of commits up to one; a named folder that is gone is an error, never empty."""
        folders = [r["folder"] for n, r in self._records() if r and (upto is None or n <= upto)]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def latest(self) -> DataFrame:
        return latest(self.log(), self.key)

    def point(self, column: str, value: str, **others: str) -> DataFrame:
        """Latest rows that hold a value in a lookup column, and the others' values: few of a snapshot's rows are read.

        Snapshots are files by a hash of the key, each sorted by it, with bloom filters of the lookup columns, so a file that
        can't hold the value is passed over. By a column of the key, which never changes, that is one filter. Else versions
        that hold the value give the keys to look up, as a later version may hold another one.
        """
        log = self.log()
        if column in self.key:
            return self._of(latest(log.where(F.col(column) == value), self.key), others)
        had = log.where(F.col(column) == value)
        for c, v in others.items():
            had = had.where(F.col(c) == v) if c in self.key else had
        by = next((c for c in self.lookups if c in self.key), None)
        if by is not None:
            few = [r[0] for r in had.select(by).distinct().limit(self.LISTED + 1).collect()]
            near = log.where(F.col(by).isin(few)) if len(few) <= self.LISTED else log.join(had.select(by).distinct(), by, "left_semi")
        else:
            near = log.join(had.select(*self.key).distinct(), self.key, "left_semi")
        return self._of(latest(near, self.key).where(F.col(column) == value), others)

    @staticmethod
    def _of(rows: DataFrame, others: dict[str, str]) -> DataFrame:
        for c, v in others.items():
            rows = rows.where(F.col(c) == v)
        return rows

    def _clustered(self, rows: DataFrame) -> DataFrame:
        """By a hash of the key's lookup column into files of about ``FILE_ROWS`` rows, each sorted by it."""
        by = [c for c in self.lookups if c in self.key] or self.key
        return rows.repartition(max(1, -(-rows.count() // self.FILE_ROWS)), *by).sortWithinPartitions(*by)

    def batches(self) -> dict[str, int]:
        """The last batch that each writer of numbered batches has committed."""
        out: dict[str, int] = {}
        for _, record in self._records():
            for writer, batch in record.get("batches", {}).items():
                out[writer] = max(batch, out.get(writer, batch))
        return out

    def batch(self, writer: str, number: int) -> DataFrame | None:
        """The rows of a batch since the last snapshot, if it was committed."""
        folders = [r["folder"] for _, r in self._records() if not r.get("snapshot") and r.get("batches", {}).get(writer) == number]
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{folders[0]}") if folders else None

    def since(self, commit: int) -> DataFrame | None:
        """All rows of later commits; None if a snapshot has taken their place, so that what lay between can't be told."""
        records = self._records()
        if records and records[0][1].get("snapshot") and records[0][0] > commit:
            return None
        folders = [r["folder"] for n, r in records if r and n > commit]
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], self.schema)

    def commit(self, rows: DataFrame | list[dict], base: int | None = None, op: str | None = "U", snapshot: bool = False, batches: dict[str, int] | None = None) -> int:
        """Appends rows, in order, as the commit after ``base``, or after whatever is last; gives its number.

        Fields that the table doesn't have are refused. Missing ones are null. ``op`` None: every row says for itself whether
        it is a deletion. ``batches`` names a writer and its batch; one that is there already adds nothing and gives 0.
        """
        names = self.schema.names
        if isinstance(rows, list):
            if unknown := {n for r in rows for n in r} - set(names):
                raise ValueError(f"unknown fields: {', '.join(sorted(unknown))}")
        for _ in range(100):
            if batches and not snapshot and any(self.batches().get(w, -1) >= b for w, b in batches.items()):
                return 0
            n = (self.head() if base is None else base) + 1
            folder = f"c{n:012d}-{uuid.uuid4().hex}"
            if isinstance(rows, list):
                made = [tuple((r | {"version": n * 1_000_000 + i, "op": r.get("op") or op or "U"}).get(c) for c in names) for i, r in enumerate(rows)]
                frame = self.spark.createDataFrame(made, self.schema).coalesce(1)
            else:
                extra = {} if snapshot else {"version": F.lit(n * 1_000_000).cast("bigint")} | ({"op": F.lit(op)} if op else {})
                frame = rows.withColumns(extra)
                frame = frame.select(*[(F.col(c) if c in frame.columns else F.lit(None)).cast(self.schema[c].dataType).alias(c) for c in names])
            blooms = {f"parquet.bloom.filter.enabled#{c}": "true" for c in self.lookups} | {f"parquet.bloom.filter.expected.ndv#{c}": str(self.FILE_ROWS) for c in self.lookups}
            frame.write.options(**(blooms if snapshot else {})).parquet(f"{self.path}/{folder}")
            if self._record(n, folder, snapshot, batches or {}):
                return n
            fs, path = hadoop(self.spark, f"{self.path}/{folder}")
            fs.delete(path, True)
            if base is not None:
                break
        raise Conflict(f"{self.path} changed after commit {base}")

    def _record(self, n: int, folder: str, snapshot: bool, batches: dict[str, int]) -> bool:
        """Claims a number, if it is free, for a folder."""
        fs, path = hadoop(self.spark, f"{self.path}/_log/{n:012d}.json")
        try:
            stream = fs.create(path, False)
        except Py4JJavaError as error:
            if "FileAlreadyExists" in str(error.java_exception):
                return False
            raise
        stream.write(json.dumps({"folder": folder, "snapshot": snapshot} | ({"batches": batches} if batches else {})).encode())
        stream.close()
        if snapshot:  # tells readers where to start; without it they find the snapshot among all records
            stream = fs.create(hadoop(self.spark, f"{self.path}/_log/snapshot")[1], True)
            stream.write(f"{n:012d}.json".encode())
            stream.close()
        return True

    def compact(self, keep: Column | None = None) -> int:
        """Rewrites the table as the last version of each key, and, with ``keep``, only such tombstones as it holds for.

        Readers see the old commits or the snapshot, whenever the writer stops.
        """
        base = self.head()
        rows = last_versions(self.log(base), self.key)
        rows = rows.where((F.col("op") != "D") | (keep if keep is not None else F.lit(False)))
        if base and self.lookups:
            rows = self._clustered(kept(rows, "snapshot"))  # counted, then written
        return self.commit(rows, base, snapshot=True, batches=self.batches()) if base else 0

    def vacuum(self) -> int:
        """Deletes folders that no record since the last snapshot names; gives how many."""
        named = {r.get("folder") for _, r in self._records()}
        fs, path = hadoop(self.spark, self.path)
        if not fs.exists(path):
            return 0
        old = [s.getPath() for s in fs.listStatus(path) if s.getPath().getName().startswith("c") and s.getPath().getName() not in named]
        for p in old:
            fs.delete(p, True)
        return len(old)


def last_versions(log: DataFrame, key: list[str], version: str = "version") -> DataFrame:
    """The last version of each key, deletions too, by a maximum that combines before the shuffle."""
    rest = [c for c in log.columns if c not in key]
    return log.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(version)).alias("_last")).select(*key, "_last.*")


def latest(log: DataFrame, key: list[str], version: str = "version", op: str = "op") -> DataFrame:
    """The last version of each key that isn't a deletion."""
    return last_versions(log, key, version).where(F.col(op) != "D")


def updated(old: Column, new: Column, clear: bool = False, replace: bool = False) -> Column:
    """A partial update of one field: cleared, replaced even by null, or kept where nothing new is given."""
    if clear and replace:
        raise ValueError("a field is cleared or replaced, not both")
    return F.lit(None) if clear else new if replace else F.coalesce(new, old)


def set_status(tasks: DataFrame, status: str, expected: str | None = None, now: Column | None = None) -> DataFrame:
    """Tasks that may take the status now, with it; ``expected`` guards against changes meanwhile.

    With ``now``, ``started_at`` is set once work starts and ``completed_at`` once it is done; an open task has neither a
    completion nor a reason to be blocked.
    """
    allowed = [s for s, to in TRANSITIONS.items() if status in to]
    guarded = tasks.where(F.col("status").isin(allowed))
    if expected is not None:
        guarded = guarded.where(F.col("status") == expected)
    if now is not None:
        started, completed = F.col("started_at"), F.col("completed_at")
        guarded = guarded.withColumns({
            "started_at": F.coalesce(started, now) if status != "open" else started,
            "completed_at": F.coalesce(completed, now) if status in ("done", "closed") else F.lit(None).cast(tasks.schema["completed_at"].dataType),
        })
    return guarded.withColumn("status", F.lit(status))


def check_transition(tasks: DataFrame, status: Column | str) -> DataFrame:
    """``verdict``: whether each task may take the status, a literal or a column."""
    pairs = [(a, b) for a, to in TRANSITIONS.items() for b in to]
    wanted = F.lit(status) if isinstance(status, str) else status
    fits = F.concat_ws(">", F.col("status"), wanted).isin([f"{a}>{b}" for a, b in pairs])
    return tasks.withColumn("verdict", F.when(fits, "allowed").otherwise("refused"))


def after_mark(rows: DataFrame, columns: list[str], mark: list) -> DataFrame:
    """Rows strictly after a high-water mark of several columns, so equal first columns aren't lost."""
    return rows.where(F.struct(*columns) > F.struct(*[F.lit(m).cast(rows.schema[c].dataType).alias(c) for c, m in zip(columns, mark, strict=True)]))


def changes(now: DataFrame, before: DataFrame, key: str, *values: str) -> DataFrame:
    """Rows of ``now`` as new, changed or same against ``before``: same if all values are."""
    old = before.select(F.col(key), *[F.col(v).alias(f"_old_{v}") for v in values], F.lit(True).alias("_known"))
    same = F.lit(True)
    for v in values:
        same = same & F.col(f"_old_{v}").eqNullSafe(F.col(v))
    state = F.when(F.col("_known").isNull(), "new").when(same, "same").otherwise("changed")
    return now.join(old, key, "left").withColumn("change", state).drop("_known", *[f"_old_{v}" for v in values])


def unseen(before: DataFrame, now: DataFrame, key: str) -> DataFrame:
    """Rows of ``before`` that are gone."""
    return before.join(now.select(key), key, "left_anti")
