"""The public operations over versioned tables: notes, tasks, history, files, links, search, memory, upkeep."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import UTC, datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import metadata, migrations
from .functions.ids import uuid7
from .functions.scores import cosine, relevance
from .functions.text import count_tokens, cut_to_tokens, normalized, query_phrases, redact
from .operators import calls, chunking, graph, index, memory, rank
from .plans.search import KINDS, MOST, TYPES, SearchQuery, entity_hits, split_budget, unified_page
from .providers import Egress, EmbeddingProvider, ExtractionProvider, RerankProvider, embed_all, rerank_scores
from .sources import files, store
from .sources.store import Conflict, VersionedTable

# Kinds of links.
RELATIONS = (
    "references",
    "blocks",
    "duplicates",
    "implements",
    "related",
    "caused_by",
    "derived_from",
)


def _schema(text: str = "", **others: T.DataType) -> T.StructType:
    return T.StructType([*[T.StructField(n, T.StringType()) for n in f"op {text}".split()], T.StructField("version", T.LongType()), *[T.StructField(n, t) for n, t in others.items()]])


_STRINGS, _LONG, _INT, _DOUBLE, _BOOLEAN = T.ArrayType(T.StringType()), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()
SCHEMAS = {
    "documents": _schema("id project kind title body status external_key parent_id blocked_by_id blocked_reason source source_ref metatags task_kind due_at started_at completed_at entry_type actor correlation_id path root_path language content_hash mtime created_at updated_at", priority=_INT, pinned=_BOOLEAN, file_size=_LONG),
    "chunks": _schema("document_id project kind title chunk_id chunk_text", chunk_index=_INT, token_count=_INT, start_line=_INT, end_line=_INT),
    "queue": _schema("document_id project kind state error indexed_at stale_since"),
    "embeddings": _schema("chunk_id document_id project model", vector=T.ArrayType(T.DoubleType())),
    "links": _schema("project source_id target_id kind created_at"),
    "facts": _schema("id project scope chat fact_type content status valid_from valid_until supersedes_id updated_at", confidence=_DOUBLE, evidence=_STRINGS),
    "scenarios": _schema("id project scope title summary status", fact_ids=_STRINGS, evidence=_STRINGS),
    "checkpoints": _schema("project chat status last_error mark mark_id", processed=_LONG),
    "triggers": _schema("project pending_since last_run", pending=_LONG),
    "events": _schema("id entity_type entity_id event_type payload created_at"),
    "settings": _schema("scope name value"),
    "migrations": _schema("name checksum applied_at", number=_INT),
}
KEYS = {
    "documents": ["project", "id"], "chunks": ["project", "document_id", "chunk_index"], "queue": ["project", "document_id"], "embeddings": ["chunk_id", "model"],
    "links": ["project", "source_id", "target_id", "kind"], "facts": ["project", "id"], "scenarios": ["project", "id"], "checkpoints": ["project", "chat"],
    "triggers": ["project"], "events": ["id"], "settings": ["scope", "name"], "migrations": ["number"],
}
#: Columns that single rows are looked up by.
LOOKUPS = {"documents": ("id", "external_key", "path"), "chunks": ("document_id",), "facts": ("id",)}
#: What callers may set on a document of each kind.
FIELDS = {
    "note": {"title", "body", "source", "source_ref", "pinned", "metatags"},
    "task": {"title", "body", "source", "source_ref", "external_key", "metatags", "task_kind", "priority", "due_at", "parent_id", "blocked_by_id"},
    "history": {"entry_type", "body", "actor", "correlation_id", "metatags", "source"},
    "file": set(),
}
#: History entries that one extraction takes up.
EXTRACTED = 20
COMPACT = ["id", "project", "kind", "title", "status", "path", "language", "pinned", "priority", "updated_at"]


class EngineError(Exception):
    """An operation refused; ``code`` says why: invalid, not_found, conflict, denied, provider."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


def now_iso() -> str:
    return datetime.now(UTC).isoformat(timespec="microseconds")


class Engine:
    """Every change appends a version; reads take the latest. A change that rests on what was read fails if another came first."""

    def __init__(self, spark: SparkSession, root: str, *, embedder: EmbeddingProvider | None = None, embedding_model: str = "", reranker: RerankProvider | None = None, extractor: ExtractionProvider | None = None, extraction_model: str = "", egress: Egress | None = None, schemas: dict[str, dict] | None = None, chunk_size: int = 400, chunk_overlap: int = 50, ignore: tuple[str, ...] = (), max_facts: int = 20, batch: int = 10, interval_seconds: int = 60, drain_on_write: bool = False):
        self.spark, self.root = spark, root.rstrip("/")
        self.tables = {n: VersionedTable(spark, f"{self.root}/{n}", s, KEYS[n], LOOKUPS.get(n, ())) for n, s in SCHEMAS.items()}
        self.embedder, self.embedding_model, self.reranker = embedder, embedding_model, reranker
        self.extractor, self.extraction_model, self.egress = extractor, extraction_model, egress or Egress()
        self.schemas, self.chunk_size, self.chunk_overlap, self.ignore = schemas or {}, chunk_size, chunk_overlap, list(ignore)
        self.max_facts, self.batch, self.interval_seconds, self.drain_on_write = max_facts, batch, interval_seconds, drain_on_write
        self._indexes: dict[str, tuple[int, index.Index]] = {}
        self._segments = {n: index.Segments(spark, f"{self.root}/indexes/{n}") for n in ("entries", "files", "facts", "scenarios")}

    # Tables.

    def latest(self, table: str) -> DataFrame:
        return self.tables[table].latest()

    def head(self, table: str) -> int:
        return self.tables[table].head()

    def commit(self, table: str, rows: list[dict] | DataFrame, base: int | None = None, op: str | None = "U", batches: dict[str, int] | None = None) -> None:
        if isinstance(rows, list) and not rows:
            return
        try:
            self.tables[table].commit(rows, base, op, batches=batches)
        except Conflict as error:
            raise EngineError("conflict", str(error)) from None
        except ValueError as error:
            raise EngineError("invalid", str(error)) from None

    def record(self, entity_type: str, entity_id: str, event_type: str, payload: dict) -> None:
        """An audit event."""
        self.commit("events", [{"id": uuid7(), "entity_type": entity_type, "entity_id": entity_id, "event_type": event_type, "payload": json.dumps(payload, sort_keys=True), "created_at": now_iso()}])

    # Documents of every kind.

    def documents(self, kind: str | None = None, project: str | None = None) -> DataFrame:
        rows = self.latest("documents")
        rows = rows.where(F.col("kind") == kind) if kind else rows
        return rows.where(F.col("project") == project) if project else rows

    def _checked(self, kind: str, fields: dict) -> dict:
        if unknown := set(fields) - FIELDS[kind]:
            raise EngineError("invalid", f"a {kind} has no {', '.join(sorted(unknown))}")
        if isinstance(fields.get("metatags"), dict):
            try:
                metadata.validate(fields["metatags"], **self.schemas.get(kind, {"fields": {}}))
            except ValueError as error:
                raise EngineError("invalid", str(error)) from None
            fields = fields | {"metatags": json.dumps(fields["metatags"], sort_keys=True)}
        return fields

    def add(self, kind: str, project: str, title: str, body: str | None = None, **fields) -> str:
        """A note or a task. A task without a body has its title as body."""
        if kind not in ("note", "task") or not title.strip() or not project.strip():
            raise EngineError("invalid", "a note or a task needs a project and a title")
        fields = self._checked(kind, fields)
        at, base = now_iso(), self.head("documents")
        row = {"id": uuid7(), "project": project, "kind": kind, "title": title, "body": title if body is None and kind == "task" else body, "created_at": at, "updated_at": at} | fields
        if kind == "task":
            row |= {"status": "open"}
            if row.get("external_key") and self.get_by_external_key(row["external_key"], project):
                raise EngineError("conflict", f"the key {row['external_key']} is taken")
            self._check_relations(row)
        self.commit("documents", [row], base if kind == "task" else None)
        self._derive([row])
        return row["id"]

    def append_history(self, project: str, entry_type: str, payload: str, actor: str = "user", **fields) -> str:
        """A history entry; its project's extraction runs once enough entries or time have come together."""
        if not entry_type.strip() or not payload.strip():
            raise EngineError("invalid", "an entry needs a type and a payload")
        at = now_iso()
        row = {"id": uuid7(), "project": project, "kind": "history", "title": entry_type, "entry_type": entry_type, "body": payload, "actor": actor, "created_at": at, "updated_at": at} | self._checked("history", fields)
        row["source_ref"] = row.get("correlation_id")
        self.commit("documents", [row])
        self._derive([row])
        self._pend(project)
        return row["id"]

    def append_history_rows(self, rows: DataFrame, batches: dict[str, int] | None = None) -> None:
        """Many entries at once: (project, entry_type, payload, actor), as one commit. Nothing is counted towards a trigger.

        ``batches`` names the writer and its batch, which are kept with the rows: a batch that comes again adds no rows, but
        what its rows still lack (chunks, queue) is derived from the rows that the first run has committed.
        """
        documents, at = self.tables["documents"], now_iso()
        ((writer, number),) = (batches or {None: None}).items()
        if writer is None or documents.batches().get(writer, -1) < number:
            made = rows.where("trim(payload) <> ''").select(
                F.expr("uuid()").alias("id"), "project", F.lit("history").alias("kind"), F.col("entry_type").alias("title"), "entry_type", F.col("payload").alias("body"),
                "actor", F.lit(at).alias("created_at"), F.lit(at).alias("updated_at"),
            )
            made = store_kept(made)  # ids are drawn once
            if made.isEmpty():
                return
            self.commit("documents", made, batches=batches)
        if writer is not None:
            made = documents.batch(writer, number)
        if made is not None:
            self._write_chunks(made.select("id", "project", "kind", "title", "body"), batches)

    def _derive(self, rows: list[dict]) -> None:
        """Chunks and queue rows of documents just written; both can be rebuilt from the documents."""
        frame = self.spark.createDataFrame([(r["id"], r["project"], r["kind"], r.get("title"), r.get("body")) for r in rows], "id string, project string, kind string, title string, body string")
        self._write_chunks(frame)
        if self.drain_on_write:
            for project in sorted({r["project"] for r in rows}):
                self.drain(project, 1, 0.1)

    def _write_chunks(self, documents: DataFrame, batches: dict[str, int] | None = None) -> None:
        """(id, project, kind, title, body) as chunks: notes and history their stripped body, tasks title and body."""
        body = F.when(F.col("kind") == "task", F.concat_ws("\n", "title", "body")).otherwise(F.col("body"))
        rows = chunking.body_chunks(documents, "id", body).join(documents.select("id", "project", "kind", "title"), "id")
        rows = rows.withColumnRenamed("id", "document_id").withColumn("chunk_id", F.concat_ws("#", "document_id", "chunk_index"))
        self._replace_chunks(rows, documents.select(F.col("id").alias("document_id"), "project", "kind"), batches)

    def _replace_chunks(self, chunks: DataFrame, documents: DataFrame, batches: dict[str, int] | None = None) -> None:
        """New chunks of the documents; what they had before goes with the same commit, embeddings are asked for anew."""
        base = self.head("chunks")
        old = self.latest("chunks").join(documents.select("document_id", "project"), ["document_id", "project"], "left_semi")
        gone = old.join(chunks.select("document_id", "chunk_index"), ["document_id", "chunk_index"], "left_anti").withColumn("op", F.lit("D"))
        fresh = chunks.withColumn("op", F.lit("U")).unionByName(gone, allowMissingColumns=True)
        if not fresh.isEmpty():
            self.commit("chunks", fresh.drop("version"), base, op=None, batches=batches)
        queued = documents.where(F.col("kind") != "task").withColumns({"state": F.lit("pending"), "indexed_at": F.lit(now_iso())})
        if not queued.isEmpty():
            self.commit("queue", queued, batches=batches)

    def get(self, key: str, project: str) -> dict:
        rows = self.tables["documents"].point("id", key, project=project).limit(1).collect()
        if not rows:
            raise EngineError("not_found", f"no document {key} in {project}")
        row = rows[0].asDict(recursive=True)
        return row | {"metatags": metadata.parsed(row["metatags"])}

    def _row(self, key: str, project: str) -> dict:
        row = self.get(key, project)
        return row | {"metatags": json.dumps(row["metatags"], sort_keys=True) if row["metatags"] else None}

    def get_by_external_key(self, external_key: str, project: str) -> dict | None:
        rows = self.tables["documents"].point("external_key", external_key, project=project, kind="task").limit(1).collect()
        return rows[0].asDict(recursive=True) if rows else None

    def get_file(self, path: str, project: str) -> dict:
        rows = self.tables["documents"].point("path", path, project=project, kind="file").limit(1).collect()
        if not rows:
            raise EngineError("not_found", f"no file {path} in {project}")
        return rows[0].asDict(recursive=True)

    def update(self, key: str, project: str, clear: tuple[str, ...] = (), **changes) -> None:
        """Fields given change, fields in ``clear`` become null, the rest stay. Chunks change only with the text."""
        if set(clear) & changes.keys():
            raise EngineError("invalid", "a field is changed or cleared, not both")
        base = self.head("documents")
        old = self._row(key, project)
        if old["kind"] == "file":
            raise EngineError("invalid", "files change by indexing")
        given = self._checked(old["kind"], {k: v for k, v in changes.items() if v is not None} | dict.fromkeys(clear))
        if any(k in given and not (given[k] or "").strip() for k in ("title", "entry_type")):
            raise EngineError("invalid", "a title must not be empty")
        row = old | given | {"updated_at": now_iso()}
        row["title"] = row["entry_type"] if row["kind"] == "history" else row["title"]
        if row["kind"] == "task":
            self._check_relations(row)
        self.commit("documents", [row], base)
        if (row["title"], row["body"]) != (old["title"], old["body"]):
            self._derive([row])

    def delete(self, key: str, project: str) -> None:
        """A tombstone; chunks and queue rows go, and facts that rest on the document or its chunks are deleted with it."""
        base = self.head("documents")
        row = self._row(key, project)
        self.commit("documents", [row | {"updated_at": now_iso(), "op": "D"}], base, "D")
        own = self.latest("chunks").where((F.col("document_id") == key) & (F.col("project") == project))
        gone = store_kept(own.select("chunk_id"))
        if not gone.isEmpty():
            self.commit("chunks", own.drop("version", "op"), op="D")
        held = self.latest("embeddings").where((F.col("document_id") == key) & (F.col("project") == project))
        if not held.isEmpty():
            self.commit("embeddings", held.drop("version", "op"), op="D")
        self.commit("queue", [{"document_id": key, "project": project, "kind": row["kind"], "op": "D"}], op="D")
        self.invalidate_all(gone.toDF("id").union(self.spark.createDataFrame([(key,)], "id string")))

    def list(self, kind: str, project: str, limit: int = 20, cursor: str | None = None, view: str = "compact", root: str | None = None, language: str | None = None, path_prefix: str | None = None) -> tuple[list[dict], str | None]:
        """A page and the cursor of the next one: newest first, files in order of their id. Full rows carry their links."""
        if not 1 <= limit <= MOST or view not in ("compact", "full"):
            raise EngineError("invalid", "limit is 1 to 100, view compact or full")
        try:
            after = rank.decode_cursor(cursor)["id"] if cursor else None
        except (ValueError, KeyError, TypeError):
            raise EngineError("invalid", "malformed cursor") from None
        rows = self._files_where(self.documents(kind, project), root, language, path_prefix) if kind == "file" else self.documents(kind, project)
        got = [r.asDict(recursive=True) for r in rank.page_after(rows if view == "full" else rows.select(*COMPACT), "id", after, limit, newest_first=kind != "file").collect()]
        page, more = got[:limit], len(got) > limit
        if view == "full" and page:
            known = {r.id: [x.asDict() for x in r.links] for r in graph.summaries(self._edges(project)).where(F.col("id").isin([r["id"] for r in page])).collect()}
            page = [r | {"links": known.get(r["id"], []), "metatags": metadata.parsed(r["metatags"])} for r in page]
        return page, rank.encode_cursor({"id": page[-1]["id"]}) if more else None

    @staticmethod
    def _files_where(rows: DataFrame, root: str | None, language: str | None, path_prefix: str | None) -> DataFrame:
        rows = rows.where(F.col("root_path") == root.rstrip("/")) if root else rows
        rows = rows.where(F.col("language") == language.strip().lower()) if language else rows
        return rows.where(F.col("path").startswith(path_prefix)) if path_prefix else rows

    # Tasks.

    def _check_relations(self, row: dict) -> None:
        for column in ("parent_id", "blocked_by_id"):
            other = row.get(column)
            if other is None:
                continue
            if other == row["id"] or self.get(other, row["project"])["kind"] != "task":
                raise EngineError("invalid", f"{column} must be another task of the project")
            tasks = self.documents("task", row["project"]).where(F.col(column).isNotNull() & (F.col("id") != row["id"]))
            if graph.would_close(tasks.select(F.col("id").alias("s"), F.col(column).alias("t")), row["id"], other):
                raise EngineError("conflict", f"{column} would close a cycle")

    def relate_tasks(self, project: str, column: str, wanted: DataFrame) -> DataFrame:
        """Sets ``parent_id`` or ``blocked_by_id`` of many tasks at once, as (id, other); gives those refused, with a reason.

        Refused are: several others for one task (ambiguous), the task itself (self), ends that are no live task of the
        project (no_source, no_target), and links that would lie on a cycle if all the rest were set (cycle). What remains
        closes none, and is one commit.
        """
        if column not in ("parent_id", "blocked_by_id"):
            raise EngineError("invalid", "tasks are related by parent_id or blocked_by_id")
        base, tasks = self.head("documents"), store_kept(self.documents("task", project))
        asked = wanted.select("id", "other").distinct()
        several = asked.groupBy("id").agg(F.count(F.lit(1)).alias("_others"))
        known = tasks.select("id", F.lit(True).alias("_task"))
        asked = asked.join(several, "id").join(known, "id", "left").join(known.select(F.col("id").alias("other"), F.col("_task").alias("_other")), "other", "left")
        reason = F.when(F.col("_others") > 1, "ambiguous").when(F.col("_task").isNull(), "no_source").when(F.col("_other").isNull(), "no_target").when(F.col("id") == F.col("other"), "self")
        asked = store_kept(asked.select("id", "other", reason.alias("reason")))
        links = tasks.where(F.col(column).isNotNull()).select(F.col("id").alias("s"), F.col(column).alias("t"))
        links = links.join(asked.where("reason IS NULL").select(F.col("id").alias("s")), "s", "left_anti")
        judged = store_kept(graph.closing(links, asked.where("reason IS NULL").select(F.col("id").alias("s"), F.col("other").alias("t"))))
        good = judged.where("NOT closes").select(F.col("s").alias("id"), F.col("t").alias("_new"))
        fresh = tasks.join(good, "id").withColumns({column: F.col("_new"), "updated_at": F.lit(now_iso())}).drop("_new", "version", "op")
        if not fresh.isEmpty():
            self.commit("documents", fresh, base)
        return asked.where("reason IS NOT NULL").unionByName(judged.where("closes").select(F.col("s").alias("id"), F.col("t").alias("other"), F.lit("cycle").alias("reason")))

    def set_status(self, key: str, project: str, status: str, expected: str | None = None, blocked_reason: str | None = None) -> None:
        base = self.head("documents")
        row = self._row(key, project)
        if expected is not None and row["status"] != expected or status not in store.TRANSITIONS.get(row["status"], ()):
            raise EngineError("conflict", f"{row['status']} can't become {status}")
        if (status == "blocked") != bool((blocked_reason or "").strip()):
            raise EngineError("invalid", "a blocked task has a reason, others have none")
        at = now_iso()
        started = row["started_at"] if status == "open" else row["started_at"] or at
        completed = row["completed_at"] or at if status in ("done", "closed") else None
        self.commit("documents", [row | {"status": status, "blocked_reason": blocked_reason, "started_at": started, "completed_at": completed, "updated_at": at}], base)

    def done(self, key: str, project: str) -> None:
        self.set_status(key, project, "done")

    def upsert_task(self, project: str, external_key: str, title: str, **fields) -> str:
        """The same key, the same task: created once, then set to the full state given, its life untouched."""
        for _ in range(3):
            base = self.head("documents")
            row = self.get_by_external_key(external_key, project)
            try:
                if row is None:
                    return self.add("task", project, title, external_key=external_key, **fields)
                state = dict.fromkeys(FIELDS["task"]) | {"title": title, "body": fields.get("body") or title, "external_key": external_key} | self._checked("task", fields)
                fresh = row | state | {"updated_at": now_iso()}
                self._check_relations(fresh)
                self.commit("documents", [fresh], base)
                self._derive([fresh])
                return row["id"]
            except EngineError as error:
                if error.code != "conflict" or "cycle" in str(error):
                    raise
        raise EngineError("conflict", f"the key {external_key} keeps changing")

    # Files.

    def index_files(self, root: str, project: str, force: bool = False) -> dict[str, int]:
        """Brings a tree's files up to date: new and changed ones are chunked, those not seen any more are deleted.

        A file is unchanged if hash, size and time are; how many were is in the run's audit event. Ignored and unreadable files count as not seen. Files' own rows are
        committed last, all at once: a run that stops before leaves them as they were, so the next one does it all again.
        """
        seen = files.scan(self.spark, root, self.ignore)
        seen = store_kept(seen)
        base = self.head("documents")
        old = self.documents("file", project).where(F.col("root_path") == root.rstrip("/"))
        state = store_kept(store.changes(seen, old, "path", "content_hash", "file_size", "mtime"))
        known = old.select("path", F.col("id").alias("_id"), F.col("created_at").alias("_at"))
        wanted = (state if force else state.where("change <> 'same'")).join(known, "path", "left")
        at, new_id = now_iso(), F.sha2(F.concat_ws("\0", F.lit(project), "path"), 256)
        rows = wanted.select(
            F.coalesce("_id", new_id).alias("id"), F.lit(project).alias("project"), F.lit("file").alias("kind"), F.element_at(F.split("path", "/"), -1).alias("title"), "path", "root_path",
            "language", "file_size", "mtime", "content_hash", F.coalesce("_at", F.lit(at)).alias("created_at"), F.lit(at).alias("updated_at"), "text",
        )
        rows = store_kept(rows)
        gone = store_kept(store.unseen(old, seen, "path").drop("version", "op"))
        counts = {"indexed": rows.count(), "deleted": gone.count()}
        if counts["deleted"]:
            lost = store_kept(self.latest("chunks").where(F.col("project") == project).join(gone.select(F.col("id").alias("document_id")), "document_id", "left_semi"))
            self.invalidate_all(gone.select("id").union(lost.select("chunk_id")))
            held = self.latest("embeddings").join(lost.select("chunk_id"), "chunk_id", "left_semi")
            for table, dropped in (("chunks", lost), ("embeddings", held), ("queue", gone.select(F.col("id").alias("document_id"), "project", "kind"))):
                if not dropped.isEmpty():
                    self.commit(table, dropped.drop("version", "op"), op="D")
        if counts["indexed"]:
            made = chunking.chunk_files(rows.withColumnRenamed("id", "document_id"), self.chunk_size, self.chunk_overlap, "document_id")
            made = made.join(rows.select(F.col("id").alias("document_id"), F.col("path").alias("title")), "document_id")
            made = made.withColumns({"project": F.lit(project), "kind": F.lit("file"), "chunk_id": F.concat_ws("#", "document_id", "chunk_index")})
            self._replace_chunks(store_kept(made), rows.select(F.col("id").alias("document_id"), "project", "kind"))
        if sum(counts.values()):
            self.commit("documents", rows.drop("text").withColumn("op", F.lit("U")).unionByName(gone.withColumn("op", F.lit("D")), allowMissingColumns=True), base, op=None)
        skipped = 0 if force else state.where("change = 'same'").count()
        self.record("file_index", project, "files_indexed", counts | {"root": root, "skipped": skipped})
        return counts | {"count": sum(counts.values())}

    def reindex_files(self, root: str, project: str) -> dict[str, int]:
        """Everything anew, embeddings too."""
        got = self.index_files(root, project, force=True)
        self.drain(project, None)
        return got

    def file_roots(self, project: str) -> list[str]:
        return [r.root_path for r in self.documents("file", project).select("root_path").distinct().orderBy("root_path").collect()]

    def invalidate_all(self, evidence: DataFrame) -> None:
        """Deletes facts that rest on any of a table of ids (id)."""
        live = self.latest("facts").where(~F.col("status").isin("deleted"))
        hit = live.select("project", "id", F.explode("evidence").alias("e")).join(evidence.toDF("e").distinct(), "e", "left_semi").select("project", "id").distinct()
        lost = live.join(hit, ["project", "id"], "left_semi")
        if not lost.isEmpty():
            self.commit("facts", lost.withColumn("status", F.lit("deleted")).drop("version", "op"))

    # Embeddings.

    def pending(self, project: str, limit: int = 8) -> list[str]:
        """Documents whose chunks wait for embeddings, those that wait longest first."""
        rows = self.latest("queue").where((F.col("project") == project) & F.col("state").isin("pending", "stale"))
        return [r.document_id for r in rows.orderBy(F.coalesce("stale_since", "indexed_at"), "document_id").limit(limit).collect()]

    def drain(self, project: str, limit: int | None = 8, seconds: float | None = None) -> int:
        """Embeds waiting documents, by calls from executors (``calls.embed``); gives how many are done.

        Those that fail are marked and wait until they are written again; what ``seconds`` (of a task) leave out stays
        pending. Vectors are committed before the states, each in one commit: a run that stops between asks again. A document
        written again meanwhile stays pending. ``limit`` None takes all.
        """
        if self.embedder is None or not self.egress.permits([project]):
            return 0
        queue = self.latest("queue").where((F.col("project") == project) & F.col("state").isin("pending", "stale"))
        queue = queue.select("project", "document_id", "kind", F.coalesce("stale_since", "indexed_at").alias("since"), F.col("version").alias("seen"))
        waiting = store_kept(queue if limit is None else queue.orderBy("since", "document_id").limit(limit))
        if waiting.isEmpty():
            return 0
        texts = self.latest("chunks").where(F.col("project") == project).select("project", "document_id", "chunk_index", "chunk_id", "chunk_text")
        texts = texts.join(waiting.select("project", "document_id", "since"), ["project", "document_id"])
        audit = {"model": self.embedding_model, "projects": [project]}
        self.record("provider", project, "embeddings", audit | {"outcome": "attempt"})
        asked = store_kept(calls.embed(texts, self.embedder, self.embedding_model, ["project", "since", "document_id", "chunk_index"], seconds))
        for r in asked.where("outcome <> 'left'").groupBy("outcome", "error").agg(F.count(F.lit(1)).alias("items"), F.count_distinct("call").alias("calls")).collect():
            self.record("provider", project, "embeddings", audit | {"outcome": "completed" if r.outcome == "embedded" else "error", "error": r.error, "items": r["items"], "calls": r.calls})
        ended = waiting.join(calls.states(asked), ["project", "document_id"], "left").withColumn("state", F.coalesce("state", F.lit("ready"))).where("state <> 'pending'")
        ended = store_kept(ended.select("project", "document_id", "kind", "state", "error", "seen", F.lit(now_iso()).alias("indexed_at")))
        vectors = asked.join(self._unchanged(ended.where("state = 'ready'")), ["project", "document_id"], "left_semi")
        if not vectors.isEmpty():
            self.commit("embeddings", vectors.select("chunk_id", "document_id", "project", "vector", F.lit(self.embedding_model).alias("model")))
        self._guarded("queue", lambda: self._unchanged(ended))
        return ended.count()

    def _unchanged(self, ended: DataFrame) -> DataFrame:
        """Queue rows that nobody has written since they were ``seen``."""
        now = self.latest("queue").select("project", "document_id", F.col("version").alias("seen"))
        return ended.join(now, ["project", "document_id", "seen"], "left_semi").drop("seen")

    def _guarded(self, table: str, rows: Callable[[], DataFrame]) -> int:
        """Commits rows that rest on the table's state, made anew whenever another writer came first; gives how many."""
        for _ in range(10):
            base, made = self.head(table), store_kept(rows())
            if made.isEmpty():
                return 0
            try:
                self.commit(table, made, base)
                return made.count()
            except EngineError as error:
                if error.code != "conflict":
                    raise
        raise EngineError("conflict", f"{table} keeps changing")

    def mark_stale(self, project: str) -> int:
        """Documents that are ready but hold a chunk without a vector of the engine's model wait again, as stale; how many."""
        held = self.latest("embeddings").where((F.col("project") == project) & (F.col("model") == self.embedding_model)).select("chunk_id")
        lacking = self.latest("chunks").where((F.col("project") == project) & (F.col("kind") != "task")).join(held, "chunk_id", "left_anti").select("document_id").distinct()
        at = now_iso()
        ready = lambda: self.latest("queue").where((F.col("project") == project) & (F.col("state") == "ready")).join(lacking, "document_id", "left_semi")
        return self._guarded("queue", lambda: ready().withColumns({"state": F.lit("stale"), "stale_since": F.lit(at)}).drop("version", "op"))

    # Search.

    def _corpus(self, name: str) -> index.Index:
        """The index of notes, tasks and history together, of files, facts or scenarios, brought up to what is committed.

        Only rows of commits since the last time are read, and become a segment. After a snapshot, which hides what was
        deleted before it, the index begins anew.
        """
        source = name if name in ("facts", "scenarios") else "chunks"
        head, table, held = self.head(source), self.tables[source], self._segments[name]
        for _ in range(3):
            if self._indexes.get(name, (-1,))[0] == head:
                break
            try:
                done = held.followed()
                if done < head:
                    fresh = table.since(done)
                    if fresh is None:
                        held.reset()
                        fresh = table.log()
                    self._follow(name, store_kept(store.last_versions(fresh, KEYS[source])), done, head)
                self._indexes[name] = (head, held.index())
            except Conflict:  # another engine has indexed meanwhile
                continue
        return self._indexes[name][1]

    def _follow(self, name: str, changed: DataFrame, done: int, head: int) -> None:
        if name == "facts":
            key, body = "id", F.col("content")
        elif name == "scenarios":
            key, body = "id", F.concat_ws("\n", "title", "summary")
        else:
            changed = changed.where(F.col("kind") == "file" if name == "files" else F.col("kind") != "file")
            key, body = "chunk_id", F.when(F.col("kind") == "history", F.col("chunk_text")).otherwise(F.concat_ws("\n", "title", "chunk_text"))
        self._segments[name].add(changed.where("op <> 'D'"), key, body, changed.select(key) if done else None, head)

    def _chunks(self) -> DataFrame:
        """Chunks with what search shows of their documents."""
        d = self.latest("documents")
        shown = F.when(F.col("kind") == "note", F.to_json(F.struct("pinned"), {"ignoreNullFields": "false"})).when(F.col("kind") == "task", F.to_json(F.struct("status", "priority"), {"ignoreNullFields": "false"}))
        shown = shown.when(F.col("kind") == "history", F.to_json(F.struct("entry_type", "actor", "correlation_id"), {"ignoreNullFields": "false"})).otherwise(F.to_json(F.struct("path", "root_path", "language", "file_size"), {"ignoreNullFields": "false"}))
        title = F.when(F.col("kind") == "history", F.concat_ws(" · ", "entry_type", "actor")).when(F.col("kind") == "file", F.col("path")).otherwise(F.col("title"))
        d = d.select(F.col("id").alias("document_id"), "project", title.alias("title"), shown.alias("attributes"), "created_at", "root_path", "language", "path")
        return self.latest("chunks").select("document_id", "project", "kind", "chunk_id", F.col("chunk_text").alias("body"), "token_count").join(d, ["document_id", "project"])

    def _vector(self, query: SearchQuery, projects: list[str]) -> list[float] | None:
        """One embedding of the query for all kinds; none if it is short, may not leave, or the provider fails."""
        if query.lexical_only or self.embedder is None or not self.egress.permits(projects):
            return None
        try:
            return embed_all(self.embedder, [query.text], self.embedding_model)[0]
        except Exception:  # whatever a provider raises: the search goes on without
            return None

    def _reranker(self, query: SearchQuery) -> Callable | None:
        if self.reranker is None or query.lexical_only:
            return None
        provider = self.reranker

        @F.pandas_udf("double")
        def scores(texts: pd.Series) -> pd.Series:
            try:
                return pd.Series(rerank_scores(provider.rerank(query.text, texts.tolist()), len(texts)))
            except Exception:  # whatever a provider raises: the order stays
                return pd.Series([None] * len(texts), dtype="float64")

        return lambda text: scores(text)

    def entity_search(self, kind: str, query: SearchQuery, project: str, limit: int, budget: int, vector: list[float] | None, root: str | None = None, language: str | None = None, path_prefix: str | None = None) -> DataFrame:
        """The hits of one kind in one project; see ``entity_hits``. Tasks are searched by their words alone."""
        phrases = query_phrases(query.text)
        chunks = self._files_where(self._chunks().where((F.col("kind") == kind) & (F.col("project") == project)), root, language, path_prefix)
        hits = index.bm25(self._corpus("files" if kind == "file" else "entries"), phrases, "chunk_id").select("chunk_id", "bm25")
        near = None
        if vector is not None and kind != "task":
            held = self.latest("embeddings").where((F.col("model") == self.embedding_model) & (F.col("project") == project)).join(chunks.select("chunk_id"), "chunk_id", "left_semi")
            near = held.select("chunk_id", cosine(F.col("vector"), F.array(*[F.lit(float(x)) for x in vector])).alias("vector")).orderBy(F.desc("vector"), "chunk_id").limit(limit)
        return entity_hits(hits, chunks, phrases, kind, limit, budget, near, self._reranker(query) if kind != "task" else None)

    def search(self, query: SearchQuery, projects: list[str] | None = None, explain: bool = False, view: str = "compact") -> dict:
        """One ranked page over kinds and projects: hits, the cursor of the next page and, with ``explain``, counts."""
        projects = list(projects or query.projects)
        if not projects:
            raise EngineError("invalid", "a search needs a project")
        for p in projects:
            self.drain(p)
        vector, budgets, limit = self._vector(query, projects), split_budget(query.budget, query.types, query.weights), query.look_ahead_of(len(projects))
        whole = None
        for t in query.types:
            for p in projects:
                own = self.entity_search(KINDS[t], query, p, limit, max(1, budgets[t] // len(projects)), vector)
                own = own.select(F.lit(t).alias("type"), F.col("document_id").alias("id"), F.lit(p).alias("project"), "title", "score", "snippet", "attributes")
                whole = own if whole is None else whole.unionByName(own)
        hits = store_kept(whole)  # at most the look-ahead of each kind and project
        rows, page = unified_page(hits, query)
        got = [r.asDict() for r in page.orderBy("place").collect()]
        more = bool(got) and rows.count() > len(got)
        out = {"count": len(got), "results": [{k: v for k, v in r.items() if k not in ("place", "spent") and (view == "full" or k != "attributes")} for r in got]}
        out["next_cursor"] = rank.encode_cursor({"score": got[-1]["score"], "type": got[-1]["type"], "id": got[-1]["id"]}) if more else None
        if explain:
            counts = {r.type: r["count"] for r in hits.groupBy("type").count().collect()}
            once = hits.select("type", "id", "project").distinct().count()
            out["stats"] = {"budget_tokens": query.budget, "consumed_tokens": got[-1]["spent"] if got else 0, "candidate_counts": {t: counts.get(t, 0) for t in query.types}, "deduplicated_count": once, "returned_count": len(got)}
        return out

    # Links.

    def link(self, project: str, source: str, target: str, kind: str = "references") -> None:
        if kind not in RELATIONS:
            raise EngineError("invalid", f"unknown relation {kind}")
        self.get(source, project), self.get(target, project)
        self.commit("links", [{"project": project, "source_id": source, "target_id": target, "kind": kind, "created_at": now_iso()}])

    def unlink(self, project: str, source: str, target: str, kind: str = "references") -> None:
        self.commit("links", [{"project": project, "source_id": source, "target_id": target, "kind": kind}], op="D")

    def links(self, project: str, key: str) -> DataFrame:
        """Links out of and into a document, both ends live in the project, newest first."""
        live = self.documents(project=project).select("id")
        rows = self.latest("links").where((F.col("project") == project) & ((F.col("source_id") == key) | (F.col("target_id") == key)))
        rows = rows.join(live.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(live.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
        return rows.orderBy(F.desc("created_at"), "source_id", "target_id", "kind")

    def _edges(self, project: str) -> DataFrame:
        """Links, and what tasks say of their parents and blockers."""
        rows = self.latest("links").where(F.col("project") == project).select("source_id", "target_id", F.col("kind").alias("relation"))
        for column, relation in (("parent_id", "child_of"), ("blocked_by_id", "blocked_by")):
            rows = rows.unionByName(self.documents("task", project).where(F.col(column).isNotNull()).select(F.col("id").alias("source_id"), F.col(column).alias("target_id"), F.lit(relation).alias("relation")))
        return rows

    # Memory.

    def capture(self, project: str, content: str, fact_type: str, scope: str = "project", evidence: tuple[str, ...] = (), confidence: float = 1.0, status: str = "candidate", chat: str | None = None, valid_from: str | None = None, valid_until: str | None = None, supersedes_id: str | None = None) -> str:
        """A fact, or more evidence for the one that says the same."""
        if not content.strip() or not fact_type.strip() or scope not in ("chat", "project", "global") or status not in memory.STATUSES:
            raise EngineError("invalid", "content, a type, a known scope and status are needed")
        if not 0.0 <= confidence <= 1.0 or valid_from and valid_until and valid_from > valid_until:
            raise EngineError("invalid", "confidence is 0 to 1, validity begins before it ends")
        if (status == "active" or scope == "global") and not evidence or scope == "chat" and not chat:
            raise EngineError("invalid", "active and global facts need evidence, chat facts a chat")
        base, rows = self.head("facts"), self.latest("facts")
        if supersedes_id is None:
            same = rows.where((F.col("scope") == scope) & (F.col("fact_type") == fact_type.strip()) & (normalized(F.col("content")) == normalized(F.lit(content))) & F.col("status").isin("candidate", "active"))
            same = same if scope == "global" else same.where(F.col("project") == project)
            same = same.where(F.col("chat").eqNullSafe(F.lit(chat))) if scope == "chat" else same
            found = same.orderBy((F.col("status") == "active").desc(), F.desc("updated_at"), F.desc("id")).limit(1).collect()
            if found:
                old = found[0].asDict(recursive=True)
                merged = list(dict.fromkeys([*old["evidence"], *evidence]))
                self.commit("facts", [old | {"evidence": merged, "confidence": min(1.0, max(old["confidence"], confidence)), "status": "active" if status == "active" else old["status"], "updated_at": now_iso()}], base)
                return old["id"]
        key = uuid7()
        row = {"id": key, "project": project, "scope": scope, "chat": chat, "fact_type": fact_type.strip(), "content": content.strip(), "confidence": confidence, "status": status, "evidence": list(evidence), "valid_from": valid_from, "valid_until": valid_until, "supersedes_id": supersedes_id, "updated_at": now_iso()}
        made = [row]
        if supersedes_id is not None:
            old = self._fact(supersedes_id, project)
            if status != "active" or old["status"] in memory.TERMINAL or any(old[c] != row[c] for c in ("scope", "fact_type", "project")) or scope == "chat" and old["chat"] != chat:
                raise EngineError("invalid", "an active fact supersedes a live one of the same scope, type, project and chat")
            made.append(old | {"status": "superseded", "updated_at": now_iso()})
        self.commit("facts", made, base)
        return key

    def _fact(self, key: str, project: str) -> dict:
        rows = self.latest("facts").where((F.col("id") == key) & (F.col("project") == project)).limit(1).collect()
        if not rows:
            raise EngineError("not_found", f"no fact {key} in {project}")
        return rows[0].asDict(recursive=True)

    def set_fact_status(self, key: str, project: str, status: str, expected: str | None = None) -> None:
        base = self.head("facts")
        row = self._fact(key, project)
        if status not in memory.STATUSES or row["status"] in memory.TERMINAL or status == "active" and not row["evidence"]:
            raise EngineError("invalid", "unknown status, a fact at its end, or no evidence")
        if expected is not None and row["status"] != expected:
            raise EngineError("conflict", f"the fact is {row['status']}")
        self.commit("facts", [row | {"status": status, "updated_at": now_iso()}], base)

    def promote(self, key: str, project: str, scope: str, chat: str | None = None) -> None:
        """Another scope, and active; the project a fact came from stays."""
        base = self.head("facts")
        row = self._fact(key, project)
        if scope not in ("chat", "project", "global") or row["status"] in memory.TERMINAL or not row["evidence"] or scope == "global" and chat is not None:
            raise EngineError("invalid", "unknown scope, a fact at its end, no evidence, or a chat for a global fact")
        self.commit("facts", [row | {"scope": scope, "chat": (chat or row["chat"]) if scope == "chat" else None, "status": "active", "updated_at": now_iso()}], base)

    def search_facts(self, query: str, projects: list[str] | None = None, chat: str | None = None, scope: str = "all", fact_type: str | None = None, statuses: tuple[str, ...] = ("active",), limit: int = 20) -> DataFrame:
        """Facts, best match first, then the newer."""
        rows = self.latest("facts").where(F.col("status").isin(*statuses) & (memory.visible(projects or [], chat, "chat") if scope == "all" else F.col("scope") == scope))
        if scope == "project" and projects:
            rows = rows.where(F.col("project").isin(projects))
        if scope == "chat" and chat is not None:
            rows = rows.where(F.col("chat") == chat)
        rows = rows.where(F.col("fact_type") == fact_type) if fact_type else rows
        found = index.bm25(self._corpus("facts"), query_phrases(query), "id").join(rows, "id")
        return found.orderBy("bm25", F.desc("updated_at"), F.desc("id")).limit(limit).select("id", "content", "scope", "project", "fact_type", "evidence", relevance(F.col("bm25"), "inverse").alias("score"))

    def recall(self, query: str, project: str, chat: str | None = None, limit: int = 5) -> DataFrame:
        """Active facts that the project, or the chat, may see, best match first."""
        return self.search_facts(query, [project], chat, limit=limit)

    def add_scenario(self, project: str, title: str, summary: str, fact_ids: tuple[str, ...], evidence: tuple[str, ...], scope: str = "project") -> str:
        """A scenario, or the one there is for just this evidence."""
        if not title.strip() or not summary.strip():
            raise EngineError("invalid", "a scenario needs a title and a summary")
        base = self.head("scenarios")
        same = self.latest("scenarios").where((F.col("scope") == scope) & F.col("project").eqNullSafe(F.lit(project)) & (F.array_sort(F.array_distinct("evidence")) == F.array_sort(F.array(*[F.lit(e) for e in dict.fromkeys(evidence)]).cast("array<string>"))))
        found = same.orderBy("id").limit(1).collect()
        if found:
            return found[0].id
        key = uuid7()
        self.commit("scenarios", [{"id": key, "project": project, "scope": scope, "title": title.strip(), "summary": summary.strip(), "status": "active", "fact_ids": list(fact_ids), "evidence": list(evidence)}], base)
        return key

    def search_scenarios(self, query: str, project: str, limit: int = 5) -> DataFrame:
        rows = self.latest("scenarios").where((F.col("scope") == "global") | (F.col("project") == project))
        found = index.bm25(self._corpus("scenarios"), query_phrases(query), "id").join(rows, "id")
        return found.orderBy("bm25", F.desc("version"), F.desc("id")).limit(limit).select("id", "scope", "title", "summary", relevance(F.col("bm25"), "inverse").alias("score"))

    def context(self, query: str, project: str, chat: str | None = None, limit: int = 5, budget: int = 800) -> dict:
        """A prompt of scenarios, then facts, within a budget of tokens; the first fact is cut to what is left."""
        if budget <= 0:
            raise EngineError("invalid", "the budget is above 0")
        head = ["<memory>", f"Project: {project}", *([f"Chat: {chat}"] if chat else [])]
        used = sum(len(query_tokens(line)) for line in [*head, "</memory>"])
        scenarios = self.search_scenarios(query, project, limit).withColumn("line", F.format_string("- [scenario/%s] %s: %s", "scope", "title", "summary"))
        facts = self.recall(query, project, chat, limit)
        scope = F.when(F.col("scope") == "project", F.concat(F.lit("project:"), "project")).otherwise(F.col("scope"))
        facts = facts.withColumn("line", F.format_string("- [%s/%s] %s", scope, "fact_type", "content"))
        ranked = lambda rows: self.spark.createDataFrame([(i, r.line) for i, r in enumerate(rows.select("line").collect())], "rank int, line string").withColumn("cost", count_tokens(F.col("line")))  # noqa: E731  a page
        lines = [r.line for r in memory.context_lines(ranked(scenarios), ranked(facts), budget, used).orderBy("place").collect()]
        spent, out, n_facts = used, [], 0
        for line in lines:
            fact = not line.startswith("- [scenario/")
            cut = cut_to_tokens(line, budget - spent) if fact and not n_facts else line
            if cut:
                out.append(cut)
                n_facts += fact
                spent += len(query_tokens(cut))
        return {"context": "\n".join([*head, *out, "</memory>"]), "count": n_facts, "scenario_count": len(out) - n_facts, "budget_tokens": budget}

    def evidence(self, key: str, project: str) -> list[dict]:
        """What a fact rests on: each reference with its document, directly or by a chunk, if that is live in the project."""
        rows = self.latest("facts").where(F.col("id") == key).limit(1).collect()
        if not rows or rows[0].project != project:
            raise EngineError("not_found", f"no fact {key} in {project}")
        refs = self.spark.createDataFrame([(i, e) for i, e in enumerate(rows[0].evidence)], "place int, ref string")
        docs = self.documents(project=project).select(F.col("id").alias("ref"), F.col("id").alias("document"), F.col("kind").alias("kind"))
        chunks = self.latest("chunks").where(F.col("project") == project).select(F.col("chunk_id").alias("ref"), F.col("document_id").alias("by_chunk"), F.col("kind").alias("chunk_kind"))
        found = refs.join(docs, "ref", "left").join(chunks, "ref", "left").select("place", "ref", F.coalesce("document", "by_chunk").alias("document_id"), F.coalesce("kind", "chunk_kind").alias("kind"))
        return [{"ref": r.ref, "document_id": r.document_id, "kind": r.kind, "found": r.document_id is not None} for r in found.orderBy("place").collect()]

    def conflicts(self, project: str, limit: int = 20) -> DataFrame:
        rows = self.latest("facts").where((F.col("project") == project) | (F.col("scope") == "global")).withColumnRenamed("evidence", "refs").withColumn("evidence", F.col("chat"))
        return memory.conflicts(rows).orderBy("scope", "project", "chat", "fact_type").limit(limit)

    def metrics(self, project: str) -> dict:
        """Facts, scenarios and checkpoints by status, and what facts' evidence is."""
        count = lambda t: {r.status: r["count"] for r in self.latest(t).where(F.col("project") == project).groupBy("status").count().collect()}
        refs = self.latest("facts").where((F.col("project") == project) & ~F.col("status").isin(*memory.TERMINAL)).select(F.explode("evidence").alias("ref"))
        known = self.documents(project=project).select("id").union(self.latest("chunks").where(F.col("project") == project).select("chunk_id"))
        seen = memory.evidence_counts(refs, known).first().asDict()
        return {"facts": count("facts"), "scenarios": count("scenarios"), "checkpoints": count("checkpoints"), "evidence": seen}

    # Extraction.

    def checkpoint(self, project: str, chat: str | None = None) -> dict:
        rows = self.latest("checkpoints").where((F.col("project") == project) & (F.col("chat") == (chat or ""))).limit(1).collect()
        return rows[0].asDict() if rows else {"project": project, "chat": chat or "", "status": None, "mark": None, "mark_id": None, "processed": 0}

    def _save_checkpoint(self, old: dict, status: str, processed: int = 0, error: str | None = None, mark: tuple[str, str] | None = None) -> dict:
        """The counter grows by what was processed; the mark moves only with success."""
        at = mark or (old["mark"], old["mark_id"])
        row = {"project": old["project"], "chat": old["chat"], "status": status, "last_error": error, "mark": at[0], "mark_id": at[1], "processed": (old["processed"] or 0) + processed}
        self.commit("checkpoints", [row])
        return row

    def waiting_history(self, project: str, mark: dict, limit: int = 20) -> DataFrame:
        """Entries strictly after the mark of (time, id), so that equal times lose none."""
        rows = self.documents("history", project).select("id", "entry_type", F.col("body").alias("payload"), "updated_at")
        if mark["mark"] is not None:
            rows = store.after_mark(rows, ["updated_at", "id"], [mark["mark"], mark["mark_id"]])
        return rows.orderBy("updated_at", "id").limit(limit)

    def preview(self, project: str, limit: int = 20) -> dict:
        """What an extraction would send, masked; nothing is sent."""
        rows = self.waiting_history(project, self.checkpoint(project), limit).withColumn("payload", redact(F.col("payload"))).collect()
        return {"project": project, "allowed": self.egress.permits([project]), "configured": self.extractor is not None, "count": len(rows), "entries": [{"id": r.id, "entry_type": r.entry_type, "payload": r.payload} for r in rows]}

    def extract(self, project: str, chat: str | None = None, limit: int = EXTRACTED) -> dict:
        """Facts and a scenario from history after the mark, masked before it leaves; the mark moves if all went well."""
        mark = self.checkpoint(project, chat)
        if not self.egress.permits([project]) or self.extractor is None:
            self._save_checkpoint(mark, "error", error="not allowed or not configured")
            raise EngineError("denied", "extraction is not allowed for the project, or has no provider")
        self._save_checkpoint(mark, "running")
        rows = self.waiting_history(project, mark, limit).withColumn("clean", redact(F.col("payload"))).collect()
        if not rows:
            self._save_checkpoint(mark, "completed")
            return {"processed": 0, "facts": 0, "scenario": None}
        refs = [r.id for r in rows]
        audit = {"project": project, "model": self.extraction_model, "scope": "chat" if chat else "project", "batch_size": len(rows), "redacted": sum(r.clean != r.payload for r in rows)}
        try:
            got = self.extractor.extract_facts("\n\n".join(f"[{r.id}] {r.entry_type}: {r.clean}" for r in rows), refs, self.extraction_model)
            if len(got) > self.max_facts:
                raise ValueError("too many facts")
            made: dict[str, str] = {}
            for fact in got:
                content, kind, scope, confidence = fact.get("content"), fact.get("fact_type", "fact"), fact.get("scope", "project"), fact.get("confidence", 0.5)
                if not isinstance(content, str) or not content.strip() or not isinstance(kind, str) or scope not in ("project", "global") or isinstance(confidence, bool) or not isinstance(confidence, (int, float)):
                    continue
                key = self.capture(project, content, kind, scope, tuple(refs), max(0.0, min(1.0, float(confidence))), chat=chat)
                made[key] = content.strip()
            scenario = None
            if made:
                told = self.extractor.summarize_scenario(list(made.values()), refs, self.extraction_model)
                scenario = self.add_scenario(project, told["title"], told["summary"], tuple(made), tuple(refs))
                for key in made:
                    if self._fact(key, project)["status"] == "candidate":
                        self.set_fact_status(key, project, "active")
        except Exception as error:  # whatever a provider raises; its text may hold what was sent
            self.record("memory_pipeline", project, "external_memory_extraction", audit | {"outcome": "error", "error_type": type(error).__name__})
            self._save_checkpoint(mark, "error", error=f"extraction failed ({type(error).__name__})")
            raise EngineError("provider", f"extraction failed ({type(error).__name__})") from None
        self.record("memory_pipeline", project, "external_memory_extraction", audit | {"outcome": "completed", "facts": len(made)})
        self._save_checkpoint(mark, "completed", len(rows), mark=(rows[-1].updated_at, rows[-1].id))
        return {"processed": len(rows), "facts": len(made), "scenario": scenario}

    def _pend(self, project: str) -> None:
        """Counts an entry; runs the extraction when it is due: enough entries or time, and not just before."""
        if self.extractor is None or not self.egress.permits([project]):
            return
        rows = self.latest("triggers").where(F.col("project") == project).limit(1).collect()
        old = rows[0].asDict() if rows else {"pending": 0, "pending_since": None, "last_run": None}
        at = datetime.now(UTC)
        since, last = old["pending_since"] or at.isoformat(), old["last_run"]
        state = {"project": project, "pending": (old["pending"] or 0) + 1, "pending_since": since, "last_run": last}
        old_enough = lambda t: (at - datetime.fromisoformat(t)).total_seconds() >= self.interval_seconds
        if (state["pending"] >= self.batch or old_enough(since)) and (last is None or old_enough(last)):
            self.flush(project)
        else:
            self.commit("triggers", [state])

    def flush(self, project: str) -> dict | None:
        """Extracts all that waits, a batch after the other, and starts counting anew; a failure is recorded and does not stop
        the caller."""
        got = None
        try:
            while got is None or part["processed"] >= EXTRACTED:
                part = self.extract(project, limit=EXTRACTED)
                got = part if got is None else {"processed": got["processed"] + part["processed"], "facts": got["facts"] + part["facts"], "scenario": part["scenario"] or got["scenario"]}
            return got
        except EngineError as error:
            if error.code not in ("provider", "denied"):
                raise
            return got
        finally:
            self.commit("triggers", [{"project": project, "pending": 0, "last_run": datetime.now(UTC).isoformat()}])

    # Upkeep.

    def projects(self) -> list[str]:
        """Projects of live documents, and of files that were deleted too."""
        live = self.latest("documents").select("project")
        files_ = self.tables["documents"].log().where("kind = 'file'").select("project")
        return [r.project for r in live.union(files_).distinct().orderBy("project").collect()]

    def purge(self, project: str | None = None, before: str | None = None) -> None:
        """Forgets tombstones of documents from before a time, of one project or all; the rest of the history is compacted."""
        stays = F.lit(False)
        if before is not None:
            stays = stays | (F.col("updated_at") > before)
        if project is not None:
            stays = stays | (F.col("project") != project)
        self.tables["documents"].compact(keep=stays)

    def rebuild(self) -> None:
        """Derives all chunks of notes, tasks and history anew; indexes follow with the next search."""
        rows = self.documents().where("kind <> 'file'").select("id", "project", "kind", "title", "body")
        if not rows.isEmpty():
            self._write_chunks(store_kept(rows))
        for segments in self._segments.values():
            segments.reset()
        self._indexes.clear()

    def compact(self, project: str | None = None, before: str | None = None, rebuild: bool = False, vacuum: bool = True) -> dict[str, int]:
        """Purges, rewrites every table as its latest rows, optionally rebuilds; gives the rows of each table."""
        self.purge(project, before)
        for name, table in self.tables.items():
            if name != "documents":
                table.compact()
        if rebuild:
            self.rebuild()
        if vacuum:
            for table in self.tables.values():
                table.vacuum()
        return self.health()["rows"]

    def maintain_if_due(self, days: int = 7) -> bool:
        """Compacts if that was never done, or so long ago."""
        last = self.setting("maintenance", "last")
        if last and datetime.fromisoformat(last) > datetime.now(UTC) - timedelta(days=days):
            return False
        self.compact(before=(datetime.now(UTC) - timedelta(days=days)).isoformat(timespec="microseconds"))
        self.set_setting("maintenance", "last", now_iso())
        return True

    def setting(self, scope: str, name: str) -> str | None:
        rows = self.latest("settings").where((F.col("scope") == scope) & (F.col("name") == name)).limit(1).collect()
        return rows[0].value if rows else None

    def set_setting(self, scope: str, name: str, value: str) -> None:
        self.commit("settings", [{"scope": scope, "name": name, "value": value}])

    def migrate(self) -> list[str]:
        """Applies what is not applied yet, in order; a step whose text has changed since is refused."""
        return migrations.apply(self)

    def health(self) -> dict:
        """Rows and commits of each table, migrations not applied, documents whose embedding failed."""
        errors = self.latest("queue").where("state = 'error'").count()
        return {"rows": {t: self.latest(t).count() for t in self.tables}, "commits": {t: self.head(t) for t in self.tables}, "pending_migrations": migrations.missing(self), "index_errors": errors}

    @staticmethod
    def capabilities() -> dict:
        return {"kinds": list(FIELDS), "types": list(TYPES), "relations": list(RELATIONS), "tables": list(SCHEMAS), "operations": [n for n in vars(Engine) if not n.startswith("_")]}


def query_tokens(text: str) -> list:
    return chunking._TOKEN.findall(text)


def store_kept(df: DataFrame) -> DataFrame:
    from .sources.work import kept

    return kept(df, "step")
