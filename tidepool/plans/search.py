"""Search: candidates, fusion, rerank, one hit a document, budget, page; for one kind of document and across all kinds."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import combine, cosine, relevance
from ..functions.snippet import highlight
from ..functions.text import count_tokens, first_words, query_phrases
from ..operators import index, rank

MOST = 100
TYPES = ("notes", "tasks", "history", "files")
KINDS = {"notes": "note", "tasks": "task", "history": "history", "files": "file"}


@dataclass(frozen=True)
class SearchQuery:
    """A checked query. Raises ValueError on what no search can serve."""

    text: str
    limit: int = 20
    budget: int = 800
    types: tuple[str, ...] = TYPES
    weights: dict[str, float] = field(default_factory=dict)
    projects: tuple[str, ...] = ()
    cursor: str | None = None

    def __post_init__(self) -> None:
        if not self.text.strip():
            raise ValueError("an empty query")
        if not 1 <= self.limit <= MOST or not 1 <= self.budget <= 10_000:
            raise ValueError("limit is 1 to 100, budget 1 to 10000")
        types = tuple(dict.fromkeys(t.strip().lower() for t in self.types)) or TYPES
        if set(types) - set(TYPES) or set(self.weights) - set(TYPES) or any(w <= 0 for w in self.weights.values()):
            raise ValueError("unknown type or weight")
        object.__setattr__(self, "text", self.text.strip())
        object.__setattr__(self, "types", types)
        object.__setattr__(self, "projects", tuple(dict.fromkeys(p.strip() for p in self.projects if p.strip())))
        if self.cursor is not None:
            after = rank.decode_cursor(self.cursor)
            if not isinstance(after, dict) or set(after) != {"score", "type", "id"}:
                raise ValueError("malformed cursor")

    @property
    def lexical_only(self) -> bool:
        """Short queries skip vectors and reranking."""
        return len(query_phrases(self.text)) <= 1 or len(self.text) <= 4

    @property
    def look_ahead(self) -> int:
        return min(MOST, max(4 * self.limit, self.limit + 1))

    def look_ahead_of(self, projects: int) -> int:
        """What each project may give, so that all together give the look-ahead."""
        return max(1, -(-self.look_ahead // projects))


def split_budget(budget: int, types: tuple[str, ...], weights: dict[str, float]) -> dict[str, int]:
    """The budget by weight, at least 1 each; the last type gets what is left."""
    total, left, out = sum(weights.get(t, 1.0) for t in types), budget, {}
    for t in types[:-1]:
        out[t] = max(1, int(budget * weights.get(t, 1.0) / total))
        left -= out[t]
    return out | {types[-1]: left}


def candidates(lexical: DataFrame, vectors: DataFrame | None, limit: int) -> DataFrame:
    """(chunk_id, lexical, vector, score, arrival) of both lists merged, best first; ties in order of arrival."""
    if vectors is None:
        return lexical.withColumns({"vector": F.lit(None).cast("double"), "score": F.col("lexical")})
    return rank.fuse(lexical, vectors, "chunk_id", limit)


def entity_hits(hits: DataFrame, chunks: DataFrame, phrases: list[list[str]], kind: str, limit: int, budget: int, vectors: DataFrame | None = None, reranker: Callable | None = None) -> DataFrame:
    """(document_id, chunk_id, title, score, snippet, attributes, place, spent) of one kind of document.

    ``hits`` are (chunk_id, bm25) of the whole corpus, ``chunks`` the kind's and project's (chunk_id, document_id, title,
    body, token_count, attributes, created_at), ``vectors`` at most ``limit`` (chunk_id, vector). Candidates are ordered by
    their match, then the newer first. Notes are ordered by their final score; of history and files each document keeps the
    place where it first came, with its best chunk.
    """
    own = hits.join(chunks.select("chunk_id", "created_at"), "chunk_id").orderBy("bm25", F.desc("created_at"), "chunk_id").limit(limit)
    merged = candidates(own.select("chunk_id", relevance(F.col("bm25")).alias("lexical")), vectors, limit)
    page = merged.join(chunks, "chunk_id")
    marked = F.pandas_udf(lambda s: s.map(lambda x: highlight(x or "", phrases)), "string")
    plain = first_words(F.col("body"), mark=kind == "note")
    page = page.withColumn("snippet", F.when(F.col("lexical").isNotNull(), marked("body")).otherwise(plain))
    page = page.withColumn("before", F.col("score"))
    if reranker is not None:
        text = F.concat_ws("\n", "title", "snippet") if kind == "note" else F.col("snippet")
        page = page.withColumn("score", combine(F.col("lexical"), F.col("vector"), reranker(text)))
    if kind == "note":
        best = rank.best_per(page, ["document_id"], [F.desc("score"), F.asc("chunk_id")]).withColumn("place", F.struct(-F.col("score"), "document_id"))
    else:
        best = rank.first_seen_best(page.withColumn("arrival", F.struct(-F.col("before"), "chunk_id")), "document_id", "score", "arrival")
    own_cost = {"note": F.col("token_count") + count_tokens(F.concat_ws(" ", "title", "snippet"))}.get(kind, count_tokens(F.concat_ws(" ", "title", "snippet")))
    trimmed = rank.trim_to_budget(best.withColumnRenamed("place", "at"), [F.asc("at")], own_cost, budget)
    return trimmed.where(F.col("place") <= limit).select("document_id", "chunk_id", "title", "score", "snippet", "attributes", "place", "spent")


def hit_cost(title: Column, snippet: Column, attributes: Column) -> Column:
    return F.greatest(count_tokens(title) + count_tokens(snippet) + count_tokens(attributes), F.lit(1).cast("bigint"))


def unified_page(hits: DataFrame, query: SearchQuery) -> tuple[DataFrame, DataFrame]:
    """(deduplicated, page): hits (type, id, project, title, score, snippet, attributes) of all kinds as one ranked page.

    The best hit of each document and project stays; order is by score, type and id; a cursor passes over all up to its hit;
    the budget cuts after that, and then the limit.
    """
    once = rank.best_per(hits, ["type", "id", "project"], [F.desc("score")])
    order = [F.desc("score"), F.asc("type"), F.asc("id")]
    rows = once
    if query.cursor is not None:
        after = rank.decode_cursor(query.cursor)
        mark = F.struct(F.lit(-float(after["score"])).alias("s"), F.lit(after["type"]).alias("t"), F.lit(after["id"]).cast(once.schema["id"].dataType).alias("i"))
        rows = rows.where(F.struct((-F.col("score")).alias("s"), F.col("type").alias("t"), F.col("id").alias("i")) > mark)
    pool = rows.orderBy(*order).limit(len(TYPES) * MOST * max(1, len(query.projects)))  # what the look-aheads can give, at most
    trimmed = rank.trim_to_budget(pool, order, hit_cost(F.col("title"), F.col("snippet"), F.col("attributes")), query.budget)
    return rows, trimmed.where(F.col("place") <= query.limit)


def search(chunks: DataFrame, query: SearchQuery, vector: list[float] | None = None, reranker: Callable | None = None) -> DataFrame:
    """(document_id, chunk_id, score, snippet, place, spent) of one page over one kind of chunks.

    ``chunks`` holds document_id, chunk_id, title, body and, for vectors, embedding. ``reranker`` is a pandas UDF of a
    snippet. The index is built here; an engine keeps it. Snippets are made for the page's rows alone.
    """
    phrases = query_phrases(query.text)
    built = index.build(chunks, "chunk_id", F.concat_ws("\n", "title", "body"))
    hits = index.bm25(built, phrases, "chunk_id").select("chunk_id", "bm25")
    near = None
    if vector is not None and not query.lexical_only:
        score = cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in vector]))
        near = chunks.where("embedding IS NOT NULL").select("chunk_id", score.alias("vector")).orderBy(F.desc("vector"), "chunk_id").limit(query.look_ahead)
    rows = chunks.select("chunk_id", "document_id", "title", "body", count_tokens(F.col("body")).alias("token_count"), F.lit("{}").alias("attributes"), F.lit(0).alias("created_at"))
    page = entity_hits(hits, rows, phrases, "note", query.look_ahead, query.budget, near, None if query.lexical_only else reranker)
    return page.where(F.col("place") <= query.limit).select("document_id", "chunk_id", "score", "snippet", "place", "spent")
