"""Ranked lists: fusion, deduplication, budgets, pages."""

from __future__ import annotations

import base64
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import combine

#: Vectors in a block.
VECTORS = 512


def fuse(lexical: DataFrame, vector: DataFrame, key: str, limit: int) -> DataFrame:
    """Full outer merge of two candidate lists: (key, lexical, vector, score), lexical arrivals first among equals."""
    both = lexical.join(vector, key, "full_outer")
    arrival = F.when(F.col("lexical").isNotNull(), 0).otherwise(1)
    return both.withColumn("score", combine(F.col("lexical"), F.col("vector"))).orderBy(F.desc("score"), arrival, key).limit(limit)


def best_per(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def merged(candidates: DataFrame, key: list[str], score: str = "score", snippet: str = "snippet") -> DataFrame:
    """(key, snippet, score): candidates that come several times as one, with the best score and the longest snippet.

    Both are maxima that combine before the shuffle, so a key with any number of candidates is no list.
    """
    return candidates.groupBy(*key).agg(F.max_by(snippet, F.length(snippet)).alias(snippet), F.max(score).alias(score))


def first_seen_best(rows: DataFrame, key: str, score: str, arrival: str) -> DataFrame:
    """The best row of each key, at the place where the key first came."""
    over = Window.partitionBy(key)
    placed = rows.withColumn("place", F.min(arrival).over(over))
    return best_per(placed, [key], [F.desc(score), F.asc(arrival)])


def trim_to_budget(page: DataFrame, order: list[Column], cost: Column, budget: int | Column, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows in order while their running cost fits; the first always stays; no budget, no rows.

    With ``by`` there is a page for each of its values, and the budget may be a column. A page is one sorted list of at most
    a few hundred rows.
    """
    if isinstance(budget, int) and budget <= 0:
        return page.limit(0).withColumns({"place": F.lit(0), "spent": F.lit(0).cast("bigint")})
    over = Window.partitionBy(*by).orderBy(*order)
    spent = F.sum(F.greatest(cost, F.lit(1))).over(over.rowsBetween(Window.unboundedPreceding, 0))
    trimmed = page.withColumns({"place": F.row_number().over(over), "spent": spent.cast("bigint")})
    return trimmed.where((F.col("spent") <= budget) | ((F.col("place") == 1) & (F.lit(budget) > 0 if isinstance(budget, int) else budget > 0)))


def encode_cursor(values: dict) -> str:
    return base64.urlsafe_b64encode(json.dumps(values, separators=(",", ":")).encode()).decode().rstrip("=")


def decode_cursor(cursor: str) -> dict:
    try:
        return json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
    except ValueError as error:
        raise ValueError("malformed cursor") from error


def page_after(rows: DataFrame, key: str, after: int | str | None, limit: int, newest_first: bool = True) -> DataFrame:
    """A keyset page with one row more, which tells that another page follows."""
    column = F.col(key)
    if after is not None:
        rows = rows.where(column < after if newest_first else column > after)
    return rows.orderBy(column.desc() if newest_first else column.asc()).limit(limit + 1)


def _valid(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector, width) without null ids and without vectors that are null, empty, zero or not finite."""
    rows = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    return rows.where(F.col("id").isNotNull() & F.coalesce(fine, F.lit(False))).withColumn("width", F.size("vector"))


def nearest_by_cosine(queries: DataFrame, rows: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, doc_id, score, n): the k rows nearest to each query by cosine, rounded to six places, ties to the smaller id.

    Rows are dealt by a hash to blocks of about VECTORS, queries to chunks. Every chunk meets every block of its width, by
    key: one product of matrices each, and what leaves a meeting is k rows a query.
    """
    rows, queries = _valid(rows, id_col, vector_col), _valid(queries, id_col, vector_col)
    blocks, chunks = rows.count() // VECTORS + 1, queries.count() // VECTORS + 1
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.withColumns({"chunk": F.pmod(F.xxhash64("id", F.lit("chunk")), F.lit(chunks)).cast("int"), "block": each(blocks)})
    right = rows.withColumns({"block": F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"), "chunk": each(chunks)})
    keys = ["width", "block", "chunk"]
    schema = pa.schema([("query_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.float64())])

    def unit(table: pa.Table) -> np.ndarray:
        flat = pa.concat_arrays([c.flatten() for c in table.column("vector").chunks])
        values = np.asarray(flat).reshape(table.num_rows, -1)
        return values / np.linalg.norm(values, axis=1, keepdims=True)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        ids, score = right.column("id").to_numpy(), np.round(unit(left) @ unit(right).T, 6)
        best = [np.lexsort((ids, -s))[:k] for s in score]
        return pa.table({"query_id": np.repeat(left.column("id").to_numpy(), [len(b) for b in best]), "doc_id": ids[np.concatenate(best)], "score": np.concatenate([s[b] for s, b in zip(score, best, strict=True)])}, schema=schema)

    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "query_id bigint, doc_id bigint, score double")
    over = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return near.withColumn("n", F.row_number().over(over)).where(F.col("n") <= k)
