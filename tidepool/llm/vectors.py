"""What both vector searches share: rows that take part, cells and blocks of them, two rounds of visits, merged ranks.

Rows of one width (number of components) are searched among themselves. Every width has cells; a cell's rows are dealt by a
hash to blocks of bounded size, so no cell is too large for a task. A query visits all blocks of its home cell first. What
it finds there bounds what other cells must promise to be visited.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Written, drawn_by_hash

#: Rows of a block and queries of a chunk, about; each meeting of the two is one group of a task.
BLOCK_ROWS, CHUNK_QUERIES = 4096, 4096
#: Cells of all widths, at most about.
MOST_CELLS = 1024


def valid(table: DataFrame, id_col: str, vector_col: str, zero: bool) -> Written:
    """Rows that take part: (row, vec_id, d, v array<double>), ``row`` being a number that no other row has.

    Left out are null ids and vectors, vectors that hold null or non-finite components, empty ones, and all-zero ones unless
    ``zero``. Rows that share an id are rows of their own; ``d`` is the width.
    """
    rows = table.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).where(F.coalesce(fine, F.lit(False)))
    if not zero:
        rows = rows.where(F.exists("v", lambda x: x != 0))
    return Written(rows.withColumn("d", F.size("v")), "vectors")


def numbers(n: Column) -> Column:
    """0 to n - 1, to be exploded."""
    return F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1)


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), dtype=np.float64).reshape(-1, width)


def by_width(batch: pa.RecordBatch) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(width, places in the batch, vectors) for every width of a batch."""
    widths, vectors = batch.column("d").to_numpy(), batch.column("v")
    if len(kinds := np.unique(widths)) == 1:
        return [(int(kinds[0]), np.arange(len(widths)), matrix(vectors, int(kinds[0])))]
    places = [(int(d), np.flatnonzero(widths == d)) for d in kinds]
    return [(d, at, matrix(vectors.take(pa.array(at)), d)) for d, at in places]


def sampled(rows: DataFrame, n: int, wanted: int, reduce: Callable[[int, np.ndarray], np.ndarray]) -> dict[int, np.ndarray]:
    """By width, a sample of about ``wanted`` rows, reduced where they are to what the index is fitted on."""

    def run(batches):
        for batch in batches:
            for d, _, vectors in by_width(batch) if batch.num_rows else ():
                reduced = list(reduce(d, vectors))
                yield pa.RecordBatch.from_pydict({"d": np.full(len(reduced), d, dtype=np.int32), "x": reduced}, schema=pa.schema([("d", pa.int32()), ("x", pa.list_(pa.float64()))]))

    drawn = rows.where(drawn_by_hash("row", n, wanted)).mapInArrow(run, "d int, x array<double>").toArrow()
    widths = drawn.column("d").to_numpy()
    return {int(d): np.array(drawn.column("x").filter(pa.array(widths == d)).to_pylist()) for d in np.unique(widths)}


def cells_of(sample: dict[int, np.ndarray], n: int) -> dict[int, int]:
    """How many cells each sampled width gets, so that a cell holds about a block; other widths have the one cell 0."""
    drawn = sum(map(len, sample.values()))
    return {d: max(1, min(MOST_CELLS * len(x) // drawn, n * len(x) // drawn // BLOCK_ROWS + 1)) for d, x in sample.items()}


def placed(rows: DataFrame, cell_of: Callable[[int, np.ndarray], tuple[np.ndarray, np.ndarray]], label: str) -> DataFrame:
    """The rows with their cell and a distance in it, written."""

    def deal(batches):
        for batch in batches:
            cell, away = np.zeros(batch.num_rows, dtype=np.int64), np.zeros(batch.num_rows)
            for d, at, vectors in by_width(batch) if batch.num_rows else ():
                cell[at], away[at] = cell_of(d, vectors)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(away)], names=[*batch.schema.names, "cell", "away"])

    names = "row bigint, vec_id bigint, v array<double>, d int, cell bigint, away double"
    return Written(rows.select("row", "vec_id", "v", "d").mapInArrow(deal, names), label).df


def meet(data: DataFrame, visits: DataFrame, search: Callable, score_type: str) -> DataFrame:
    """(q_row, query_id, vec_id, score) of every visit, a query's at a cell: all blocks of the cell are searched.

    ``search(ids, rows, vectors, query ids, query rows, queries, bounds)`` gives (query places, row places, scores). Blocks
    and chunks of queries follow the counts of the cell, and cells that nobody visits are not sent anywhere.
    """
    held = data.groupBy("d", "cell").agg((F.floor(F.count(F.lit(1)) / BLOCK_ROWS) + 1).alias("blocks"))
    asked = visits.groupBy("d", "cell").agg((F.floor(F.count(F.lit(1)) / CHUNK_QUERIES) + 1).alias("chunks"))
    plan = held.join(asked, ["d", "cell"])
    left = data.join(plan, ["d", "cell"]).withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks"))).withColumn("chunk", F.explode(numbers(F.col("chunks"))))
    right = visits.join(plan, ["d", "cell"]).withColumn("chunk", F.pmod(F.xxhash64("row", F.lit("chunk")), F.col("chunks"))).withColumn("block", F.explode(numbers(F.col("blocks"))))
    kind = pa.float64() if score_type == "double" else pa.int64()
    keys = ["d", "cell", "block", "chunk"]
    schema = f"q_row bigint, query_id bigint, vec_id bigint, score {score_type}"

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        got = ([], [], [])
        query_ids, query_rows = right.column("vec_id").to_numpy(), right.column("row").to_numpy()
        ids = left.column("vec_id").to_numpy()
        if left.num_rows and right.num_rows:
            width = key[0].as_py()
            got = search(ids, left.column("row").to_numpy(), matrix(left.column("v"), width), query_rows, matrix(right.column("v"), width), right.column("bound").to_numpy())
        q, at = np.asarray(got[0], dtype=np.int64), np.asarray(got[1], dtype=np.int64)
        return pa.table([pa.array(query_rows[q], pa.int64()), pa.array(query_ids[q], pa.int64()), pa.array(ids[at], pa.int64()), pa.array(got[2], kind)], names=["q_row", "query_id", "vec_id", "score"])

    columns = [*keys, "row", "vec_id", "v"]
    return left.select(*columns).groupBy(*keys).cogroup(right.select(*columns, "bound").groupBy(*keys)).applyInArrow(run, schema)


def two_rounds(data: DataFrame, asked: DataFrame, k: int, homes: Callable, others: Callable, search: Callable, score_type: str, largest: bool, label: str) -> DataFrame:
    """(query_id, rank, vec_id, score): each query row's k best of its home cell and of the cells that may hold better ones.

    ``homes(width, vectors)`` gives each query's home cell, ``others(width, vectors, homes, bounds)`` lists of (query place,
    cell) still to visit, the bound being the k-th score at home, or the worst possible where home holds fewer rows.
    """
    worst = float("-inf") if largest else float("inf")

    def start(batches):
        for batch in batches:
            cell = np.zeros(batch.num_rows, dtype=np.int64)
            for d, at, vectors in by_width(batch) if batch.num_rows else ():
                cell[at] = homes(d, vectors)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])

    queries = asked.select("row", "vec_id", "v", "d").mapInArrow(start, "row bigint, vec_id bigint, v array<double>, d int, cell bigint")
    queries = Written(queries, f"{label}-queries").df
    first = Written(best(meet(data, queries.withColumn("bound", F.lit(worst)), search, score_type), k, largest), f"{label}-home").df
    reached = first.where(F.col("rank") == k).select(F.col("q_row").alias("row"), F.col("score").cast("double").alias("bound"))
    waiting = queries.join(reached, "row", "left").withColumn("bound", F.coalesce("bound", F.lit(worst)))

    def visit(batches):
        for batch in batches:
            place, cell = [], []
            for d, at, vectors in by_width(batch) if batch.num_rows else ():
                own, bounds = batch.column("cell").to_numpy()[at], batch.column("bound").to_numpy()[at]
                q, c = others(d, vectors, own, bounds)
                place.append(at[q])
                cell.append(c)
            taken = batch.take(pa.array(np.concatenate(place) if place else [], pa.int64())).drop_columns(["cell"])
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(np.concatenate(cell) if cell else [], pa.int64())], names=[*taken.schema.names, "cell"])

    visits = waiting.select("row", "vec_id", "v", "d", "bound", "cell").mapInArrow(visit, "row bigint, vec_id bigint, v array<double>, d int, bound double, cell bigint")
    second = meet(data, visits, search, score_type)
    merged = best(first.drop("rank").unionByName(second), k, largest)
    return merged.select("query_id", "rank", "vec_id", "score")


def best(found: DataFrame, k: int, largest: bool) -> DataFrame:
    """The k best of each query row's finds, best first, ties to the smaller id."""
    score = F.desc("score") if largest else F.asc("score")
    order = Window.partitionBy("q_row").orderBy(score, "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
