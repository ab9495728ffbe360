"""Vector search over coarse cells: centroids from a bounded sample, one folder a cell, probing with an exact second step."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.work import kept, new_path
from .rank import VECTORS, _valid

#: Rows that centroids are fitted to, cells at most, rounds of fitting.
SAMPLE, MOST_CELLS, ROUNDS = 20_000, 1024, 8


def _unit(column: pa.ChunkedArray | pa.Array, n: int) -> np.ndarray:
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    values = np.concatenate([np.asarray(c.flatten()) for c in chunks]).reshape(n, -1) if n else np.zeros((0, 1))
    return values / np.linalg.norm(values, axis=1, keepdims=True)


def _fitted(sample: np.ndarray, cells: int) -> np.ndarray:
    """Centroids of unit vectors: first rows far from each other, then a few rounds of means."""
    at, far = [0], np.full(len(sample), np.inf)
    for _ in range(1, min(cells, len(sample))):
        far = np.minimum(far, 2 - 2 * sample @ sample[at[-1]])
        at.append(int(far.argmax()))
    middle = sample[at]
    for _ in range(ROUNDS):
        near = (sample @ middle.T - (middle**2).sum(1) / 2).argmax(1)
        sums, n = np.zeros_like(middle), np.bincount(near, minlength=len(middle))
        np.add.at(sums, near, sample)
        middle = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], middle)
    return middle


@dataclass(frozen=True)
class Cells:
    """``rows`` (cell, id, vector, far) by cell; centroids by width, numbered from a first cell; of each cell its rows and radius."""

    rows: DataFrame
    paths: tuple[str, ...]
    centroids: dict[int, tuple[int, np.ndarray]]
    held: dict[int, tuple[int, float]]


def _assigned(rows: DataFrame, centroids: dict) -> DataFrame:
    """(cell, id, vector, far): every row's nearest centroid, and how far that is from the row's unit vector."""
    shared = rows.sparkSession.sparkContext.broadcast(centroids)  # at most MOST_CELLS of a width

    def run(batches):
        for batch in batches:
            width = batch.column("width").to_numpy()
            for w in np.unique(width):
                part = batch.filter(pa.array(width == w))
                first, middle = shared.value[int(w)]
                unit = _unit(part.column("vector"), part.num_rows)
                square = np.maximum((unit**2).sum(1)[:, None] + (middle**2).sum(1) - 2 * unit @ middle.T, 0)
                near = square.argmin(1)
                yield pa.RecordBatch.from_arrays([pa.array(near + first, pa.int32()), part.column("id"), part.column("vector"), pa.array(np.sqrt(square[np.arange(len(near)), near]))], names=["cell", "id", "vector", "far"])

    return rows.select("id", "vector", "width").mapInArrow(run, "cell int, id bigint, vector array<double>, far double")


def _with(cells: Cells, rows: DataFrame) -> Cells:
    """The cells with more rows, written to folders of their own."""
    spark, path = rows.sparkSession, new_path(rows.sparkSession, "cells")
    made = _assigned(rows, cells.centroids)
    made.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(8))).write.partitionBy("cell").parquet(path)
    part = spark.read.schema("id bigint, vector array<double>, far double, cell int").parquet(path)
    held = dict(cells.held)
    for r in part.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect():  # a row a cell
        n, far = held.get(r.cell, (0, 0.0))
        held[r.cell] = (n + r.n, max(far, r.far))
    return replace(cells, rows=part if not cells.paths else cells.rows.unionByName(part), paths=(*cells.paths, path), held=held)


def build(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> Cells:
    """Cells of all rows; centroids are fitted, width by width, to about SAMPLE rows drawn by a hash of their id."""
    valid = kept(_valid(rows, id_col, vector_col), "vectors")
    centroids, first = {}, 0
    for width, n in sorted((r.width, r["count"]) for r in valid.groupBy("width").count().collect()):  # a few widths
        share = F.pmod(F.xxhash64("id", F.lit("cells")), F.lit(1 << 40)) < int((1 << 40) * min(1.0, SAMPLE / n))
        drawn = np.array([r.vector for r in valid.where((F.col("width") == width) & share).orderBy("id").limit(2 * SAMPLE).collect()] or [np.ones(width)])
        unit = drawn / np.linalg.norm(drawn, axis=1, keepdims=True)
        centroids[width] = (first, _fitted(unit, max(1, min(MOST_CELLS, int(n**0.5) // 2))))
        first += len(centroids[width][1])
    return _with(Cells(valid.limit(0), (), centroids, {}), valid)


def upsert(cells: Cells, rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> Cells:
    """The cells with new rows, and without the old rows of the same ids. Widths must be known; centroids stay."""
    fresh = kept(_valid(rows, id_col, vector_col), "vectors")
    return _with(replace(cells, rows=cells.rows.join(fresh.select("id"), "id", "left_anti")), fresh)


def _asked(queries: DataFrame, cells: Cells, probes: int, least: bool) -> DataFrame:
    """(query_id, vector, cell): the ``probes`` cells nearest to each query, or, with ``least`` (a column, the k-th score),
    the other cells that could hold a row at least as near."""
    shared = queries.sparkSession.sparkContext.broadcast((cells.centroids, cells.held))
    columns = ["id", "vector", "width"] + (["least"] if least else [])

    def run(batches):
        centroids, held = shared.value
        for batch in batches:
            out = {"query_id": [], "vector": [], "cell": []}
            bounds = batch.column("least").to_pylist() if least else [None] * batch.num_rows
            for key, vector, width, bound in zip(batch.column("id").to_pylist(), batch.column("vector").to_pylist(), batch.column("width").to_pylist(), bounds, strict=True):
                if width not in centroids:
                    continue
                first, middle = centroids[width]
                own = np.array(vector) / np.linalg.norm(vector)
                apart = np.sqrt(np.maximum(((middle - own) ** 2).sum(1), 0))
                order = np.lexsort((np.arange(len(apart)), apart))
                chosen = order[:probes]
                if least:
                    radius = np.array([held.get(first + c, (0, -np.inf))[1] for c in range(len(apart))])
                    nearest = np.maximum(apart - radius - 1e-9, 0)
                    rest = order[probes:]
                    chosen = rest if bound is None else rest[1 - nearest[rest] ** 2 / 2 + 1e-6 >= bound]
                chosen = [c for c in chosen.tolist() if first + c in held]
                out["query_id"] += [key] * len(chosen)
                out["vector"] += [vector] * len(chosen)
                out["cell"] += [first + c for c in chosen]
            yield pa.RecordBatch.from_arrays([pa.array(out["query_id"], pa.int64()), pa.array(out["vector"], pa.list_(pa.float64())), pa.array(out["cell"], pa.int32())], names=list(out))

    return queries.select(*columns).mapInArrow(run, "query_id bigint, vector array<double>, cell int")


def _met(asked: DataFrame, cells: Cells, k: int) -> DataFrame:
    """(query_id, doc_id, score): the k best of each query in each block of each cell it visits; large cells have more blocks."""
    blocks = F.create_map(*[F.lit(x) for cell, (n, _) in cells.held.items() for x in (cell, n // VECTORS + 1)]) if cells.held else F.create_map(F.lit(0), F.lit(1))
    of = F.coalesce(F.try_element_at(blocks, F.col("cell")), F.lit(1))
    left = asked.withColumn("block", F.explode(F.sequence(F.lit(0), of - 1)))
    right = cells.rows.join(asked.select("cell").distinct(), "cell", "left_semi").withColumn("block", F.pmod(F.xxhash64("id"), of).cast("int"))
    schema = pa.schema([("query_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.float64())])

    def meet(q: pa.Table, r: pa.Table) -> pa.Table:
        if not q.num_rows or not r.num_rows:
            return schema.empty_table()
        ids, score = r.column("id").to_numpy(), np.round(_unit(q.column("vector"), q.num_rows) @ _unit(r.column("vector"), r.num_rows).T, 6)
        best = [np.lexsort((ids, -s))[:k] for s in score]
        return pa.table({"query_id": np.repeat(q.column("query_id").to_numpy(), [len(b) for b in best]), "doc_id": ids[np.concatenate(best)], "score": np.concatenate([s[b] for s, b in zip(score, best, strict=True)])}, schema=schema)

    return left.groupBy("cell", "block").cogroup(right.groupBy("cell", "block")).applyInArrow(meet, "query_id bigint, doc_id bigint, score double")


def nearest(cells: Cells, queries: DataFrame, k: int, probes: int = 8, exact: bool = False, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, doc_id, score, n): the k rows nearest to each query by cosine, rounded to six places, ties to the smaller id.

    Each query visits its ``probes`` nearest cells. With ``exact`` it then visits all others that, by their radius, could hold
    a row as near as its k-th: the rows are those of a comparison with all.
    """
    asked = kept(_valid(queries, id_col, vector_col), "queries")
    over = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    best = lambda rows: rows.withColumn("n", F.row_number().over(over)).where(F.col("n") <= k)
    found = best(_met(_asked(asked, cells, probes, False), cells, k))
    if not exact:
        return found
    found = kept(found, "probed")
    least = found.where(F.col("n") == k).select(F.col("query_id").alias("id"), F.col("score").alias("least"))
    more = _met(kept(_asked(asked.join(least, "id", "left"), cells, probes, True), "asked"), cells, k)
    return best(found.drop("n").unionByName(more))


def visited(cells: Cells, queries: DataFrame, probes: int, id_col: str = "vec_id", vector_col: str = "embedding") -> float:
    """The share of all rows that a query meets, on average, when it probes."""
    sizes = queries.sparkSession.createDataFrame([(c, n) for c, (n, _) in cells.held.items()], "cell int, n bigint")
    asked = _asked(_valid(queries, id_col, vector_col), cells, probes, False).join(sizes, "cell").groupBy("query_id").agg(F.sum("n").alias("n"))
    return asked.agg(F.avg("n")).first()[0] / max(1, sum(n for n, _ in cells.held.values()))
