"""Approximate nearest neighbours: low-dimensional stable projections, kd-trees, a chi-square stopping test.

Vectors are projected by a fixed Gaussian (2-stable) matrix, so a projected distance is the true one times a chi variable.
A kd-tree over a bounded sample's projections deals all rows to cells; inside a block of a cell a kd-tree of pages orders
candidates by projected distance. They are verified with the true distance until no candidate further out could, at the
wanted confidence, be nearer than the k-th found. Each query searches its own cell first; its k-th distance there is the
bound with which it visits only those other cells that the same test doesn't rule out.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import cells_of, placed, sampled, two_rounds, valid

#: Projected dimensions, confidence of the stopping test, rows of a kd-tree's page.
PROJECTED, CONFIDENCE, PAGE_ROWS = 8, 0.97, 256
#: Rows whose projections the cells' trees are fitted on, about, by a hash of their place: eight numbers a row.
SAMPLE_ROWS = 65_536


def chi_square(confidence: float, dimensions: int = PROJECTED) -> float:
    """Quantile of the chi-square distribution with an even number of degrees of freedom, by bisection."""
    low, high = 0.0, 1000.0
    for _ in range(80):
        x = (low + high) / 2
        tail = math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dimensions // 2))
        low, high = (x, high) if 1 - tail < confidence else (low, x)
    return high


def projection(dimension: int) -> np.ndarray:
    return np.random.default_rng(20240229).standard_normal((dimension, PROJECTED))


class Cells:
    """A kd-tree of medians over sampled projections; leaves are numbered, each with its box."""

    def __init__(self, points: np.ndarray, cells: int):
        self.nodes: list[tuple] = []
        self.boxes: list[tuple[np.ndarray, np.ndarray]] = []
        top = np.full(PROJECTED, np.inf)
        self._split(points, max(0, math.ceil(math.log2(max(cells, 1)))), -top, top)

    def _split(self, points: np.ndarray, depth: int, low: np.ndarray, high: np.ndarray) -> int:
        at = len(self.nodes)
        self.nodes.append(())
        spread = np.ptp(points, axis=0) if len(points) > 1 else np.zeros(PROJECTED)
        if not depth or not spread.any():
            self.nodes[at] = (-1, 0.0, len(self.boxes), 0)
            self.boxes.append((low, high))
            return at
        axis = int(spread.argmax())
        cut = float(np.median(points[:, axis]))
        left = points[:, axis] < cut
        if not left.any():
            cut = float(points[points[:, axis] > cut, axis].min())
            left = points[:, axis] < cut
        below, above = high.copy(), low.copy()
        below[axis], above[axis] = cut, cut
        a = self._split(points[left], depth - 1, low, below)
        b = self._split(points[~left], depth - 1, above, high)
        self.nodes[at] = (axis, cut, a, b)
        return at

    def of(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), dtype=np.int64)
        stack = [(0, np.arange(len(points)))]
        while stack:
            node, rows = stack.pop()
            axis, cut, a, b = self.nodes[node]
            if axis < 0:
                out[rows] = a
            elif len(rows):
                left = points[rows, axis] < cut
                stack += [(a, rows[left]), (b, rows[~left])]
        return out

    def distances(self, point: np.ndarray) -> np.ndarray:
        """Squared projected distance from a point to each cell's box."""
        low = np.array([b[0] for b in self.boxes])
        high = np.array([b[1] for b in self.boxes])
        return (np.maximum(0, np.maximum(low - point, point - high)) ** 2).sum(axis=1)


def pages(points: np.ndarray) -> list[np.ndarray]:
    """A block's kd-tree, as its leaves: row numbers of at most PAGE_ROWS points, split at medians of the widest axis."""
    stack, out = [np.arange(len(points))], []
    while stack:
        rows = stack.pop()
        if len(rows) <= PAGE_ROWS:
            out.append(rows)
            continue
        axis = int(np.ptp(points[rows], axis=0).argmax())
        rows = rows[np.argsort(points[rows, axis], kind="stable")]
        stack += [rows[: len(rows) // 2], rows[len(rows) // 2 :]]
    return out


def search_block(ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray, query_rows: np.ndarray, queries: np.ndarray, bounds: np.ndarray, k: int, reach: float) -> tuple:
    """Each query's k nearest of a block, verified page by page in the order of projected distance until the test holds."""
    matrix_ = projection(vectors.shape[1])
    points, targets = vectors @ matrix_, queries @ matrix_
    leaves = pages(points)
    low = np.array([points[r].min(axis=0) for r in leaves])
    high = np.array([points[r].max(axis=0) for r in leaves])
    found: tuple[list, list, list] = ([], [], [])
    for n, (own, query, target) in enumerate(zip(query_rows, queries, targets, strict=True)):
        bound = bounds[n]
        best_d, best_at = np.empty(0), np.empty(0, dtype=np.int64)
        gaps = (np.maximum(0, np.maximum(low - target, target - high)) ** 2).sum(axis=1)
        for leaf in np.argsort(gaps, kind="stable"):
            if gaps[leaf] > reach * bound * bound:
                break
            at = leaves[leaf]
            near = ~(((points[at] - target) ** 2).sum(axis=1) > reach * bound * bound)
            at = at[near & (rows[at] != own)]
            if not len(at):
                continue
            best_d, best_at = np.concatenate([best_d, distances(vectors[at], query)]), np.concatenate([best_at, at])
            if len(best_d) > k:
                order = np.lexsort((ids[best_at], best_d))[:k]
                best_d, best_at = best_d[order], best_at[order]
            if len(best_d) == k:
                bound = min(bound, best_d.max())
        found[0].extend([n] * len(best_d))
        found[1].extend(best_at)
        found[2].extend(best_d)
    return found


def distances(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances; scaled where squares would leave the range of doubles, so finite ones stay so if they can."""
    with np.errstate(over="ignore"):
        out = np.sqrt(((vectors - query) ** 2).sum(axis=1))
    if np.isfinite(out).all():
        return out
    half = vectors / 2 - query / 2
    top = np.maximum(np.abs(half).max(axis=1), 1)
    with np.errstate(over="ignore"):
        return np.where(np.isfinite(out), out, 2 * top * np.sqrt(((half / top[:, None]) ** 2).sum(axis=1)))


def nearest(table: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding", confidence: float = CONFIDENCE) -> DataFrame:
    """The k nearest rows found for every row whose id is divisible by ``every``, by Euclidean distance.

    Every row is indexed, and each row but the query's own is a candidate: rows that share an id are rows of their own, as
    queries (each gives its k ranks) and as candidates. Rows of one width are searched among themselves, as there is no
    distance between vectors of different lengths. Each true neighbour is passed over with a chance of at most
    1 - confidence. With fewer than k candidates all are returned. Vectors that take no part: see ``valid``. Identical vectors
    are ties at one distance, in order of id. Components whose projections leave the range of doubles rule nothing out.
    Empty table, or no such queries: no rows. Extra columns: ignored.
    """
    valid_ = valid(table, id_col, vector_col, zero=False)
    n = valid_.df.count()
    sample = sampled(valid_.df, n, SAMPLE_ROWS, lambda d, vectors: vectors @ projection(d))
    wanted = cells_of(sample, n)
    trees = {d: Cells(np.nan_to_num(points, posinf=1e300, neginf=-1e300), wanted[d]) for d, points in sample.items()}
    reach = chi_square(confidence)

    def cell_of(d: int, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (trees[d].of(vectors @ projection(d)) if d in trees else np.zeros(len(vectors), dtype=np.int64)), np.zeros(len(vectors))

    data = placed(valid_.df, cell_of, "ann-cells")

    def others(d: int, vectors: np.ndarray, own: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if d not in trees:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        near = np.array([~(trees[d].distances(point) > reach * r * r) for point, r in zip(vectors @ projection(d), bounds, strict=True)]).reshape(len(own), -1)
        near[np.arange(len(own)), own] = False
        return np.nonzero(near)

    def search(ids, rows, vectors, query_rows, queries, bounds):
        return search_block(ids, rows, vectors, query_rows, queries, bounds, k, reach)

    asked = data.where(F.col("vec_id") % every == 0)
    return two_rounds(data, asked, k, lambda d, vectors: cell_of(d, vectors)[0], others, search, "double", False, "ann")
