"""Exact top-k by inner product: M-tree best-first search.

Vectors become whole numbers. Rows are dealt to metric cells, each around a routing vector (one of a bounded sample's rows,
spread by farthest-first choice) with the largest distance of its rows as covering radius; the cells are the paged root of
the tree. Inside a cell every block of rows is a subtree: pages of rows around a routing vector with its covering radius,
pages of such nodes above them, and for every entry the stored distance to its parent's routing vector. For a query q and a
node (o, R), no row below can score more than q.o + |q| R; cells and nodes are taken best bound first. Stored parent
distances bound an entry before its own product is computed: q.x <= q.p + |q| d(x, p).
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import cells_of, placed, sampled, two_rounds, valid

#: Entries of a node, at most about; rows that routing vectors of cells are chosen from, about; such vectors of a width, at most.
PAGE, SAMPLE_ROWS, MOST_ROUTES = 256, 4096, 256
#: Scores are longs: larger and smaller ones are given, and ordered, as these.
LARGEST = 2**63 - 1
#: Components beyond this leave no room for bounds in doubles: their rows lie in cell FAR, which every query visits.
HUGE, FAR = 1e100, -1


def whole(vectors: np.ndarray) -> np.ndarray:
    """floor(1024 * x) as doubles, exact: scaling by 1024 is, and so is the floor. Huge components may become infinite."""
    with np.errstate(over="ignore"):
        return np.floor(1024 * vectors)


def integers(vectors: np.ndarray) -> np.ndarray:
    """floor(1024 * x) as Python integers, exact for all finite doubles."""
    return np.array([[int(x) * 1024 if abs(x) > HUGE else int(np.floor(1024 * x)) for x in v] for v in vectors], dtype=object).reshape(vectors.shape)


class Node:
    """A page of rows with their distances to its center, or of nodes with theirs; ``reach`` is that distance and the radius."""

    __slots__ = ("center", "radius", "children", "rows", "distances", "centers", "radii", "reach")

    def __init__(self, center: np.ndarray, radius: float, rows: np.ndarray | None = None, distances: np.ndarray | None = None):
        self.center, self.radius, self.rows, self.distances = center, radius, rows, distances

    def hold(self, children: list[Node]) -> None:
        self.children = children
        self.centers, self.radii = np.array([c.center for c in children]), np.array([c.radius for c in children])
        self.reach = np.sqrt(((self.centers - self.center) ** 2).sum(axis=1)) + self.radii


def spread(vectors: np.ndarray, n: int) -> np.ndarray:
    """Places of at most n vectors, each the one farthest from those before; none twice at one point."""
    chosen, gap = [0], np.full(len(vectors), np.inf)
    while len(chosen) < n:
        gap = np.minimum(gap, ((vectors - vectors[chosen[-1]]) ** 2).sum(axis=1))
        if not gap.max() > 0:
            break
        chosen.append(int(gap.argmax()))
    return np.array(chosen)


def build(vectors: np.ndarray, rows: np.ndarray) -> Node:
    """Bulk loading: rows go to the nearest of a few spread routing rows until they fit a page; radii from the true distances."""
    center = vectors[rows[0]]
    distances = np.sqrt(((vectors[rows] - center) ** 2).sum(axis=1))
    radius = float(distances.max())
    if len(rows) <= PAGE or radius == 0:
        return Node(center, radius, rows, distances)
    node = Node(center, radius)
    routes = rows[spread(vectors[rows], min(16, -(-len(rows) // PAGE) + 1))]
    owner = np.array([((vectors[rows] - vectors[p]) ** 2).sum(axis=1) for p in routes]).argmin(axis=0)
    owned = [(route, rows[owner == p]) for p, route in enumerate(routes)]
    node.hold([build(vectors, np.concatenate([[route], own[own != route]])) for route, own in owned])
    return node


def search_block(ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray, query_rows: np.ndarray, queries: np.ndarray, bounds: np.ndarray, k: int) -> tuple:
    """Each query's k best of a block, ties to the smaller id; whole numbers in doubles are exact below 2**53."""
    huge = max(np.abs(vectors).max(), np.abs(queries).max()) > HUGE
    values, wanted = whole(vectors), whole(queries)
    most = max(np.abs(values).max(), 1) * max(np.abs(wanted).max(), 1) * vectors.shape[1]
    if exact := most < 2**53:
        numbers, asked = values, wanted
    else:
        numbers, asked = integers(vectors), integers(queries)

    def products(at: np.ndarray, query: np.ndarray) -> np.ndarray:
        scores = numbers[at] @ query
        return scores.astype(np.int64) if exact else np.array([max(-LARGEST, min(LARGEST, s)) for s in scores], dtype=np.int64)

    root = None if huge else build(values, np.arange(len(values)))
    found: tuple[list, list, list] = ([], [], [])
    for n, (own, query) in enumerate(zip(query_rows, wanted, strict=True)):
        scores, places = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        least = -np.inf if bounds[n] <= -LARGEST else bounds[n] - 1e-9 * abs(bounds[n])

        def take(at: np.ndarray) -> None:
            nonlocal scores, places
            at = at[rows[at] != own]
            new = products(at, asked[n])
            good = new >= (least if len(scores) < k else max(least, scores.min()))
            if not good.any():
                return
            scores, places = np.concatenate([scores, new[good]]), np.concatenate([places, at[good]])
            if len(scores) > k:
                order = np.lexsort((ids[places], -scores))[:k]
                scores, places = scores[order], places[order]

        if root is None:
            take(np.arange(len(ids)))
        else:
            length = float(np.sqrt(query @ query))
            slack = 1e-9 * (1 + length * (1 + float(np.abs(values).max()) * vectors.shape[1]))
            first = float(query @ root.center)
            heap, ticket = [(-(first + length * root.radius), 0, root, first)], 0
            while heap:
                bound, _, node, product = heapq.heappop(heap)
                if -bound + slack < least:
                    break
                if node.rows is not None:
                    take(node.rows[product + length * node.distances + slack >= least])
                    if len(scores) == k and scores.min() > -LARGEST:
                        least = max(least, float(scores.min()) - 1e-9 * abs(float(scores.min())))
                    continue
                at = np.flatnonzero(product + length * node.reach + slack >= least)
                products_ = node.centers[at] @ query
                upper = products_ + length * node.radii[at]
                for i in np.flatnonzero(upper + slack >= least):
                    ticket += 1
                    heapq.heappush(heap, (-upper[i], ticket, node.children[at[i]], products_[i]))
        found[0].extend([n] * len(places))
        found[1].extend(places)
        found[2].extend(scores)
    return found


def top(table: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k highest whole-number inner products for every row whose id is divisible by ``every``, against all other rows.

    Exact. Each row but the query's own is a candidate: rows that share an id are rows of their own, as queries (each gives
    its k ranks) and as candidates. Rows of one width are searched among themselves, as there is no product of vectors of
    different lengths. Scores beyond the range of a long are given, and ordered, as its ends. With fewer than k candidates
    all are returned; zero vectors take part. Vectors that take no part: see ``valid``. Ties go to the smaller id. Empty
    table, or no such queries: no rows. Extra columns: ignored.
    """
    valid_ = valid(table, id_col, vector_col, zero=True)
    n = valid_.df.count()
    sample = sampled(valid_.df, n, SAMPLE_ROWS, lambda d, vectors: whole(vectors[np.abs(vectors).max(axis=1) <= HUGE]))
    wanted = cells_of({d: x for d, x in sample.items() if len(x)}, n)
    routes = {d: sample[d][spread(sample[d], min(m, MOST_ROUTES))] for d, m in wanted.items()}

    def cell_of(d: int, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if d not in routes:
            return np.zeros(len(vectors), dtype=np.int64), np.full(len(vectors), np.inf)
        fine = np.abs(vectors).max(axis=1) <= HUGE
        values = whole(np.where(fine[:, None], vectors, 0))
        cell, away = np.zeros(len(vectors), dtype=np.int64), np.full(len(vectors), np.inf)
        for c, route in enumerate(routes[d]):
            gap = np.sqrt(((values - route) ** 2).sum(axis=1))
            closer = gap < away
            cell[closer], away[closer] = c, gap[closer]
        return np.where(fine, cell, FAR), np.where(fine, away, np.inf)

    data = placed(valid_.df, cell_of, "topk-cells")
    radii = {d: np.zeros(len(x)) for d, x in routes.items()}
    covering = data.where(F.col("away") < float("inf")).groupBy("d", "cell").agg(F.max("away").alias("radius"))
    for r in covering.collect():  # at most MOST_ROUTES cells of each width that the sample holds
        radii[r.d][r.cell] = r.radius

    def homes(d: int, vectors: np.ndarray) -> np.ndarray:
        if d not in routes:
            return np.zeros(len(vectors), dtype=np.int64)
        fine = np.abs(vectors).max(axis=1) <= HUGE
        return np.where(fine, (whole(np.where(fine[:, None], vectors, 0)) @ routes[d].T).argmax(axis=1), FAR)

    def others(d: int, vectors: np.ndarray, own: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if d not in routes:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        fine = np.abs(vectors).max(axis=1) <= HUGE
        values = whole(np.where(fine[:, None], vectors, 0))
        length = np.sqrt((values**2).sum(axis=1))[:, None]
        upper = values @ routes[d].T + length * radii[d]
        slack = 1e-9 * (1 + np.abs(upper) + length * np.abs(routes[d]).max() * vectors.shape[1])
        least = np.where(bounds <= -LARGEST, -np.inf, bounds - 1e-9 * np.abs(bounds))[:, None]
        visit = np.concatenate([(upper + slack >= least) | ~fine[:, None], np.ones((len(own), 1), dtype=bool)], axis=1)
        visit[np.arange(len(own)), own] = False  # FAR, -1, is the last column
        place, cell = np.nonzero(visit)
        return place, np.where(cell == len(routes[d]), FAR, cell)

    def search(ids, rows, vectors, query_rows, queries, bounds):
        return search_block(ids, rows, vectors, query_rows, queries, bounds, k)

    asked = data.where(F.col("vec_id") % every == 0)
    return two_rounds(data, asked, k, homes, others, search, "bigint", True, "topk")
