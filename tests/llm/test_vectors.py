"""Both vector searches against brute force: repeated ids, several widths, ties across blocks, huge components."""

import math
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from tidepool.llm import ann, queries, topk, vectors


@pytest.fixture
def small_blocks(monkeypatch):
    """Blocks, cells and chunks so small that the table makes many of each."""
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 64)
    monkeypatch.setattr(vectors, "CHUNK_QUERIES", 4)


def rows():
    r = np.random.default_rng(8)
    centres = 6 * r.standard_normal((9, 12))
    made = [(i, [float(np.float32(x)) for x in centres[i % 9] + r.standard_normal(12)]) for i in range(1200)]
    made += [(100, made[7][1]), (200, made[200][1]), (1, [50.0] * 12), (3, made[3][1])]  # ids that come twice, one row twice
    made += [(2000 + i, made[40][1]) for i in range(300)]  # a third of some blocks at one point
    made += [(3000 + i, [float(x) for x in r.standard_normal(5)]) for i in range(40)] + [(5000, [2.0]), (5001, [3.0]), (5100, [2.0, 1.0, 1.0])]
    made += [(None, made[0][1]), (400, None), (500, [None] * 12), (600, [float("nan")] * 12), (700, [float("inf")] * 12), (800, [])]
    return made


def table(spark, made):
    return spark.createDataFrame([(i, v, 7, "x") for i, v in made], "vec_id long, embedding array<float>, rank int, query_id string")


def taking_part(made, zero):
    return [(i, v) for i, v in made if i is not None and v and None not in v and all(map(math.isfinite, v)) and (zero or any(v))]


def lists(frame):
    got = defaultdict(list)
    for r in frame.orderBy("query_id", "rank").collect():
        got[r.query_id, r.rank].append((r.score, r.vec_id))
    return {k: sorted(v) for k, v in got.items()}


def brute(made, measure, largest):
    want = defaultdict(list)
    for n, (q, a) in enumerate(made):
        if q % 100 == 0:
            near = sorted((-measure(a, b) if largest else measure(a, b), i) for m, (i, b) in enumerate(made) if m != n and len(b) == len(a))[:10]
            for rank, (s, i) in enumerate(near, 1):
                want[q, rank].append((-s if largest else s, i))
    return {k: sorted(v) for k, v in want.items()}


def product(a, b):
    whole = [[int(x) * 1024 if abs(x) > 1e100 else math.floor(1024 * x) for x in v] for v in (a, b)]
    return max(-topk.LARGEST, min(topk.LARGEST, sum(x * y for x, y in zip(*whole, strict=True))))


def test_exact_topk_equals_brute_force_and_sql(spark, small_blocks):
    made = rows() + [(900, [0.0] * 12)]
    got = topk.top(table(spark, made))
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert lists(got) == brute(taking_part(made, True), product, True)
    base = duckdb.connect()
    base.register("arrow_rows", table(spark, [(i, v) for i, v in made if v is None or None not in v]).select("vec_id", "embedding").toArrow())
    base.execute("CREATE TABLE embeddings AS SELECT * FROM arrow_rows")
    sql = sorted(base.execute(queries.ORACLE_SQL["op9_exact_topk"]).fetchall())
    assert sql == sorted(tuple(r) for r in got.collect())


def test_huge_components(spark, small_blocks):
    made = [(i, [float(i % 13) * 10.0 ** (i % 12), 1e9 - i, -(2.0**40)]) for i in range(300)]
    made += [(1000 + i, [1e306 * (-1) ** i, 1.0, float(i)]) for i in range(4)] + [(1100, [1.7e308, -1.7e308, 0.0]), (1101, [1e160, 1.0, 1.0]), (1200, [3e160, 2.0, 1.0])]
    frame = spark.createDataFrame(made, "vec_id long, embedding array<double>")
    assert lists(topk.top(frame)) == brute(made, product, True)

    got, want = lists(ann.nearest(frame)), brute(made, math.dist, False)
    assert got.keys() == want.keys() and all(s == pytest.approx(w[0][0]) for k, w in want.items() for s, _ in got[k])


def test_neighbours_recall_and_scores(spark, small_blocks):
    made = rows() + [(900, [0.0] * 12)]
    got, known = lists(ann.nearest(table(spark, made))), taking_part(made, False)
    want = brute(known, math.dist, False)
    assert got.keys() == want.keys()
    hits = 0
    for k, v in want.items():
        hits += sum(any(i == j and math.isclose(s, t, abs_tol=1e-9) for t, j in got[k]) for s, i in v)
    assert hits >= 0.9 * sum(map(len, want.values()))
    near = {i for i, _ in known}
    assert all(i in near for v in got.values() for _, i in v)


def test_few_and_no_rows(spark):
    for search in (ann.nearest, topk.top):
        assert search(table(spark, [])).collect() == []
        assert search(table(spark, [(0, [1.0, 2.0])])).collect() == []
        assert [(r.query_id, r.rank, r.vec_id) for r in search(table(spark, [(0, [1.0, 2.0]), (7, [1.0, 3.0])])).collect()] == [(0, 1, 7)]
        assert search(table(spark, [(1, [1.0]), (2, [2.0])])).collect() == []
