"""Vector cells: exact rows, recall of probing, upserts, awkward vectors."""

import numpy as np

from tidepool.operators import cells, rank


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>")


def clustered(n, seed, first=0):
    r = np.random.default_rng(seed)
    middles = r.normal(size=(12, 16)) * 4
    return [(first + i, middles[r.integers(12)] + r.normal(size=16)) for i in range(n)]


def rows_of(df):
    return sorted((r.query_id, r.n, r.doc_id, r.score) for r in df.collect())


def test_exact_and_recall(spark):
    data = clustered(1500, 1)
    rows, asked = frame(spark, data), frame(spark, data[::30])
    made = cells.build(rows)
    every = rows_of(rank.nearest_by_cosine(asked, rows, 10))
    assert rows_of(cells.nearest(made, asked, 10, probes=1, exact=True)) == every
    found = {(q, i) for q, _, i, _ in rows_of(cells.nearest(made, asked, 10, probes=5))}
    assert len(found & {(q, i) for q, _, i, _ in every}) >= 0.9 * len(every)
    assert cells.visited(made, asked, 5) < 0.5


def test_upserts_and_awkward_vectors(spark):
    data = [*clustered(200, 2), (900, None), (901, np.zeros(16)), (902, [float("nan")] + [1.0] * 15), (903, [1.0, 2.0]), (904, [2.0, 1.0]), (3, np.ones(16))]
    rows = frame(spark, data)
    made = cells.build(rows)
    asked = frame(spark, [*data[:20:4], (903, [1.0, 2.0]), (905, [1.0] * 5)])
    assert rows_of(cells.nearest(made, asked, 4, 1, True)) == rows_of(rank.nearest_by_cosine(asked, rows, 4))
    fresh = clustered(40, 3, 180)
    now = [x for x in data if x[0] not in dict(fresh)] + fresh
    assert rows_of(cells.nearest(cells.upsert(made, frame(spark, fresh)), asked, 4, 1, True)) == rows_of(rank.nearest_by_cosine(asked, frame(spark, now), 4))
    assert cells.nearest(cells.build(rows.limit(0)), asked, 4, exact=True).collect() == []
