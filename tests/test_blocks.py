"""Components by blocks of near ids: few rounds however long the ways, and the same with small, skipped and useless blocks."""

import random

import pyarrow as pa
import pytest

from tidepool.operators import graph


def components(pairs):
    """By brute force: (component, size) of each node."""
    out = {}
    for s, t in pairs:
        out.setdefault(s, set()).add(t)
        out.setdefault(t, set())
    reach = {}
    for node in out:
        seen, stack = set(), [node]
        while stack:
            for t in out[stack.pop()] - seen:
                seen.add(t)
                stack.append(t)
        reach[node] = seen
    same = {n: {m for m in reach[n] if n in reach[m]} | {n} for n in out}
    return {n: (min(c), len(c)) for n, c in same.items()}


def found(table):
    return {x.id: (x.component, x["size"]) for x in graph.strong_components(table).collect()}


@pytest.fixture
def written(monkeypatch):
    plans, real = [], graph.kept

    def kept(df, label):
        plans.append((label, df._jdf.queryExecution().executedPlan().toString()))
        return real(df, label)

    monkeypatch.setattr(graph, "kept", kept)
    return plans


def test_long_ways_take_few_rounds(spark, written):
    pairs = [(i, (i + 1) % 300) for i in range(300)] + [(i, i + 1) for i in range(400, 600)] + [(5, 400)]
    assert found(spark.createDataFrame(pairs, "s long, t long")) == {i: (0, 300) for i in range(300)} | {i: (i, 1) for i in range(400, 601)}
    assert len(written) <= 6


def test_rings_over_blocks(spark, monkeypatch, written):
    monkeypatch.setattr(graph, "BLOCK_NODES", 40)
    ring = lambda ids: list(zip(ids, [*ids[1:], ids[0]]))
    pairs = [p for a in range(0, 300, 15) for p in ring(range(a, a + 15))] + [(a + 14, a + 16) for a in range(0, 285, 45)] + [(7, 7), (299, 0), (900, 900)]
    assert found(spark.createDataFrame(pairs, "s long, t long")) == components(pairs)
    assert 2 <= [label for label, _ in written].count("marks") <= 4
    assert [label for label, plan in written if "Broadcast" in plan] == []


@pytest.mark.parametrize("nodes, rows, seed", [(12, 500_000, 1), (12, 20, 2), (500, 0, 3)])
def test_what_blocks_leave_is_found(spark, monkeypatch, written, nodes, rows, seed):
    """Blocks that take little, that are skipped in part, and that are all skipped."""
    monkeypatch.setattr(graph, "BLOCK_NODES", nodes)
    monkeypatch.setattr(graph, "BLOCK_ROWS", rows)
    r = random.Random(seed)
    pairs = [(f"{r.randrange(50):02}", f"{r.randrange(50):02}") for _ in range(64)]
    assert found(spark.createDataFrame(pairs, "s string, t string")) == components(pairs)
    assert [label for label, plan in written if "Broadcast" in plan] == []


def test_a_block():
    links = [(1, 2), (2, 1), (2, 3), (3, 4), (4, 3), (5, 3), (4, 6), (7, 8), (None, 1), (4, None), (None, 7), (6, 9)]
    rows = pa.table({"block": [0] * len(links), "s": pa.array([s for s, _ in links], pa.int64()), "t": pa.array([t for _, t in links], pa.int64())})
    got = {r["id"]: (r["root"], r["open"]) for r in graph._block(rows).to_pylist()}
    assert set(got) == set(range(1, 10))
    assert got[1][0] == got[2][0] and got[3][0] == got[4][0] and len({root for root, _ in got.values()}) == 7
    assert {n for n in got if got[n][1]} == {1, 2, 3, 4}
    r = random.Random(4)
    links = [(r.randrange(80), r.randrange(80)) for _ in range(110)]
    got = {r["id"]: r["root"] for r in graph._block(pa.table({"s": [s for s, _ in links], "t": [t for _, t in links]})).to_pylist()}
    low = {root: min(n for n in got if got[n] == root) for root in got.values()}
    assert {n: low[root] for n, root in got.items()} == {n: c for n, (c, _) in components(links).items()}
