"""Pairs meet their whole sets only where sketches leave them, in rounds; links stay those of all candidate pairs."""

import numpy as np
import pytest

from tidepool.llm import neardup, partenum


def sets_of(n=40, seed=3):
    r = np.random.default_rng(seed)
    base = r.integers(0, 1 << 63, 4000, dtype=np.uint64)
    out = [np.empty(0, np.uint64), base[:1], base[:2], base[:9], base[:10]]
    for i in range(n):
        own = base[: r.integers(20, 1500)].copy() if i % 2 else base[500 * (i % 3) : 500 * (i % 3) + 400].copy()
        change = r.random(len(own)) < (i % 5) * 0.05
        own[change] = r.integers(0, 1 << 63, change.sum(), dtype=np.uint64)
        out.append(np.unique(own))
    return out


def test_sketches_never_show_more_than_the_difference():
    sets = sets_of()
    sketches = [partenum.sketch(s) for s in sets]
    for s, x in zip(sets, sketches, strict=True):
        assert len(s) < 16 or len(x) - 4 <= len(s) * 8 / 16
        for t, y in zip(sets, sketches, strict=True):
            n, m, differ = partenum.least_difference(x, y)
            assert (n, m) == (len(s), len(t))
            assert differ <= len(np.setxor1d(s, t))


@pytest.mark.parametrize("num", [50, 80, 95])
def test_links_equal_all_pairs_and_few_meet_their_sets(spark, monkeypatch, num):
    sets = sets_of()[1:]
    table = spark.createDataFrame([(i, bytearray(s.tobytes()), bytearray(partenum.sketch(s))) for i, s in enumerate(sets)], "node long, items binary, sketch binary")
    pairs = [(i, j) for i in range(len(sets)) for j in range(i)]
    asked = spark.createDataFrame(pairs, "a long, b long")
    same = {(i, j): len(np.intersect1d(sets[i], sets[j])) for i, j in pairs}
    want = {(i, j) for (i, j), n in same.items() if n * 100 >= num * (len(sets[i]) + len(sets[j]) - n)}
    left = {(r.a, r.b) for r in neardup.likely(asked, table, num, 100).collect()}
    assert want <= left
    assert num < 80 or len(left) < len(pairs) / 2  # before, all met
    monkeypatch.setattr(neardup, "ROUND_BYTES", 1)
    got = neardup.linked(asked, table, num, 100)
    assert {(r.u, r.v) for x in got for r in x.df.collect()} == want
    for x in got:
        x.drop()


def test_rounds_follow_what_moves(spark):
    sets = spark.createDataFrame([(1, bytearray(100)), (2, bytearray(60))], "node long, items binary")
    held = neardup.ROUND_BYTES
    assert [neardup.turns_for(n, sets) for n in (0, 1, held, held + 1, 5 * held)] == [1, 1, 1, 2, 5]


def test_groups_in_rounds(spark, monkeypatch):
    """A group of many blocks in many rounds gives the components of one."""
    r = np.random.default_rng(8)
    base = [f"w{x}" for x in r.integers(0, 500, 80)]
    rows = [(i, " ".join(w if r.random() > 0.03 else f"v{i}" for w in base)) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    rows = lambda: sorted(tuple(x) for x in neardup.groups(docs, 5, 80, 100).collect())
    got, turns, kept = rows(), [], neardup.turns_for
    monkeypatch.setattr(neardup, "BLOCK", 8)
    monkeypatch.setattr(neardup, "ROUND_BYTES", 1)
    monkeypatch.setattr(neardup, "turns_for", lambda *a: turns.append(kept(*a)) or turns[-1])
    assert rows() == got
    assert turns[1] > 1
