"""Signatures shuffled in rounds: each is in one round, and the groups are those of one round."""

import numpy as np
import pytest

from tidepool.llm import neardup
from tidepool.llm.common import Written

EMPTY = np.empty(0, dtype=np.uint64)


def texts(n):
    r = np.random.default_rng(5)
    base = [[f"w{x}" for x in r.integers(0, 4000, 60)] for _ in range(n // 3)]
    return [(i, " ".join(w if i < len(base) or r.random() > 0.02 else "other" for w in base[i % len(base)])) for i in range(n)]


def test_rounds_part_the_signatures(spark):
    docs = spark.createDataFrame(texts(60), "doc_id long, text string")
    rows = lambda *turn: [tuple(x) for x in neardup.signed(docs, 5, 80, 100, EMPTY, EMPTY, *turn).collect()]
    whole, turns = rows(), [rows(t, 3) for t in range(3)]
    assert sorted(whole) == sorted(sum(turns, []))
    sigs = [{x[0] for x in t} for t in turns]
    assert not (sigs[0] & sigs[1] | sigs[0] & sigs[2] | sigs[1] & sigs[2])
    assert all(len(t) < len(whole) / 2 for t in turns)  # what lies on disk at once


@pytest.mark.parametrize("num", [60, 80, 95])
def test_groups_do_not_depend_on_rounds(spark, monkeypatch, num):
    docs = spark.createDataFrame(texts(60), "doc_id long, text string")
    rows = lambda: sorted(tuple(x) for x in neardup.groups(docs, 5, num, 100).collect())
    got = rows()
    monkeypatch.setattr(neardup, "ROUNDS", 0)
    assert got == rows()
    assert len({x[2] for x in got}) < 60


def test_more_differences_more_rounds():
    assert [neardup.rounds_of(n, 100) for n in (100, 90, 80, 50)] == [1, 1, 2, 7]


def test_written_leaves_no_shuffle_files(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: str(manager.getAllBlocks()).count("shuffle_")
    before = shuffles()
    Written(spark.range(1000).repartition(3, "id"), "shuffled").drop()
    assert shuffles() <= before
