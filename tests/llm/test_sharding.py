"""Sharding: the law, whole groups, slots, sizes and checksums, over tables with hot groups."""

import random
import zlib
from collections import defaultdict

import pytest

from tidepool.llm import sharding


def check(docs, shards=8):
    """Checks what must hold for any table; gives the shards of each text."""
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    got = sharding.shard(docs, shards).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.size, r.text_crc32) for r in got) == sorted((-1 if d is None else d, len(t.encode()) + 1, zlib.crc32(t.encode())) for d, t in rows)
    size, slots, homes = defaultdict(int), defaultdict(list), defaultdict(set)
    for r in got:
        assert (r.law, r.grown_shard) == ("bytes", None) and 0 <= r.shard < shards
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
        homes[r.size, r.text_crc32].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    total = sum(size.values())
    spread = max(size.values(), default=0) - min((size[s] for s in range(shards)), default=0)
    assert spread <= max((r.size for r in got), default=0) + 0.03 * total / shards, dict(size)
    groups = defaultdict(int)
    for r in got:
        groups[r.size, r.text_crc32] += r.size
    return homes, groups, total / shards


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_groups_stay_together(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RANGE_ROWS", 200)
    r = random.Random(1)
    rows = [(i, f"text {r.randrange(26)} " * 9 if i % 2 else f"own {i} " * r.randrange(1, 30)) for i in range(6000)]
    homes, _, _ = check(frame(spark, rows))
    assert all(len(s) == 1 for s in homes.values())


def test_a_group_is_cut_only_where_no_shard_has_room(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RANGE_ROWS", 200)
    rows = [(i, "hot " * 6 if i % 3 == 0 else "warm " * 4 if i % 10 == 1 else f"t {i}" * (i % 9)) for i in range(6000)]
    homes, groups, share = check(frame(spark, rows))
    for key, at in homes.items():
        assert len(at) <= max(1, -(-groups[key] // int(share)) + 1) and (groups[key] > 0.5 * share or len(at) == 1)


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_awkward_tables(spark, shards):
    check(frame(spark, []), shards)
    check(frame(spark, [(1, None)]), shards)
    check(frame(spark, [(i, "x" * r) for i, r in enumerate(range(500, 560, 3))]), shards)
    check(frame(spark, [(7, None)] * 900 + [(7, "")] * 900 + [(None, "a")] * 40), shards)
    check(frame(spark, [(1, "y" * 90_000), (2, "é"), (2, "é"), (3, None)]), shards)


def test_rows_equal_in_text_and_id_are_spread(spark, monkeypatch):
    """No unit holds many of them: units are what a window gathers."""
    monkeypatch.setattr(sharding, "RANGE_ROWS", 50)
    docs = frame(spark, [(7, None)] * 4000 + [(i, f"t{i}") for i in range(2000)])
    check(docs)
    seen = {}
    real = sharding.Written

    def spy(df, label):
        seen[label] = real(df, label)
        return seen[label]

    monkeypatch.setattr(sharding, "Written", spy)
    sharding.shard(docs).count()
    assert seen["shard-placed"].df.groupBy("unit").count().agg({"count": "max"}).first()[0] <= 250
