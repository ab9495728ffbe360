"""Merkle manifest: against a tree built in memory, in one round and in many, over awkward tables."""

import hashlib
import random
import zlib

import pytest

from tidepool.llm import merkle


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def up(nodes):
    return [h("".join(nodes[i : i + 3])) for i in range(0, len(nodes), 3)]


def siblings(nodes, i):
    """Of the node at ``i``, by level: (before, after)."""
    out = []
    while len(nodes) > 1:
        first = i - i % 3
        out.append((nodes[first:i], nodes[i + 1 : first + 3]))
        nodes, i = up(nodes), i // 3
    return out


def top(nodes):
    while len(nodes) > 1:
        nodes = up(nodes)
    return nodes[0]


def plain(rows):
    """What the manifest says, computed one row at a time."""
    leaf = lambda r, text: h("".join(field(x) for x in (r[0], r[2], r[3], r[4], text)))
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(((r[0] is not None, r[0] or 0, leaf(r, r[1])), r))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    roots = {}
    for s in order:
        groups[s].sort(key=lambda x: x[0])
        roots[s] = top([k[2] for k, _ in groups[s]])
    whole, out = [roots[s] for s in order], []
    for at, s in enumerate(order):
        leaves = [k[2] for k, _ in groups[s]]
        for i, (key, r) in enumerate(groups[s]):
            path = siblings(leaves, i) + siblings(whole, at)
            text = r[1]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            folded = leaf(r, text)
            for before, after in path:
                folded = h("".join([*before, folded, *after]))
            out.append((r[0], key[2], roots[s], top(whole), h("".join("".join(b + a) for b, a in path)), folded, folded == top(whole)))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")


def given(n, sources, seed):
    r = random.Random(seed)
    return [(i, r.choice([None, "", "a\nb", f"é {i}\n\n", "line " * 40]), None if (s := r.randrange(-1, sources)) < 0 else f"s{s if r.random() < 0.6 else 0}", r.choice(["en", None]), r.choice([None, 7, i])) for i in range(n)]


@pytest.mark.parametrize(("block", "most", "n", "sources"), [(6, 4096, 300, 5), (1, 4, 260, 3), (2, 3, 400, 40), (1, 2, 90, 60), (6, 4096, 30, 30)])
def test_equals_a_tree_in_memory(spark, block, most, n, sources):
    """Small blocks and tops take the rounds that large tables take, more groups than the driver holds among them."""
    rows = given(n, sources, block)
    got = [tuple(r) for r in merkle.manifest(frame(spark, rows), block, most).collect()]
    assert sorted(got, key=str) == plain(rows)


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None)], [(5, "x\ny", "a", "en", 3)] * 7 + [(None, "t\n", "a", "en", 3), (None, None, "a", "", 0), (5, "other", "a", "en", 3)], [(2, "long\n" * 50_000, "Z", "de", 1), (-3, "", "é", "de", 1), (9, "\n", "z", "de", 1)]])
def test_awkward_tables(spark, rows):
    got = [tuple(r) for r in merkle.manifest(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == plain(rows)


def test_extra_columns_and_a_proof_stands_alone(spark):
    rows = given(50, 3, 9)
    docs = frame(spark, rows)
    noisy = docs.selectExpr("*", "1 as tree", "2 as pos", "3 as `a.b`", "'x' as digest", "4 as u")
    assert sorted((tuple(r) for r in merkle.manifest(noisy).collect()), key=str) == plain(rows)
    leaves = docs.selectExpr("source as tree", "doc_id as id", "unhex(sha2(coalesce(text, ''), 256)) as digest", "cast(null as binary) as told")
    for r in merkle.prove(leaves).collect():
        assert merkle.fold(bytes(r.digest), bytes(r.proof), bytes(r.turns)) == bytes(r.root) == bytes(r.folded)
        assert merkle.fold(b"\0" * 32, bytes(r.proof), bytes(r.turns)) != bytes(r.root)


def test_one_changed_text_fails_alone(spark):
    rows = [(i, f"text {i}\n", "s", "en", 1) for i in range(100)]
    got = merkle.manifest(frame(spark, rows)).collect()
    assert {r.doc_id for r in got if not r.verified} == {i for i in range(100) if zlib.crc32(str(i).encode()) % 2 == 0}
