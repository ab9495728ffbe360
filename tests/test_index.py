"""The full-text index: phrases from positions, best regions, segments that follow writes."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.engine import Engine
from tidepool.functions import text
from tidepool.operators import index
from tidepool.plans.search import SearchQuery

from test_operations import tiny  # noqa: F401  the fixture of small plans

WORDS = ["the", "cat", "cat-like", "Élan", "and", "hat", "to", "be", "or"]


def corpus(n, seed, first=0):
    r = random.Random(seed)
    return [(first + i, " ".join(r.choice(WORDS) for _ in range(r.randrange(0, r.choice([4, 30, 200]))))) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, body string")


def folded(rows):
    import re

    return {k: re.findall(r"[^\W_]+", text.folded(t or "")) for k, t in rows}


def test_phrases_from_positions(spark):
    rows = [*corpus(60, 1), (900, None), (901, ""), (902, "to be or to be to be to"), (903, "be be be")]
    phrases = [["to", "be"], ["be", "be"], ["the"], ["to", "be", "to"], ["elan", "cat", "like"]]
    got = {r["key"]: [r[f"f{i}"] for i in range(len(phrases))] for r in index.frequencies(index.build(frame(spark, rows), "id", F.col("body")), phrases).collect()}
    for k, t in folded(rows).items():
        want = [sum(t[i : i + len(p)] == p for i in range(len(t))) for p in phrases]
        assert got.get(k, [0] * len(phrases)) == want, (k, t)


@pytest.mark.parametrize("words", [["the", "cat"], ["the"], ["hat", "rare"], ["absent"]])
def test_best_regions_equal_scoring_all(spark, monkeypatch, words):
    """The same rows as scoring every posting, and fewer postings read where the best stand out."""
    monkeypatch.setattr(index, "REGIONED", 20)
    monkeypatch.setattr(index, "REGION_ROWS", 10)
    rows = [*corpus(400, 2), *[(5000 + i, f"{'rare ' if i < 3 else ''}the cat the cat hat") for i in range(5)]]
    built = index.build(frame(spark, rows), "id", F.col("body"))
    got = index.top(built, words, 5)
    every = sorted((round(r.bm25, 9), r.key) for r in index.bm25(built, [[w] for w in words]).collect())
    assert [(r.bm25, r.key) for r in got.rows.collect()] == every[:5]
    assert got.read <= got.held
    if words == ["the"]:
        assert got.read < got.held / 2


def test_segments_equal_a_rebuild(spark, tmp_path, monkeypatch):
    """Adds, replacements, deletions and merges: scores equal an index of what is there."""
    monkeypatch.setattr(index, "FANOUT", 3)
    made, live, r = index.Segments(spark, str(tmp_path / "i"), T.LongType()), {}, random.Random(5)
    assert index.bm25(made.index(), [["the"]]).collect() == []
    for turn in range(5):
        fresh = dict(corpus(6, turn, turn * 4))  # some keys come again
        gone = [k for k in live if r.random() < 0.2] + [k for k in fresh if k in live]
        live = {k: t for k, t in live.items() if k not in gone} | fresh
        made.add(frame(spark, list(fresh.items())), "id", F.col("body"), spark.createDataFrame([(k,) for k in gone], "k long"), followed=turn + 1)
    assert len(made.segments()) < 4 and made.followed() == 5
    now, whole = made.index(), index.build(frame(spark, list(live.items())), "id", F.col("body"))
    assert (now.rows, round(now.mean, 9)) == (whole.rows, round(whole.mean, 9))
    for phrases in ([["the"]], [["the"], ["cat", "like"]]):
        score = lambda i, phrases=phrases: sorted((x.key, x.length, round(x.bm25, 9)) for x in index.bm25(i, phrases).collect())
        assert score(now) == score(whole) and score(now)
    made.reset()
    assert made.index().rows == 0 and made.segments() == []


def test_an_add_indexes_what_was_added(spark, tmp_path, monkeypatch):
    """A search after a write tokenises the texts of that write alone."""
    e, seen, real = Engine(spark, str(tmp_path / "s")), [], index.tokens

    def counting(rows, *args):
        seen.append(rows.count())
        return real(rows, *args)

    monkeypatch.setattr(index, "tokens", counting)
    search = lambda q: [h["title"] for h in e.search(SearchQuery(q, types=("notes",)), ["p"])["results"]]
    first = e.add("note", "p", "one", "the first release")
    e.add("note", "p", "two", "another text")
    assert search("release") == ["one"]
    e.add("note", "p", "three", "a second release")
    assert sorted(search("release")) == ["one", "three"]
    e.update(first, "p", body="nothing of the kind")
    assert search("release") == ["three"] and search("kind") == ["one"]
    e.delete(first, "p")
    assert search("kind") == [] and seen == [2, 1, 1, 0]
    again = Engine(spark, e.root)
    assert [h["title"] for h in again.search(SearchQuery("release", types=("notes",)), ["p"])["results"]] == ["three"] and seen == [2, 1, 1, 0]
    for _ in range(2):
        again.tables["chunks"].compact()
    assert [h["title"] for h in Engine(spark, e.root).search(SearchQuery("release", types=("notes",)), ["p"])["results"]] == ["three"]


def test_many_queries_equal_single_ones(spark):
    rows = corpus(200, 7)
    built = index.build(frame(spark, rows), "id", F.col("body"))
    asked = {1: ["the"], 2: ["cat", "like"], 3: ["to", "be", "or"], 4: ["absent", "the"], 5: ["elan"]}
    queries = spark.createDataFrame([(q, w) for q, words in asked.items() for w in words * 2], "query_id int, term string")
    got = sorted((r.query_id, r.place, r.key, r.length, r.bm25) for r in index.bm25_many(built, queries, 7).collect())
    want = []
    for q, words in asked.items():
        every = sorted((round(r.bm25, 9), r.key, r.length) for r in index.bm25(built, [[w] for w in words]).collect())[:7]
        want += [(q, i, k, n, s) for i, (s, k, n) in enumerate(every, 1)]
    assert [(q, i, k, n) for q, i, k, n, _ in got] == [(q, i, k, n) for q, i, k, n, _ in want]
    assert all(abs(a[4] - b[4]) < 1e-8 for a, b in zip(got, want, strict=True))
