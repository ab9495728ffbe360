"""Phrases: against counts of all word sequences, with hot prefixes, small buffers and awkward tables."""

import random
import re
from collections import Counter

import pytest

from tidepool.llm import phrases

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, keep=100, top=2000):
    """(lang, rank, phrase, a, l, r, n, score) from a table of every sequence of up to five words."""
    seen, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, 6):
                for i in range(len(words) - m + 1):
                    seen.setdefault(lang, Counter())[tuple(words[i : i + m])] += 1
    out = []
    for lang, f in seen.items():
        found, inside = {p: a for p, a in f.items() if len(p) > 1 and a >= least}, Counter()
        for p, a in found.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inside[p[i : i + m]] = max(inside[p[i : i + m]], a)
        ranked = []
        for p, a in found.items():
            if 100 * inside[p] < keep * a or not inside[p]:
                score, k = min((1000 * a * n[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                ranked.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(ranked)[:top], 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")


def given(n, seed, vocabulary=40):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)] + ["É", "Ab", "a\x01", "a", "x y", "\U0001f600"]
    some = [" ".join(r.choice(words) for _ in range(r.randrange(3, 9))) for _ in range(6)]
    text = lambda: "".join(r.choice(["", "", r.choice(some)]) + " " + r.choice(words) + r.choice([" ", " ", "\t", ", ", "\n", ".\r\n"]) for _ in range(r.randrange(40)))
    return [(r.choice(["en", "en", "de", None, "und"]), r.choice([None, "", text(), text(), text()])) for _ in range(n)]


@pytest.mark.parametrize(("least", "keep", "hot", "top"), [(5, 100, 20_000, 2000), (3, 60, 5, 2000), (4, 100, 1, 7)])
def test_equals_counting_all(spark, least, keep, hot, top):
    rows = given(300, least)
    got = sorted(tuple(r) for r in phrases.mine(frame(spark, rows), least, keep, top, hot).collect())
    assert got == plain(rows, least, keep, top) and got


def test_buffers_and_ranking_in_parts(spark, monkeypatch):
    monkeypatch.setattr(phrases, "RANKED", 20)
    rows = given(150, 8)
    buffer = phrases.Buffer()
    buffer.held = phrases.BUFFER_WORDS
    assert buffer.full
    assert sorted(tuple(r) for r in phrases.mine(frame(spark, rows), 3, 100, 9).collect()) == plain(rows, 3, 100, 9)


def test_awkward_tables(spark):
    assert phrases.mine(frame(spark, [])).collect() == []
    assert phrases.mine(frame(spark, [(None, None), ("en", ""), ("en", " . , ")]), 1).collect() == []
    rows = [("en", "a a a a a a a")] * 3 + [(None, "b c " * 30_000), ("und", "b c"), ("de", "one line\n" * 4)]
    docs = frame(spark, rows).selectExpr("*", "1 as phrase", "2 as f", "3 as `a.b`", "'x' as first", "4 as n")
    assert sorted(tuple(r) for r in phrases.mine(docs, 3).collect()) == plain(rows, 3)


def test_a_hot_prefix_is_dealt_by_more_words(spark):
    rows = [("en", f"very common {a} {b} end") for a in range(12) for b in range(12)] * 2
    seen = phrases.windows(frame(spark, rows).select("lang", "text"), *phrases.pair_filter(phrases.counted(frame(spark, rows).select("lang", "text")).where("second IS NOT NULL")))
    words = {r.phrase: r.dealt for r in phrases.dealt(seen, 10).collect()}
    assert all(n >= 3 for p, n in words.items() if p.startswith("very common ")) and 4 in words.values()


def test_large_counts_are_exact(spark):
    """Products beyond 64 bits: the expression of the score, on numbers that no test corpus has."""
    a, n, left, right = 9_000_000_000, 80_000_000_000_000, 10_000_000_001, 9_000_000_007
    got = spark.sql(f"SELECT (CAST(1000 AS DECIMAL(38, 0)) * {a}L * {n}L) DIV (CAST({left}L AS DECIMAL(38, 0)) * {right}L) AS s").first().s
    assert got == 1000 * a * n // (left * right)
