"""Toxicity: Levenshtein automata intersected with a lexicon trie, with context-window scores.

The lexicon is learned from labelled documents: word beginnings (stems) and words that mark one label. A trie holds it.
A text's words are walked through the trie exactly and, for longer terms, by a Levenshtein automaton of one edit, which
catches misspelled terms. Hits are weighed by their context: a hit inside quotation marks counts as quoted, others as
abuse. A logistic regression over these hits gives the score.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLICE_ROWS, Written, any_names, map_columns

#: Labelled documents that the lexicon and the regression are fitted on, at most, drawn by a hash of their id.
MOST_LABELLED = 16_000
#: Lengths of stems, and the shortest term that may be misspelled.
STEM_LENGTHS, FUZZY_LENGTH = range(4, 8), 5
#: Words that a Python worker remembers at once.
REMEMBERED = 300_000
FEATURES = ("bias", "abuse", "quoted", "misspelled", "strongest", "three_strongest", "density")

WORD = re.compile(r"[^\W_]+")
# Pairs of quotation marks, opening and closing.
QUOTES = (('"', '"'), ("“", "”"), ("„", "“"), ("«", "»"), ("‘", "’"))
# Line ends and all marks; one between two letters is an apostrophe.
MARK = re.compile(r"\n|[\"“”„«»‘]|(?<![^\W_])’|’(?![^\W_])")


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Lexicon:
    """A trie of stems (any ending), words, and their weights. ``find`` gives (weight, misspelled) or None.

    ``ordinary`` are words known from clean documents: near a term as they may be, they are not misspelled.
    """

    def __init__(self, stems: dict[str, float], terms: dict[str, float], ordinary: Iterable[str] = ()):
        self.root: dict = {}
        self.ordinary = frozenset(ordinary)
        for entries, mark in ((terms, "word"), (stems, "stem")):
            for entry, weight in entries.items():
                node = self.root
                for letter in entry:
                    node = node.setdefault(letter, {})
                node[mark] = weight
        self.size = len(stems) + len(terms)
        # One edit leaves one half of a term as it is, or swaps the letters between the halves: what a word must begin or
        # end with to be near any term.
        fuzzy = [t for t in terms if len(t) >= FUZZY_LENGTH]
        self.begins = {t[: len(t) // 2] for t in fuzzy} | {t[: len(t) // 2 - 1] + t[len(t) // 2] for t in fuzzy}
        self.ends = {t[len(t) // 2 :] for t in fuzzy}
        self.begin_lengths, self.end_lengths = sorted({len(x) for x in self.begins}), sorted({len(x) for x in self.ends})
        self.lengths = range(min(map(len, fuzzy), default=1) - 1, max(map(len, fuzzy), default=0) + 2)
        self.known: dict[str, tuple[float, bool] | None] = {}

    def find(self, word: str) -> tuple[float, bool] | None:
        if word not in self.known:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[word] = self.exact(word) or (None if word in self.ordinary else self.misspelled(word))
        return self.known[word]

    def exact(self, word: str) -> tuple[float, bool] | None:
        node, best = self.root, None
        for letter in word:
            node = node.get(letter)
            if node is None:
                return best and (best, False)
            if "stem" in node:
                best = max(best or node["stem"], node["stem"])
        if "word" in node:
            best = max(best or node["word"], node["word"])
        return best and (best, False)

    def misspelled(self, word: str) -> tuple[float, bool] | None:
        """The best whole term within one edit (insertion, deletion, change, swapped neighbours).

        States of the automaton are (place in the word, whether edited); each is walked along the trie's nodes together with
        the node that its letters lead to, and only while some term goes on there.
        """
        if len(word) not in self.lengths:
            return None
        if not any(word[:n] in self.begins for n in self.begin_lengths) and not any(word[-n:] in self.ends for n in self.end_lengths):
            return None
        n, best, node = len(word), None, self.root
        for i in range(n + 1):  # unedited states: the node of the first i letters
            here = word[i] if i < n else "word"  # what a node must hold for a state at place i, or i + 1, to go on
            after = word[i + 1] if i + 1 < n else "word"
            reached = []
            if i < n and after in node:
                reached.append((node, i + 1, i))  # a letter too many
            for letter, child in node.items():
                if len(letter) == 1:
                    if here in child:
                        reached.append((child, i, i + 1))  # a letter too few
                    if i < n and letter != here and after in child:
                        reached.append((child, i + 1, i + 1))  # another letter
            if i + 1 < n and here != after and (child := node.get(after)) and (child := child.get(here)):
                reached.append((child, i + 2, i + 2))  # two letters swapped
            for child, at, depth in reached:  # edited states go on exactly
                while at < n and child is not None:
                    child = child.get(word[at])
                    at, depth = at + 1, depth + 1
                if child is not None and "word" in child and depth >= FUZZY_LENGTH:
                    best = max(best or child["word"], child["word"])
            node = node.get(here) if i < n else None
            if node is None:
                break
        return best and (best, True)


def quotations(text: str) -> list[tuple[int, int]]:
    """Where quotations begin and end: marks paired within each whole line. No two overlap; inner ones are part of the outer.

    A mark closes the last open one of its pair, if there is any, and otherwise opens where it can.
    """
    found: list[tuple[int, int]] = []
    opened: dict[str, list[int]] = {}
    for match in MARK.finditer(text):
        mark, at = match.group(), match.start()
        if mark == "\n":
            opened.clear()
            continue
        left = next((a for a, b in QUOTES if b == mark and opened.get(a)), None)
        if left is None:
            opened.setdefault(mark, []).append(at)
            continue
        start = opened[left].pop()
        while found and found[-1][1] > start:
            start = min(start, found.pop()[0])
        found.append((start, at))
    return found


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    """The regression's inputs for one whole text; without text or hits all but the bias are zero."""
    lower = (text or "").lower()
    found = WORD.findall(lower)
    hits = {w: hit for w in set(found) if (hit := lexicon.find(w))}
    if not hits:
        return [1.0] + [0.0] * 6
    abuse = in_quotes = wrong = 0
    weights = []
    spans, n = quotations(lower), 0
    for match in WORD.finditer(lower):
        hit = hits.get(match.group())
        if hit:
            weight, misspelled = hit
            while n < len(spans) and spans[n][1] < match.start():
                n += 1
            if n < len(spans) and spans[n][0] < match.start():
                in_quotes += 1
                continue
            wrong += misspelled
            abuse += not misspelled
            weights.append(weight / 2 if misspelled else weight)
    top = sorted(weights, reverse=True)[:3] or [0.0]
    return [1.0, float(np.log1p(abuse)), float(np.log1p(in_quotes)), float(np.log1p(wrong)), top[0], sum(top), min(1.0, 20 * len(weights) / len(found))]


def held_out(id_col: Column) -> Column:
    """Rows that labels are never learned from: crc32 of the id as text, modulo 3, is 1. A null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fold(doc_id: int) -> int:
    return zlib.crc32(b"fold" + str(doc_id).encode()) & 1


def lexicon_counts(sample: DataFrame) -> DataFrame:
    """For each word (mark ``=``) and word beginning: toxic and clean documents that have it, in either fold."""

    def make():
        counts: dict[str, list[int]] = {}

        def work(doc_id: list, text: list, toxic: list) -> dict:
            counts.clear()
            for d, t, y in zip(doc_id, text, toxic, strict=True):
                place = 2 * fold(d) + (1 - y)
                entries = set()
                for w in set(words(t or "")):
                    entries.add("=" + w)
                    entries.update(w[:n] for n in STEM_LENGTHS if len(w) >= n)
                for entry in entries:
                    counts.setdefault(entry, [0, 0, 0, 0])[place] += 1
            rows = list(counts.items())
            return {"entry": [k for k, _ in rows]} | {c: [v[i] for _, v in rows] for i, c in enumerate(("t0", "c0", "t1", "c1"))}

        return work

    counted = map_columns(sample.select("doc_id", "text", "toxic"), "entry string, t0 bigint, c0 bigint, t1 bigint, c1 bigint", make)
    return counted.groupBy("entry").agg(*[F.sum(c).alias(c) for c in ("t0", "c0", "t1", "c1")])


def choose(counts: Iterable[tuple[str, int, int]], toxic: int, clean: int) -> Lexicon:
    """Stems and words that mark toxic documents: in few clean ones, and in more toxic ones than chance gives."""
    stems: dict[str, float] = {}
    terms: dict[str, float] = {}
    for entry, t, c in sorted(counts):
        odds = np.log((t + 0.1) / (toxic + 1)) - np.log((c + 0.1) / (clean + 1))
        if t < 3 or odds < 2.5 or (t < 4 and c) or t < 3 * c:
            continue
        weight = float(odds * min(1.0, np.log1p(t) / np.log1p(8)))
        if entry.startswith("="):
            if len(entry) > 3:
                terms[entry[1:]] = weight
        elif not any(entry[:n] in stems for n in STEM_LENGTHS if n < len(entry)):
            stems[entry] = weight
    return Lexicon(stems, terms)


def bar_ordinary(counts: DataFrame, lexicons: list[Lexicon]) -> None:
    """Tells the lexicons of the halves, and of the whole, which words near their terms the clean documents hold.

    Those are words of their own, in at least one clean document for three toxic ones. Only words that an automaton accepts
    come back, and no more than the bounded sample holds.
    """

    def make():
        def work(entry: list, t0: list, c0: list, t1: list, c1: list) -> dict:
            out: dict[str, list] = {"word": [], "which": []}
            for e, *n in zip(entry, t0, c0, t1, c1, strict=True):
                seen = (n[:2], n[2:], [n[0] + n[2], n[1] + n[3]])
                for which, (lexicon, (t, c)) in enumerate(zip(lexicons, seen, strict=True)):
                    if 3 * c > t and not lexicon.exact(e[1:]) and lexicon.misspelled(e[1:]):
                        out["word"].append(e[1:])
                        out["which"].append(which)
            return out

        return work

    words_ = counts.where(F.col("entry").startswith("=") & (F.col("c0") + F.col("c1") > 0))
    found = map_columns(words_, "word string, which int", make).collect()
    for which, lexicon in enumerate(lexicons):
        lexicon.ordinary = frozenset(r.word for r in found if r.which == which)


def fit(rows: np.ndarray, labels: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Logistic regression with a quadratic penalty, by Newton's method."""
    weights = np.zeros(rows.shape[1])
    keep = np.full(rows.shape[1], penalty)
    keep[0] = 1e-3
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(rows @ weights, -30, 30)))
        step = np.linalg.solve((rows * (p * (1 - p))[:, None]).T @ rows + np.diag(keep), rows.T @ (labels - p) - keep * weights)
        weights += step
        if np.abs(step).max() < 1e-8:
            break
    return weights


class Model:
    def __init__(self, lexicon: Lexicon, weights: np.ndarray):
        self.lexicon, self.weights = lexicon, weights

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.weights @ np.array(features(text, self.lexicon)), -30, 30))))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fits lexicon and regression on a bounded sample of the labelled documents that aren't held out.

    The regression sees each half of the sample through the lexicon of the other half, so it learns how far hits can be
    trusted on unseen documents. Labels other than 0 and 1 and ids without a text are left out; without any labelled
    documents every score is that of an empty lexicon. An id labelled twice counts as toxic if one label says so;
    of an id that several rows hold, the least text is taken, so the sample keeps its bound.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    drawn = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_LABELLED))  # bounded by MOST_LABELLED rows of two numbers
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    once = texts.join(drawn, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    sample = Written(once, "toxicity-sample")
    totals = {(r.f, r.toxic): r.n for r in sample.df.groupBy((F.crc32(F.concat(F.lit("fold"), F.col("doc_id").cast("string")).cast("binary")) % 2).cast("int").alias("f"), "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = Written(lexicon_counts(sample.df), "toxicity-counts")
    t, c = F.col("t0") + F.col("t1"), F.col("c0") + F.col("c1")
    marks = (t >= 3 * c) | (F.col("t0") >= 3 * F.col("c0")) | (F.col("t1") >= 3 * F.col("c1"))
    best = counts.df.where((t >= 3) & marks).collect()  # what may be in one of the lexicons: bounded by the sample
    n = [[totals.get((f, y), 0) for y in (1, 0)] for f in (0, 1)]
    halves = [choose(((r.entry, r[f"t{f}"], r[f"c{f}"]) for r in best), *n[f]) for f in (0, 1)]
    lexicon = choose(((r.entry, r.t0 + r.t1, r.c0 + r.c1) for r in best), n[0][0] + n[1][0], n[0][1] + n[1][1])
    bar_ordinary(counts.df, [*halves, lexicon])
    counts.drop()

    def make():
        def work(doc_id: list, text: list, toxic: list) -> dict:
            return {"x": [features(t, halves[1 - fold(d)]) for d, t in zip(doc_id, text, strict=True)], "toxic": toxic}

        return work

    seen = map_columns(sample.df.select("doc_id", "text", "toxic"), "x array<double>, toxic int", make).collect()  # bounded, seven numbers a row
    sample.drop()
    rows = np.array([r.x for r in seen]).reshape(-1, len(FEATURES))
    return Model(lexicon, fit(rows, np.array([r.toxic for r in seen], dtype=float)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """Scores every whole text: doc_id, held_out, score, predicted.

    Null and empty texts get the score of a text without hits. Null ids pass through and aren't held out. One row out for
    each row in, repeated ones too. Empty table: no rows. Extra columns, whatever their names: ignored.
    """

    def make():
        def work(doc_id: list, text: list, held_out: list) -> dict:
            scores = [model.score(t) for t in text]
            return {"doc_id": doc_id, "held_out": held_out, "score": scores, "predicted": [int(s >= threshold) for s in scores]}

        return work

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), held_out(F.col(id_col).cast("bigint")).alias("held_out"))
    return map_columns(rows, "doc_id bigint, held_out boolean, score double, predicted int", make)


@any_names
def reject(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows, all their columns unchanged, whose texts score below ``threshold``.

    Null and empty texts score as texts without hits and stay, unless those are rejected too. Null ids, repeated rows: each
    row is judged by its own text. Empty table: no rows. Other columns, whatever their names, stay.
    """

    def clean(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                kept = [model.score(t) < threshold for t in part.column(text_col).to_pylist()]
                yield part.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)
