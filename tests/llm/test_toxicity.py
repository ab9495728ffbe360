"""The lexicon's automaton against plain edit distances, words of any length, ordinary words near terms."""

import random

import pytest

from tidepool.llm import toxicity


def distance(a, b):
    """Insertions, deletions, changes and swaps of neighbours (optimal string alignment)."""
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def brute(word, stems, terms):
    exact = [w for s, w in stems.items() if word.startswith(s)] + [w for t, w in terms.items() if t == word]
    if exact:
        return max(exact), False
    near = [w for t, w in terms.items() if len(t) >= toxicity.FUZZY_LENGTH and distance(word, t) == 1]
    return (max(near), True) if near else None


def test_find_equals_distances_to_all_terms():
    r = random.Random(2)
    word = lambda low, high: "".join(r.choice("abcdé") for _ in range(r.randrange(low, high)))
    for _ in range(6):
        terms = {word(4, 9): round(r.random() + 1, 3) for _ in range(60)} | {"a" * 70: 2.0}
        stems = {word(4, 8): round(r.random() + 1, 3) for _ in range(5)}
        lexicon = toxicity.Lexicon(stems, terms)
        asked = [word(1, 10) for _ in range(400)]
        for t in list(terms)[:40] + ["a" * 70]:
            i = r.randrange(len(t))
            asked += [t, t[:i] + t[i + 1 :], t[:i] + r.choice("abcdé") + t[i:], t[:i] + "z" + t[i + 1 :], t[:i] + t[i : i + 2][::-1] + t[i + 2 :], t + "zz"]
        for w in asked:
            assert lexicon.find(w) == brute(w, stems, terms), w


def test_ordinary_words_near_a_term_are_no_misspelling(spark):
    """A word of clean documents beside a term, a long term, and the same word misspelled."""
    long = "donaudampfschifffahrtsgesellschaftskapitänsmützenträger"
    rows, labels = [], []
    for i in range(600):
        toxic = i % 3 == 0
        rows.append((i, f"the river {'scoundrel ' + long if toxic else 'scoundrels river mill'} runs {i}"))
        labels.append((i, 1, int(toxic)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, marks)
    find = model.lexicon.find
    assert find(long) and find(long[:3] + long[4:])
    assert find("scoundrel") and not find("scoundrels") and not find("river")


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, ""), (1, ""), (None, "a b")]])
def test_reject_keeps_rows_without_hits(spark, rows):
    docs = spark.createDataFrame([(i, t, 0.5, 1) for i, t in rows], "doc_id long, text string, score double, predicted int")
    model = toxicity.train(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert sorted(map(str, toxicity.reject(docs, model).collect())) == sorted(map(str, docs.collect()))
