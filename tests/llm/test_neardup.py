"""The Jaccard join against sets of word tuples, at several thresholds, with hot signatures; and against its SQL."""

import random
import re

import duckdb
import pytest

from tidepool.llm import neardup, partenum, queries


def sets_of(rows, width):
    out = []
    for doc_id, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        out.append((doc_id, {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()))
    return out


def brute(rows, width, num):
    sets = sets_of(rows, width)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= num * len(a | b):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _) in enumerate(sets):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(s), least[find(i)]) for i, (d, s) in enumerate(sets))


def made(seed, n=150):
    r = random.Random(seed)
    base = [[r.choice("abcdefghij") + str(r.randrange(30)) for _ in range(r.choice([1, 2, 5, 12, 60, 150]))] for _ in range(14)]
    rows = []
    for i in range(n):
        words = list(base[i % 14] if i % 3 else base[5])
        for _ in range(r.randrange(len(words) // 4 + 2) if i % 3 else r.randrange(3)):
            words[r.randrange(len(words))] = "e" + str(r.randrange(9))
        rows.append((i * 3 + 1, r.choice([" ", "\t", "  ", "  "]).join(words).upper() if i % 2 else " ".join(words)))
    return rows + [(5001, None), (5002, ""), (5003, " \n"), (5004, "É É É"), (5005, "é É É")]


def groups(spark, rows, width, num):
    return sorted((x.doc_id, x.n_shingles, x.component_id) for x in neardup.groups(spark.createDataFrame(rows, "doc_id long, text string"), width, num).collect())


@pytest.mark.parametrize(("width", "num"), [(3, 90), (2, 50), (4, 100)])
def test_groups_equal_sets_of_tuples(spark, width, num):
    rows = made(num)
    assert groups(spark, rows, width, num) == brute(rows, width, num)


def test_hot_signatures_lose_nothing(spark, monkeypatch):
    """Nearly every signature is hot, and every bucket of two sets large."""
    monkeypatch.setattr(neardup, "HOT_COUNT", 2)
    monkeypatch.setattr(neardup, "SMALL", 1)
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rows = made(2)
    assert groups(spark, rows, 3, 90) == brute(rows, 3, 90)


def test_similar_sets_of_distant_bands_share_a_signature():
    r = random.Random(3)
    none = partenum.np.empty(0, dtype="uint64")
    for num in (30, 40, 50, 60, 70, 80, 90):
        for _ in range(60):
            large = [r.getrandbits(64) for _ in range(r.randrange(4, 200))]
            small = large[: -(-len(large) * num // 100)]
            a, b = (partenum.np.sort(partenum.np.array(x, dtype="uint64")) for x in (large, small))
            same = set(partenum.signatures(a, num, 100, none).tolist()) & set(partenum.signatures(b, num, 100, none).tolist())
            assert same or len(large) == len(small), (num, len(large))


def test_thresholds_out_of_range_are_refused(spark):
    for num in (0, 101, -1):
        with pytest.raises(ValueError, match="threshold"):
            neardup.groups(spark.createDataFrame([], "doc_id long, text string"), 3, num)


def test_sql_gives_the_same_rows():
    rows = made(9)
    base = duckdb.connect()
    base.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    base.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert sorted(base.execute(queries.ORACLE_SQL["op2_ngram_jaccard_join"]).fetchall()) == brute(rows, 3, 90)
