"""Strong components and proposed links, against reach by brute force."""

import random

import pytest

from tidepool.engine import Engine, EngineError
from tidepool.operators import graph


def reach(pairs):
    out = {}
    for s, t in pairs:
        out.setdefault(s, set()).add(t)
    def of(node):
        seen, stack = set(), [node]
        while stack:
            for t in out.get(stack.pop(), ()):
                if t not in seen:
                    seen.add(t)
                    stack.append(t)
        return seen
    return {n: of(n) for p in pairs for n in p}


def test_components_and_proposals(spark):
    r = random.Random(5)
    pairs = [(r.randrange(60), r.randrange(60)) for _ in range(62)] + [(70, 71), (71, 72), (72, 70), (72, 73), (80, 80), (70, 71)]
    table = spark.createDataFrame([*pairs, (None, 1), (1, None)], "s long, t long")
    got = {x.id: (x.component, x["size"]) for x in graph.strong_components(table).collect()}
    to = reach(pairs)
    want = {n: {m for m in to if n in to[m] and m in to[n]} | {n} for n in to}
    assert got == {n: (min(c), len(c)) for n, c in want.items()}
    fresh = [(73, 70), (73, 90), (90, 73), (5, 91), (92, 92), (None, 3)]
    marked = {(x.s, x.t): x.closes for x in graph.closing(table, spark.createDataFrame(fresh, "s long, t long")).collect()}
    after = reach([*pairs, *[p for p in fresh if None not in p]])
    assert marked == {(s, t): s is not None and (s == t or s in after[t]) for s, t in fresh}
    assert graph.strong_components(spark.createDataFrame([], "s long, t long")).collect() == []


def test_many_tasks_related_at_once(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "s"))
    a, b, c, d = (e.add("task", "p", f"t{i}") for i in range(4))
    note, far = e.add("note", "p", "n", "x"), e.add("task", "q", "elsewhere")
    e.update(b, "p", parent_id=a)
    wanted = [(c, b), (a, c), (d, a), (d, d), (b, note)]  # d twice; a, b, c would be a ring
    table = lambda rows: spark.createDataFrame(rows, "id string, other string")
    refused = {(r.id, r.other): r.reason for r in e.relate_tasks("p", "parent_id", table(wanted)).collect()}
    assert refused == {(c, b): "cycle", (a, c): "cycle", (d, a): "ambiguous", (d, d): "ambiguous", (b, note): "no_target"}
    refused = {(r.id, r.other): r.reason for r in e.relate_tasks("p", "parent_id", table([(c, b), (d, c), (far, a), (a, a)])).collect()}
    assert refused == {(far, a): "no_source", (a, a): "self"}
    assert {r.id: r.parent_id for r in e.documents("task", "p").collect()} == {a: None, b: a, c: b, d: c}
    assert e.get(d, "p")["title"] == "t3" and e.get(d, "p")["status"] == "open"
    with pytest.raises(EngineError):
        e.relate_tasks("p", "title", table([(a, b)]))
