"""Rounds over links send nothing through the driver."""

from pyspark.sql import functions as F

from tidepool.operators import graph


def test_rounds_broadcast_nothing(spark, monkeypatch):
    plans, real = [], graph.kept

    def kept(df, label):
        plans.append((label, df._jdf.queryExecution().executedPlan().toString()))
        return real(df, label)

    monkeypatch.setattr(graph, "kept", kept)
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5)], "s long, t long")
    asked = spark.createDataFrame([(5, 4), (5, 9), (None, 1), (7, 7)], "s long, t long")
    out = graph.closing(edges, asked)
    plans.append(("closing", out._jdf.queryExecution().executedPlan().toString()))
    assert {(r.s, r.t): r.closes for r in out.collect()} == {(5, 4): True, (5, 9): False, (None, 1): False, (7, 7): True}
    assert [label for label, plan in plans if "Broadcast" in plan] == []
    assert {"trimmed", "marks", "inner"} <= {label for label, _ in plans}


def test_pages_shuffle_links_once_for_each_step(spark, monkeypatch):
    """Equal links go where they were ranged to, not in a shuffle before it, and only ordered links are written."""
    plans, real = [], graph.kept

    def kept(df, label):
        plans.append((label, df._jdf.queryExecution().executedPlan().toString()))
        return real(df, label)

    monkeypatch.setattr(graph, "kept", kept)
    edges = spark.createDataFrame([("a", "b", "r"), ("a", "b", "r"), ("a", "c", "r"), ("b", "a", "q")], "source_id string, target_id string, relation string")
    got = {(r.id, r.page): [tuple(x) for x in r.links] for r in graph.summary_pages(edges, 2).collect()}
    assert got == {("a", 0): [("out", "r", "b"), ("out", "r", "c")], ("a", 1): [("in", "q", "b")], ("b", 0): [("out", "q", "a"), ("in", "r", "a")], ("c", 0): [("in", "r", "a")]}
    assert [label for label, _ in plans] == ["link-order"]
    initial = plans[0][1].split("Initial Plan")[-1]
    assert initial.count("Exchange") == 1
