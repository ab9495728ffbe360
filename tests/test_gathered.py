"""Postings are gathered where a document is read: a row for each of its terms goes to the shuffle, not one for each token."""

import pyarrow as pa
from pyspark.sql import functions as F

from tidepool.operators import index


def test_a_row_for_each_term_of_a_document(spark, monkeypatch):
    monkeypatch.setattr(index, "SLICE_ROWS", 2)
    rows = [(1, "b a b b"), (2, "a"), (3, None), (4, "..."), (5, "b c a a"), (6, "b " * 500)]
    got = index.tokens(spark.createDataFrame(rows, "id long, body string").coalesce(1), "id", F.col("body"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert {(r.key, r.term): (r.length, r.tf, list(r.positions)) for r in got.collect()} == {
        (1, "a"): (4, 1, [1]), (1, "b"): (4, 3, [0, 2, 3]), (2, "a"): (1, 1, [0]), (5, "a"): (4, 2, [2, 3]), (5, "b"): (4, 1, [0]), (5, "c"): (4, 1, [1]), (6, "b"): (500, 500, list(range(500))),
    }
    assert got.count() == 7


def test_sliced_batches():
    whole = pa.RecordBatch.from_arrays([pa.array(["x", "y", "z"]), pa.array([2, 3, 1]), pa.array([7, 8, 9]), pa.array([["a", "b"], ["c", "a", "c"], ["a"]])], names=["key", "length", "region", "_terms"])
    got = index._gathered(whole.slice(1, 2)).to_pylist()
    assert sorted((r["key"], r["region"], r["term"], tuple(r["positions"])) for r in got) == [("y", 8, "a", (1,)), ("y", 8, "c", (0, 2)), ("z", 9, "a", (0,))]
