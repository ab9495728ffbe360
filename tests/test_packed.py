"""Postings are shuffled packed, a row for each slice and folder; what is written equals rows of single postings."""

import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidepool.operators import index


def corpus(n, seed=4):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["the", "Élan", "ß", "名前", "x"]
    return [(i * 7 - 50, " ".join(r.choice(words) if r.random() < 0.6 else "the" for _ in range(r.choice([0, 1, 9, 90])))) for i in range(n)] + [(-9000, None), (-9001, "the " * 700)]


@pytest.mark.parametrize(("folder", "file", "tasks"), [(4096, 1_000_000, 2048), (20, 1_000_000, 2048), (20, 50, 3)])
def test_written_postings_equal_rows(spark, monkeypatch, folder, file, tasks):
    for name, value in (("FOLDER_ROWS", folder), ("FILE_ROWS", file), ("MOST_TASKS", tasks), ("SLICE_ROWS", 37)):
        monkeypatch.setattr(index, name, value)
    frame = spark.createDataFrame(corpus(150), "id long, body string")
    built = index.build(frame, "id", F.col("body"))
    columns = ["term", "region", "key", "tf", "length", "positions"]
    rows = lambda df: sorted((*x[:5], tuple(x[5])) for x in df.select(columns).collect())
    assert rows(built.postings) == rows(index.tokens(frame, "id", F.col("body"), index._parts(frame.count())))
    assert built.postings.where(F.col("bucket") != index._bucket(built.buckets)).count() == 0
    files = built.postings.select("bucket", F.input_file_name().alias("f")).distinct().groupBy("bucket").count()
    assert files.agg(F.max("count")).first()[0] <= built.rows // file + 1


def test_a_row_for_each_slice_and_folder(spark, monkeypatch):
    monkeypatch.setattr(index, "FOLDER_ROWS", 20)
    frame = spark.createDataFrame(corpus(150), "id long, body string").coalesce(1)
    made = index.tokens(frame, "id", F.col("body"), 1, (8, 1)).collect()
    assert sorted(x.place for x in made) == list(range(8))  # before, a row for each term of each document
    assert sum(len(x.postings) for x in made) < 10 * index.tokens(frame, "id", F.col("body")).count()


def test_keys_of_any_type():
    whole = pa.RecordBatch.from_arrays([pa.array([{"p": "a", "i": 1}, None, {"p": None, "i": 3}]), pa.array([2, 3, 1]), pa.array([7, 8, 9], pa.int32()), pa.array([["a", "b"], ["c", "a", "c"], ["a"]]), pa.array([0, 1, 1], pa.int32())], names=["key", "length", "region", "_terms", "_file"])
    got = [r for x in index._packed(whole, 2, 2).column(1) for r in index._unpacked(x.as_py()).to_pylist()]
    want = index._gathered(whole.select([0, 1, 2, 3])).to_pylist()
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_written_index_leaves_no_shuffle_files(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: str(manager.getAllBlocks()).count("shuffle_")
    made = index._postings(spark.createDataFrame(corpus(40), "id long, body string"), "id", F.col("body"), 42, 1)
    time.sleep(2)
    before = shuffles()
    index._write(made, index.new_path(spark, "test-index"))
    for _ in range(100):  # they go in the background
        if shuffles() <= before:
            break
        time.sleep(0.1)
    assert shuffles() <= before
