"""Calls of outside models on executors: requests packed by two limits, retries, a time budget, and what was asked as rows."""

from __future__ import annotations

import pickle
import sys
import time
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..providers import BATCH_CHARACTERS, BATCH_ITEMS, Overlong, Room, embedded

ASKED = "project string, document_id string, chunk_id string, vector array<double>, outcome string, error string, call bigint"


def shipped(provider: object) -> bytes:
    """The provider for executors, its class by value: executors needn't be able to import the module that defines it."""
    module = sys.modules.get(type(provider).__module__)
    if module is None or module.__name__ == "__main__" or module.__name__ in cloudpickle.list_registry_pickle_by_value():
        return cloudpickle.dumps(provider)
    cloudpickle.register_pickle_by_value(module)
    try:
        return cloudpickle.dumps(provider)
    finally:
        cloudpickle.unregister_pickle_by_value(module)


def numbered(rows: DataFrame, group: list[str], order: list[str], size: Column, items: int = BATCH_ITEMS, characters: int = BATCH_CHARACTERS) -> DataFrame:
    """(group, order, batch): which request of its group each row goes into, in order, from 0.

    A request takes rows until one more would exceed the number of items or of characters; a row that alone has more is a
    request of its own (null sizes count as none). Groups are folded as a stream of sorted rows, each by one task, so they
    should be of bounded size: a part of a source rather than a source.
    """
    keys = [*group, *order]
    sorted_rows = rows.select(*keys, F.coalesce(size, F.lit(0)).cast("bigint").alias("_size")).repartition(*group).sortWithinPartitions(*keys)

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        room, at, batch = Room(items, characters), None, 0
        for frame in frames:
            out = []
            for own, n in zip(frame[group].itertuples(index=False, name=None), frame["_size"].tolist(), strict=True):
                if own != at:
                    room, at, batch = Room(items, characters), own, 0
                batch += room.full(n)
                out.append(batch)
            yield frame[keys].assign(batch=out)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sorted_rows.schema.fields[:-1])
    return sorted_rows.mapInPandas(fold, f"{schema}, batch bigint")


def embed(rows: DataFrame, provider: object, model: str, order: list[str], seconds: float | None = None, attempts: int = 2, parallel: int = 8, items: int = BATCH_ITEMS, characters: int = BATCH_CHARACTERS) -> DataFrame:
    """The answer for each row (project, document_id, chunk_id, chunk_text): ``ASKED``. Read it once, or write it: every
    reading asks again.

    Rows are dealt in order to ``parallel`` tasks, which is how many requests are under way at once; a long document spans
    as many as it fills. Each task packs its rows in order, a request holding texts of one project only. A request that
    fails is tried again, then each of its documents apart, so that one bad text does not fail others. ``outcome`` is
    embedded, error (with the kind of error, never its text), or left: not asked, as ``seconds`` had passed since the task's
    first request; a request once begun is seen through. Texts above the limit of characters are refused without a call.
    ``call`` tells requests apart and is null without one.
    """
    held = shipped(provider)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model_at, began = pickle.loads(held), None
        place, calls = TaskContext.get().partitionId() << 33, 0

        def ask(batch: list[tuple], begun: bool = False) -> list[tuple]:
            nonlocal calls, began
            began = time.monotonic() if began is None else began
            if seconds is not None and calls and not begun and time.monotonic() - began >= seconds:
                return [(*r[:3], None, "left", None, None) for r in batch]
            error = ""
            for attempt in range(attempts):
                calls += 1
                try:
                    vectors = embedded(model_at, [r[3] for r in batch], model)
                    return [(*r[:3], [float(x) for x in v], "embedded", None, place + calls) for r, v in zip(batch, vectors, strict=True)]
                except Exception as raised:  # whatever a provider raises
                    error = type(raised).__name__
                    if attempt + 1 < attempts:
                        time.sleep(0.05 * 2**attempt)
            documents = list(dict.fromkeys(r[1] for r in batch))
            if len(documents) > 1:
                return [x for d in documents for x in ask([r for r in batch if r[1] == d], True)]
            return [(*r[:3], None, "error", error, place + calls) for r in batch]

        names = ["project", "document_id", "chunk_id", "vector", "outcome", "error", "call"]
        room, batch = Room(items, characters), []
        for frame in frames:
            for row in frame.itertuples(index=False, name=None):
                if len(row[3]) > characters:
                    yield pd.DataFrame([(*row[:3], None, "error", Overlong.__name__, None)], columns=names).astype({"call": "Int64"})
                    continue
                apart = bool(batch) and batch[-1][0] != row[0]
                if apart:
                    room = Room(items, characters)
                if room.full(len(row[3])) or apart:
                    yield pd.DataFrame(ask(batch), columns=names).astype({"call": "Int64"})
                    batch = []
                batch.append(row)
        if batch:
            yield pd.DataFrame(ask(batch), columns=names).astype({"call": "Int64"})

    dealt = rows.withColumn("chunk_text", F.coalesce("chunk_text", F.lit(""))).repartitionByRange(parallel, *order).sortWithinPartitions(*order)
    return dealt.select("project", "document_id", "chunk_id", "chunk_text").mapInPandas(work, ASKED)


def states(asked: DataFrame) -> DataFrame:
    """(project, document_id, state, error): ready if all of a document's rows are embedded, in one length; error if any
    failed; pending if any is left."""
    lengths = F.count_distinct(F.size("vector"))
    found = asked.groupBy("project", "document_id").agg(F.max("error").alias("error"), F.max(F.col("outcome") == "left").alias("_left"), lengths.alias("_lengths"))
    error = F.coalesce("error", F.when(F.col("_lengths") > 1, "ValueError"))
    return found.select("project", "document_id", F.when(error.isNotNull(), "error").when(F.col("_left"), "pending").otherwise("ready").alias("state"), error.alias("error"))
