"""Calls of providers on executors: packing, failures, limits, the engine's queue."""

import time

import pytest

from tidepool import engine as engines
from tidepool.engine import Engine
from tidepool.operators import calls
from tidepool.providers import Egress, Overlong, embed_all


class Lengths:
    """Embeds a text as its length and its place in the request."""

    def __init__(self, wait=0.0):
        self.wait = wait

    def embed(self, texts, model):
        time.sleep(self.wait)
        if any("explode" in t for t in texts):
            raise RuntimeError("what a provider says must not be kept")
        return [[float(len(t)), float(len(texts))] for t in texts]


ROWS = [("a", f"d{i}", 0, f"d{i}#0", "x" * (i + 1)) for i in range(6)] + [("a", "bad", 0, "bad#0", "will explode"), ("a", "bad", 1, "bad#1", "fine"), ("a", "long", 0, "long#0", "y" * 60), ("b", "e", 0, "e#0", "zz"), ("b", "n", 0, "n#0", None)]


def frame(spark):
    return spark.createDataFrame(ROWS, "project string, document_id string, chunk_index int, chunk_id string, chunk_text string")


def asked(spark, provider, **more):
    return calls.embed(frame(spark), provider, "m", ["project", "document_id", "chunk_index"], items=4, characters=50, **more)


def test_requests_fail_alone(spark):
    got = asked(spark, Lengths(), parallel=1).collect()
    assert len(got) == len(ROWS)
    by = {r.chunk_id: r for r in got}
    assert (by["bad#0"].outcome, by["bad#0"].error) == ("error", "RuntimeError")
    assert (by["long#0"].outcome, by["long#0"].error, by["long#0"].call) == ("error", "Overlong", None)
    assert all(r.outcome == "embedded" for r in got if r.document_id not in ("bad", "long"))
    assert by["d3#0"].vector[0] == 4.0 and by["n#0"].vector == [0.0, 2.0]  # its request holds the other text of b, none of a
    assert by["d2#0"].call == by["d5#0"].call != by["e#0"].call
    state = {r.document_id: (r.state, r.error) for r in calls.states(asked(spark, Lengths(), parallel=3)).collect()}
    assert state == {**{f"d{i}": ("ready", None) for i in range(6)}, "bad": ("error", "RuntimeError"), "long": ("error", "Overlong"), "e": ("ready", None), "n": ("ready", None)}
    with pytest.raises(Overlong):
        embed_all(Lengths(), ["x" * 200_001], "m")


def test_time_budget(spark):
    got = asked(spark, Lengths(0.3), parallel=1, seconds=0.1).collect()
    outcome = {r.chunk_id: r.outcome for r in got}
    first = {"bad#0": "error", "bad#1": "error", "d0#0": "embedded", "d1#0": "embedded", "long#0": "error"}  # the one request begun in time, seen through
    assert outcome == {r[3]: first.get(r[3], "left") for r in ROWS}
    state = calls.states(spark.createDataFrame(got, calls.ASKED))
    assert {r.document_id for r in state.where("state = 'pending'").collect()} == {"d2", "d3", "d4", "d5", "e", "n"}


def test_numbers(spark):
    sizes = [(g, i, (i * 37 + g) % 60 if i % 9 else None) for g in range(3) for i in range(80)]
    got = {(r.g, r.i): r.batch for r in calls.numbered(spark.createDataFrame(sizes, "g int, i int, n int"), ["g"], ["i"], calls.F.col("n"), 5, 100).collect()}
    for g in range(3):
        batch, held, room = 0, 0, 0
        for _, i, n in [x for x in sizes if x[0] == g]:
            if held and (held == 5 or room + (n or 0) > 100):
                batch, held, room = batch + 1, 0, 0
            held, room = held + 1, room + (n or 0)
            assert got[g, i] == batch
    assert calls.numbered(spark.createDataFrame([], "g int, i int, n int"), ["g"], ["i"], calls.F.col("n")).collect() == []


def test_queue(spark, tmp_path, monkeypatch):
    e = Engine(spark, str(tmp_path / "s"), embedder=Lengths(), embedding_model="one", egress=Egress(True, ["*"]))
    first, second = e.add("note", "a", "n", "river"), e.add("note", "a", "n", "tool")
    plain = calls.embed

    def meanwhile(*given):
        e.update(second, "a", body="written while it was asked")
        return plain(*given)

    monkeypatch.setattr(engines.calls, "embed", meanwhile)
    e.drain("a")
    monkeypatch.undo()
    assert e.pending("a") == [second]  # its new text is not embedded yet
    assert [r.document_id for r in e.latest("embeddings").collect()] == [first]
    assert e.drain("a", None) == 1 and e.mark_stale("a") == 0
    e.embedding_model = "two"
    assert e.mark_stale("a") == 2 and {r.state for r in e.latest("queue").collect()} == {"stale"}
    assert e.drain("a", None) == 2 and e.latest("embeddings").count() == 4 and e.pending("a") == []
    assert {r.entity_type for r in e.latest("events").collect()} == {"provider"}
