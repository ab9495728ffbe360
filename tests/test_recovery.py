"""Runs that stop between commits: the next run leaves the tables as if none had stopped."""

import pytest

from tidepool.engine import Engine
from tidepool.plans.search import SearchQuery
from tidepool.providers import Egress
from tidepool.streaming import jobs

from test_operations import Extractor, tiny  # noqa: F401  the fixture of small plans


class Stopped(Exception):
    pass


def stopping(engine, at):
    """The engine, whose commit number ``at`` (from 1) fails before anything is written."""
    real, count = engine.commit, [0]

    def commit(*args, **kwargs):
        count[0] += 1
        if count[0] == at:
            raise Stopped
        return real(*args, **kwargs)

    engine.commit = commit
    return engine


def files_state(e):
    docs = sorted((r.path, r.content_hash) for r in e.documents("file").collect())
    return docs, sorted((r.title, r.chunk_index, r.chunk_text) for r in e.latest("chunks").collect()), sorted(r.state for r in e.latest("queue").collect()), e.latest("embeddings").count()


def test_file_index_at_every_commit(spark, tmp_path):
    """A stop at any commit loses no file, and leaves none behind."""
    root = tmp_path / "tree"
    root.mkdir()
    for at in (2, 4, 6):  # among the chunks that go, the chunks that come, the files' own rows
        (root / "a.py").write_text("def deploy():\n    return 'hello'\n")
        (root / "b.txt").write_text("goes away")
        e = Engine(spark, str(tmp_path / f"s{at}"))
        e.index_files(str(root), "p")
        fact = e.capture("p", "rests on b", "note", evidence=(e.get_file(f"{root}/b.txt", "p")["id"],))
        (root / "a.py").write_text("def deploy():\n    return 'changed'\n")
        (root / "b.txt").unlink()
        (root / "c.md").write_text("# New\nfile\n")
        with pytest.raises(Stopped):
            stopping(Engine(spark, str(tmp_path / f"s{at}")), at).index_files(str(root), "p")
        e.index_files(str(root), "p")
        docs, chunks, queue, _ = files_state(e)
        assert [p for p, _ in docs] == [f"{root}/a.py", f"{root}/c.md"], at
        assert [t for t, _, _ in chunks] == [f"{root}/a.py", f"{root}/c.md"] and "changed" in str(chunks) and len(queue) == 2, at
        assert e._fact(fact, "p")["status"] == "deleted", at
        (root / "c.md").unlink()
    assert len(e.search(SearchQuery("deploy", types=("files",)), ["p"])["results"]) == 1


@pytest.mark.parametrize("at", [1, 2, 4])
def test_history_stream_at_every_commit(spark, tmp_path, at):
    """A batch that is run again adds what is missing and nothing twice."""
    e = Engine(spark, str(tmp_path / "s"), extractor=Extractor([{"content": "learned"}]), egress=Egress(True, ["*"]))
    rows = spark.createDataFrame([("a", "turn", "one", "u"), ("a", "turn", "one", "u"), ("b", "turn", "two", "u")], "project string, entry_type string, payload string, actor string")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    run = lambda engine: jobs.extract_history(spark, str(tmp_path / "in"), rows.schema, engine, str(tmp_path / "cp")).awaitTermination()
    with pytest.raises(Exception, match="Stopped"):
        run(stopping(Engine(spark, e.root, extractor=e.extractor, egress=e.egress), at))
    run(e)
    assert sorted((r.project, r.body) for r in e.documents("history").collect()) == [("a", "one"), ("a", "one"), ("b", "two")]
    assert e.latest("chunks").count() == 3 == e.latest("queue").count()
    assert (e.checkpoint("a")["processed"], e.checkpoint("b")["processed"]) == (2, 1)
    assert sorted(r.project for r in e.latest("facts").collect()) == ["a", "b"]


def test_the_backlog_drains(spark, tmp_path):
    """More rows than one extraction takes are all taken up with their batch."""
    e = Engine(spark, str(tmp_path / "s"), extractor=Extractor([]), egress=Egress(True, ["*"]))
    rows = spark.createDataFrame([("a", "turn", f"row {i}", "u") for i in range(45)], "project string, entry_type string, payload string, actor string")
    e.append_history_rows(rows, {"job": 0})
    e.append_history_rows(rows, {"job": 0})
    e.flush("a")
    assert e.documents("history").count() == 45 == e.checkpoint("a")["processed"]
    e.tables["documents"].compact()
    e.append_history_rows(rows, {"job": 0})  # the batch is known after compaction too
    assert e.documents("history").count() == 45


def test_a_batch_is_committed_once(spark, tmp_path):
    from tidepool.engine import KEYS, SCHEMAS
    from tidepool.sources.store import VersionedTable

    t = VersionedTable(spark, str(tmp_path / "t"), SCHEMAS["settings"], KEYS["settings"])
    row = [{"scope": "s", "name": "n", "value": "1"}]
    assert (t.commit(row, batches={"w": 4}), t.commit(row, batches={"w": 4}), t.commit(row, batches={"w": 3}), t.commit(row, batches={"v": 3})) == (1, 0, 0, 2)
    assert t.batches() == {"w": 4, "v": 3} and t.batch("w", 4).count() == 1 and t.batch("w", 5) is None
    assert t.since(1).count() == 1 and t.since(2).count() == 0
    t.compact()
    assert t.batches() == {"w": 4, "v": 3} and t.since(1) is None and t.since(3).count() == 0
