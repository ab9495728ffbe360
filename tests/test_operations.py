"""The engine's operations, with deterministic providers."""

import json

import pytest

from tidepool import config, metadata, providers
from tidepool.engine import Engine, EngineError
from tidepool.plans.search import SearchQuery
from tidepool.providers import Egress


class Words:
    """Embeds a text as the counts of a few words."""

    calls = 0

    def embed(self, texts, model):
        Words.calls += 1
        if any("explode" in t for t in texts):
            raise RuntimeError("provider text that must not be kept")
        return [[1.0 + t.lower().count(w) for w in ("release", "river", "tool")] for t in texts]


class Extractor:
    def __init__(self, facts=None, title="Tools"):
        self.facts, self.title, self.seen = facts, title, []

    def extract_facts(self, transcript, evidence, model):
        self.seen.append(transcript)
        return self.facts if self.facts is not None else [{"content": "User prefers pytest", "confidence": 7}, {"content": " "}, {"content": "x", "scope": "chat"}, {"content": "y", "confidence": True}]

    def summarize_scenario(self, contents, evidence, model):
        return {"title": self.title, "summary": "About " + ", ".join(contents)}


def refused(code, call, *args, **kwargs):
    with pytest.raises(EngineError) as caught:
        call(*args, **kwargs)
    assert caught.value.code == code


@pytest.fixture(autouse=True)
def tiny(spark):
    """Tables of a few rows: one partition, and plans interpreted, not compiled."""
    small = {"spark.sql.shuffle.partitions": "1", "spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path / "store"), embedder=Words(), embedding_model="w", egress=Egress(True, ["*"]))


def test_notes_and_links(engine):
    e = engine
    note = e.add("note", "a", "Deploy plan", "ship the release on friday", source="cli", source_ref="r1", pinned=True, metatags={"k": 1})
    other = e.add("note", "b", "Elsewhere", "another project")
    got = e.get(note, "a")
    assert (got["source"], got["source_ref"], got["pinned"], got["metatags"]) == ("cli", "r1", True, {"k": 1})
    refused("invalid", e.add, "note", "a", "t", priority=3)
    refused("invalid", e.add, "note", "a", " ")
    refused("not_found", e.get, note, "b")
    e.update(note, "a", title="Deploy plan v2", clear=("pinned",))
    got = e.get(note, "a")
    assert got["title"] == "Deploy plan v2" and got["pinned"] is None and got["body"].startswith("ship")
    refused("invalid", e.update, note, "a", clear=("title",), title="x")
    refused("not_found", e.link, "a", note, other)
    second = e.add("note", "a", "Second", "text")
    refused("invalid", e.link, "a", note, second, "relates_to")
    e.link("a", note, second, "implements")
    assert [r.kind for r in e.links("a", second).collect()] == ["implements"]
    page, cursor = e.list("note", "a", limit=1, view="full")
    assert page[0]["id"] == second and page[0]["links"] == [{"direction": "in", "relation": "implements", "other": note}] and cursor
    rest, end = e.list("note", "a", limit=1, cursor=cursor)
    assert rest[0]["id"] == note and end is None
    refused("invalid", e.list, "note", "a", cursor="!!")
    e.unlink("a", note, second, "implements")
    assert e.links("a", note).count() == 0
    assert e.latest("chunks").where(f"document_id = '{note}'").first().chunk_text == "ship the release on friday"


def test_tasks(engine):
    e = engine
    task = e.add("task", "a", "write docs", priority=2, due_at="2024-05-01")
    got = e.get(task, "a")
    assert (got["body"], got["status"], got["priority"]) == ("write docs", "open", 2)
    first = e.upsert_task("a", "work-42", "t1", priority=1)
    assert e.upsert_task("a", "work-42", "t2") == first
    got = e.get_by_external_key("work-42", "a")
    assert got["title"] == "t2" and got["priority"] is None
    refused("conflict", e.add, "task", "a", "again", external_key="work-42")
    refused("invalid", e.set_status, task, "a", "blocked")
    e.set_status(task, "a", "blocked", blocked_reason="waits")
    started = e.get(task, "a")["started_at"]
    refused("conflict", e.set_status, task, "a", "open")
    refused("conflict", e.set_status, task, "a", "done", expected="open")
    e.done(task, "a")
    got = e.get(task, "a")
    assert got["started_at"] == started and got["completed_at"] and got["blocked_reason"] is None
    e.set_status(task, "a", "closed")
    refused("conflict", e.set_status, task, "a", "done")
    e.update(first, "a", parent_id=task)
    refused("conflict", e.update, task, "a", parent_id=first)
    refused("invalid", e.update, task, "a", blocked_by_id=task)
    refused("not_found", e.update, task, "a", blocked_by_id="nobody")
    e.update(first, "a", clear=("parent_id",))
    assert e.get(first, "a")["parent_id"] is None


def test_search_over_kinds(spark, engine):
    e = engine
    note = e.add("note", "a", "Deploy plan", "ship the release on friday, the release of tools")
    task = e.add("task", "a", "Plan the release", "for friday")
    entry = e.append_history("a", "decision", "we release on friday after lunch", actor="agent")
    e.add("note", "b", "Other", "release friday in another project")
    got = e.search(SearchQuery("release friday", budget=2000), ["a"], explain=True, view="full")
    assert {(r["type"], r["id"]) for r in got["results"]} == {("notes", note), ("tasks", task), ("history", entry)}
    assert [r["score"] for r in got["results"]] == sorted((r["score"] for r in got["results"]), reverse=True)
    assert got["stats"]["candidate_counts"] == {"notes": 1, "tasks": 1, "history": 1, "files": 0} and got["next_cursor"] is None
    shown = {r["type"]: r for r in got["results"]}
    assert shown["history"]["title"] == "decision · agent" and json.loads(shown["tasks"]["attributes"]) == {"status": "open", "priority": None}
    assert "[release]" in shown["notes"]["snippet"]
    first = e.search(SearchQuery("release friday", limit=1, budget=2000), ["a"])
    second = e.search(SearchQuery("release friday", limit=5, budget=2000, cursor=first["next_cursor"]), ["a"])
    assert first["results"] + second["results"] == [{k: v for k, v in r.items() if k != "attributes"} for r in got["results"]]
    assert e.search(SearchQuery("release friday", limit=5, budget=1), ["a"])["count"] == 1
    assert {r["project"] for r in e.search(SearchQuery("release friday", types=("notes",)), ["a", "b"])["results"]} == {"a", "b"}
    Words.calls = 0
    e.search(SearchQuery("te"), ["a"])
    assert Words.calls == 0  # short queries ask nobody


def test_embedding_queue(engine):
    e = engine
    good, bad = e.add("note", "a", "n", "a river"), e.add("note", "a", "n", "will explode")
    assert e.pending("a") == [good, bad]
    assert e.drain("a", 8) == 2 and e.pending("a") == []
    assert {r.document_id: (r.state, r.error) for r in e.latest("queue").collect()} == {good: ("ready", None), bad: ("error", "RuntimeError")}
    assert e.health()["index_errors"] == 1
    e.update(bad, "a", body="calm now")
    assert e.pending("a") == [bad] and e.drain("a") == 1
    assert e.latest("embeddings").where(f"document_id = '{good}'").first().vector == [1.0, 2.0, 1.0]
    e.egress = Egress(True, ["b"])
    e.update(good, "a", body="the tool")
    assert e.drain("a") == 0 and e.pending("a") == [good]


def test_file_index(engine, tmp_path):
    e, root = engine, tmp_path / "tree"
    (root / "src").mkdir(parents=True)
    (root / "src" / "app.py").write_text("def deploy():\n    return 'hello'\n")
    (root / "readme.md").write_text("# Deploy\nhello there\n")
    (root / "old.txt").write_text("goes away")
    assert e.index_files(str(root), "a") == {"indexed": 3, "deleted": 0, "count": 3}
    assert e.index_files(str(root), "a") == {"indexed": 0, "deleted": 0, "count": 0}
    before = e.get_file(f"{root}/src/app.py", "a")
    fact = e.capture("a", "goes", "note", evidence=(e.get_file(f"{root}/old.txt", "a")["id"] + "#0",))
    (root / "src" / "app.py").write_text("def deploy():\n    return 'bye'\n")
    (root / "old.txt").unlink()
    assert e.index_files(str(root), "a") == {"indexed": 1, "deleted": 1, "count": 2}
    after = e.get_file(f"{root}/src/app.py", "a")
    assert after["id"] == before["id"] and after["created_at"] == before["created_at"] and after["content_hash"] != before["content_hash"]
    refused("not_found", e.get_file, f"{root}/old.txt", "a")
    assert e._fact(fact, "a")["status"] == "deleted"
    assert e.file_roots("a") == [str(root)]
    assert [f["path"] for f in e.list("file", "a", language="python")[0]] == [f"{root}/src/app.py"]
    assert [f["path"] for f in e.list("file", "a", path_prefix=f"{root}/r")[0]] == [f"{root}/readme.md"]
    got = e.search(SearchQuery("deploy", types=("files",)), ["a"])["results"]
    assert {r["title"] for r in got} == {f"{root}/src/app.py", f"{root}/readme.md"} and "bye" in str(got)
    assert e.reindex_files(str(root), "a")["indexed"] == 2 and e.pending("a") == []


def test_memory(engine):
    e = engine
    note = e.add("note", "a", "n", "about tools")
    fact = e.capture("a", "Uses pytest", "tool", evidence=(note,), status="active", confidence=0.4)
    assert e.capture("a", " uses PYTEST ", "tool", evidence=("x",), confidence=0.9) == fact
    row = e._fact(fact, "a")
    assert row["evidence"] == [note, "x"] and row["confidence"] == 0.9 and row["status"] == "active"
    refused("invalid", e.capture, "a", "y", "tool", status="active")
    refused("invalid", e.capture, "a", "y", "tool", scope="chat")
    refused("invalid", e.capture, "a", "y", "tool", confidence=1.5)
    refused("invalid", e.capture, "a", "y", "tool", valid_from="2024-02", valid_until="2024-01")
    said = e.capture("a", "Said once", "talk", scope="chat", chat="c1")
    assert e.capture("a", "said once", "talk", scope="chat", chat="c1") == said and e.capture("a", "said once", "talk", scope="chat", chat="c2") != said
    fresh = e.capture("a", "Uses nose", "tool", evidence=(note,), status="active", supersedes_id=fact)
    assert e._fact(fact, "a")["status"] == "superseded" and [r.id for r in e.recall("nose", "a").collect()] == [fresh]
    refused("invalid", e.set_fact_status, fact, "a", "active")
    refused("conflict", e.set_fact_status, fresh, "a", "conflicted", "candidate")
    assert e.recall("nose", "b").count() == 0
    e.promote(fresh, "a", "global")
    assert [r.project for r in e.recall("nose", "b").collect()] == ["a"]
    scenario = e.add_scenario("a", "Tool choice", "which nose tool", (fresh,), (note,))
    assert e.add_scenario("a", "Again", "the same evidence", (), (note, note)) == scenario
    text = e.context("nose", "a", budget=60)
    assert text["context"].split("\n") == ["<memory>", "Project: a", "- [scenario/project] Tool choice: which nose tool", "- [global/tool] Uses nose", "</memory>"] and (text["count"], text["scenario_count"]) == (1, 1)
    short = e.context("nose", "a", budget=7)
    assert short["scenario_count"] == 0 and short["context"].split("\n")[2] == "- [global/tool] Uses"
    assert [(r["kind"], r["found"]) for r in e.evidence(fresh, "a")] == [("note", True)]
    assert e.metrics("a")["facts"] == {"superseded": 1, "active": 1, "candidate": 2}
    e.delete(note, "a")
    assert e._fact(fresh, "a")["status"] == "deleted" and e.projects() == []


def test_extraction(spark, tmp_path):
    taught = Extractor()
    e = Engine(spark, str(tmp_path / "s"), extractor=taught, extraction_model="m", batch=2, interval_seconds=10_000)
    first = e.append_history("a", "turn", "User prefers pytest, token=abc mail x@y.org")
    assert e.preview("a")["entries"] == [{"id": first, "entry_type": "turn", "payload": "User prefers pytest, [REDACTED_SECRET] mail [REDACTED_EMAIL]"}] and not e.preview("a")["allowed"]
    refused("denied", e.extract, "a")
    assert e.checkpoint("a")["status"] == "error"
    e.egress = Egress(True, ["a"])
    got = e.extract("a")
    assert (got["processed"], got["facts"]) == (1, 1) and "token" not in taught.seen[0] and got["scenario"]
    fact = e.latest("facts").first()
    assert (fact.status, fact.confidence, fact.evidence) == ("active", 1.0, [first])
    state = e.checkpoint("a")
    assert (state["status"], state["processed"], state["mark_id"]) == ("completed", 1, first) and e.extract("a")["processed"] == 0
    taught.facts = [{"content": f"f{i}"} for i in range(21)]
    e.append_history("a", "turn", "second")
    assert e.checkpoint("a")["processed"] == 1  # one entry is not a batch yet
    refused("provider", e.extract, "a")
    state = e.checkpoint("a")
    assert state["status"] == "error" and state["mark_id"] == first and "second" not in state["last_error"]
    taught.facts = []
    e.append_history("a", "turn", "third")
    state = e.checkpoint("a")
    assert (state["status"], state["processed"]) == ("completed", 3) and e.latest("triggers").first().pending == 0
    outcomes = [json.loads(r.payload)["outcome"] for r in e.latest("events").orderBy("version").collect()]
    assert outcomes == ["completed", "error", "completed"]


def test_history_stream(spark, tmp_path):
    from tidepool.streaming import jobs

    e = Engine(spark, str(tmp_path / "s"), extractor=Extractor([]), egress=Egress(True, ["*"]))
    rows = spark.createDataFrame([("a", "turn", "one", "u"), ("b", "turn", "two", "u"), ("a", "turn", " ", "u")], "project string, entry_type string, payload string, actor string")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        jobs.extract_history(spark, str(tmp_path / "in"), rows.schema, e, str(tmp_path / "cp")).awaitTermination()
    assert sorted((r.project, r.body) for r in e.documents("history").collect()) == [("a", "one"), ("b", "two")]
    assert e.checkpoint("a")["processed"] == 1 and e.latest("chunks").count() == 2


def test_upkeep(engine):
    e = engine
    note, gone = e.add("note", "a", "n", "kept"), e.add("note", "a", "n", "gone")
    e.delete(gone, "a")
    at = e.tables["documents"].log().where("op = 'D'").first().updated_at
    e.purge(before="2000-01-01")
    assert e.tables["documents"].log().where("op = 'D'").count() == 1
    e.purge(project="b", before=at)
    assert e.tables["documents"].log().where("op = 'D'").count() == 1
    assert e.compact("a", at, rebuild=True)["documents"] == 1 and e.tables["documents"].log().where("op = 'D'").count() == 0
    assert e.get(note, "a")["body"] == "kept" and e.search(SearchQuery("kept"), ["a"])["count"] == 1
    assert e.maintain_if_due() is True and e.maintain_if_due() is False
    assert e.health()["pending_migrations"] == ["task_keys", "quarantine_links"]
    one, two, three = (e.add("task", "a", t, source_ref=r) for t, r in (("t1", "k1"), ("t2", "k2"), ("t3", "k2")))
    e.commit("links", [{"project": "a", "source_id": note, "target_id": "nobody", "kind": "related"}])
    assert e.migrate() == ["task_keys", "quarantine_links"] and e.migrate() == []
    assert e.get(one, "a")["external_key"] == "k1" and e.get(two, "a")["external_key"] is None and e.get(three, "a")["external_key"] is None
    assert e.latest("links").count() == 0 and e.latest("events").where("event_type = 'quarantined'").count() == 1
    assert "search" in e.capabilities()["operations"]


def test_providers():
    assert [len(b) for b in providers.batches(["aaaa"] * 5, items=2)] == [2, 2, 1] and list(providers.batches(["aaaa", "b", "cccccc", "d"], characters=5)) == [["aaaa", "b"], ["cccccc"], ["d"]]
    assert providers.rerank_scores('noise {"scores": [0.5, 1]} end', 2) == [0.5, 1.0]
    assert providers.rerank_scores({"results": [{"index": 1, "relevance_score": 0.2}, {"index": 0, "relevance_score": 0.9}]}, 2) == [0.9, 0.2]
    assert providers.rerank_scores({"results": [{"index": 0, "rank": 3}, {"index": 1, "rank": 1}]}, 2) == [0.0, 1.0] and providers.ranks_to_scores([2, 2]) == [1.0, 1.0]
    for wrong in ([1.0], [float("nan"), 1.0], ["a", "b"], {"results": [{"index": 0, "score": 1}, {"index": 0, "score": 1}]}, "none", [True, 1.0]):
        with pytest.raises(ValueError):
            providers.rerank_scores(wrong, 2)


def test_metadata_and_config(tmp_path):
    fields = {"n": "integer", "x": "number", "s": "string", "b": "boolean", "a": "array", "o": "object"}
    metadata.validate({"n": 1, "x": 1.5, "s": "", "b": True, "a": [], "o": {}}, fields, ("n",), allow_extra=False)
    for wrong in ({"n": True}, {"x": True}, {"n": 1.0}, {"s": 1}, {"b": 1}, {"a": {}}, {"o": []}, {}, {"n": 1, "more": 1}):
        with pytest.raises(ValueError):
            metadata.validate(wrong, fields, ("n",) if "n" not in wrong and not wrong else (), allow_extra=False)
    assert metadata.parsed("{bad") == metadata.parsed("[1]") == metadata.parsed(None) == {} and metadata.parsed('{"a": 1}') == {"a": 1}
    path = tmp_path / "c.toml"
    assert config.init(path) and not config.init(path) and config.get(path, "search.limit") == 20
    assert config.set_(path, "search.limit", "30") == 30 and config.set_(path, "provider.external", "true") is True and config.set_(path, "filesystem.ignore", "a, b") == ["a", "b"]
    with path.open("a") as out:
        out.write('\n[profiles.work.search]\nlimit = 7\n[profiles.work.provider]\nprojects = ["x \\"y\\""]\n')
    assert config.get(path, "search.limit") == 30 and config.get(path, "search.limit", "work") == 7 and config.get(path, "provider.projects", "work") == ['x "y"']
    config.save(path, config.load_raw(path))
    assert config.get(path, "provider.projects", "work") == ['x "y"'] and config.get(path, "provider.external", "work") is True
    for wrong in (lambda: config.get(path, "no.key"), lambda: config.load(path, "none"), lambda: config.set_(path, "search.limit", "x"), lambda: config.set_(path, "provider.external", "1")):
        with pytest.raises((KeyError, ValueError)):
            wrong()


def test_commands(spark, tmp_path):
    from tidepool import cli

    root = ["--root", str(tmp_path / "r")]
    note = cli.run(["notes", "add", *root, "--project", "a", "--title", "T", "--body", "rain on the harbour", "--pinned", "true"], spark)
    assert note["ok"] and note["command"] == "notes add" and note["meta"]["duration_ms"] >= 0
    page = cli.run(["notes", "list", *root, "--project", "a"], spark)["data"]
    assert page["count"] == 1 and page["items"][0]["pinned"] is True and page["next_cursor"] is None
    found = cli.run(["search", *root, "--project", "a", "--query", "harbour rain", "--limit", "3"], spark)["data"]
    assert [r["id"] for r in found["results"]] == [note["data"]]
    codes = [cli.run(words, spark)["error"]["code"] for words in (["notes", "get", *root, "--key", "no", "--project", "a"], ["notes", "fly", *root], ["notes", "add", *root, "--size", "1"], ["search", *root, "--project", "a", "--query", " "], ["notes", "list", "--limit"])]
    assert codes == ["not_found", "invalid", "invalid", "invalid", "invalid"]
    assert cli.run(["config", "init", *root])["data"] is True and cli.run(["config", "set", *root, "--key", "search.limit", "--text", '"5"'])["data"] == 5 and cli.run(["config", "get", *root, "--key", "no.key"])["error"]["code"] == "not_found"
    assert set(cli.NAMED[c][0] for c in cli.NAMED) <= set(cli.run(["capabilities", *root], spark)["data"]["operations"])
