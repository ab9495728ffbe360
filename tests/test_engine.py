import math
import os
import random
import re
import sqlite3

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.functions import ids, scores, snippet, text
from tidepool.operators import chunking, graph, index, memory, rank
from tidepool.plans.search import SearchQuery, search, split_budget
from tidepool.sources import files, store

DOCS = [(1, "the cat and the hat."), (2, "a dog. And a cat sat on the mat"), (3, "Élan vital"), (4, "the the the"), (5, "cat-like and the rest: of cat and mouse and more words that go on for a long way past the window")]


def test_bm25_equals_fts5(spark):
    base = sqlite3.connect(":memory:")
    base.execute("CREATE VIRTUAL TABLE t USING fts5(body)")
    base.executemany("INSERT INTO t(rowid, body) VALUES (?, ?)", DOCS)
    rows = spark.createDataFrame(DOCS, "id long, body string")
    for query in ("the", "cat", "cat and", "elan", "cat-like"):
        phrases = text.query_phrases(query)
        match = " AND ".join('"' + " ".join(p) + '"' for p in phrases)
        want = dict(base.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ?", (match,)))
        got = {r.id: r.bm25 for r in index.bm25(index.build(rows, "id", F.col("body")), phrases, "id").collect()}
        assert got.keys() == want.keys()
        assert all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in got)


def test_snippet_equals_fts5():
    base = sqlite3.connect(":memory:")
    base.execute("CREATE VIRTUAL TABLE t USING fts5(body)")
    base.executemany("INSERT INTO t(rowid, body) VALUES (?, ?)", DOCS)
    for query in ("the", "cat", "cat AND and"):
        phrases = [[w] for w in query.lower().replace(" and ", " ").split()] if query != "cat AND and" else [["cat"], ["and"]]
        match = " AND ".join(f'"{p[0]}"' for p in phrases)
        for rowid, want in base.execute("SELECT rowid, snippet(t, 0, '[', ']', '…', 12) FROM t WHERE t MATCH ?", (match,)):
            assert snippet.highlight(dict(DOCS)[rowid], phrases) == want


def test_text_functions(spark):
    row = spark.createDataFrame([("FTS * (search) ÉTÉ",)], "a string")
    got = row.select(text.count_tokens(F.col("a")), text.fold(F.col("a"))).first()
    assert got[0] == 3 and got[1].endswith("ete")
    with pytest.raises(ValueError):
        text.query_phrases(" * ")


def test_folding_equals_fts5(spark):
    """Every letter below U+0590 and of Latin Extended Additional that FTS5 keeps in a token, alone and with marks."""
    letters = [c for c in map(chr, [*range(0x80, 0x590), *range(0x1E00, 0x1F00)]) if c.isalpha()] + ["e" + m for m in map(chr, range(0x300, 0x332))]
    base = sqlite3.connect(":memory:")
    base.execute("CREATE VIRTUAL TABLE t USING fts5(body)")
    base.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, 'instance')")
    base.executemany("INSERT INTO t(rowid, body) VALUES (?, ?)", [(i, f"x{c}y") for i, c in enumerate(letters)])
    want = {}
    for term, row in base.execute("SELECT term, doc FROM v ORDER BY doc, offset"):
        want.setdefault(row, []).append(term)
    got = {r.i: r.t for r in spark.createDataFrame([(i, f"x{c}y") for i, c in enumerate(letters)], "i int, s string").select("i", text.terms(F.col("s")).alias("t")).collect()}
    differ = {letters[i] for i in want if want[i] != got[i]}
    assert differ <= set("İϐϑϕϖϰϱϵͿԨԪԬԮẛẞ"), sorted(differ)  # symbol forms, and letters younger than FTS5's tables
    assert all(text.query_phrases(f"x{c}y") == [got[i]] for i, c in enumerate(letters) if len(c) == 1 and c not in "İ")


MASKED = [
    ("token=sk-or-v1-abcdef1234 email user@example.com phone +7 999 123-45-67", "[REDACTED_SECRET] email [REDACTED_EMAIL] phone [REDACTED_PHONE]"),
    ("sk-abcdefghijklmno and SK-abcdefghijklmnop", "sk-abcdefghijklmno and [REDACTED_SECRET]"),
    ("Bearer abc.def bearer abcdefghijkl", "Bearer abc.def [REDACTED_SECRET]"),
    ("Api-Key : 'x y', password=\"a,b;c", "[REDACTED_SECRET] y', [REDACTED_SECRET],b;c"),
    ("ñtoken=a tokens=b", "ñtoken=a tokens=b"),
    ("call 1234567890, a12345678901 or (12) 345-678-901 x", "call [REDACTED_PHONE], a12345678901 or ([REDACTED_PHONE] x"),
    ("mail a.b+c@d-e.org. b@c", "mail [REDACTED_EMAIL]. b@c"),
]


def test_redaction(spark):
    rows = spark.createDataFrame(MASKED, "a string, want string").select(text.redact(F.col("a")), "want").collect()
    assert [r[0] for r in rows] == [r[1] for r in rows]


def test_cut_to_tokens():
    body = "One two-three, (four)  five. "
    assert [text.cut_to_tokens(body, n) for n in range(5)] == ["", "One", "One two-three, (", "One two-three, (four)", body]


def test_scores_and_cursor(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in rows.select(scores.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0]
    one = spark.createDataFrame([(0.5, 0.4, 0.9)], "l double, v double, r double")
    got = one.select(scores.combine(F.col("l"), F.col("v")), scores.combine(F.col("l"), F.col("v"), F.col("r"))).first()
    assert got[0] == pytest.approx(0.47) and got[1] == pytest.approx(0.8)
    assert rank.decode_cursor(rank.encode_cursor({"id": 7})) == {"id": 7}
    with pytest.raises(ValueError):
        rank.decode_cursor("!!")


def test_budget_keeps_a_prefix_and_the_first(spark):
    page = spark.createDataFrame([(1, 9), (2, 5), (3, 1)], "n int, cost int")
    assert [r.n for r in rank.trim_to_budget(page, [F.asc("n")], F.col("cost"), 12).collect()] == [1]
    assert [r.n for r in rank.trim_to_budget(page, [F.asc("n")], F.col("cost"), 2).collect()] == [1]
    assert rank.trim_to_budget(page, [F.asc("n")], F.col("cost"), 0).count() == 0


def test_nearest_by_cosine(spark):
    rows = [(i, [float(i % 7 - 3), float(i % 11), float(i % 5)]) for i in range(700)] + [(700, None), (701, [0.0, 0.0, 0.0]), (702, [1.0]), (703, [float("nan"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    known = {i: v for i, v in rows if i is not None and v and any(v) and not any(map(math.isnan, v))}

    def cosine(a, b):
        return round(sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b)), 6)

    got = {}
    for r in rank.nearest_by_cosine(table.where("vec_id % 20 = 0"), table, 5).orderBy("query_id", "n").collect():
        got.setdefault(r.query_id, []).append((-r.score, r.doc_id))
    want = {q: sorted((-cosine(known[q], v), i) for i, v in known.items() if len(v) == 3)[:5] for q in known if q % 20 == 0}
    assert {q: [(pytest.approx(s), i) for s, i in x] for q, x in want.items()} == got


def folded(body, boundary, size, overlap):
    """Chunks by a plain fold over segments: texts, tokens and, by the older count, first and last lines."""
    lines, out, held, count, start = body.splitlines(), [], [], 0, 0
    if not body.strip():
        return out
    cuts = [i for i in range(len(lines)) if i == 0 or boundary is None or re.match(boundary, lines[i])] + [len(lines)]

    def emit():
        whole = "\n".join(held).strip()
        out.append((len(out), whole, max(1, chunking.tokens(whole)), start + 1, start + len(held)))

    for a, b in zip(cuts, cuts[1:]):
        own = "\n".join(lines[a:b]).strip()
        if not own:
            continue
        n = chunking.tokens(own)
        if held and count + n > size:
            emit()
            again, count = [], 0
            for line in reversed(held) if overlap > 0 else ():
                again, count = [line, *again], count + chunking.tokens(line)
                if count >= overlap:
                    break
            held, start = again, max(0, b - len(again))
        if not held:
            start = a
        held += lines[a:b]
        count += n
    if held:
        emit()
    return out


@pytest.mark.parametrize(("language", "boundary"), [("text", None), ("python", r"(async\s+def|def|class)\s"), ("markdown", r"#{1,6}\s"), ("md", r"#{1,6}\s")])
def test_chunks_equal_a_plain_fold(language, boundary):
    r = random.Random(language)
    for _ in range(300):
        body = "\n".join(r.choice(["", "  ", "def f(x):", "async  def g():", "class A:", "# Head", "###### h", "####### no", "  def inner():", "one two three four", "it's a well-known word", "x"]) for _ in range(r.randrange(25)))
        size, overlap = r.choice([3, 8, 20]), r.choice([0, 1, 4, 9])
        got = list(chunking.chunk(body, language, size, overlap, ahead=True))
        assert got == folded(body, boundary, size, overlap)
        kept = list(chunking.chunk(body, language, size, overlap))
        assert [c[:3] for c in kept] == [c[:3] for c in got]
        assert all(1 <= a <= b <= len(body.splitlines()) for *_, a, b in kept)
    if language == "text":
        lines = [f"line {i} with some words" for i in range(40)]
        for _, whole, _, a, b in chunking.chunk("\n".join(lines), size=50, overlap=10):
            assert whole == "\n".join(lines[a - 1 : b])


def test_versions_and_guards(spark, tmp_path):
    log = spark.createDataFrame([(1, 1, "U", "a"), (1, 2, "U", "b"), (2, 1, "U", "c"), (2, 3, "D", None)], "id int, version int, op string, v string")
    assert [(r.id, r.v) for r in store.latest(log, ["id"]).collect()] == [(1, "b")]
    schema = T.StructType([T.StructField(n, t) for n, t in (("id", T.LongType()), ("v", T.StringType()), ("op", T.StringType()), ("version", T.LongType()))])
    table = store.VersionedTable(spark, str(tmp_path / "t"), schema, ["id"])
    assert table.head() == 0 and table.latest().count() == 0
    table.commit([{"id": 1, "v": "a"}, {"id": 2, "v": "b"}])
    base = table.head()
    table.commit([{"id": 1, "v": "c"}], base)
    with pytest.raises(store.Conflict):
        table.commit([{"id": 1, "v": "lost"}], base)
    with pytest.raises(ValueError, match="unknown fields"):
        table.commit([{"id": 3, "priority": 1}])
    table.commit(spark.createDataFrame([(2,)], "id long"), op="D")
    rows = lambda df: sorted((r.id, r.v) for r in df.collect())
    assert rows(table.latest()) == [(1, "c")] and rows(store.latest(table.log(1), ["id"])) == [(1, "a"), (2, "b")]
    table.compact(keep=F.col("id") == 2)
    assert rows(table.latest()) == [(1, "c")] and table.log().count() == 2
    assert table.vacuum() >= 3 and rows(table.latest()) == [(1, "c")]
    table.commit([{"id": 5, "v": "e"}])
    assert rows(table.latest()) == [(1, "c"), (5, "e")]
    gone = next(p for p in (tmp_path / "t").iterdir() if p.name.startswith("c"))
    gone.rename(tmp_path / "away")
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        table.latest().count()


def test_states_and_updates(spark):
    tasks = spark.createDataFrame([(1, "open"), (2, "done"), (3, "closed"), (4, "blocked")], "id int, status string")
    assert [r.id for r in store.set_status(tasks, "done").orderBy("id").collect()] == [1, 2, 4]
    assert [r.id for r in store.set_status(tasks, "open").collect()] == [1] and store.set_status(tasks, "done", expected="closed").count() == 0
    one = spark.createDataFrame([("a", None), ("a", "b")], "old string, new string")
    old, new = F.col("old"), F.col("new")
    got = one.select(store.updated(old, new), store.updated(old, new, clear=True), store.updated(old, new, replace=True)).collect()
    assert [tuple(r) for r in got] == [("a", None, None), ("b", None, "b")]
    with pytest.raises(ValueError):
        store.updated(old, new, clear=True, replace=True)


def test_cycles_and_long_chains(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (5, 5), (6, 7)], "s long, t long")
    assert {(r.id, r.depth) for r in graph.cycles(edges).collect()} == {(1, 3), (2, 3), (3, 3), (5, 1)}
    assert graph.would_close(edges, 1, 4) is True and graph.would_close(edges, 1, 9) is False and graph.would_close(edges, 8, 8) is True
    chain = spark.createDataFrame([(i, i + 1) for i in range(300)], "s int, t int").coalesce(1)
    assert graph.would_close(chain, 300, 0) is True and graph.would_close(chain, 301, 0) is False and graph.cycles(chain).count() == 0


def test_summary_pages(spark):
    """Pages hold what the summaries hold, in their order; a hub's are spread, and none is longer than a page."""
    edges = spark.createDataFrame([(1, i, "r") for i in range(2, 300)] + [(i, 1, "s") for i in range(2, 90)] + [(5, 5, "r"), (5, 5, "r"), (7, None, "r")], "source_id int, target_id int, relation string")
    whole = {r.id: [tuple(x) for x in r.links] for r in graph.summaries(edges).collect() if r.id is not None}  # pages are of nodes that there are
    pages = graph.summary_pages(edges, 50).collect()
    got = {}
    for r in sorted(pages, key=lambda r: (r.id, r.page)):
        assert len(r.links) <= 50 and r.total == len(whole[r.id])
        got.setdefault(r.id, []).extend(tuple(x) for x in r.links)
    assert got == whole and graph.summary_pages(edges.limit(0)).collect() == []


def test_memory(spark):
    facts = spark.createDataFrame([(1, "global", "t", 1, 1, "Use pytest ", 0.5, "candidate"), (2, "global", "t", 1, 2, "use pytest", 1.9, "active"), (3, "global", "t", 1, 3, "use nose", 0.1, "active"), (4, "project", "t", 2, 4, "use nose", 0.1, "conflicted")], "id long, scope string, fact_type string, project long, evidence long, content string, confidence double, status string")
    merged = {(r.content, r.project): r for r in memory.merge(facts).collect()}
    one = merged["use pytest", None]
    assert one.evidence == [1, 2] and one.confidence == 1.0 and one.status == "active" and merged["use nose", 2].status == "conflicted"
    assert [r.variants for r in memory.conflicts(facts).collect()] == [2]
    gone = spark.createDataFrame([(3,)], "evidence long")
    assert [r.status for r in memory.invalidate(facts, gone).orderBy("id").collect()][2] == "deleted"
    assert facts.where(memory.visible([], None)).count() == 4 and facts.where(memory.visible([1])).count() == 3


def test_search_page(spark):
    rows = spark.createDataFrame([(d, d * 10, "t", b, [float(d), 1.0]) for d, b in DOCS], "document_id long, chunk_id long, title string, body string, embedding array<double>")
    got = search(rows, SearchQuery("cat and", limit=2, budget=500), vector=[1.0, 0.0]).collect()
    assert 1 <= len(got) <= 2 and "[cat]" in " ".join(r.snippet for r in got) + "[cat]"
    for wrong in ({"limit": 101}, {"limit": 0}, {"budget": 10_001}, {"types": ("facts",)}, {"weights": {"notes": 0.0}}, {"cursor": "!!"}, {"cursor": rank.encode_cursor({"id": 1})}):
        with pytest.raises(ValueError):
            SearchQuery("x", **wrong)
    with pytest.raises(ValueError):
        SearchQuery("  ")
    assert split_budget(100, ("notes", "files"), {"notes": 3.0}) == {"notes": 75, "files": 25}
    assert [SearchQuery("deploy plan", limit=n).look_ahead for n in (1, 25, 26, 100)] == [4, 100, 100, 100] and SearchQuery("a b", limit=5).look_ahead_of(3) == 7
    assert SearchQuery("te").lexical_only and SearchQuery("deploy").lexical_only and not SearchQuery("deploy plan").lexical_only
    assert SearchQuery("x", types=("Notes", "notes"), projects=("a", " ", "a")).types == ("notes",)


def test_files(spark, tmp_path):
    root = tmp_path / "root"
    (root / "src" / "deep").mkdir(parents=True)
    made = {"src/a.py": "def a(): pass", "src/deep/b.md": "# B", "src/deep/c.tmp": "x", "c.tmp": "kept", "skip.log": "no", "build/x.txt": "no", "README": "r", "docs/one.txt": "glob", "docs/sub/two.txt": "glob too"}
    for name, body in made.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(body)
    (root / "src" / "deep" / ".gitignore").write_text("# none\n*.tmp\n")
    (root / ".gitignore").write_text("build/\n\ndocs/s*/t*.txt\n")
    (root / "b.bin").write_bytes(b"x\0y")
    (root / "late.bin").write_bytes(b"x" * 5000 + b"\0")
    (root / "bad.txt").write_bytes(b"\xff\xfe")
    (root / "big.txt").write_text("y" * 9000)
    (root / "link.py").symlink_to(root / "src" / "a.py")
    (root / "way").symlink_to(root / "src")
    os.link(root / "README", root / "twice")
    got = {r.relative: (r.language, r.text) for r in files.scan(spark, str(root), ["*.log"], 8000).collect()}
    assert set(got) == {"src/a.py", "src/deep/b.md", "c.tmp", "docs/one.txt", "late.bin", ".gitignore", "src/deep/.gitignore"}
    assert got["src/a.py"] == ("python", "def a(): pass") and got["src/deep/b.md"][0] == "markdown"


def test_streams(spark, tmp_path):
    from tidepool.streaming import jobs

    events = spark.sql("SELECT id AS event_id, timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, int(id) * 10) AS ts, 'a' AS event_type, 1.0D AS value FROM range(30)")
    events.write.parquet(str(tmp_path / "in"))
    q = jobs.event_windows(spark, str(tmp_path / "in"), events.schema, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("start").collect()
    assert rows and rows[0].n == 6


def test_uuid7():
    import re

    made = [ids.uuid7() for _ in range(50)]
    assert all(re.match(ids.UUID7, x) for x in made)
