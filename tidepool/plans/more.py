"""Further named queries: sinks, projections, sets, scalar functions, retrieval steps, streams; each beside SQL with the same rows."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import metadata, providers
from ..functions import scores, text
from ..operators import calls, chunking, graph, index, memory, rank
from ..sources import datasets, store
from ..sources.datasets import read
from ..sources.work import hadoop, kept, new_path
from ..streaming import jobs
from .catalog import COSINE, FACTS, TASKS, THE_AND, big, found, indexed, query
from .search import SearchQuery, entity_hits, split_budget, unified_page

TOKEN = "[\\p{L}\\p{N}]+(?:[-''][\\p{L}\\p{N}]+)*"


def accepted(check, *given) -> bool:
    """Whether a check of the library lets something pass."""
    try:
        check(*given)
    except ValueError:
        return False
    return True


def tokens_sql(body: str) -> str:
    return f"len(regexp_extract_all({body}, '{TOKEN}'))"


# Sources and sinks.


@query("""SELECT key, version, price FROM (SELECT o_custkey AS key, o_orderkey AS version, round(o_totalprice, 2) AS price, o_orderstatus AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS n
  FROM orders WHERE o_orderkey <= 700) WHERE n = 1 AND s <> 'P'""")
def snapshot_read(spark, d):
    """A versioned table as it was after an older commit."""
    log = read(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("version"), F.when(F.col("o_orderstatus") == "P", "D").otherwise("U").alias("op"), F.round("o_totalprice", 2).alias("price"))
    return store.latest(log.where("version <= 700"), ["key"]).select("key", "version", "price")


@query("SELECT page_id, url FROM pages WHERE url = (SELECT max(url) FROM pages)")
def file_by_path(spark, d):
    files = datasets.files(spark, d)
    path = files.agg(F.max("path")).first()[0]
    return files.where(F.col("path") == path).select(F.col("id").alias("page_id"), F.col("path").alias("url"))


@query("SELECT DISTINCT regexp_extract(url, '^([a-z]+://[^/]+)', 1) AS root FROM pages")
def file_roots(spark, d):
    return datasets.files(spark, d).select("root").distinct()


@query(f"""SELECT doc_id, 0 AS chunk_index, regexp_replace(text, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') AS chunk_text, greatest({tokens_sql('text')}, 1) AS token_count
FROM documents WHERE length(regexp_replace(text, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')) > 0""")
def note_chunks(spark, d):
    return chunking.body_chunks(read(spark, d, "documents"), "doc_id", F.col("text"))


@query()
def file_chunks(spark, d):
    """Every page's source cut to chunks of 120 tokens with 20 of overlap; a fold that SQL can't express."""
    return chunking.chunk_files(datasets.files(spark, d).withColumn("language", F.lit("text")), 120, 20, "id")


@query("""SELECT vec_id % 40 AS chunk, label AS model, max(vec_id) AS version, round(list_sum(list_transform(arg_max(embedding, vec_id), lambda x: x::DOUBLE)), 4) AS total FROM embeddings GROUP BY 1, 2""")
def embedding_replace(spark, d):
    """The last vector written for each chunk and model."""
    log = read(spark, d, "embeddings").select((F.col("vec_id") % 40).alias("chunk"), F.col("label").alias("model"), F.col("vec_id").alias("version"), F.lit("U").alias("op"), "embedding")
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return store.latest(log, ["chunk", "model"]).select("chunk", "model", "version", F.round(total, 4).alias("total"))


@query("""SELECT event_id, '{"entity":"user:' || user_id || '","event":"' || event_type || '","value":' || CAST(json_extract_string(props, '$.k') AS BIGINT) || '}' AS payload FROM events""")
def audit_events(spark, d):
    payload = F.struct(F.concat(F.lit("user:"), "user_id").alias("entity"), F.col("event_type").alias("event"), F.get_json_object("props", "$.k").cast("bigint").alias("value"))
    return read(spark, d, "events").select("event_id", F.to_json(payload).alias("payload"))


@query(f"""WITH {FACTS}, fresh AS (SELECT id + 1000000 AS id, id AS old, scope, fact_type, CASE WHEN turn = 0 THEN project + 1 ELSE project END AS project, evidence AS chat, CASE WHEN turn = 1 THEN 'candidate' ELSE 'active' END AS status FROM facts WHERE evidence % 2 = 0)
SELECT f.id, CASE WHEN n.old IS NOT NULL AND f.status NOT IN ('deleted', 'superseded') THEN 'superseded' ELSE f.status END AS status
FROM facts f LEFT JOIN fresh n ON n.old = f.id AND n.status = 'active' AND n.scope = f.scope AND n.fact_type = f.fact_type AND n.project = f.project AND n.chat = f.evidence UNION ALL SELECT id, status FROM fresh""")
def supersede_facts(spark, d):
    """New facts for those of even chats: first turns under another project, second ones not active yet."""
    facts = datasets.facts(spark, d).select("id", "scope", "fact_type", "project", F.col("evidence").alias("chat"), "status", "turn")
    status, project = F.when(F.col("turn") == 1, "candidate").otherwise("active"), F.when(F.col("turn") == 0, F.col("project") + 1).otherwise(F.col("project"))
    fresh = facts.where("chat % 2 = 0").select((F.col("id") + 1_000_000).alias("id"), "scope", "fact_type", project.alias("project"), "chat", status.alias("status"), "turn", F.col("id").alias("supersedes_id"))
    return memory.supersede(facts, fresh).select("id", "status")


@query(f"""WITH {FACTS} SELECT id, CASE WHEN status = 'deleted' OR evidence % 5 = 0 THEN scope ELSE 'global' END AS scope, CASE WHEN status = 'deleted' OR evidence % 5 = 0 THEN status ELSE 'active' END AS status, project FROM facts""")
def promote_facts(spark, d):
    """Facts that are live and have evidence become global and active; their project stays."""
    facts = datasets.facts(spark, d).withColumn("refs", F.when(F.col("evidence") % 5 != 0, F.array("evidence")).otherwise(F.array().cast("array<bigint>")))
    may = ~F.col("status").isin(*memory.TERMINAL) & (F.size("refs") > 0)
    return facts.select("id", F.when(may, "global").otherwise(F.col("scope")).alias("scope"), F.when(may, "active").otherwise(F.col("status")).alias("status"), "project")


@query(f"""WITH {FACTS} SELECT id, CASE WHEN confidence * 3 - 0.5 < 0 THEN 0::DOUBLE WHEN confidence * 3 - 0.5 > 1 THEN 1::DOUBLE ELSE round(confidence * 3 - 0.5, 6)::DOUBLE END AS confidence FROM facts""")
def clamp_confidence(spark, d):
    raised = F.col("confidence") * 3 - 0.5
    return datasets.facts(spark, d).select("id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raised)), 6).alias("confidence"))


@query(f"""WITH {TASKS} SELECT id, 'done' AS status, due_at::DATE::VARCHAR AS started, '2002-01-01' AS completed FROM tasks WHERE status = 'in_progress'
UNION ALL SELECT id, 'done', '2002-01-01', '2002-01-01' FROM tasks WHERE status = 'open' UNION ALL SELECT id, 'done', '2002-01-01', due_at::DATE::VARCHAR FROM tasks WHERE status = 'done'""")
def task_status_times(spark, d):
    """All tasks set to done: work that had started keeps its day, work that was done keeps its end."""
    day = F.date_format("due_at", "yyyy-MM-dd")
    rows = datasets.tasks(spark, d).withColumns({"started_at": F.when(F.col("status") == "in_progress", day), "completed_at": F.when(F.col("status") == "done", day)})
    return store.set_status(rows, "done", now=F.lit("2002-01-01")).select("id", "status", F.col("started_at").alias("started"), F.col("completed_at").alias("completed"))


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'new' ELSE NULL END END AS due,
  CASE WHEN o_orderkey % 2 = 0 THEN 'new' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS kept FROM orders""")
def nullable_updates(spark, d):
    """One field cleared, kept or replaced even by null; another that null leaves as it is."""
    old, new = F.date_format("o_orderdate", "yyyy-MM-dd"), F.when(F.col("o_orderkey") % 2 == 0, "new")
    due = F.when(F.col("o_orderkey") % 3 == 0, store.updated(old, new, clear=True)).when(F.col("o_orderkey") % 3 == 1, old).otherwise(store.updated(old, new, replace=True))
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), due.alias("due"), store.updated(old, new).alias("kept"))


# Projections, filters, sets.


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 0 WHEN event_id % 4 = 1 THEN 0 ELSE 1 END AS keys, event_id % 4 = 3 AS pinned FROM events""")
def row_casts(spark, d):
    """Stored text as a map, empty for bad JSON and for what is no object; 0 and 1 as booleans."""
    raw = F.when(F.col("event_id") % 4 == 0, F.lit("{bad")).when(F.col("event_id") % 4 == 1, F.lit("[1]")).otherwise(F.col("props"))
    keys = F.pandas_udf(lambda texts: texts.map(lambda t: len(metadata.parsed(t))).astype("int32"), "int")
    rows = read(spark, d, "events").withColumn("flag", (F.col("event_id") % 4 == 3).cast("int"))
    return rows.select("event_id", keys(raw).alias("keys"), F.col("flag").cast("boolean").alias("pinned"))


JSONS = ['"x"', "1", "1.5", "true", "[1]", "{}"]


@query("""WITH m AS (SELECT event_id, ['"x"', '1', '1.5', 'true', '[1]', '{}'][event_id % 6 + 1] AS v, ['string', 'integer', 'number', 'boolean', 'array', 'object'][event_id // 6 % 6 + 1] AS wanted FROM events)
SELECT event_id, wanted, CASE json_type(v) WHEN 'VARCHAR' THEN wanted = 'string' WHEN 'UBIGINT' THEN wanted IN ('integer', 'number') WHEN 'DOUBLE' THEN wanted = 'number' WHEN 'BOOLEAN' THEN wanted = 'boolean' WHEN 'ARRAY' THEN wanted = 'array' ELSE wanted = 'object' END AS fits FROM m""")
def metatag_types(spark, d):
    """Values of the six JSON types against each of the six; a boolean is no number, an integer is one."""
    value = F.element_at(F.array(*[F.lit(v) for v in JSONS]), (F.col("event_id") % 6 + 1).cast("int"))
    wanted = F.element_at(F.array(*[F.lit(v) for v in ("string", "integer", "number", "boolean", "array", "object")]), (F.floor(F.col("event_id") / 6) % 6 + 1).cast("int"))
    fits = F.pandas_udf(lambda v, w: pd.Series([accepted(metadata.validate, {"v": json.loads(a)}, {"v": b}) for a, b in zip(v, w, strict=True)]), "boolean")(value, wanted)
    return read(spark, d, "events").select("event_id", wanted.alias("wanted"), fits.alias("fits"))


@query("SELECT item_id FROM benchmark WHERE item_id % 3 = 0 OR item_id % 5 IN (1, 2)")
def scenario_visibility(spark, d):
    rows = read(spark, d, "benchmark").select("item_id", F.when(F.col("item_id") % 3 == 0, "global").otherwise("project").alias("scope"), (F.col("item_id") % 5).alias("project"))
    return rows.where(memory.visible([1, 2])).select("item_id")


@query(f"""WITH {FACTS} SELECT list_aggregate(list_distinct(list(fact_type)), 'count') AS n, array_to_string(list_sort(list_distinct(list(fact_type))), ',') AS types FROM facts""")
def distinct_types(spark, d):
    return datasets.facts(spark, d).agg(F.countDistinct("fact_type").alias("n"), F.array_join(F.array_sort(F.collect_set("fact_type")), ",").alias("types"))


@query("SELECT DISTINCT s_suppkey AS number FROM supplier EXCEPT SELECT c_custkey % 60 FROM customer")
def missing_steps(spark, d):
    """What is expected and not applied."""
    return read(spark, d, "supplier").select(F.col("s_suppkey").alias("number")).exceptAll(read(spark, d, "customer").select(F.col("c_custkey") % 60)).distinct()


@query("""WITH l AS (SELECT o_orderkey AS source_id, o_orderkey + 1 + o_custkey % 7 AS target_id, CASE WHEN o_custkey % 2 = 0 THEN 'child_of' ELSE 'references' END AS relation FROM orders WHERE o_orderstatus = 'O'),
e AS (SELECT o_orderkey AS id, o_custkey % 2 AS project, CASE WHEN o_orderstatus = 'P' THEN 'note' ELSE 'task' END AS kind FROM orders WHERE o_orderkey % 11 <> 0)
SELECT source_id, target_id, reason FROM (SELECT l.*, CASE WHEN s.id IS NULL THEN 'no_source' WHEN t.id IS NULL THEN 'no_target' WHEN s.project <> t.project THEN 'cross_project'
  WHEN relation IN ('child_of', 'blocked_by') AND (s.kind <> 'task' OR t.kind <> 'task') THEN 'not_a_task' END AS reason FROM l LEFT JOIN e s ON s.id = source_id LEFT JOIN e t ON t.id = target_id) WHERE reason IS NOT NULL""")
def misplaced_links(spark, d):
    orders = read(spark, d, "orders")
    links = orders.where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("source_id"), (F.col("o_orderkey") + 1 + F.col("o_custkey") % 7).alias("target_id"), F.when(F.col("o_custkey") % 2 == 0, "child_of").otherwise("references").alias("relation"))
    ends = orders.where("o_orderkey % 11 <> 0").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 2).alias("project"), F.when(F.col("o_orderstatus") == "P", "note").otherwise("task").alias("kind"))
    return graph.misplaced(links, ends).select("source_id", "target_id", "reason")


@query("""SELECT l_orderkey AS source_id, l_partkey AS target_id, strftime(l_shipdate, '%Y-%m-%d') AS created FROM lineitem WHERE l_orderkey IN (1, 2, 3, 4, 5, 6, 7) ORDER BY created DESC, l_orderkey, l_partkey LIMIT 20""")
def links_newest_first(spark, d):
    rows = read(spark, d, "lineitem").where(F.col("l_orderkey").isin(1, 2, 3, 4, 5, 6, 7))
    return rows.select(F.col("l_orderkey").alias("source_id"), F.col("l_partkey").alias("target_id"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("created")).orderBy(F.desc("created"), "source_id", "target_id").limit(20)


# Scalar functions.


@query("""SELECT event_id, CAST(json_extract_string(regexp_extract('noise ' || props || ' end', '(?s)[\\{\\[].*[\\}\\]]'), '$.k') AS BIGINT) AS k FROM events""")
def json_salvage(spark, d):
    noisy = F.concat(F.lit("noise "), "props", F.lit(" end"))
    found_ = F.pandas_udf(lambda texts: texts.map(lambda t: providers.salvaged(t).get("k")).astype("Int64"), "bigint")
    return read(spark, d, "events").select("event_id", found_(noisy).alias("k"))


@query("""SELECT doc_id, '[{"lang":"' || lang || '"},{"n":' || n_chars || '}]' AS json FROM documents""")
def json_build(spark, d):
    return read(spark, d, "documents").select("doc_id", F.concat(F.lit("["), F.to_json(F.struct("lang")), F.lit(","), F.to_json(F.struct(F.col("n_chars").alias("n"))), F.lit("]")).alias("json"))


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN CAST(user_id AS VARCHAR) ELSE CAST(user_id + 1 AS VARCHAR) END AS ref FROM events""")
def reference_ids(spark, d):
    """References as a plain string, or as an object with an id."""
    raw = F.when(F.col("event_id") % 2 == 0, F.to_json(F.struct(F.col("user_id").cast("string").alias("v")))).otherwise(F.to_json(F.struct(F.struct((F.col("user_id") + 1).cast("string").alias("id"), F.lit("user").alias("type")).alias("v"))))
    return read(spark, d, "events").select("event_id", memory.reference_id(F.try_variant_get(F.try_parse_json(raw), "$.v", "variant")).alias("ref"))


@query(f"""WITH {FACTS}, a AS (SELECT evidence AS chat, list_distinct(list(turn % 5)) AS old FROM facts GROUP BY evidence) SELECT chat, list_contains(old, 9) AS had, len(old) + 1 AS n FROM a""")
def append_unique(spark, d):
    """A number that isn't there is added to each list, one that is there is not."""
    a = datasets.facts(spark, d).groupBy(F.col("evidence").alias("chat")).agg(F.collect_set(F.col("turn") % 5).alias("old"))
    added = F.array_union("old", F.array(F.lit(9).cast("bigint"), F.element_at("old", 1)))
    return a.select("chat", F.array_contains("old", F.lit(9).cast("bigint")).alias("had"), F.size(added).cast("bigint").alias("n"))


@query(f"""WITH {FACTS}, c AS (SELECT project, status, count(*) AS n FROM facts GROUP BY ALL) SELECT project, string_agg(status || '=' || n, ',' ORDER BY status) AS counts FROM c GROUP BY project""")
def status_maps(spark, d):
    """Counts by status as a map for each project."""
    c = datasets.facts(spark, d).groupBy("project", "status").agg(F.count(F.lit(1)).alias("n"))
    made = c.groupBy("project").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("m"))
    shown = F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return made.select("project", F.array_join(shown, ",").alias("counts"))


@query("""SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%dT00:00:00+00:00') AS at, strftime(o_orderdate - INTERVAL 30 DAY, '%Y-%m-%d') AS cut, o_orderdate <= TIMESTAMP '1998-01-01' - INTERVAL 30 DAY AS due FROM orders""")
def retention_cut(spark, d):
    date = F.col("o_orderdate")
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.date_format(date, "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("at"), F.date_format(date - F.expr("INTERVAL 30 DAYS"), "yyyy-MM-dd").alias("cut"), (date <= F.expr("TIMESTAMP_NTZ '1998-01-01' - INTERVAL 30 DAYS")).alias("due"))


@query("""SELECT l_orderkey AS id, l_linenumber AS line, strftime(l_shipdate, '%Y-%m-%d') <= CASE WHEN l_linenumber % 2 = 0 THEN '1997-01-01' ELSE '9' END AS valid FROM lineitem""")
def validity_window(spark, d):
    """Beginnings and ends compared as text."""
    until = F.when(F.col("l_linenumber") % 2 == 0, "1997-01-01").otherwise("9")
    return read(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), (F.date_format("l_shipdate", "yyyy-MM-dd") <= until).alias("valid"))


@query("""SELECT vec_id, isfinite(x) AND x >= 0 AND x <= 1 AS valid FROM (SELECT vec_id, CASE vec_id % 4 WHEN 0 THEN 'nan'::DOUBLE WHEN 1 THEN 'inf'::DOUBLE WHEN 2 THEN 0.5::DOUBLE ELSE 2::DOUBLE END AS x FROM embeddings)""")
def finite_scores(spark, d):
    x = F.when(F.col("vec_id") % 4 == 0, float("nan")).when(F.col("vec_id") % 4 == 1, float("inf")).when(F.col("vec_id") % 4 == 2, 0.5).otherwise(2.0)
    return read(spark, d, "embeddings").select("vec_id", (F.pandas_udf(lambda xs: xs.map(lambda v: accepted(providers.rerank_scores, [v], 1)), "boolean")(x) & x.between(0, 1)).alias("valid"))


@query("SELECT p_partkey, sha256(p_partkey || ':' || p_name) AS checksum FROM part")
def step_checksum(spark, d):
    return read(spark, d, "part").select("p_partkey", F.sha2(F.concat_ws(":", F.col("p_partkey"), F.col("p_name")), 256).alias("checksum"))


# Retrieval steps.


@query(f"SELECT e.vec_id AS chunk_id, d.lang AS title, round({COSINE}, 6) AS score FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id, (SELECT * FROM embeddings WHERE vec_id = 0) q WHERE e.label <> 2 ORDER BY score DESC, chunk_id LIMIT 20")
def vector_chunk_join(spark, d):
    """Vector hits with their documents; those of other models are left out before the ranking."""
    e = read(spark, d, "embeddings").where("label <> 2").select(F.col("vec_id").alias("chunk_id"), "embedding").join(read(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("lang").alias("title")), "chunk_id")
    q = read(spark, d, "embeddings").where("vec_id = 0").select(F.col("embedding").cast("array<double>").alias("q")).first().q
    return e.select("chunk_id", "title", F.round(scores.cosine(F.col("embedding"), F.array(*[F.lit(x) for x in q])), 6).alias("score")).orderBy(F.desc("score"), "chunk_id").limit(20)


@query(f"SELECT vec_id AS chunk_id, round(1 - (1 - {COSINE}), 6) AS score FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id = 0) q".replace("SELECT vec_id", "SELECT e.vec_id"))
def distance_scores(spark, d):
    """Cosine distances back to scores."""
    e = read(spark, d, "embeddings")
    q = e.where("vec_id = 0").select(F.col("embedding").cast("array<double>").alias("q")).first().q
    distance = 1 - scores.cosine(F.col("embedding"), F.array(*[F.lit(x) for x in q]))
    return e.select(F.col("vec_id").alias("chunk_id"), F.round(1 - distance, 6).alias("score"))


@query("""WITH c AS (SELECT doc_id, unnest(string_split(text, '.')) AS snippet, generate_subscripts(string_split(text, '.'), 1) AS i FROM documents)
SELECT doc_id, max(length(snippet)) AS size, max(i * 7 % 13) AS score FROM c GROUP BY doc_id""")
def merge_candidates(spark, d):
    """Candidates that come twice: the highest score and the longest snippet."""
    c = read(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", r"\.")).alias("i", "snippet"))
    merged = rank.merged(c.select("doc_id", "snippet", ((F.col("i") + 1) * 7 % 13).cast("bigint").alias("score")), ["doc_id"])
    return merged.select("doc_id", F.length("snippet").cast("bigint").alias("size"), "score")


FIRST = "array_to_string(regexp_split_to_array(trim(text), '\\s+')[1:12], ' ')"


@query(f"""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN greatest({tokens_sql('text')} + {tokens_sql('lang')} + {tokens_sql(FIRST)}, 1) ELSE greatest({tokens_sql("source || ' ' || lang")} + {tokens_sql(FIRST)}, 1) END AS cost FROM documents""")
def hit_token_costs(spark, d):
    """Notes cost their chunk, title and snippet, others their title and snippet."""
    rows = read(spark, d, "documents").withColumn("snippet", text.first_words(F.col("text")))
    note = text.count_tokens(F.col("text")) + text.count_tokens(F.col("lang")) + text.count_tokens(F.col("snippet"))
    other = text.count_tokens(F.concat_ws(" ", "source", "lang")) + text.count_tokens(F.col("snippet"))
    return rows.select("doc_id", F.greatest(F.when(F.col("doc_id") % 4 == 0, note).otherwise(other), F.lit(1)).alias("cost"))


# Unified search over three kinds: notes and history by BM25 within their budgets, one page after the other.
UNIFIED = f"""WITH {THE_AND}, notes AS (SELECT 'notes' AS type, key AS id, source AS project, lang AS title, abs(bm25) / (1 + abs(bm25)) AS score, {FIRST} AS snippet, '{{}}' AS attributes FROM r JOIN documents ON doc_id = key ORDER BY bm25, key LIMIT 100)"""


@query(UNIFIED + f""", c AS (SELECT *, greatest({tokens_sql('title')} + {tokens_sql('snippet')} + {tokens_sql('attributes')}, 1) AS cost, row_number() OVER (ORDER BY score DESC, type, id) AS n FROM notes)
SELECT id, project, place, spent FROM (SELECT id, project, n - 15 AS place, sum(cost) OVER (ORDER BY n) AS spent FROM c WHERE n > 15) WHERE (spent <= 200 OR place = 1) AND place <= 10""")
def unified_page_by_cursor(spark, d):
    """The page after the hit in place 15: cursor, budget of 200 tokens, limit of 10."""
    top = found(spark, d).orderBy("bm25", "doc_id").limit(100)
    docs = read(spark, d, "documents").select("doc_id", "source", "lang", "text")
    rows = top.join(docs, "doc_id").select(F.lit("notes").alias("type"), F.col("doc_id").alias("id"), F.col("source").alias("project"), F.col("lang").alias("title"), scores.relevance(F.col("bm25")).alias("score"), text.first_words(F.col("text")).alias("snippet"), F.lit("{}").alias("attributes"))
    rows = kept(rows, "hits")  # at most 100
    last = rows.orderBy(F.desc("score"), "type", "id").limit(15).collect()[-1]
    cursor = rank.encode_cursor({"score": last.score, "type": last.type, "id": last.id})
    _, page = unified_page(rows, SearchQuery("the and", limit=10, budget=200, cursor=cursor))
    return page.select("id", "project", F.col("place").cast("bigint").alias("place"), "spent")


@query("""SELECT * FROM (VALUES ('notes', 428), ('tasks', 142), ('history', 142), ('files', 288)) v(type, budget)""")
def budgets_by_weight(spark, d):
    """1000 tokens by weights 3, 1, 1 and 2: floors of the shares, and the rest for the last kind."""
    made = split_budget(1000, ("notes", "tasks", "history", "files"), {"notes": 3.0, "files": 2.0})
    return spark.createDataFrame([(t, b) for t, b in made.items()], "type string, budget int")


@query(f"""WITH {THE_AND}, hits AS (SELECT key, abs(bm25) / (1 + abs(bm25)) AS score, lang, {tokens_sql('text')} AS own, {FIRST} AS snippet, text FROM r JOIN documents ON doc_id = key WHERE source = 'src1' ORDER BY bm25, key LIMIT 20)
SELECT key AS document_id, round(score, 6) AS score FROM hits""")
def entity_search_notes(spark, d):
    """One kind in one project: candidates, one hit a document, in order, without a budget that binds."""
    hits = found(spark, d).select(F.col("doc_id").alias("chunk_id"), "bm25")
    chunks = read(spark, d, "documents").where("source = 'src1'").select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("document_id"), F.col("lang").alias("title"), F.col("text").alias("body"), text.count_tokens(F.col("text")).alias("token_count"), F.lit("{}").alias("attributes"), (-F.col("doc_id")).alias("created_at"))
    page = entity_hits(hits, chunks, [["the"], ["and"]], "note", 20, 10_000_000)
    return page.select("document_id", F.round("score", 6).alias("score"))


@query("""SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) AND length(trim(text)) > 0""")
def chunk_backfill(spark, d):
    """Documents without chunks get theirs before a search."""
    docs = read(spark, d, "documents").join(read(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti")
    return chunking.body_chunks(docs, "doc_id", F.col("text")).join(docs.select("doc_id", "n_chars"), "doc_id").select("doc_id", "n_chars")


@query("""WITH b AS (SELECT page_id, sha256(html) AS h FROM pages WHERE page_id % 2 = 0) SELECT count(*) FILTER (b.page_id IS NULL) AS indexed, count(*) FILTER (b.h = sha256(html)) AS unchanged, (SELECT count(*) FROM benchmark WHERE item_id > (SELECT max(page_id) FROM pages)) AS deleted FROM pages p LEFT JOIN b USING (page_id)""")
def index_counters(spark, d):
    now = datasets.files(spark, d).select("id", "hash")
    state = store.changes(now, now.where("id % 2 = 0"), "id", "hash").agg(F.count_if(F.col("change") == "new").alias("indexed"), F.count_if(F.col("change") == "same").alias("unchanged"))
    gone = store.unseen(read(spark, d, "benchmark").select(F.col("item_id").alias("id")).where(F.col("id") > now.agg(F.max("id")).first()[0]), now, "id").count()
    return state.withColumn("deleted", F.lit(gone).cast("bigint"))


# Streams and states.


@query("""WITH w AS (SELECT time_bucket(INTERVAL '1 hour', ts) AS s, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2)
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, event_type, n, total FROM w WHERE s + INTERVAL '1 hour' <= (SELECT max(ts) - INTERVAL '10 minutes' FROM events)""")
def stream_job_windows(spark, d):
    """Structured Streaming over the events: windows that the watermark has passed."""
    source, name = f"{d}/events.parquet", "*"
    schema = spark.read.parquet(source).schema
    fs, path = hadoop(spark, source)
    if fs.getFileStatus(path).isFile():  # streams read folders
        source, name = d, "events.parquet"
    out, mark = new_path(spark, "windows"), new_path(spark, "windows-state")
    jobs.event_windows(spark, source, schema, out, mark, name=name).awaitTermination()
    return spark.read.parquet(out).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""SELECT CAST(user_id AS BIGINT) AS user_id, count(*) AS pending, strftime(min(ts), '%Y-%m-%d %H:%M') AS since FROM events GROUP BY user_id HAVING count(*) >= 205 OR min(ts) <= TIMESTAMP '2024-01-01 00:30:00'""")
def trigger_due(spark, d):
    """Keys whose job should run: enough rows, or one that has waited long enough."""
    rows = read(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("pending"), F.min("ts").alias("first"))
    waited = F.expr("timestampdiff(SECOND, first, TIMESTAMP_NTZ '2024-01-01 01:30:00')")
    due = jobs.due(rows.withColumns({"waited": waited, "since_last": F.lit(7200)}), 205, 3600)
    return due.select(big("user_id"), "pending", F.date_format("first", "yyyy-MM-dd HH:mm").alias("since"))


@query("""SELECT conv_id * 1000 + turn AS id, role AS actor, text AS payload FROM conversations WHERE conv_id = 3 AND turn > 1 ORDER BY turn LIMIT 20""")
def history_after_mark(spark, d):
    """What an extraction would take up next: entries of a chat after its mark, masked."""
    rows = datasets.history(spark, d).where("chat = 3")
    return store.after_mark(rows, ["chat", "seq"], [3, 1]).orderBy("seq").limit(20).select("id", "actor", text.redact(F.col("payload")).alias("payload"))


@query(f"""WITH {FACTS}, s AS (SELECT item_id AS rank, '- [scenario/project] ' || item_id || ': ' || left(text, 40) AS line FROM benchmark WHERE item_id < 5),
f AS (SELECT id AS rank, '- [project:' || project || '/' || fact_type || '] ' || left(content, 60) AS line FROM facts WHERE status = 'active' AND scope = 'project' ORDER BY id LIMIT 30),
a AS (SELECT 0 AS part, rank, line, 10 + sum({tokens_sql('line')}) OVER (ORDER BY rank) AS spent FROM s), k AS (SELECT * FROM a WHERE spent <= 150),
b AS (SELECT 1 AS part, rank, line, (SELECT coalesce(max(spent), 10) FROM k) + sum({tokens_sql('line')}) OVER (ORDER BY rank) AS spent, row_number() OVER (ORDER BY rank) AS n FROM f)
SELECT CAST(row_number() OVER (ORDER BY part, rank) AS INTEGER) AS place, line, CAST(spent AS BIGINT) AS spent FROM (SELECT part, rank, line, spent FROM k UNION ALL SELECT part, rank, line, spent FROM b WHERE spent <= 150 OR n = 1)""")
def context_prompt(spark, d):
    """Scenarios while they fit, then facts while they fit after those."""
    s = read(spark, d, "benchmark").where("item_id < 5").select(F.col("item_id").alias("rank"), F.concat(F.lit("- [scenario/project] "), "item_id", F.lit(": "), F.left("text", F.lit(40))).alias("line"))
    f = datasets.facts(spark, d).where("status = 'active' AND scope = 'project'").orderBy("id").limit(30)
    f = f.select(F.col("id").alias("rank"), F.concat(F.lit("- [project:"), "project", F.lit("/"), "fact_type", F.lit("] "), F.left("content", F.lit(60))).alias("line"))
    cost = text.count_tokens(F.col("line"))
    return memory.context_lines(s.withColumn("cost", cost), f.withColumn("cost", cost), 150, 10)


@query("""WITH s AS (SELECT item_id, CASE WHEN item_id % 2 = 0 THEN [item_id % 3, 5] ELSE [5, item_id % 3, 5] END AS ev FROM benchmark), k AS (SELECT item_id, array_to_string(list_sort(list_distinct(ev)), ',') AS key FROM s)
SELECT item_id, min(item_id) OVER (PARTITION BY key) AS "first" FROM k""")
def scenario_duplicates(spark, d):
    """Scenarios that rest on the same evidence as an earlier one, in whatever order and number."""
    n, five = F.col("item_id") % 3, F.lit(5).cast("bigint")
    rows = read(spark, d, "benchmark").select("item_id", F.when(F.col("item_id") % 2 == 0, F.array(n, five)).otherwise(F.array(five, n, five)).alias("evidence"))
    return memory.first_of_equal_evidence(rows, "item_id").select("item_id", "first")


@query(f"""WITH {FACTS}, gone AS (SELECT doc_id AS ref FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id * 10 + 1 FROM labels WHERE toxic = 1)
SELECT id, CASE WHEN evidence IN (SELECT ref FROM gone) THEN 'deleted' ELSE status END AS status FROM facts""")
def invalidate_by_chunks(spark, d):
    """Facts that rest on a deleted document or on a chunk of it."""
    gone = read(spark, d, "labels").where("toxic = 1").select("doc_id")
    refs = gone.select(F.col("doc_id").alias("evidence")).union(gone.select(F.col("doc_id") * 10 + 1)).distinct()
    return memory.invalidate(datasets.facts(spark, d), refs).select("id", "status")


@query("""WITH q AS (SELECT doc_id, text FROM documents WHERE contains(lower(text), 'of the')) SELECT count(*) > 0 AS any FROM q""")
def phrase_search_any(spark, d):
    """A phrase of two words is looked up by its words, and read only in texts that hold both."""
    hits = index.bm25(indexed(spark, d, "documents", "doc_id", "text"), [["of", "the"]])
    return hits.agg((F.count(F.lit(1)) > 0).alias("any"))


@query(f"WITH {THE_AND} SELECT count(*) AS n, round(sum(abs(bm25) / (1 + abs(bm25))), 3) AS total FROM r JOIN documents ON doc_id = key WHERE source IN ('src1', 'src2')")
def scoped_candidates(spark, d):
    """Statistics are of the whole corpus, candidates of the projects asked for."""
    own = read(spark, d, "documents").where(F.col("source").isin("src1", "src2")).select("doc_id")
    return found(spark, d).join(own, "doc_id", "left_semi").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(scores.relevance(F.col("bm25"))), 3).alias("total"))



@query(r"""WITH tk AS (SELECT doc_id, regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}]+') AS t FROM documents),
post AS (SELECT doc_id, term, count(*) AS tf, len(any_value(t)) AS length FROM (SELECT doc_id, t, unnest(t) AS term FROM tk) GROUP BY doc_id, term),
stats AS (SELECT count(*)::DOUBLE AS n, avg(len(t)) AS mean FROM tk),
dfs AS (SELECT term, count(*)::DOUBLE AS df FROM post GROUP BY term),
qt AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}]+')) AS term FROM benchmark),
asked AS (SELECT item_id, term FROM qt QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY length(term) DESC, term) <= 2),
scored AS (SELECT a.item_id, p.doc_id, any_value(p.length) AS length, round(sum((CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END)::DOUBLE * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * p.length / mean))), 6) AS score, count(*) AS hits
  FROM asked a JOIN post p USING (term) JOIN dfs USING (term), stats GROUP BY a.item_id, p.doc_id),
best AS (SELECT s.* FROM scored s JOIN (SELECT item_id, count(*) AS terms FROM asked GROUP BY item_id) t ON s.item_id = t.item_id AND hits = terms QUALIFY row_number() OVER (PARTITION BY s.item_id ORDER BY score DESC, doc_id) <= 10),
run AS (SELECT item_id AS query_id, doc_id, score, row_number() OVER w AS place, sum(length) OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ROWS UNBOUNDED PRECEDING) AS spent FROM best WINDOW w AS (PARTITION BY item_id ORDER BY score DESC, doc_id))
SELECT query_id, doc_id, score, CAST(place AS INTEGER) AS place, CAST(spent AS BIGINT) AS spent FROM run WHERE spent <= 1000 + 100 * (query_id % 7) OR place = 1""")
def batched_search(spark, d):
    """A query for every benchmark item, its two longest terms, in one plan: the ten best each, cut to the query's own budget."""
    term = F.explode(F.array_distinct(text.terms(F.col("text")))).alias("term")
    asked = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), term)
    order = Window.partitionBy("query_id").orderBy(F.desc(F.length("term")), "term")
    asked = asked.withColumn("n", F.row_number().over(order)).where("n <= 2")
    best = index.bm25_many(indexed(spark, d, "documents", "doc_id", "text"), asked, 10, 6)
    page = best.select("query_id", F.col("key").alias("doc_id"), (-F.col("bm25")).alias("score"), "length")
    budget = 1000 + 100 * (F.col("query_id") % 7)
    return rank.trim_to_budget(page, [F.desc("score"), F.asc("doc_id")], F.col("length"), budget, ("query_id",)).select("query_id", "doc_id", "score", "place", "spent")


@query("""WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS key, epoch_us(ts) // 1000 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS rn FROM events),
run AS (
  SELECT DISTINCT key, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS p, CAST(NULL AS BIGINT) AS f, CAST(NULL AS BIGINT) AS l, CAST(NULL AS BIGINT) AS t1, CAST(NULL AS BIGINT) AS n1, CAST(NULL AS BIGINT) AS t2, CAST(NULL AS BIGINT) AS n2 FROM e
  UNION ALL
  SELECT key, rn, CASE WHEN hit THEN 0 ELSE p END, CASE WHEN hit THEN NULL ELSE f END, CASE WHEN hit THEN t ELSE l END, t1, n1, CASE WHEN hit THEN t END, CASE WHEN hit THEN p END
  FROM (SELECT *, p >= 6 AND (l IS NULL OR t - l >= 172800000) AS hit
    FROM (SELECT key, rn, t, CASE WHEN due <= t THEN 1 ELSE p + 1 END AS p, CASE WHEN due <= t OR f IS NULL THEN t ELSE f END AS f, CASE WHEN due <= t THEN due ELSE l END AS l, CASE WHEN due <= t THEN due END AS t1, CASE WHEN due <= t THEN p END AS n1
      FROM (SELECT run.key, e.rn, e.t, run.p, run.f, run.l, CASE WHEN p = 0 THEN NULL WHEN p >= 6 AND l IS NOT NULL THEN l + 172800000 ELSE f + 172800000 END AS due FROM run JOIN e ON e.key = run.key AND e.rn = run.rn + 1)))
), rest AS (
  SELECT key, p, CASE WHEN p >= 6 AND l IS NOT NULL THEN l + 172800000 ELSE f + 172800000 END AS due FROM run JOIN (SELECT key, max(rn) AS rn FROM e GROUP BY key) USING (key, rn) WHERE p > 0
), fired AS (
  SELECT key, t1 AS t, n1 AS n FROM run WHERE t1 IS NOT NULL UNION ALL SELECT key, t2, n2 FROM run WHERE t2 IS NOT NULL
  UNION ALL SELECT key, due, p FROM rest WHERE due <= (SELECT max(t) - 600000 FROM e)
)
SELECT key, t AS fired_ms, n AS pending, CASE WHEN n < 6 THEN 'age' ELSE 'count' END AS reason FROM fired""")
def trigger_firings(spark, d):
    """Structured Streaming over the events: each user's job fires after six rows or two days, by keyed state and timers."""
    from ..streaming import triggers

    source, name = f"{d}/events.parquet", "*"
    schema = spark.read.parquet(source).schema
    fs, path = hadoop(spark, source)
    if fs.getFileStatus(path).isFile():  # streams read folders
        source, name = d, "events.parquet"
    out, mark = new_path(spark, "firings"), new_path(spark, "firings-state")
    triggers.run(spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(source), out, mark, "user_id", "ts", 6, 2 * 24 * 3600)
    return spark.read.schema(triggers.FIRED).parquet(out).selectExpr("key", "unix_millis(fired_at) AS fired_ms", "pending", "reason")


#: Each customer passes work on within its block of 12 and of 30, and some to the next block of 60, never further than four blocks.
CUSTOMER_LINKS = """e AS (SELECT DISTINCT s, t FROM (
  SELECT c_custkey AS s, c_custkey - c_custkey % 12 + (c_custkey % 12 * 5 + 1) % 12 AS t FROM customer
  UNION ALL SELECT c_custkey, c_custkey - c_custkey % 30 + (c_custkey % 30 * 7) % 30 FROM customer WHERE c_mktsegment <> 'BUILDING'
  UNION ALL SELECT c_custkey, c_custkey + 60 FROM customer WHERE c_custkey % 60 = 7 AND c_custkey // 60 % 4 <> 3))"""


def customer_links(spark, d):
    rows, key = read(spark, d, "customer"), F.col("c_custkey")
    near = rows.select(key.alias("s"), (key - key % 12 + (key % 12 * 5 + 1) % 12).alias("t"))
    far = rows.where("c_mktsegment <> 'BUILDING'").select(key.alias("s"), (key - key % 30 + (key % 30 * 7) % 30).alias("t"))
    on = rows.where("c_custkey % 60 = 7 AND c_custkey div 60 % 4 <> 3").select(key.alias("s"), (key + 60).alias("t"))
    return near.unionByName(far).unionByName(on)


@query(f"""WITH RECURSIVE {CUSTOMER_LINKS}, n AS (SELECT s AS id FROM e UNION SELECT t FROM e),
w AS (SELECT s AS a, t AS b FROM e UNION SELECT a, t FROM w JOIN e ON s = b),
c AS (SELECT id, least(id, coalesce(min(x.b), id)) AS component FROM n LEFT JOIN (SELECT w.a, w.b FROM w JOIN w v ON v.a = w.b AND v.b = w.a) x ON x.a = id GROUP BY id)
SELECT id, component, count(*) OVER (PARTITION BY component) AS size FROM c""")
def strong_relation_components(spark, d):
    """Customers that pass work on to each other in the end, where each may have several links out."""
    return graph.strong_components(customer_links(spark, d))


@query(f"""WITH RECURSIVE {CUSTOMER_LINKS}, p AS (SELECT c_custkey AS s, c_custkey + 12 AS t FROM customer WHERE c_mktsegment = 'MACHINERY' UNION ALL SELECT c_custkey, c_custkey - 60 FROM customer WHERE c_mktsegment = 'FURNITURE' AND c_custkey % 60 < 30),
g AS (SELECT * FROM e UNION SELECT * FROM p), w AS (SELECT DISTINCT s AS o, t AS b FROM g UNION SELECT o, g.t FROM w JOIN g ON g.s = b)
SELECT s, t, s = t OR EXISTS (SELECT 1 FROM w WHERE o = p.t AND b = p.s) AS closes FROM p""")
def proposed_links_closing(spark, d):
    """Which of many proposed links would lie on a cycle, were all of them added."""
    rows, key = read(spark, d, "customer"), F.col("c_custkey")
    proposed = rows.where("c_mktsegment = 'MACHINERY'").select(key.alias("s"), (key + 12).alias("t"))
    proposed = proposed.unionByName(rows.where("c_mktsegment = 'FURNITURE' AND c_custkey % 60 < 30").select(key.alias("s"), (key - 60).alias("t")))
    return graph.closing(customer_links(spark, d), proposed)


@query("""WITH RECURSIVE r AS (SELECT source, doc_id // 500 AS part, doc_id, length(coalesce(text, '')) AS size, row_number() OVER (PARTITION BY source, doc_id // 500 ORDER BY doc_id) AS n FROM documents),
run AS (SELECT source, part, doc_id, n, 0 AS batch, 1 AS held, size AS room FROM r WHERE n = 1
  UNION ALL SELECT r.source, r.part, r.doc_id, r.n, batch + CASE WHEN held = 16 OR room + size > 20000 THEN 1 ELSE 0 END, CASE WHEN held = 16 OR room + size > 20000 THEN 1 ELSE held + 1 END, CASE WHEN held = 16 OR room + size > 20000 THEN size ELSE room + size END
  FROM run JOIN r ON r.source IS NOT DISTINCT FROM run.source AND r.part = run.part AND r.n = run.n + 1)
SELECT source, part, doc_id, CAST(batch AS BIGINT) AS batch FROM run""")
def provider_requests(spark, d):
    """Documents packed into a provider's requests by both limits, 16 texts and 20,000 characters, in parts of a source."""
    rows = read(spark, d, "documents").select("source", F.expr("doc_id div 500").alias("part"), "doc_id", "text")
    return calls.numbered(rows, ["source", "part"], ["doc_id"], F.length("text"), 16, 20_000)
