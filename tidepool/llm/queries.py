"""One query for each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, html, licenses, merkle, neardup, packing, phrases, secrets, sentencepiece, sharding, topk, toxicity
from .common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(table(spark, sf_dir, "documents"), width=3, num=90, den=100)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.digest(table(spark, sf_dir, "documents"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op5_approximate_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_counts(table(spark, sf_dir, "documents"))


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top(table(spark, sf_dir, "embeddings"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(table(spark, sf_dir, "documents"))


def op13_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of the scan that SQL can express."""
    return op13_license_scans(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = [op1_toxicity, op2_ngram_jaccard_join, op3_sentencepiece, op4_html_extraction, op5_approximate_neighbours, op6_secret_scans, op7_sharding, op8_token_counts, op9_exact_topk, op10_packing, op11_merkle_manifest, op12_phrase_collocations, op13_license_scans, license_base]
    return {f.__name__: f for f in made}


#: DuckDB SQL for the queries that SQL can express.
ORACLE_SQL = {
    "op2_ngram_jaccard_join": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM words
), items AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS item FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b USING (item)
  WHERE a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), reach AS (
  SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
), least_of AS (
  SELECT a AS doc_id, min(b) AS least FROM reach GROUP BY a
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(least_of.least, doc_id)) AS component_id
FROM sets LEFT JOIN least_of USING (doc_id)
""",
  "op9_exact_topk": """
WITH fine AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM fine q JOIN fine c ON q.vec_id % 100 = 0 AND c.r <> q.r AND len(c.v) = len(q.v)
), ordered AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ordered WHERE rank <= 10
""",
    "op11_merkle_manifest": r"""
WITH RECURSIVE rows_ AS (
  SELECT row_number() OVER () AS r, doc_id, source, text, concat(
    coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-'), coalesce(octet_length(encode(source)) || ':' || source, '-'),
    coalesce(octet_length(encode(lang)) || ':' || lang, '-'), coalesce(octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || n_chars, '-')) AS head
  FROM documents
), bits AS (
  SELECT CAST(i AS BIGINT) AS i FROM range(256) t(i)
), crc_step AS (
  SELECT i, i AS c, 0 AS k FROM bits
  UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc_step WHERE k < 8
), crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM crc_step WHERE k = 8
), leaves AS (
  SELECT r, doc_id, source, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
    CASE WHEN list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])) & 1 = 1
      THEN sha256(head || coalesce(octet_length(encode(replace(text, chr(10), ''))) || ':' || replace(text, chr(10), ''), '-')) END AS told
  FROM rows_, crc_table
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM leaves
), up AS (
  SELECT source, 0 AS level, pos, n, leaf AS digest FROM placed
  UNION ALL
  SELECT source, level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY source, level, n, pos // 3
), subroots AS (
  SELECT source, digest AS subroot, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS place, count(*) OVER () AS many FROM up WHERE n = 1
), over_ AS (
  SELECT 0 AS level, place AS pos, many AS n, subroot AS digest FROM subroots
  UNION ALL
  SELECT level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM over_ WHERE n > 1 GROUP BY level, n, pos // 3
), nodes AS (
  SELECT a.source, a.level, a.pos, string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos) AS before, string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos) AS after
  FROM up a JOIN up b ON a.source IS NOT DISTINCT FROM b.source AND a.level = b.level AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY ALL
  UNION ALL
  SELECT s.source, 1000 + a.level, a.pos, string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos), string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos)
  FROM over_ a JOIN over_ b ON a.level = b.level AND a.pos // 3 = b.pos // 3 JOIN subroots s ON s.place // CAST(3 ** a.level AS BIGINT) = a.pos WHERE a.n > 1 GROUP BY ALL
), steps AS (
  SELECT p.r, row_number() OVER (PARTITION BY p.r ORDER BY k.level) AS step, coalesce(before, '') AS before, coalesce(after, '') AS after
  FROM placed p JOIN nodes k ON p.source IS NOT DISTINCT FROM k.source AND (k.level >= 1000 OR k.pos = p.pos // CAST(3 ** k.level AS BIGINT))
), fold AS (
  SELECT r, 1 AS step, coalesce(told, leaf) AS digest FROM placed
  UNION ALL
  SELECT f.r, f.step + 1, sha256(s.before || f.digest || s.after) FROM fold f JOIN steps s ON s.r = f.r AND s.step = f.step
), folded AS (
  SELECT r, arg_max(digest, step) AS folded_root FROM fold GROUP BY r
), proofs AS (
  SELECT r, sha256(string_agg(before || after, '' ORDER BY step)) AS proof_sha256 FROM steps GROUP BY r
), root_ AS (
  SELECT digest AS root FROM over_ WHERE n = 1
)
SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM placed JOIN subroots ON placed.source IS NOT DISTINCT FROM subroots.source JOIN folded USING (r) LEFT JOIN proofs USING (r), root_
""",
    "op12_phrase_collocations": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w
  FROM documents
), grams AS (
  SELECT lang, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS phrase
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM pieces, (SELECT unnest(range(1, 6)) AS m) WHERE len(w) >= m)
), known AS (
  SELECT lang, phrase, m, count(*) AS f FROM grams GROUP BY lang, phrase, m
), totals AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM known WHERE m = 1 GROUP BY lang
), candidates AS (
  SELECT lang, phrase, m, f AS a, string_split(phrase, ' ') AS w FROM known WHERE m > 1 AND f >= 100
), inside AS (
  SELECT lang, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase, max(a) AS longer
  FROM (SELECT lang, w, a, k, unnest(range(1, m - k + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS k FROM candidates WHERE m > 2)) GROUP BY ALL
), cuts AS (
  SELECT c.lang, c.phrase, a, k, array_to_string(list_slice(w, 1, k), ' ') AS head, array_to_string(list_slice(w, k + 1, m), ' ') AS tail
  FROM (SELECT *, unnest(range(1, m)) AS k FROM candidates) c LEFT JOIN inside i ON i.lang = c.lang AND i.phrase = c.phrase
  WHERE longer IS NULL OR 100 * longer < 100 * a
), scored AS (
  SELECT c.lang, c.phrase, a, k, x.f AS l, y.f AS r, n, CAST((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM cuts c JOIN known x ON x.lang = c.lang AND x.phrase = c.head JOIN known y ON y.lang = c.lang AND y.phrase = c.tail JOIN totals t ON t.lang = c.lang
), weakest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
FROM weakest QUALIFY rank <= 2000
""",
    "license_base": r"""
WITH words AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), phrases AS (
  SELECT * FROM (VALUES (['gnu', 'general', 'public', 'license'], 'gpl'), (['apache', 'license'], 'apache'), (['cc', 'by'], 'cc-by'), (['mit', 'license'], 'mit')) t(p, label)
), places AS (
  SELECT r, label, i - 1 AS at_word FROM (SELECT r, w, p, label, unnest(range(1, len(w) - len(p) + 2)) AS i FROM words, phrases WHERE len(w) >= len(p)) WHERE list_slice(w, i, i + len(p) - 1) = p
), sums AS (
  SELECT r, count(*) AS n, min(at_word) AS first_word, max(at_word) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, first_word, last_word, coalesce(labels, '') AS base_labels FROM words LEFT JOIN sums USING (r)
""",
}
