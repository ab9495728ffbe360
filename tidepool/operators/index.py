"""Full-text index with positions, in segments, and BM25 search over it.

Texts are tokenised once, when they are indexed. A document's tokens are gathered by term where it is read, and these postings
shuffled once, packed, to folders by a hash of their term. A search reads its terms' folders and nothing else: phrases come from
positions, statistics are sums, and the best k come from regions of documents in order of what they can score at most.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scores import bm25_part, idf
from ..functions.text import terms
from ..sources.store import VersionedTable
from ..sources.work import exists, kept, new_path, shuffles_dropped, stamp

#: Documents for each folder of postings, folders at most, documents for each file of a folder.
FOLDER_ROWS, MOST_FOLDERS, FILE_ROWS = 4096, 1024, 1_000_000
#: Documents of a region, about; parts that documents of like length are dealt to, at most.
REGION_ROWS, MOST_PARTS = 2048, 1 << 16
#: Terms in fewer documents have no table of regions.
REGIONED = 1024
#: Documents whose terms a Python worker gathers at once.
SLICE_ROWS = 1000
#: Partitions that packed postings are shuffled to, at most.
MOST_TASKS = 2048
#: Segments of like size that are merged into one.
FANOUT = 8


@dataclass(frozen=True)
class Index:
    """``postings`` (bucket, term, region, key, tf, length, positions) of live documents; rows and mean length of the corpus.

    ``regions`` (term, region, n, most, shortest) sums up the postings of common terms.
    """

    postings: DataFrame
    rows: int
    mean: float
    buckets: int = 1
    regions: DataFrame | None = field(default=None)

    def of_terms(self, words: list[str]) -> DataFrame:
        """The postings of some terms: only their folders are read."""
        rows = self.postings.where(F.col("term").isin(words))
        if self.buckets == 1:
            return rows
        spark = self.postings.sparkSession
        at = spark.createDataFrame([(w,) for w in words], "term string").select(_bucket(self.buckets)).distinct().collect()
        return rows.where(F.col("bucket").isin([r.bucket for r in at]))


_COLUMNS = ("term", "region", "key", "tf", "length", "positions", "segment", "bucket")


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("bucket")


def tokens(corpus: DataFrame, key: str, text: Column, parts: int = 1, places: tuple[int, int] | None = None) -> DataFrame:
    """(key, length, region, term, positions, tf): each document's terms with their places, gathered where the document is,
    so that a row for each term of a document is shuffled and not one for each token.

    A region holds documents of about the same length, and so bounds what its postings can score. With ``places``, the
    numbers of folders and files, (place, postings): a row for each of them and slice of documents, packed.
    """
    rows = _lists(corpus, key, text, parts)
    if places:
        rows = rows.withColumn("_file", F.pmod(F.xxhash64("key"), F.lit(places[1])).cast("int"))
        return _by_slice(rows, functools.partial(_packed, buckets=places[0], files=places[1]), 0, "place bigint, postings binary")
    return _by_slice(rows, _gathered, 3, "term string, positions array<int>").withColumn("tf", F.size("positions").cast("bigint"))


def _lists(corpus: DataFrame, key: str, text: Column, parts: int) -> DataFrame:
    """(key, length, region, _terms) of the documents that hold terms."""
    rows = corpus.select(F.col(key).alias("key"), terms(text).alias("_terms"))
    region = F.floor(F.log2("length") * 2).cast("int") * MOST_PARTS + F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int")
    return rows.select("key", F.size("_terms").cast("bigint").alias("length"), "_terms").where("length > 0").select("key", "length", region.alias("region"), "_terms")


def _by_slice(rows: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch], first: int, added: str) -> DataFrame:
    """What ``work`` makes of each slice: the ``first`` columns, and those added."""
    schema = T.StructType([*rows.schema.fields[:first], *T.StructType.fromDDL(added).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                yield work(batch.slice(start, SLICE_ROWS))

    return rows.mapInArrow(run, schema)


def _grouped(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows (key, length, region, list of terms): the different terms; of each posting its row, its term and where its
    places begin; and all places, ascending in each."""
    words = batch.column(3).flatten().dictionary_encode()
    sizes = batch.column(1).to_numpy()
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = (np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
    group = row * len(words.dictionary) + words.indices.to_numpy()
    order = np.argsort(group, kind="stable")
    first = np.flatnonzero(np.diff(group[order], prepend=-1))
    one = order[first]
    return words.dictionary, row[one], words.indices.to_numpy()[one], np.append(first, len(order)), at[order]


def _gathered(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Rows (key, length, region, list of terms) as one for each different term of a row, with its ascending places."""
    words, row, word, begins, at = _grouped(batch)
    positions = pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(at))
    kept_ = batch.select([0, 1, 2]).take(pa.array(row))
    return pa.RecordBatch.from_arrays([*kept_.columns, words.take(pa.array(word)), positions], names=[*kept_.schema.names, "term", "positions"])


def _packed(batch: pa.RecordBatch, buckets: int, files: int) -> pa.RecordBatch:
    """Rows (key, length, region, list of terms, file) as one for each folder and file: (place, its postings).

    Postings are in order of their term and row. Documents and terms stand once in each such block, with which documents hold
    a term, how often, and the steps between the places, all compressed.
    """
    out, codec, file = [], pa.Codec("zstd"), batch.column(4).to_numpy()
    for f in np.unique(file).tolist():
        part = batch.filter(pa.array(file == f))
        words, row, word, begins, at = _grouped(part)
        hashed = np.array([xxhash.xxh64_intdigest(w, 42) for w in words.to_pylist()], dtype=np.uint64).view(np.int64)  # Spark's xxhash64
        bucket = np.mod(hashed, buckets)[word]
        order = np.lexsort((row, word, bucket))
        row, word, bucket, sizes, begins = row[order], word[order], bucket[order], np.diff(begins)[order], begins[:-1][order]
        ends = np.cumsum(sizes)
        at = at[np.repeat(begins - (ends - sizes), sizes) + np.arange(len(at))]
        steps = np.diff(at, prepend=np.int32(0))
        steps[ends - sizes] = at[ends - sizes]
        edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            rows, doc = np.unique(row[a:b], return_inverse=True)
            terms_, times = np.unique(word[a:b], return_counts=True)
            held = part.select([0, 1, 2]).take(pa.array(rows))
            lists = [*held.columns, words.take(pa.array(terms_)), *[pa.array(x.astype(np.int32)) for x in (times, np.diff(doc, prepend=0), sizes[a:b], steps[ends[a] - sizes[a] : ends[b - 1]])]]
            block = pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists], names=["key", "length", "region", "term", "times", "doc", "tf", "step"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, block.schema) as stream:
                stream.write_batch(block)
            data = sink.getvalue()
            out.append((int(bucket[a]) * files + f, len(data).to_bytes(8, "little") + codec.compress(data, asbytes=True)))
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.binary())], names=["place", "postings"])


def _unpacked(data: bytes) -> pa.RecordBatch:
    """A block's postings as rows (key, length, region, term, positions)."""
    block = pa.ipc.open_stream(pa.Codec("zstd").decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"))).read_next_batch()
    key, length, region, words, times, doc, sizes, steps = (c.flatten() for c in block.columns)
    doc, word = pa.array(np.cumsum(doc.to_numpy())), pa.array(np.repeat(np.arange(len(words)), times.to_numpy()))
    sizes, steps = sizes.to_numpy(), steps.to_numpy()
    begins, sums = np.append(0, np.cumsum(sizes)), np.cumsum(steps, dtype=np.int64)
    at = sums - np.repeat((sums - steps)[begins[:-1]], sizes)
    positions = pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(at, pa.int32()))
    return pa.RecordBatch.from_arrays([key.take(doc), length.take(doc), region.take(doc), words.take(word), positions], names=["key", "length", "region", "term", "positions"])


def _postings(corpus: DataFrame, key: str, text: Column, documents: int, buckets: int) -> DataFrame:
    """The rows of ``tokens`` with ``bucket``, in the partitions that write them: those of a folder and file in one.

    A row for each slice of documents, folder and file is shuffled, which holds the postings packed. This is the only shuffle.
    """
    files = documents // FILE_ROWS + 1
    tasks = min(buckets * files, MOST_TASKS)
    packed = tokens(corpus, key, text, _parts(documents), (buckets, files))
    dealt = packed.repartitionById(tasks, F.pmod("place", F.lit(tasks)).cast("int"))
    own = T.StructField("key", corpus.select(F.col(key)).schema[0].dataType)
    schema = T.StructType([own, *T.StructType.fromDDL("length bigint, region int, term string, positions array<int>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column(1):
                yield _unpacked(block.as_py())

    return dealt.mapInArrow(run, schema).select("*", F.size("positions").cast("bigint").alias("tf"), _bucket(buckets))


def _dealt(rows: DataFrame, documents: int, buckets: int) -> DataFrame:
    """Rows with ``bucket``, by their term's hash, and ``file``, by their key's, shuffled by both."""
    file = F.pmod(F.xxhash64("key"), F.lit(documents // FILE_ROWS + 1)).cast("int").alias("file")
    return rows.select("*", _bucket(buckets), file).repartition("bucket", "file")


def _write(made: DataFrame, path: str) -> None:
    """Postings to a folder for each bucket, common ones as several files, each in order of (term, region, key)."""
    with shuffles_dropped(made.sparkSession):
        made.sortWithinPartitions("bucket", "term", "region", "key").write.partitionBy("bucket").parquet(path)


def _parts(rows: int) -> int:
    return min(MOST_PARTS, rows // REGION_ROWS + 1)


def buckets_of(rows: int) -> int:
    return min(MOST_FOLDERS, rows // FOLDER_ROWS + 1)


def summed(postings_: DataFrame) -> DataFrame:
    """(term, region, n, most, shortest) of terms that many documents hold: postings, most hits, least length.

    Which terms those are is counted first and written, one row each: the others, most terms by far, have about a region for
    each posting and would not combine before the shuffle.
    """
    common = kept(postings_.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= REGIONED).select("term"), "common-terms")
    rows = postings_.select("term", "region", "tf", "length").join(common, "term", "left_semi")
    return rows.groupBy("term", "region").agg(F.count(F.lit(1)).alias("n"), F.max("tf").alias("most"), F.min("length").alias("shortest"))


def build(corpus: DataFrame, key: str, text: Column) -> Index:
    """Writes the index of a corpus, whose keys must be unique."""
    spark, rows, path = corpus.sparkSession, corpus.count(), new_path(corpus.sparkSession, "index")
    buckets = buckets_of(rows)
    made = _postings(corpus, key, text, rows, buckets).select(*[c for c in _COLUMNS if c != "segment"])
    _write(made, path)
    written = spark.read.schema(made.schema).parquet(path)
    total = written.agg(F.coalesce(F.sum("tf"), F.lit(0))).first()[0]
    regions = kept(summed(written), "index-regions") if rows >= REGIONED else None
    return Index(written, rows, total / max(rows, 1), buckets, regions)


_BUILT: dict[tuple, Index] = {}


def of(corpus: DataFrame, key: str, text: Column) -> Index:
    """The index of files as they are: built when first asked for in this application, and again once the files change
    or the work folder was emptied."""
    mark = (corpus.sparkSession.sparkContext.applicationId, stamp(corpus), key, str(text))
    if mark not in _BUILT or not exists(_BUILT[mark].postings):
        _BUILT[mark] = build(corpus, key, text)
    return _BUILT[mark]


def phrase_places(positions: list[Column]) -> Column:
    """Where a phrase begins, from the positions of its words: those of each word, shifted by its place, intersected."""
    here = positions[0]
    for step, later in enumerate(positions[1:], 1):
        here = F.array_intersect(here, F.transform(later, _back(step)))
    return here


def _back(step: int):
    return lambda place: place - step


def frequencies(index: Index, phrases: list[list[str]]) -> DataFrame:
    """(key, length, f0, f1, ...): how often each phrase stands in the documents that hold any of their words."""
    words = sorted({w for p in phrases for w in p})
    at, inside = {w: f"t{i}" for i, w in enumerate(words)}, {w for p in phrases if len(p) > 1 for w in p}
    picked = lambda w, c: F.max(F.when(F.col("term") == w, F.col(c)))  # noqa: E731  a term is in a document once
    found = index.of_terms(words).groupBy("key").agg(
        F.max("length").alias("length"), *[F.coalesce(picked(w, "tf"), F.lit(0)).alias(c) for w, c in at.items()], *[picked(w, "positions").alias(f"p_{at[w]}") for w in sorted(inside)]
    )
    counts = [F.coalesce(F.size(phrase_places([F.col(f"p_{at[w]}") for w in p])), F.lit(0)) if len(p) > 1 else F.col(at[p[0]]) for p in phrases]
    return found.select("key", "length", *[F.greatest(c, F.lit(0)).cast("bigint").alias(f"f{i}") for i, c in enumerate(counts)])


def bm25(index: Index, phrases: list[list[str]], key: str = "key") -> DataFrame:
    """(key, length, bm25) of the documents that hold every phrase; bm25 is negative, smaller is better.

    Counts are over the whole corpus: how many documents hold each phrase comes to the driver, a number for each phrase.
    """
    found = frequencies(index, phrases)
    names = [f"f{i}" for i in range(len(phrases))]
    having = found.agg(*[F.count_if(F.col(n) > 0).alias(n) for n in names]).first()
    return _scored(found, index, names, [having[n] for n in names]).withColumnRenamed("key", key)


def _scored(found: DataFrame, index: Index, names: list[str], having: list[int]) -> DataFrame:
    score, every = F.lit(0.0), F.lit(True)
    for n, h in zip(names, having, strict=True):
        score = score + bm25_part(idf(F.lit(float(index.rows)), F.lit(float(h))), F.col(n), F.col("length"), F.lit(index.mean))
        every = every & (F.col(n) > 0)
    return found.where(every).select("key", F.col("length").cast("bigint").alias("length"), (-score).alias("bm25"))


def bm25_many(index: Index, queries: DataFrame, k: int, digits: int = 9) -> DataFrame:
    """(query_id, key, length, bm25, place) for a table of queries (query_id, term): the k best of each, all in one plan.

    A document must hold all terms of a query. Postings meet the queries' terms by folder and term, so the folders of no term
    aren't read, and how many documents hold a term is counted where its postings are. Scores are rounded to ``digits``, equal
    ones go by key. Best documents are picked in two steps, so a query with many hits is no single list.
    """
    asked = queries.select("query_id", "term").distinct()
    words = asked.select("term").distinct().select("term", _bucket(index.buckets))
    held = index.postings.select("bucket", "term", "key", "tf", "length") if index.buckets > 1 else index.postings.select(F.lit(0).alias("bucket"), "term", "key", "tf", "length")
    held = held.join(words, ["bucket", "term"], "left_semi")
    weights = held.groupBy("term").agg(F.count(F.lit(1)).alias("df")).select("term", idf(F.lit(float(index.rows)), F.col("df").cast("double")).alias("idf"))
    sizes = asked.groupBy("query_id").agg(F.count(F.lit(1)).alias("terms"))
    part = bm25_part(F.col("idf"), F.col("tf"), F.col("length"), F.lit(index.mean))
    found = held.join(asked.join(weights, "term"), "term").groupBy("query_id", "key").agg(F.max("length").alias("length"), F.sum(part).alias("score"), F.count(F.lit(1)).alias("hits"))
    found = found.join(sizes, "query_id").where(F.col("hits") == F.col("terms")).select("query_id", "key", "length", F.round(-F.col("score"), digits).alias("bm25"))
    first = lambda rows, *by: rows.withColumn("place", F.row_number().over(Window.partitionBy("query_id", *by).orderBy("bm25", "key"))).where(F.col("place") <= k)
    return first(first(found.withColumn("_part", F.pmod(F.xxhash64("key"), F.lit(16))), "_part").drop("_part", "place"))


@dataclass(frozen=True)
class Top:
    """``rows`` (key, length, bm25) in order; how many postings were read for them, of how many."""

    rows: DataFrame
    read: int
    held: int


def top(index: Index, words: list[str], k: int, digits: int = 9) -> Top:
    """The k best documents that hold all words, by bm25 rounded to ``digits``, then by key: exactly those of ``bm25``.

    What a region can score at most follows from the most hits and the least length in it. The regions that promise most are
    read first; their k-th score rules out all regions that can't reach it.
    """
    words = sorted(set(words))
    known = index.regions.where(F.col("term").isin(words)) if index.regions is not None else None
    rare = [w for w in words if known is None or known.where(F.col("term") == w).isEmpty()]
    each = index.of_terms(rare).groupBy("term", "region").agg(F.count(F.lit(1)).alias("n"), F.max("tf").alias("most"), F.min("length").alias("shortest")) if rare else None
    headers = kept(known if each is None else each if known is None else known.unionByName(each), "regions")
    df = {r.term: r.df for r in headers.groupBy("term").agg(F.sum("n").alias("df")).collect()}
    held, having = sum(df.values()), [df.get(w, 0) for w in words]
    weight = F.create_map(*[x for w, h in zip(words, having, strict=True) for x in (F.lit(w), idf(F.lit(float(index.rows)), F.lit(float(h))))])
    most = F.sum(bm25_part(F.try_element_at(weight, F.col("term")), F.col("most"), F.col("shortest"), F.lit(index.mean)))
    bounds = headers.groupBy("region").agg(most.alias("bound"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("terms")).where(F.col("terms") == len(words))
    bounds = kept(bounds.select("region", F.round("bound", digits).alias("bound"), "n"), "region-bounds")

    def scored(rows: DataFrame) -> DataFrame:
        names = [f"f{i}" for i in range(len(words))]
        counts = [F.coalesce(F.max(F.when(F.col("term") == w, F.col("tf"))), F.lit(0)).alias(n) for w, n in zip(words, names, strict=True)]
        found = _scored(rows.groupBy("key").agg(F.max("length").alias("length"), *counts), index, names, having)
        return found.withColumn("bm25", F.round("bm25", digits)).orderBy("bm25", "key").limit(k)

    first = [r.region for r in bounds.orderBy(F.desc("bound"), "region").limit(8).collect()]
    best = scored(index.of_terms(words).where(F.col("region").isin(first))).collect() if first else []
    least = -best[-1].bm25 if len(best) == k else None
    wanted = bounds if least is None else bounds.where(F.col("bound") >= least)
    some = wanted.agg(F.count(F.lit(1)).alias("regions"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    listed = [r.region for r in wanted.select("region").collect()] if some.regions <= 1000 else None
    rows = index.of_terms(words)
    rows = rows.join(wanted.select("region"), "region", "left_semi") if listed is None else rows.where(F.col("region").isin(listed))
    return Top(scored(rows), some.n, held)


# An index that follows writes.

_SEGMENT = T.StructType([
    T.StructField("op", T.StringType()), T.StructField("version", T.LongType()), T.StructField("folder", T.StringType()),
    *[T.StructField(n, T.LongType()) for n in ("number", "rows", "total", "gone", "dead_rows", "dead_total", "buckets", "followed")],
])


class Segments:
    """An index as immutable segments and the keys that later ones replace or delete in those before them.

    Adding documents writes a segment of theirs alone. What a segment's keys take away from older ones is counted when it is
    written, so rows and length of the whole are sums. Segments of like size are merged from their postings, never from texts.
    All are named by commits of one table: a reader sees a state before or after a change.
    """

    def __init__(self, spark: SparkSession, path: str, key: T.DataType = T.StringType()):  # noqa: B008  types are constants
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.log = VersionedTable(spark, f"{self.path}/log", _SEGMENT, ["number"])
        self.postings = T.StructType.fromDDL("term string, region int").add("key", key).add("tf", T.LongType()).add("length", T.LongType()).add("positions", T.ArrayType(T.IntegerType())).add("segment", T.LongType()).add("bucket", T.IntegerType())
        self.lengths = T.StructType([T.StructField("key", key), T.StructField("length", T.LongType()), T.StructField("segment", T.LongType())])
        self.marks = T.StructType([T.StructField("key", key), T.StructField("segment", T.LongType())])

    def segments(self) -> list:
        return self.log.latest().orderBy("number").collect()  # FANOUT for each size, so as the logarithm of the corpus

    def followed(self) -> int:
        """The commit of the source up to which the index has followed it."""
        return max((s.followed for s in self.segments()), default=0)

    def _read(self, segments: list, name: str, schema: T.StructType) -> DataFrame:
        paths = [f"{s.folder}/{name}" for s in segments if name != "gone" or s.gone]
        if not paths:
            return self.spark.createDataFrame([], schema)
        if name == "postings":  # partitioned folders, each with a root of its own
            return functools.reduce(DataFrame.union, [self.spark.read.schema(schema).parquet(p) for p in paths])
        return self.spark.read.schema(schema).parquet(*paths)

    def _live(self, rows: DataFrame, segments: list) -> DataFrame:
        """Rows of documents that no later segment replaces or deletes."""
        if not any(s.gone for s in segments):
            return rows
        last = self._read(segments, "gone", self.marks).groupBy("key").agg(F.max("segment").alias("_last"))
        return rows.join(last, "key", "left").where(F.col("_last").isNull() | (F.col("segment") >= F.col("_last"))).drop("_last")

    def index(self) -> Index:
        segments = self.segments()
        rows, total = sum(s.rows - s.dead_rows for s in segments), sum(s.total - s.dead_total for s in segments)
        buckets = {s.buckets for s in segments}
        return Index(self._live(self._read(segments, "postings", self.postings), segments), rows, total / max(rows, 1), buckets.pop() if len(buckets) == 1 else 1)

    def add(self, corpus: DataFrame, key: str, text: Column, gone: DataFrame | None = None, followed: int = 0) -> None:
        """A segment of the corpus (unique keys); ``gone`` (key) are keys of older segments that it replaces or deletes.

        If another writer comes first, this fails (``Conflict``) and has changed nothing.
        """
        base, older = self.log.head(), self.segments()
        number = max((s.number for s in older), default=0) + 1
        folder, rows = f"{self.path}/segments/{number}-{uuid.uuid4().hex}", corpus.count()
        buckets = buckets_of(rows)
        made = _postings(corpus, key, text, rows, buckets).withColumn("segment", F.lit(number).cast("bigint"))
        _write(made.select(*_COLUMNS), f"{folder}/postings")
        written = self.spark.read.schema(self.postings).parquet(f"{folder}/postings")
        total = written.agg(F.coalesce(F.sum("tf"), F.lit(0))).first()[0]
        lengths = written.groupBy("key").agg(F.first("length").alias("length"))
        corpus.select(F.col(key).alias("key")).join(lengths, "key", "left").select("key", F.coalesce("length", F.lit(0)).cast("bigint").alias("length"), F.lit(number).cast("bigint").alias("segment")).write.parquet(f"{folder}/lengths")
        marks = dead = None
        if gone is not None and older:
            marks = gone.toDF("key").select(F.col("key").cast(self.key).alias("key"), F.lit(number).cast("bigint").alias("segment")).distinct()
            marks.write.parquet(f"{folder}/gone")
            marks = self.spark.read.schema(self.marks).parquet(f"{folder}/gone")
            lost = self._live(self._read(older, "lengths", self.lengths), older).join(marks.select("key"), "key", "left_semi")
            dead = lost.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
        row = {"number": number, "folder": folder, "rows": rows, "total": total, "gone": marks.count() if marks is not None else 0, "dead_rows": dead[0] if dead else 0, "dead_total": dead[1] if dead else 0, "buckets": buckets, "followed": followed}
        self.log.commit([row], base)
        self.merge()

    def merge(self) -> None:
        """Merges the newest segments while FANOUT or more of them are of one size or less."""
        while True:
            base, segments = self.log.head(), self.segments()
            size = lambda s: max(s.rows, 1).bit_length() // FANOUT.bit_length()
            for level in sorted({size(s) for s in segments}):
                last = next((i for i, s in enumerate(reversed(segments)) if size(s) > level), len(segments))
                if last >= FANOUT:
                    break
            else:
                return
            chosen = segments[len(segments) - last :]
            self._merge(chosen, base)

    def _merge(self, chosen: list, base: int) -> None:
        number = chosen[-1].number
        folder, at = f"{self.path}/segments/{number}-{uuid.uuid4().hex}", F.lit(number).cast("bigint")
        live = kept(self._live(self._read(chosen, "lengths", self.lengths), chosen), "lengths")
        rows, total = live.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
        buckets = buckets_of(rows)
        _write(_dealt(self._live(self._read(chosen, "postings", self.postings), chosen).drop("bucket").withColumn("segment", at), rows, buckets).select(*_COLUMNS), f"{folder}/postings")
        live.withColumn("segment", at).write.parquet(f"{folder}/lengths")
        marks = self._read(chosen, "gone", self.marks).select("key", at.alias("segment")).distinct()
        gone = marks.count()
        if gone:
            marks.write.parquet(f"{folder}/gone")
        before, length = sum(s.rows - s.dead_rows for s in chosen), sum(s.total - s.dead_total for s in chosen)
        row = {"number": number, "folder": folder, "rows": rows, "total": total, "gone": gone, "dead_rows": rows - before, "dead_total": total - length, "buckets": buckets, "followed": max(s.followed for s in chosen)}
        self.log.commit([*[{"number": s.number, "op": "D"} for s in chosen[:-1]], row], base)

    def reset(self) -> None:
        """Takes all segments out; files of old ones stay for those who read them still."""
        old = self.segments()
        if old:
            self.log.commit([{"number": s.number, "op": "D"} for s in old], self.log.head())
