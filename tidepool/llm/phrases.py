"""Phrase collocations by contiguous pattern growth: frequent pairs are found first, then every frequent prefix's projection,
the windows of words that begin with it, goes to one task, which extends it to the right depth-first.

Equal windows are one row with a weight before they are shuffled, and a window ends where no frequent phrase can go on. A
prefix with more than a small part of all windows is dealt by one word more, so no task holds more than that part.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SLICE_ROWS, Written

#: Words of a phrase, at most.
LONGEST = 5
#: Words that a task encodes before it gives its counts; different words that it holds meanwhile.
BUFFER_WORDS, BUFFER_VOCABULARY = 1_000_000, 250_000
#: Bits of the filter of frequent pairs: at least, at most, and for each pair.
LEAST_BITS, MOST_BITS, BITS_EACH = 16, 30, 16
#: A prefix with more windows than this, and than all windows divided by the second, is dealt by one word more.
HOT_WINDOWS, HOT_PART = 20_000, 1024
#: Phrases of a language that are ranked in one task.
RANKED = 50_000

# Letters that are lowered, what ends a piece, what parts words.
_UPPER, _LOWER, _ENDS, _BLANKS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b".,;:!?\x0a\x0b\x0c\x0d", b"\x20\x09"
_END = b"\xff"  # in no UTF-8 text
_TABLE = bytes.maketrans(_UPPER + _ENDS + _BLANKS, _LOWER + _END * len(_ENDS) + b" " * len(_BLANKS))


def tokens(text: str | None) -> list[bytes]:
    """A text's words in order; _END between pieces."""
    return (text or "").encode().translate(_TABLE).replace(_END, b" \xff ").split()


class Buffer:
    """Texts of a task as arrays of word numbers by language, 0 between pieces; emptied before it grows too large."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.vocabulary: defaultdict[bytes, int] = defaultdict()
        self.vocabulary.default_factory = self.vocabulary.__len__
        self.vocabulary[_END]  # number 0
        self.texts: defaultdict[str, list] = defaultdict(list)
        self.held = 0

    def add(self, lang: str | None, text: str | None) -> None:
        own = tokens(text)
        own.append(_END)
        self.texts["und" if lang is None else lang].append(np.fromiter(map(self.vocabulary.__getitem__, own), dtype=np.int64, count=len(own)))
        self.held += len(own)

    @property
    def full(self) -> bool:
        return self.held >= BUFFER_WORDS or len(self.vocabulary) >= BUFFER_VOCABULARY

    def words(self) -> pa.Array:
        """The vocabulary by number, null for the end of a piece."""
        return pa.array([None, *[w.decode() for w in list(self.vocabulary)[1:]]], type=pa.string())


def _buffered(df: DataFrame, schema: str, arrow: pa.Schema, give) -> DataFrame:
    """``give(buffer)`` for every buffer that tasks fill from (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffer = Buffer()
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    buffer.add(lang, text)
                    if buffer.full:
                        yield from give(buffer)
                        buffer.clear()
        yield from give(buffer)

    return df.mapInArrow(run, schema)


_COUNTS = pa.schema([("lang", pa.string()), ("first", pa.string()), ("second", pa.string()), ("f", pa.int64())])
_WINDOWS = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())])


def counted(docs: DataFrame) -> DataFrame:
    """(lang, first, second, f): pairs of words; ``second`` is null for single words, ``first`` too for all words together."""

    def give(buffer: Buffer) -> Iterator[pa.RecordBatch]:
        words = buffer.words()
        for lang, texts in buffer.texts.items():
            ids = np.concatenate(texts)
            single = np.bincount(ids, minlength=len(words))
            single[0] = 0
            seen = np.flatnonzero(single)
            left, right = ids[:-1], ids[1:]
            code, n = np.unique((left * len(words) + right)[(left > 0) & (right > 0)], return_counts=True)
            none = np.zeros(1, dtype=np.int64)
            first, second = np.concatenate([none, seen, code // len(words)]), np.concatenate([none, np.zeros_like(seen), code % len(words)])
            f = np.concatenate([[single.sum()], single[seen], n])
            for at in range(0, len(f), 100_000):
                part = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(f[part]), type=pa.string()), words.take(pa.array(first[part])), words.take(pa.array(second[part])), pa.array(f[part], type=pa.int64())], schema=_COUNTS)

    rows = _buffered(docs, "lang string, first string, second string, f bigint", _COUNTS, give)
    return rows.groupBy("lang", "first", "second").agg(F.sum("f").alias("f"))


def _hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def _places(lang: str, first: np.ndarray, second: np.ndarray, bits: int) -> np.ndarray:
    """Where pairs of word hashes lie in a filter of 2 ** bits bits."""
    with np.errstate(over="ignore"):
        mixed = (first * np.uint64(0x9E3779B97F4A7C15) ^ second) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(_hash(lang.encode()))
        return ((mixed ^ mixed >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)


def pair_filter(pairs: DataFrame) -> tuple[int, bytes]:
    """(bits, filter): a bitmap with the places of (lang, first, second) set, at most 2 ** MOST_BITS bits at any size.

    More pairs than it is made for let more windows through, which are counted all the same.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, (pairs.count() * BITS_EACH).bit_length()))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = batch.column(0).to_pylist()
            first, second = ([_hash(w.encode()) for w in c.to_pylist()] for c in batch.columns[1:3])
            first, second = np.array(first, dtype=np.uint64), np.array(second, dtype=np.uint64)
            at = np.zeros(len(lang), dtype=np.int64)
            for name in set(lang):
                own = np.array([x == name for x in lang])
                at[own] = _places(name, first[own], second[own], bits).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at + 1)], names=["x"])  # bitmap functions count from 1

    found = pairs.select("lang", "first", "second").mapInArrow(place, "x bigint")
    found = found.selectExpr("bitmap_bucket_number(x) as k", "bitmap_bit_position(x) as p").groupBy("k").agg(F.expr("bitmap_construct_agg(p)").alias("bits"))
    whole = bytearray(max(1 << bits >> 3, 4096))
    for r in found.toLocalIterator():  # 4 KB each, at most the filter's size
        whole[(r.k - 1) * 4096 : r.k * 4096] = r.bits
    return bits, bytes(whole)


def windows(docs: DataFrame, bits: int, held: bytes) -> DataFrame:
    """(lang, phrase, f): the words from each place on, as far as all neighbours pass the filter, three to LONGEST words, and how often."""
    shared = docs.sparkSession.sparkContext.broadcast(held)  # at most 2 ** MOST_BITS bits

    def give(buffer: Buffer) -> Iterator[pa.RecordBatch]:
        words, passes = buffer.words(), np.frombuffer(shared.value, dtype=np.uint8)
        hashes = np.fromiter(map(_hash, buffer.vocabulary), dtype=np.uint64, count=len(words))
        for lang, texts in buffer.texts.items():
            ids = np.concatenate([*texts, np.zeros(LONGEST, dtype=np.int64)])
            place = _places(lang, hashes[ids[:-1]], hashes[ids[1:]], bits)
            good = (ids[:-1] > 0) & (ids[1:] > 0) & (passes[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
            good = np.append(good, np.zeros(LONGEST, dtype=bool))
            starts = np.flatnonzero(good[: len(ids)] & good[1 : len(ids) + 1])
            rows, on = np.zeros((len(starts), LONGEST), dtype=np.int32), np.ones(len(starts), dtype=bool)
            for step in range(LONGEST):
                rows[:, step] = np.where(on, ids[np.minimum(starts + step, len(ids) - 1)], 0)
                on = on & good[starts + step]
            rows, n = _distinct(rows)
            for at in range(0, len(n), 100_000):
                part = rows[at : at + 100_000]
                columns = [words.take(pa.array(part[:, i])) for i in range(LONGEST)]
                phrase = pc.binary_join_element_wise(*columns, " ", null_handling="skip")
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), type=pa.string()), phrase, pa.array(n[at : at + 100_000], type=pa.int64())], schema=_WINDOWS)

    rows = _buffered(docs, "lang string, phrase string, f bigint", _WINDOWS, give)
    return rows.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different rows and how often each is there."""
    if not len(rows):
        return rows, np.zeros(0, dtype=np.int64)
    rows = rows[np.lexsort(rows.T[::-1])]
    first = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]).any(axis=1)))
    return rows[first], np.diff(np.append(first, len(rows)))


class Growth:
    """Phrases grown from a task's windows, in the order of their words, so that a prefix's projection is one stretch."""

    def __init__(self, rows: Iterator[tuple[str, list[str], int, int]], least: int):
        self.rows, self.least, self.found = rows, least, []
        self.head = next(rows, None)

    def grow(self, lang: str, prefix: list[str]) -> int:
        """Takes up the prefix's projection, extends it by every word that follows, and gives how often it stands."""
        total, parted, depth = 0, False, len(prefix)
        while self.head is not None and self.head[1][:depth] == prefix and self.head[0] == lang:
            _, words, f, dealt = self.head
            parted = parted or dealt > depth
            if len(words) == depth:
                total += f
                self.head = next(self.rows, None)
            else:
                total += self.grow(lang, words[: depth + 1])
        if depth > 2 and (total >= self.least or parted):  # other tasks may hold more of a prefix that was dealt by more words
            self.found.append((lang, " ".join(prefix), total))
        return total

    def run(self) -> Iterator[list]:
        while self.head is not None:
            self.grow(self.head[0], self.head[1][:2])
            if len(self.found) >= 10_000 or self.head is None:
                yield self.found
                self.found = []


def _prefix(words: int | Column) -> Column:
    return F.substring_index("phrase", " ", words) if isinstance(words, int) else F.array_join(F.slice(F.split("phrase", " "), F.lit(1), words), " ")


def dealt(rows: DataFrame, most: int = HOT_WINDOWS) -> DataFrame:
    """Windows with ``dealt``, how many words of theirs decide on their task: two, or more where many share those."""
    limit = max(most, rows.count() // HOT_PART)
    words, named = F.lit(2), lambda n: F.concat_ws("\t", "lang", _prefix(n))  # no word holds a tab
    for n in range(2, LONGEST):
        own = rows.withColumn("dealt", words).where(F.col("dealt") == n).groupBy(named(n).alias("name")).count()
        hot = [r.name for r in own.where(F.col("count") > limit).collect()]  # at most HOT_PART
        if not hot:
            break
        words = F.when((words == n) & named(n).isin(hot), n + 1).otherwise(words)
    return rows.withColumn("dealt", words)


def grown(rows: DataFrame, least: int, most: int = HOT_WINDOWS) -> DataFrame:
    """(lang, phrase, f): phrases of three words and more that stand at least ``least`` times, from all windows."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for lang, phrase, f, n in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                yield lang, phrase.split(" "), f, n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in Growth(stream(batches), least).run():
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], type=t) for i, t in enumerate(_WINDOWS.types)], schema=_WINDOWS)

    parts = dealt(rows, most).withColumn("task", _prefix(F.col("dealt")))
    parts = parts.repartition("lang", "task").sortWithinPartitions("lang", F.concat("phrase", F.lit(" ")))
    found = parts.select("lang", "phrase", "f", "dealt").mapInArrow(run, "lang string, phrase string, f bigint")
    return found.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def mine(docs: DataFrame, least: int = 100, keep: int = 100, top: int = 2000, hot: int = HOT_WINDOWS) -> DataFrame:
    """Each language's ``top`` phrases of two to five words by how much more often they stand than their parts would.

    ``a`` counts a phrase, ``l`` and ``r`` the parts of its weakest cut, ``n`` all words of the language. Phrases that stand
    at least ``least`` times count; one goes where its words lie inside a longer one that has ``keep`` hundredths of its places.

    Null text: no words; null lang: ``und``, as that name itself. A text of any length is read whole. Equal scores go by
    ``a``, then by the phrase's bytes. Repeated rows count as often as they are there. Ids play no part, so null or repeated
    ones change nothing. Empty table, or nothing frequent: no rows. Extra columns: ignored.
    """
    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    few = Written(counted(rows).where((F.col("f") >= least) | F.col("first").isNull()), "phrase-pairs").df
    sums = few.where("first IS NULL").select("lang", F.col("f").alias("n"))
    shorter = few.where("first IS NOT NULL").select("lang", F.concat_ws(" ", "first", "second").alias("phrase"), "f")
    seen = Written(windows(rows, *pair_filter(few.where("second IS NOT NULL"))), "phrase-windows")
    known = Written(shorter.unionByName(grown(seen.df, least, hot)).withColumn("m", F.size(F.split("phrase", " "))), "phrases").df
    seen.drop()

    # Phrases inside longer ones that stand as often.
    words, m = F.split("phrase", " "), F.col("m")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), m - 1), lambda k: F.transform(F.sequence(F.lit(0), m - k), lambda i: F.array_join(F.slice(words, i + 1, k), " "))))
    around = known.where("m > 2").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    found = known.where("m > 1").join(around, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < keep * F.col("f"), F.lit(True)))

    # The weakest cut of each.
    cuts = found.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), m - 1)).alias("k"))
    cuts = cuts.withColumns({"left": _prefix(F.col("k")), "right": F.array_join(F.slice(words, F.col("k") + 1, F.lit(LONGEST)), " ")})
    part = lambda name, f: known.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cuts = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"]).join(sums, "lang")
    cuts = cuts.withColumn("score", F.expr("(CAST(1000 AS DECIMAL(38, 0)) * a * n) DIV (CAST(l AS DECIMAL(38, 0)) * r)"))
    weakest = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min_by(F.struct("l", "r", "score"), F.struct("score", "k")).alias("cut"))
    scored = Written(weakest.select("lang", "phrase", "a", "cut.*", "n"), "phrase-scores").df

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = scored.count() // RANKED + 1
    first = lambda df, *by: df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= top)
    if parts > 1:
        scored = first(scored, "lang", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    return first(scored, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
