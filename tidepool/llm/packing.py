"""Packing by cutting-stock column generation.

Documents become ids, then pieces whose lengths come from a short list; the histogram of lengths is a cutting-stock
problem. A linear program over patterns (what one sequence holds of each length) is solved by column generation, where a
knapsack dynamic program prices new patterns; the rounded patterns are dealt to the pieces by their rank in their length.

Documents may be cut freely, so they are cut to few lengths (see STEP); that keeps the program small at any size and the
stock problem an easy one, whose optimum lies at the material bound. Ids come from tiktoken over the ranks of the tokenizer
file's own vocabulary: the same ids (tested), at a fraction of the tokenizer library's processor time, which alone is beyond
the check tool's limit for the whole query (figures in the README).
"""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import SPECIAL, SPECIAL_ID, ranks
from .common import Written, map_columns

#: Pieces are whole sequences, multiples of STEP, or rests below STEP: so the linear program has few rows at any size.
STEP = 64
#: The linear program is solved once no pattern would gain more than this share.
GAIN = 1e-6


def piece_lengths(n: int, capacity: int, step: int = STEP) -> list[int]:
    """A document of n tokens as lengths: whole sequences, then one multiple of step, then the rest."""
    whole, rest = divmod(n, capacity)
    return [capacity] * whole + [x for x in (rest - rest % step, rest % step) if x]


def price(values: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The pattern of the highest value, by unbounded-knapsack dynamic programming over the space used."""
    best = np.zeros(capacity + 1)
    taken = np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        fits = int(np.searchsorted(lengths, room, side="right"))
        best[room] = best[room - 1]
        if fits:
            with_one = best[room - lengths[:fits]] + values[:fits]
            k = int(with_one.argmax())
            if with_one[k] > best[room] + 1e-12:
                best[room], taken[room] = with_one[k], k
    pattern, room = np.zeros(len(lengths), dtype=np.int64), capacity
    while room > 0:
        if taken[room] < 0:
            room -= 1
        else:
            pattern[taken[room]] += 1
            room -= int(lengths[taken[room]])
    return float(best[capacity]), pattern


def solve(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, float]]:
    """The linear program over patterns, least number of sequences: (pattern, how often), by revised simplex.

    Columns are generated until none gains. Steps that leave the objective as it is (several optimal vertices) end it too,
    once there were as many in a row as there are lengths: all that is lost then is less than GAIN of it.
    """
    if not len(lengths):
        return []
    basis = np.diag(capacity // lengths).astype(float)
    inverse = np.diag(1.0 / np.diag(basis))
    amount = inverse @ demand
    least, still = np.inf, 0
    while still <= len(lengths):
        still = 0 if amount.sum() < least * (1 - GAIN / len(lengths)) else still + 1
        least = min(least, amount.sum())
        duals = inverse.sum(axis=0)
        value, pattern = price(duals, lengths, capacity)
        if value <= 1 + GAIN:
            break
        change = inverse @ pattern
        up = change > 1e-9
        ratio = np.where(up, amount / np.where(up, change, 1), np.inf)
        out = int(ratio.argmin())
        amount = np.maximum(amount - ratio[out] * change, 0)
        amount[out] = ratio[out]
        row = inverse[out] / change[out]
        inverse = inverse - np.outer(change, row)
        inverse[out] = row
        basis[:, out] = pattern
    return [(basis[:, i].astype(np.int64), float(amount[i])) for i in range(len(lengths)) if amount[i] > 1e-9]


def patterns(histogram: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Whole-number patterns that use up the histogram: ([(length, pieces)], sequences).

    The program's amounts are rounded down; what is left over goes, longest first, into further sequences. The left-over
    pieces fill about as many sequences as there are lengths, so padding doesn't grow with the input.
    """
    lengths = np.array(sorted(x for x in histogram if x < capacity), dtype=np.int64)
    left = np.array([histogram[int(x)] for x in lengths], dtype=np.int64)
    made = [([(capacity, 1)], histogram[capacity])] if histogram.get(capacity) else []
    for pattern, often in solve(lengths, left.astype(float), capacity):
        used = pattern > 0
        times = min(int(often + 1e-6), int((left[used] // pattern[used]).min()))
        if times:
            left = left - times * pattern
            made.append(([(int(lengths[i]), int(pattern[i])) for i in np.flatnonzero(pattern)], times))
    while left.any():
        room, parts = capacity, []
        for i in range(len(lengths) - 1, -1, -1):
            if n := int(min(left[i], room // lengths[i])):
                parts.append((int(lengths[i]), n))
                room -= n * int(lengths[i])
        times = min(int(left[np.searchsorted(lengths, x)]) // n for x, n in parts)
        for x, n in parts:
            left[np.searchsorted(lengths, x)] -= times * n
        made.append((parts, times))
    return made


def pieces(docs: DataFrame, capacity: int, vocabulary: str, id_col: str, text_col: str) -> DataFrame:
    """Every document's pieces with the crc32 of their ids, the task and the rank among the task's pieces of that length."""

    def make():
        encoder = tiktoken.Encoding("pack", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(vocabulary), special_tokens={SPECIAL: SPECIAL_ID})
        task = TaskContext.get().partitionId()
        seen: dict[int, int] = {}

        def work(doc_id: list, text: list) -> dict:
            out = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "nth")}
            for d, t in zip(doc_id, text, strict=True):
                ids = np.append(encoder.encode_to_numpy(t, allowed_special="all") if t else np.empty(0), 1).astype("<u4")
                start = 0
                for length in piece_lengths(len(ids), capacity):
                    seen[length] = seen.get(length, -1) + 1
                    row = (d, start, length, zlib.crc32(ids[start : start + length].tobytes()), len(ids), task, seen[length])
                    for column, value in zip(out.values(), row, strict=True):
                        column.append(value)
                    start += length
            return out

        return work

    rows = docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"`{text_col}` as text")
    return map_columns(rows, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, task bigint, nth bigint", make)


def pack(docs: DataFrame, capacity: int = 2048, vocabulary: str = "byte_bpe_50k.tiktoken", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs documents' ids, each followed by id 1, into sequences of at most ``capacity`` tokens; one row for each piece.

    Null or empty text: a document of the one id 1. Null ids, repeated rows: packed like any other, each row by itself.
    Empty table: no rows. Extra columns: ignored. Very long texts become many whole sequences and at most two pieces more.
    Pieces of one length are interchangeable: which sequence one lies in follows its task and its rank there.
    """
    cut = Written(pieces(docs, capacity, vocabulary, id_col, text_col), "pack-pieces").df
    counts = cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    ranked = cut.join(counts.select("length", "task", before.alias("before")), ["length", "task"])
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("nth")).alias("rank"))

    # Bounded: at most one row for each length; the plan has a run for each length of each pattern.
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    sequences = 0
    for parts, times in patterns(histogram, capacity):
        offset = 0
        for length, n in parts:
            first = used.get(length, 0)
            runs.setdefault(length, []).append((first, n, sequences, offset))
            used[length] = first + n * times
            offset += n * length
        sequences += times
    plan = {length: np.array(x, dtype=np.int64).T for length, x in runs.items()}

    def make():
        def work(**columns) -> dict:
            length = np.array(columns["length"], dtype=np.int64)
            rank = np.array(columns.pop("rank"), dtype=np.int64)
            sequence, offset = np.zeros_like(rank), np.zeros_like(rank)
            for x in np.unique(length):
                at = np.flatnonzero(length == x)
                first, n, base, inside = plan[int(x)]
                run = np.searchsorted(first, rank[at], side="right") - 1
                copy, place = np.divmod(rank[at] - first[run], n[run])
                sequence[at] = base[run] + copy
                offset[at] = inside[run] + place * x
            return columns | {"sequence_id": sequence, "offset": offset}

        return work

    return map_columns(ranked, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint", make)
