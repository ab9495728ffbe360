"""Scores as columns: BM25, cosine, fusion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def idf(rows: Column, having: Column) -> Column:
    raw = F.ln((rows - having + 0.5) / (having + 0.5))
    return F.when(raw <= 0, LEAST_IDF).otherwise(raw)


def bm25_part(idf_: Column, hits: Column, length: Column, mean: Column) -> Column:
    return idf_ * hits * (K1 + 1) / (hits + K1 * (1 - B + B * length / mean))


def relevance(bm25: Column, mode: str = "relevance") -> Column:
    """A full-text rank (negative, smaller is better) as a score.

    ``relevance`` rises with the match. ``inverse`` and ``pole`` are kept for compatibility: the first
    falls as matches get better, the second has a pole at -1, where it is null.
    """
    if mode == "inverse":
        return 1 / (1 + F.abs(bm25))
    if mode == "pole":
        return F.when(bm25 == -1, None).otherwise(F.try_divide(F.lit(1.0), 1 + bm25))
    return F.abs(bm25) / (1 + F.abs(bm25))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in doubles; 0 for different lengths, empty vectors and zero norms."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    fine = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (norms > 0)
    return F.when(fine, dot(a, b) / F.when(norms > 0, norms)).otherwise(0.0)


def combine(lexical: Column, vector: Column, rerank: Column | None = None) -> Column:
    """Rerank, if there, outweighs the vector score; without either the lexical score stands alone."""
    plain = F.when(vector.isNotNull(), 0.7 * F.coalesce(lexical, F.lit(0.0)) + 0.3 * vector).otherwise(F.coalesce(lexical, F.lit(0.0)))
    if rerank is None:
        return plain
    both = F.when(vector.isNotNull(), 0.8 * rerank + 0.2 * vector).otherwise(rerank)
    return F.when(rerank.isNotNull(), both).otherwise(plain)
