"""PartEnum signatures of sets of word shingles.

Sets of sizes in one band whose Jaccard similarity reaches the threshold differ in at most k elements. The feature domain is
hashed into n1 partitions, so that some partition holds at most k2 of the differences, and each partition into n2 parts, so
that some n2 - k2 of its parts hold none: every choice of n2 - k2 parts of a partition gives a signature, and sufficiently
similar sets share one.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

#: Parts of a partition and differences allowed in it; growth of size bands; partitions more than needed, by 1 in SPARE.
PARTS, ALLOWED, GROWTH, SPARE = 3, 1, 1.5, 3
#: A choice of parts with at most this many elements that aren't common is weak: it gives no signature where enough
#: partitions have others.
WEAK = 0


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Of each byte, whether it parts words; and a fixed random number.
_PARTS_WORDS = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_OF_BYTE = np.random.default_rng(7).integers(0, 1 << 64, 256, dtype=np.uint64)


@lru_cache(4)
def _of_place(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def word_codes(text: str) -> np.ndarray:
    """A 64-bit hash of every word. Words are runs of other than space and U+0009 to U+000D, with A-Z lowered.

    A word's hash is the mixed sum over its bytes of (a number of the byte) times (an odd number of the byte's place).
    """
    data = np.frombuffer(text.encode().lower(), dtype=np.uint8)
    inside = ~_PARTS_WORDS[data]
    edges = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    place = np.arange(first[-1] + lengths[-1]) - np.repeat(first, lengths)
    longest = 1 << int(lengths.max() - 1).bit_length()
    sums = np.add.reduceat(_OF_BYTE[data[inside]] * _of_place(longest)[place], first)
    return mix(sums + lengths.astype(np.uint64))


def shingles(text: str | None, width: int) -> np.ndarray:
    """The distinct ``width``-word shingles as sorted 64-bit hashes; fewer words make one shingle, none an empty set."""
    codes = word_codes(text) if text else np.empty(0, dtype=np.uint64)
    if not len(codes):
        return codes
    span = min(width, len(codes))
    out = codes[: len(codes) - span + 1]
    for i in range(1, span):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + codes[i : len(codes) - span + 1 + i])
    return np.unique(out if span == width else mix(out + np.uint64(span)))


def sketch(items: np.ndarray) -> bytes:
    """A set's size, and of each of so many places as a power of two from twice that size on, whether an odd number of elements falls there."""
    places = 1 << max(6, int(2 * len(items) - 1).bit_length())
    odd = np.bincount((items & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1
    return len(items).to_bytes(4, "little") + np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def least_difference(x: bytes, y: bytes) -> tuple[int, int, int]:
    """Two sets' sizes from their sketches, and how many elements at least are in one of them only.

    What both hold falls on the same place in both, so places that differ need an element each that only one holds. The
    longer sketch is folded to the places of the shorter.
    """
    a, b = (np.frombuffer(s, dtype=np.uint8, offset=4) for s in (x, y))
    short = min(len(a), len(b))
    a, b = (s if len(s) == short else np.bitwise_xor.reduce(s.reshape(-1, short)) for s in (a, b))
    return int.from_bytes(x[:4], "little"), int.from_bytes(y[:4], "little"), int(np.bitwise_count(a ^ b).sum())


@lru_cache(1)
def bands() -> tuple[int, ...]:
    low = [1]
    while low[-1] < 1 << 40:
        low.append(max(low[-1] + 1, int(low[-1] * GROWTH)))
    return tuple(low)


def signatures(items: np.ndarray, num: int, den: int, common: np.ndarray) -> np.ndarray:
    """Signatures of a set for the threshold num/den, as 64-bit numbers; one may come twice.

    ``common`` are sorted shingles of passages that many documents share. It may be any set: a choice of parts is weak by
    what it holds, so similar sets agree on that too, and which signatures come of it changes only the number of candidates.
    """
    n, low = len(items), bands()
    if not n:
        return np.empty(0, dtype=np.uint64)
    rare = np.ones(n, dtype=bool)
    if len(common):
        rare = common[np.minimum(np.searchsorted(common, items), len(common) - 1)] != items
    band = int(np.searchsorted(low, n, side="right")) - 1
    out = [_instance(items, rare, band, num, den)]
    while den * n >= num * low[band + 1]:  # a similar set may be large enough for the next band
        band += 1
        out.append(_instance(items, rare, band, num, den))
    return np.concatenate(out)


def _instance(items: np.ndarray, rare: np.ndarray, band: int, num: int, den: int) -> np.ndarray:
    largest = bands()[band + 1] - 1
    differ = 2 * largest * (den - num) // (den + num)
    if not differ:  # only equal sets are similar
        return np.empty(0, dtype=np.uint64)
    needed = -(-(differ + 1) // (ALLOWED + 1))
    spare = needed // SPARE
    n1 = needed + spare
    part = (mix(items + np.uint64(band * 0x1000193 + 7)) % np.uint64(n1 * PARTS)).astype(np.int64)
    code = mix(items ^ np.uint64(0xA0761D6478BD642F))
    count = np.bincount(part[rare], minlength=n1 * PARTS).reshape(n1, PARTS)
    low = np.bincount(part, weights=(code & np.uint64(0xFFFFFFFF)).astype(float), minlength=n1 * PARTS).astype(np.uint64)
    high = np.bincount(part, weights=(code >> np.uint64(32)).astype(float), minlength=n1 * PARTS).astype(np.uint64)
    code = (low + (high << np.uint64(32))).reshape(n1, PARTS)
    keys, weak = [], []
    where = np.arange(n1, dtype=np.uint64)
    for t, chosen in enumerate(combinations(range(PARTS), PARTS - ALLOWED)):
        chosen = list(chosen)
        keys.append(mix(code[:, chosen].sum(axis=1, dtype=np.uint64) + mix(where * np.uint64(64) + np.uint64(t + 1) + np.uint64(band << 40))))
        weak.append(count[:, chosen].sum(axis=1) <= WEAK)
    keys, weak = np.array(keys), np.array(weak)
    # Similar sets agree in 1 + spare partitions. If at most ``spare`` have a weak choice, an agreement without one is left.
    if weak.any(axis=0).sum() <= spare:
        return keys[~weak]
    return keys.ravel()
