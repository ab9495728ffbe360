"""Byte-pair encoding with public vocabularies: token counts by heap merging, and ids for packing."""

from __future__ import annotations

import base64
import heapq
from functools import cache

import public_tokenizers
import regex
from pyspark.sql import DataFrame

from .common import map_columns

#: The text that the tokenizer file declares as a special token.
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
#: Pre-tokens whose counts a Python worker remembers at once; it starts anew beyond that.
REMEMBERED = 400_000


@cache
def ranks(name: str) -> dict[bytes, int]:
    with open(public_tokenizers.path(name), "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def split_pattern() -> regex.Pattern:
    """The vocabulary's pre-token pattern, with white space as Unicode has it (the regex module adds four controls)."""
    return regex.compile(public_tokenizers.PATTERN.replace(r"[^\s\p{L}\p{N}]", r"[^\p{White_Space}\p{L}\p{N}]").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


def merged_count(word: bytes, rank: dict[bytes, int]) -> int:
    """Tokens of one pre-token: symbols minus merges.

    A heap holds adjacent pairs by (rank, place), a doubly linked list the symbols that are left. The lowest pair merges;
    its two neighbours give new pairs; an entry whose symbols have changed since is passed over. A pre-token that is itself in
    the vocabulary merges to one token, as merging reaches every entry (tested), so its merges need not be done.
    """
    n = len(word)
    if n < 2 or word in rank:
        return min(n, 1)
    end = list(range(1, n + 1))
    back = list(range(-1, n - 1))
    alive = [True] * n
    heap = []
    for i in range(n - 1):
        r = rank.get(word[i : i + 2])
        if r is not None:
            heap.append((r, i, i + 2))
    heapq.heapify(heap)
    left = n
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if not alive[i] or j >= n or end[j] != stop:
            continue
        alive[j] = False
        end[i] = stop
        left -= 1
        if stop < n:
            back[stop] = i
            far = end[stop]
            r = rank.get(word[i:far])
            if r is not None:
                heapq.heappush(heap, (r, i, far))
        before = back[i]
        if before >= 0:
            r = rank.get(word[before:stop])
            if r is not None:
                heapq.heappush(heap, (r, before, stop))
    return left


def token_counts(docs: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken", limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts each whole text's tokens without making ids.

    The special token's text counts as one token, as the tokenizer library has it by default. Null or empty text: no bytes,
    no tokens. Null ids, repeated rows: one row out for each row in. Empty table: no rows. Extra columns: ignored.
    """

    def make():
        rank, find, known = ranks(vocabulary), split_pattern().findall, {}

        def count(text: str) -> int:
            parts = text.split(SPECIAL)
            total = len(parts) - 1
            for part in parts:
                for word in find(part):
                    n = known.get(word)
                    if n is None:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        n = known[word] = merged_count(word.encode(), rank)
                    total += n
            return total

        def work(doc_id: list, text: list) -> dict:
            counts = [count(t) if t else 0 for t in text]
            return {"doc_id": doc_id, "n_bytes": [len(t.encode()) if t else 0 for t in text], "n_tokens": counts, "over_limit": [n > limit for n in counts]}

        return work

    rows = docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"`{text_col}` as text")
    return map_columns(rows, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean", make)
