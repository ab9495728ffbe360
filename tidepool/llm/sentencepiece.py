"""SentencePiece encoding and decoding by a streaming Viterbi pass.

The model's vocabulary, scores and normalisation come from its file. For a unigram model the pass keeps, for each place of
a window no longer than the longest piece, the best score and the backpointer of the piece that ends there. For a merge
(BPE) model, the kind of the public file, scores aren't added up: the last piece of a prefix's encoding is the one piece
whose joint with the encoding before it is itself stable under merging, so a backpointer is kept for that piece instead.
Either way pieces are committed whenever the backpointer paths from all places of the window meet at one boundary.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame

from .common import map_columns

SPACE = "▁"
#: Words whose ids, and joints whose stability, a Python worker remembers at once.
REMEMBERED = 600_000
NONE: dict[str, bool] = {}


class Pieces:
    """A model's pieces by text; ``kind`` is ``bpe`` or ``unigram``."""

    def __init__(self, path: str, kind: str = "bpe"):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.kind = kind
        m = self.model
        self.id_of: dict[str, int] = {}
        self.byte_of: dict[int, int] = {}
        for i in range(m.get_piece_size()):
            piece = m.id_to_piece(i)
            if m.is_byte(i):
                self.byte_of[int(piece[3:5], 16)] = i
            elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
                self.id_of[piece] = i
        self.byte_text = {i: bytes([b]) for b, i in self.byte_of.items()}
        self.score_of = {p: m.get_score(i) for p, i in self.id_of.items()}
        self.longest = max(map(len, self.id_of), default=1)
        # A boundary before a space holds if no piece runs over it.
        self.splits = not any(SPACE in p.lstrip(SPACE) for p in self.id_of)
        self.spare = min(self.score_of.values(), default=0.0) - 10.0
        self.words: dict[str, tuple[int, ...]] = {}
        self.joints: dict[str, dict[str, bool]] = {}
        self.remembered = 0
        # Pieces that merging their own characters gives; others never come out of a merge model.
        self.reversed: dict[str, tuple] = {}
        for piece in self.id_of if kind == "bpe" else ():
            if len(piece) == 1 or self.merged(piece) == [piece]:
                node = self.reversed
                for letter in reversed(piece[1:]):
                    node = node.setdefault(letter, ({}, None))[0]
                node[piece[0]] = (node.get(piece[0], ({}, None))[0], piece)

    def merged(self, text: str) -> list[str]:
        """A short text's pieces by plain merging: the best-scored adjacent pair first, the leftmost of equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score_of.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def stable(self, left: str, right: str) -> bool:
        """Whether merging the two pieces' text gives just these two pieces."""
        if self.remembered >= REMEMBERED:
            self.joints.clear()
            self.remembered = 0
        known = self.joints.setdefault(left, {})[right] = self.merged(left + right) == [left, right]
        self.remembered += 1
        return known

    def _best_unigram(self, text: str, end: int, start: int, best: dict[int, float]) -> str:
        found, score = "", float("-inf")
        for begin in range(max(start, end - self.longest), end):
            own = self.score_of.get(text[begin:end], self.spare if end - begin == 1 else None)
            if own is not None and begin in best and best[begin] + own > score:
                found, score = text[begin:end], best[begin] + own
        best[end] = score
        return found

    def stream(self, text: str) -> Iterator[list[str]]:
        """The text's pieces, a few at a time.

        Held are the scores (for unigram models) of a window of the longest piece, and the backpointers (the piece that ends
        at a place) since the last committed boundary. Two windows after that boundary the paths from every place of the last window are
        compared; they share all boundaries below the place where they meet, and those are committed.
        """
        n, start = len(text), 0
        back: dict[int, str] = {}
        best: dict[int, float] = {0: 0.0}
        unigram, window, joints, pieces = self.kind == "unigram", 2 * self.longest, self.joints, self.reversed
        for end in range(1, n + 1):
            if unigram:
                back[end] = self._best_unigram(text, end, start, best)
                best.pop(end - self.longest, None)  # no piece that ends later begins there
            else:  # the trie of reversed pieces is walked from ``end`` back to the only piece with a stable joint before it
                node, begin, found = pieces, end - 1, text[end - 1]  # a character without a piece never merges
                while begin >= start and (step := node.get(text[begin])) is not None:
                    node, piece = step
                    if piece is not None:
                        if begin == 0:
                            found = piece
                            break
                        before = back[begin]
                        known = joints.get(before, NONE).get(piece)
                        if self.stable(before, piece) if known is None else known:
                            found = piece
                            break
                    begin -= 1
                back[end] = found
            if end == n or end - start >= window:
                path = self._path(end, start, back)
                boundary = end
                if end < n:
                    shared = set(path).intersection(*[self._path(e, start, back) for e in range(end - self.longest + 1, end)])
                    boundary = max(shared, default=start)
                if boundary > start:
                    yield [back[x] for x in reversed(path) if x <= boundary]
                    start = boundary
                    back = {e: p for e, p in back.items() if e >= start}
                    best = {e: s for e, s in best.items() if e >= start}

    @staticmethod
    def _path(end: int, start: int, back: dict[int, str]) -> list[int]:
        """The boundaries of the path that ends at ``end``, from there back, without ``start``."""
        path = []
        while end > start:
            path.append(end)
            end -= len(back[end])
        return path

    def ids(self, piece: str) -> list[int]:
        known = self.id_of.get(piece)
        return [known] if known is not None else [self.byte_of[b] for b in piece.encode()] if self.byte_of else [self.model.unk_id()]

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text, by words where no piece runs over a space, else in one stream."""
        text = self.model.normalize(text)
        out: list[int] = []
        for word in self._words(text) if self.splits else [text]:
            ids = self.words.get(word)
            if ids is None:
                ids = tuple(i for pieces in self.stream(word) for p in pieces for i in self.ids(p))
                if len(word) <= 64:
                    if len(self.words) >= REMEMBERED:
                        self.words.clear()
                    self.words[word] = ids
            out += ids
        return out

    @staticmethod
    def _words(text: str):
        """Cuts before each run of spaces."""
        start, n = 0, len(text)
        while start < n:
            end = start
            while end < n and text[end] == SPACE:
                end += 1
            end = text.find(SPACE, end)
            end = n if end < 0 else end
            yield text[start:end]
            start = end

    def decode(self, ids: list[int]) -> str:
        """The text of ids, as the library gives it: bytes joined, marks turned to spaces, one leading space dropped."""
        return self.model.decode(ids)


@cache
def pieces(model: str, kind: str = "bpe") -> Pieces:
    return Pieces(public_tokenizers.path(model), kind)


def encode(docs: DataFrame, model: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of every whole text: (doc_id, ids array).

    Null or empty text: no ids. Null ids, repeated rows: one row out for each row in. Empty table: no rows. Extra columns:
    ignored.
    """

    def make():
        vocabulary = pieces(model)

        def work(doc_id: list, text: list) -> dict:
            return {"doc_id": doc_id, "ids": [vocabulary.encode(t) if t else [] for t in text]}

        return work

    rows = docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"`{text_col}` as text")
    return map_columns(rows, "doc_id bigint, ids array<int>", make)


def decode(tokens: DataFrame, model: str = "piece_bpe_32k.model", id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Texts of ids: (doc_id, text). Null or no ids: empty text. Otherwise as ``encode``."""

    def make():
        vocabulary = pieces(model)

        def work(doc_id: list, ids: list) -> dict:
            return {"doc_id": doc_id, "text": [vocabulary.decode(x) if x else "" for x in ids]}

        return work

    rows = tokens.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"`{ids_col}` as ids")
    return map_columns(rows, "doc_id bigint, text string", make)


def digest(docs: DataFrame, model: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes every whole text in one pass: token count, crc32 of the ids (little-endian unsigned 32 bits),
    whether decoding gives the text back (not so where the model's normalisation changes it). Rows as in ``encode``."""

    def make():
        vocabulary = pieces(model)

        def work(doc_id: list, text: list) -> dict:
            ids = [vocabulary.encode(t) if t else [] for t in text]
            same = [vocabulary.decode(i) == (t or "") for i, t in zip(ids, text, strict=True)]
            return {"doc_id": doc_id, "n_tokens": [len(i) for i in ids], "ids_crc32": [zlib.crc32(np.array(i, dtype="<u4").tobytes()) for i in ids], "round_trip": same}

        return work

    rows = docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"`{text_col}` as text")
    return map_columns(rows, "doc_id bigint, n_tokens bigint, ids_crc32 bigint, round_trip boolean", make)
