"""What outside models give the engine: embeddings, rerank scores, extracted facts. Protocols, batching, checks of answers."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator, Sequence
from typing import Protocol

#: Texts and characters of a request, at most.
BATCH_ITEMS, BATCH_CHARACTERS = 100, 200_000


class EmbeddingProvider(Protocol):
    def embed(self, texts: list[str], model: str) -> list[list[float]]: ...


class RerankProvider(Protocol):
    def rerank(self, query: str, texts: list[str]) -> object: ...


class ExtractionProvider(Protocol):
    def extract_facts(self, transcript: str, evidence: list[str], model: str) -> list[dict]: ...

    def summarize_scenario(self, contents: list[str], evidence: list[str], model: str) -> dict: ...


class Overlong(ValueError):
    """A text has more characters than a request may hold."""


class Room:
    """What a request holds so far, and whether one more text begins the next one."""

    def __init__(self, items: int = BATCH_ITEMS, characters: int = BATCH_CHARACTERS):
        self.items, self.characters, self.count, self.size = items, characters, 0, 0

    def full(self, size: int) -> bool:
        """Takes a text of so many characters; true if it is the first of another request."""
        over = self.count > 0 and (self.count == self.items or self.size + size > self.characters)
        self.count, self.size = (1, size) if over else (self.count + 1, self.size + size)
        return over


def batches(texts: Sequence[str], items: int = BATCH_ITEMS, characters: int = BATCH_CHARACTERS) -> Iterator[list[str]]:
    """The texts in order, in lists of at most so many, and so many characters unless one text alone has more."""
    held: list[str] = []
    room = Room(items, characters)
    for text in texts:
        if room.full(len(text)):
            yield held
            held = []
        held.append(text)
    if held:
        yield held


def embedded(provider: EmbeddingProvider, texts: list[str], model: str) -> list[list[float]]:
    """Embeddings of one request's texts, one for each, all of one length and finite; anything else is an error."""
    out = provider.embed(texts, model)
    if len(out) != len(texts) or len({len(v) for v in out}) > 1 or not all(math.isfinite(x) for v in out for x in v):
        raise ValueError("the provider gave embeddings of the wrong number, length or value")
    return out


def embed_all(provider: EmbeddingProvider, texts: list[str], model: str) -> list[list[float]]:
    """Embeddings of all texts in as many requests as they fill; texts above the limit are refused before any is asked."""
    if any(len(t) > BATCH_CHARACTERS for t in texts):
        raise Overlong("a text exceeds the characters of a request")
    out = [v for part in batches(texts) for v in embedded(provider, part, model)]
    if len({len(v) for v in out}) > 1:
        raise ValueError("the provider gave embeddings of several lengths")
    return out


def salvaged(text: str) -> object:
    """JSON in noisy text: the text itself, else from its first bracket to the last."""
    try:
        return json.loads(text)
    except ValueError:
        found = re.search(r"(?s)[\[{].*[\]}]", text)
        if not found:
            raise ValueError("no JSON in the answer") from None
        return json.loads(found.group())


def ranks_to_scores(ranks: list[float]) -> list[float]:
    """Ranks, smaller is better, as scores from 1 down to 0; equal ranks all give 1."""
    low, high = min(ranks, default=0.0), max(ranks, default=0.0)
    return [1.0 if high == low else (high - r) / (high - low) for r in ranks]


def rerank_scores(answer: object, count: int) -> list[float]:
    """Scores in the order of the texts, from a list, ``scores``, or ``results`` with an index and a score or rank each."""
    answer = salvaged(answer) if isinstance(answer, str) else answer
    if isinstance(answer, dict) and "scores" in answer:
        answer = answer["scores"]
    elif isinstance(answer, dict):
        answer = answer.get("results", answer.get("data"))
    if not isinstance(answer, list) or len(answer) != count:
        raise ValueError("the answer holds another number of scores")
    if answer and isinstance(answer[0], dict):
        place = {int(r["index"]): r for r in answer}
        if sorted(place) != list(range(count)):
            raise ValueError("the answer's indexes are not those of the texts")
        rows = [place[i] for i in range(count)]
        ranked = "rank" in rows[0]
        answer = [r["rank"] if ranked else r.get("relevance_score", r.get("score")) for r in rows]
        answer = ranks_to_scores([float(x) for x in answer]) if ranked else answer
    if not all(isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x) for x in answer):
        raise ValueError("scores must be finite numbers")
    return [float(x) for x in answer]


class Egress:
    """Which projects' texts may leave; ``*`` stands for all."""

    def __init__(self, allowed: bool = False, projects: Sequence[str] = ()):
        self.allowed, self.projects = allowed, frozenset(projects)

    def permits(self, projects: Sequence[str]) -> bool:
        return self.allowed and ("*" in self.projects or set(projects) <= self.projects)
