"""Highlighted snippets for the rows of a result page."""

from __future__ import annotations

import re

from .text import MARKS, folded

WINDOW = 12
_WORD = re.compile(rf"[^\W_](?:[^\W_]|[{MARKS}])*")


def highlight(text: str, phrases: list[list[str]], left: str = "[", right: str = "]", gap: str = "…") -> str:
    """The best window of WINDOW words, phrase hits marked.

    A window starts at a hit, centred on the hits it holds, or at the start of the sentence before it. A phrase's first hit
    counts 1000 and further ones 1; a sentence start adds 100, the text's start 120. The first window of the best score wins.
    """
    words = [(m.start(), m.end(), folded(m.group())) for m in _WORD.finditer(text)]
    hits = [(i, p) for i in range(len(words)) for p, phrase in enumerate(phrases) if [w[2] for w in words[i : i + len(phrase)]] == phrase]
    total = len(words)
    starts = [i for i in range(total) if i == 0 or (gap_ := text[words[i - 1][1] : words[i][0]]) and gap_[-1].isspace() and gap_.rstrip()[-1:] in (".", ":")]

    def score(start: int) -> tuple[int, int]:
        seen: set[int] = set()
        points, first, last = 0, -1, start
        for i, p in hits:
            if start <= i < start + WINDOW:
                points += 1 if p in seen else 1000
                seen.add(p)
                first = i if first < 0 else first
                last = i + len(phrases[p])
        centred = first - int((WINDOW - (last - first)) / 2)
        return points, max(0, min(centred, total - WINDOW))

    best, at = 0, 0
    for o, _ in hits:
        points, centred = score(o)
        if points > best:
            best, at = points, centred
        if total > WINDOW and (before := [s for s in starts if s < o]):
            points = score(before[-1])[0] + (120 if before[-1] == 0 else 100)
            if points > best:
                best, at = points, before[-1]
    spans: list[list[int]] = []
    for i, p in hits:
        if at <= i < at + WINDOW:
            begin, end = words[i][0], words[min(i + len(phrases[p]), at + WINDOW, total) - 1][1]
            if spans and begin < spans[-1][1]:
                spans[-1][1] = max(end, spans[-1][1])
            else:
                spans.append([begin, end])
    out = [gap] if at > 0 else []
    place = words[at][0] if at > 0 else 0
    for begin, end in spans:
        out += [text[place:begin], left, text[begin:end], right]
        place = end
    if at + WINDOW >= total:
        return "".join([*out, text[place:]])
    return "".join([*out, text[place : words[at + WINDOW - 1][1]], gap])
