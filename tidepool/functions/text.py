"""Text as columns: folding, tokens, counts, snippets, redaction."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words joined by hyphens or apostrophes count as one token; search terms are plain runs of letters and digits.
TOKEN = r"([\p{L}\p{N}]+(?:[-'][\p{L}\p{N}]+)*)"
TERM = r"([\p{L}\p{N}]+)"

# Combining marks that a search passes over.
MARKS = "\u0300\u0301\u0302\u0303\u0304\u0306\u0307\u0308\u0309\u030a\u030b\u030c\u030f\u0311\u031b\u0323\u0324\u0325\u0326\u0327\u0328\u032d\u032e\u0330\u0331"


def _plain(letter: str) -> str | None:
    """The Latin letter that one with a single such mark folds to."""
    parts = unicodedata.normalize("NFD", letter)
    return parts[0] if len(parts) == 2 and parts[0].isascii() and parts[1] in MARKS else None


_FOLDED = {c: p for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]) if c == c.lower() and (p := _plain(c))} | {"ſ": "s", "µ": "μ", "ς": "σ"}
_FROM, _TO = "".join(_FOLDED) + MARKS, "".join(_FOLDED.values())  # what has no counterpart is deleted
_TABLE = str.maketrans(_FROM[: len(_TO)], _TO, MARKS)

# What is masked, in this order, and by what. Classes are Unicode's.
REDACTIONS = (
    (r"(?i)\b(?:sk-or-v1-|sk-)[A-Za-z0-9_-]{16,}", "[REDACTED_SECRET]"),
    (r"(?i)\b(?:bearer\s+)[A-Za-z0-9._~+/=-]{12,}", "[REDACTED_SECRET]"),
    (r"(?i)\b(?:api[_-]?key|token|password|secret)\s*[:=]\s*[^\s,;]+", "[REDACTED_SECRET]"),
    (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "[REDACTED_EMAIL]"),
    (r"(?<!\w)(?:\+?\d[\d ()-]{8,}\d)(?!\w)", "[REDACTED_PHONE]"),
)
# Languages by suffix; others are text.
LANGUAGES = {
    ".py": "python",
    ".md": "markdown",
    ".markdown": "markdown",
    ".txt": "text",
    ".rst": "text",
    ".json": "json",
    ".toml": "toml",
    ".yaml": "yaml",
    ".yml": "yaml",
}


def fold(text: Column) -> Column:
    """Lower case without accents: single marks on Latin letters, written as one character or two."""
    return F.translate(F.lower(text), _FROM, _TO)


def folded(text: str) -> str:
    """``fold`` of a single text."""
    return text.lower().translate(_TABLE)


def terms(text: Column) -> Column:
    return F.regexp_extract_all(fold(text), F.lit(TERM), 1)


def count_tokens(text: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), 1)).cast("bigint")


def query_phrases(query: str) -> list[list[str]]:
    """A query's tokens, each a phrase of search terms. All must match. Nothing to search for is an error."""
    tokens = re.findall(r"[^\W_]+(?:[-'][^\W_]+)*", folded(query))
    if not tokens:
        raise ValueError("the query holds no searchable token")
    return [re.findall(r"[^\W_]+", t) for t in tokens]


def first_words(text: Column, n: int = 12, mark: bool = False) -> Column:
    """The first words joined by single spaces; with ``mark`` short texts stay as they are and cut ones end in an ellipsis."""
    words = F.split(F.trim(text), r"\s+")
    cut = F.array_join(F.slice(words, 1, n), " ")
    return F.when(F.size(words) > n, F.concat(cut, F.lit("…"))).otherwise(text) if mark else cut


def around(text: Column, word: str, before: int = 80, length: int = 240) -> Column:
    """A stretch of text from a little before a word's first place, else from the start."""
    at = F.locate(word.lower(), F.lower(text))
    return F.substr(text, F.when(at > 0, F.greatest(at - before, F.lit(1))).otherwise(1), F.lit(length))


def redact(text: Column, rules: tuple = REDACTIONS) -> Column:
    for pattern, mask in rules:
        text = F.regexp_replace(text, f"(?U){pattern}", mask)
    return text


def normalized(text: Column) -> Column:
    return F.lower(F.trim(text))


def language_of(path: Column) -> Column:
    """A file's language by its suffix: from the last dot of its name on, unless the name begins there."""
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))), F.lit("text"))


def cut_to_tokens(text: str, budget: int) -> str:
    """The longest beginning of a text, without white space at its end, that holds at most ``budget`` tokens."""
    if budget <= 0:
        return ""
    found = list(re.finditer(r"[^\W_]+(?:[-'][^\W_]+)*", text))
    return text if len(found) <= budget else text[: found[budget].start()].rstrip()
