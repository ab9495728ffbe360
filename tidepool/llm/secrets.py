"""Secret scans: fixed patterns, and formats learned by grammar inference.

The fixed patterns give the base spans. Their values are the labelled credentials: for each kind a prefix tree of the
values' character classes is built, and its statistically compatible states are merged (Hoeffding's bound on outgoing
frequencies, red and blue states) into a probabilistic automaton. Every candidate token of every text, inside base spans
too, is scored by its likelihood as such a format, against that of an ordinary token, and likely ones are added as spans.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written, any_names, map_columns

# The base patterns, in the order of their kinds.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "format")
#: Candidates are runs of these characters, padding included, that hold a digit and a letter.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.-]{16,}={0,2}")
#: Labelled credentials of each kind that the automata are learned from, at most, drawn by a hash.
MOST_LABELLED = 400
#: Confidence of Hoeffding's bound, least count at which states are told apart, least count of labelled values.
ALPHA, LEAST_COUNT, LEAST_VALUES = 0.05, 10, 8
#: A candidate is a secret above this quantile of ordinary tokens and of labelled values, in likelihood by character.
ORDINARY_QUANTILE, LABELLED_QUANTILE = 0.999, 0.05
SMOOTHING = 1e-3
#: Character classes; fits of the ordinary frequencies, each without the tokens that the one before tells from ordinary ones, at most.
CLASSES, ROUNDS = 11, 8
#: Steps in one unit of a score, to which scores are rounded where their quantile is taken.
STEPS = 1000


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) of the base patterns, ends exclusive, in code points.

    The lengths in ACCESS and HEX equal dropping shorter matches afterwards: a run that is too short holds no longer one.
    """
    spans = [("assign", *m.span(), m.group(2)) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    if "AKIA" in text:
        spans += [("access", *m.span(), m.group()) for m in ACCESS.finditer(text)]
    spans += [("hex", *m.span(), m.group()) for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def candidates(text: str) -> list[tuple[int, int, str]]:
    """All tokens to be scored: (start, end, token)."""
    found = []
    for m in CANDIDATE.finditer(text):
        token = m.group()
        if not token.isalpha() and any(map(str.isdigit, token)) and any(map(str.isalpha, token)):
            found.append((*m.span(), token))
    return found


def joined(spans: Iterable[tuple]) -> str:
    return ",".join(f"{s[0]}:{s[1]}:{s[2]}" for s in spans)


@cache
def _classes() -> dict[int, str]:
    table = {}
    for c in map(chr, range(128)):
        table[ord(c)] = "d" if c.isdigit() else "h" if c in "abcdef" else "H" if c in "ABCDEF" else "l" if c.islower() else "U" if c.isupper() else c
    return table


def format_of(token: str) -> str:
    """A token's character classes: digits, letters by case and by whether hexadecimal, other characters themselves."""
    return token.translate(_classes())


class Automaton:
    """A probabilistic automaton: for each state how many values pass, end there, and go on by each class."""

    def __init__(self, values: Iterable[str]):
        self.passed, self.ended, self.next = [0], [0], [{}]
        for value in values:
            self._insert(format_of(value))
        self._merge()

    def _insert(self, symbols: str) -> None:
        state = 0
        self.passed[0] += 1
        for symbol in symbols:
            to = self.next[state].get(symbol)
            if to is None:
                to = len(self.passed)
                self.passed.append(0)
                self.ended.append(0)
                self.next.append({})
                self.next[state][symbol] = [to, 0]
                to = self.next[state][symbol]
            to[1] += 1
            state = to[0]
            self.passed[state] += 1
        self.ended[state] += 1

    def _differ(self, x: int, n: int, y: int, m: int) -> bool:
        if n < LEAST_COUNT or m < LEAST_COUNT:
            return False
        return abs(x / n - y / m) > math.sqrt(0.5 * math.log(2 / ALPHA)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _compatible(self, a: int, b: int) -> bool:
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            n, m = self.passed[a], self.passed[b]
            if self._differ(self.ended[a], n, self.ended[b], m):
                return False
            for symbol in self.next[a].keys() | self.next[b].keys():
                left, right = self.next[a].get(symbol, (-1, 0)), self.next[b].get(symbol, (-1, 0))
                if self._differ(left[1], n, right[1], m):
                    return False
                if left[1] >= LEAST_COUNT and right[1] >= LEAST_COUNT:
                    stack.append((left[0], right[0]))
        return True

    def _fold(self, red: int, blue: int) -> None:
        """Adds the tree below ``blue`` to ``red``."""
        stack = [(red, blue)]
        while stack:
            a, b = stack.pop()
            self.passed[a] += self.passed[b]
            self.ended[a] += self.ended[b]
            for symbol, (to, n) in self.next[b].items():
                mine = self.next[a].get(symbol)
                if mine is None:
                    self.next[a][symbol] = [to, n]
                else:
                    mine[1] += n
                    stack.append((mine[0], to))

    def _merge(self) -> None:
        """Red states are kept; a blue state (next after a red one) merges into the first compatible red one or turns red."""
        red, seen = [0], {0}
        while True:
            blue = [(-self.passed[to], state, symbol, to) for state in red for symbol, (to, _) in self.next[state].items() if to not in seen]
            if not blue:
                return
            _, state, symbol, to = min(blue)
            for known in red:
                if self._compatible(known, to):
                    self.next[state][symbol][0] = known
                    self._fold(known, to)
                    break
            else:
                red.append(to)
                seen.add(to)

    def likelihood(self, symbols: str) -> float:
        """Mean log probability of a symbol. The end is not scored: a token cut off scores like a whole one."""
        state, total, spare = 0, 0.0, math.log(SMOOTHING)
        for symbol in symbols:
            to = self.next[state].get(symbol)
            if to is None:
                total += spare
            else:
                total += math.log((1 - SMOOTHING) * to[1] / self.passed[state] + SMOOTHING)
                state = to[0]
        return total / max(len(symbols), 1)


class Ordinary:
    """First-order frequencies of ordinary tokens' character classes, from how often each pair of classes follows.

    Without any pairs every class is as likely as any other.
    """

    def __init__(self, pairs: dict[str, int]):
        self.pairs = pairs
        self.firsts: dict[str, int] = {}
        for pair, n in pairs.items():
            self.firsts[pair[0]] = self.firsts.get(pair[0], 0) + n

    def likelihood(self, symbols: str) -> float:
        if not self.pairs:
            return -math.log(CLASSES)
        total, before = 0.0, "^"
        for symbol in symbols:
            total += math.log((self.pairs.get(before + symbol, 0) + 0.5) / (self.firsts.get(before, 0) + 20))
            before = symbol
        return total / max(len(symbols), 1)


def class_pairs(formats: Iterable[str], counts: Iterable[int]) -> dict[str, int]:
    """How often each class follows another, ``^`` standing for the beginning."""
    pairs: dict[str, int] = {}
    for symbols, n in zip(formats, counts, strict=True):
        symbols = "^" + symbols
        for a, b in zip(symbols, symbols[1:], strict=False):
            pairs[a + b] = pairs.get(a + b, 0) + n
    return pairs


class Formats:
    """The automata of the labelled kinds and what a candidate must exceed to count as a secret.

    That comes from the likelihoods, never from how many candidates are secrets: of tokens that follow the ordinary
    frequencies, a share of at most 1 - ORDINARY_QUANTILE is likelier by ``margin`` under one of the automata.
    """

    def __init__(self, labelled: dict[str, list[str]], pairs: dict[str, int]):
        self.automata = [Automaton(values) for _, values in sorted(labelled.items()) if len(values) >= LEAST_VALUES]
        self.margin = math.log(max(len(self.automata), 1) / (1 - ORDINARY_QUANTILE))
        self.labelled = [format_of(v) for values in labelled.values() for v in values] if self.automata else []
        self.against(pairs)

    def against(self, pairs: dict[str, int]) -> None:
        """Takes new ordinary frequencies, and with them the labelled quantile as the threshold."""
        self.ordinary = Ordinary(pairs)
        own = sorted(map(self.score, self.labelled))
        self.threshold = max(0.0, own[min(len(own) - 1, int(LABELLED_QUANTILE * len(own)))] if own else 0.0)

    def above_ordinary(self, steps: Iterable[tuple[int, int]]) -> None:
        """Raises the threshold to a quantile of tokens known to be ordinary, given as (score in steps, tokens).

        Not for candidates, of which any number may be secrets.
        """
        steps = sorted(steps)
        left = int(ORDINARY_QUANTILE * sum(n for _, n in steps))
        for step, n in steps:
            left -= n
            if left < 0:
                self.threshold = max(self.threshold, step / STEPS)
                return

    def score(self, symbols: str) -> float:
        return max((a.likelihood(symbols) for a in self.automata), default=-math.inf) - self.ordinary.likelihood(symbols)

    def step(self, symbols: str) -> int:
        """The score in steps, rounded up, so that no token of the quantile's step passes for its rounding."""
        return math.ceil(self.score(symbols) * STEPS)

    def formatted(self, symbols: str) -> bool:
        """Whether an automaton explains the whole token better than the ordinary frequencies, by the margin."""
        return bool(self.automata) and self.score(symbols) * len(symbols) > self.margin

    def secret(self, token: str) -> bool:
        symbols = format_of(token)
        return self.formatted(symbols) and self.score(symbols) > self.threshold


def found(docs: DataFrame, id_col: str, text_col: str, carried: list[str]) -> DataFrame:
    """Base spans, their values, and candidates of every whole text, in one pass."""

    def make():
        def work(**columns) -> dict:
            out = {c: columns[c] for c in columns if c != "text"}
            texts = [t or "" for t in columns["text"]]
            spans = [base_spans(t) for t in texts]
            tokens = [candidates(t) for t in texts]
            return out | {
                "kinds": [[s[0] for s in x] for x in spans], "starts": [[s[1] for s in x] for x in spans], "ends": [[s[2] for s in x] for x in spans], "values": [[s[3] for s in x] for x in spans],
                "c_starts": [[c[0] for c in x] for x in tokens], "c_tokens": [[c[2] for c in x] for x in tokens],
            }

        return work

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), *carried)
    schema = ", ".join([f"{n} {t}" for n, t in rows.dtypes if n != "text"])
    return map_columns(rows, schema + ", kinds array<string>, starts array<bigint>, ends array<bigint>, values array<string>, c_starts array<bigint>, c_tokens array<string>", make)


def learn(spans: DataFrame) -> Formats:
    """Automata from a bounded sample, by hash, of the base spans' values; ordinary frequencies from all candidates that the
    automata don't explain better, each token once.

    What the automata explain better is told against even frequencies first, then against those of the rest, until the
    rest stays the same. Candidates are aggregated by format; what comes to the driver is bounded by pairs of classes.
    """
    pairs = spans.select(F.explode(F.arrays_zip("kinds", "values")).alias("s")).select("s.kinds", "s.values").distinct()
    labelled: dict[str, list[str]] = {}
    for kind in KINDS[:3]:
        rows = pairs.where(F.col("kinds") == kind).orderBy(F.xxhash64("values"), "values").limit(MOST_LABELLED).collect()
        labelled[kind] = [r["values"] for r in rows]
    learned = Formats(labelled, {})
    if not learned.automata:
        return learned

    def formats_of():
        return lambda t: {"f": [format_of(x) for x in t]}

    tokens = spans.select(F.explode("c_tokens").alias("t")).distinct()
    table = Written(map_columns(tokens, "f string", formats_of).groupBy("f").agg(F.count(F.lit(1)).alias("n")), "secret-formats")

    def count_pairs():
        def work(f: list, n: list) -> dict:
            rest = [(x, k) for x, k in zip(f, n, strict=True) if not learned.formatted(x)]
            counted = class_pairs([x for x, _ in rest], [k for _, k in rest])
            return {"pair": list(counted), "n": list(counted.values())}

        return work

    for _ in range(ROUNDS):
        follows = map_columns(table.df, "pair string, n bigint", count_pairs).groupBy("pair").agg(F.sum("n").alias("n"))
        counted = {r.pair: r.n for r in follows.collect()}
        if counted == learned.ordinary.pairs:
            break
        learned.against(counted)
    table.drop()
    return learned


def all_spans(base: list[tuple[str, int, int]], tokens: list[tuple[int, str]], formats: Formats) -> list[tuple[str, int, int]]:
    """Base spans and the tokens, given as (start, token), that score as secrets; one with the bounds of a base span adds nothing."""
    known = {s[1:] for s in base}
    added = [("format", s, s + len(t)) for s, t in tokens if (s, s + len(t)) not in known and formats.secret(t)]
    return sorted([*base, *added], key=lambda s: (s[1], KINDS.index(s[0])))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Finds secrets in every whole text: base spans, counted and hashed, and all spans.

    A base span is its whole match; a ``format`` span is a token that an automaton tells from ordinary ones, be it inside a base
    span (the value of an ``assign`` one, say) or where no pattern looks. Null or empty text: no spans, empty string, its hash. Null ids pass through; one row
    out for each row in, repeated ones too. Empty table: no rows. Extra columns: ignored. With fewer than LEAST_VALUES
    labelled values of a kind that kind gives no automaton, and with no automaton no spans are added.
    """
    spans = Written(found(docs, id_col, text_col, []), "secret-spans").df
    formats = learn(spans)

    def make():
        def work(doc_id: list, kinds: list, starts: list, ends: list, values: list, c_starts: list, c_tokens: list) -> dict:
            out = {"doc_id": doc_id} | {f"n_{k}": [x.count(k) for x in kinds] for k in KINDS[:3]}
            base = [joined(zip(*x, strict=True)) for x in zip(kinds, starts, ends, strict=True)]
            out["base_sha256"] = [hashlib.sha256(b.encode()).hexdigest() for b in base]
            rows = zip(kinds, starts, ends, c_starts, c_tokens, strict=True)
            out["spans"] = [joined(all_spans(list(zip(k, s, e, strict=True)), list(zip(c, t, strict=True)), formats)) for k, s, e, c, t in rows]
            return out

        return work

    return map_columns(spans, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string", make)


@any_names
def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "<secret>") -> DataFrame:
    """The same rows and columns, with every span found by ``scan`` replaced by ``mask``; texts without spans stay as they are.

    Spans that overlap are masked as one. Null and empty texts stay. An ``n_chars`` column is set to the new length. Null ids,
    repeated rows: one row out for each row in, alike ones masked alike. Empty table: no rows. Other columns, whatever their
    names, stay.
    """
    spans = Written(found(docs, id_col, text_col, []), "secret-spans")
    formats = learn(spans.df)
    spans.drop()

    def make():
        def masked(text: str | None) -> str | None:
            if not text:
                return text
            out, at = [], 0
            for _, start, end in all_spans([s[:3] for s in base_spans(text)], [c[::2] for c in candidates(text)], formats):
                if start >= at:
                    out += [text[at:start], mask]
                at = max(at, end)
            return "".join([*out, text[at:]])

        def work(**columns) -> dict:
            texts = [masked(t) for t in columns[text_col]]
            changed = {text_col: texts}
            if "n_chars" in columns:
                changed["n_chars"] = [n if t == old else len(t) for n, t, old in zip(columns["n_chars"], texts, columns[text_col], strict=True)]
            return columns | changed

        return work

    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)
    return map_columns(docs, schema, make)
