"""Secret scans: base spans against a scanner without regular expressions, learned formats on planted and held-out credentials."""

import hashlib
import random
from string import ascii_lowercase, ascii_uppercase, digits

import pytest

from tidepool.llm import secrets

VALUE = set(ascii_lowercase + ascii_uppercase + digits + "+/_.=-")


def run(text, at, allowed):
    end = at
    while end < len(text) and text[end] in allowed:
        end += 1
    return end


def folded(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def assigned(text, at):
    """The end of an assignment that begins at a place and the length of its value, or None."""
    low = folded(text)
    for word in ("password", "passwd", "secret", "token", "api_key", "apikey"):
        if low.startswith(word, at):
            i = at + len(word)
            i += text[i : i + 1] in ("'", '"') and text[i : i + 1] != ""
            i = run(text, i, " ")
            if text[i : i + 1] not in (":", "="):
                continue
            i = run(text, i + 1, " ")
            i += text[i : i + 1] in ("'", '"') and text[i : i + 1] != ""
            end = run(text, i, VALUE)
            if end > i:
                return end, end - i
    return None


def brute(text):
    """(kind, start, end) of all base spans, by start and kind."""
    out, at = [], 0
    while at < len(text):
        got = assigned(text, at)
        if got and got[1] >= 8:
            out.append((at, 0, "assign", got[0]))
        at = got[0] if got else at + 1
    at = 0
    while at < len(text):
        end = run(text, at + 4, ascii_uppercase + digits) if text.startswith("AKIA", at) else at
        if end - at >= 16:
            out.append((at, 1, "access", end))
        at = end if end > at + 4 else at + 1
    at = 0
    while at < len(text):
        end = run(text, at, digits + "abcdef")
        if end - at >= 32:
            out.append((at, 2, "hex", end))
        at = max(end, at + 1)
    return [(kind, start, end) for start, _, kind, end in sorted(out)]


def hostile(r):
    parts = ["password", "PassWD", "secret", "TOKEN", "api_key", "ApiKey", "api__key", "'", '"', " ", "  ", ":", "=", "\t", "\n", "AKIA", "A7", "Z" * 9, "AKIAAKIA", "0f" * 9, "e" * 16, "x+/y.", "longervalue1", "ſecret", "é", "🙂", "-"]
    return "".join(r.choice(parts) for _ in range(r.randrange(40)))


def test_base_spans_equal_a_plain_scanner(spark):
    r = random.Random(4)
    texts = [hostile(r) for _ in range(4000)] + ["", "secret=" * 50 + "abcdefgh", "AKIA" * 30, "token:" + " " * 3000 + "x" * 9000]
    for text in texts:
        assert [s[:3] for s in secrets.base_spans(text)] == brute(text), text
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(list(enumerate(texts[:800], 10**6)), "doc_id long, text string"))
    known = {x.doc_id: brute(x.text or "") for x in docs.collect()}
    for x in secrets.scan(docs).collect():
        base = known[x.doc_id]
        assert (x.n_assign, x.n_access, x.n_hex) == tuple(sum(s[0] == k for s in base) for k in ("assign", "access", "hex"))
        assert x.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        given = [tuple(s.split(":")) for s in x.spans.split(",") if s]
        assert {(k, str(a), str(b)) for k, a, b in base} == {s for s in given if s[0] != "format"}


KEYS = {
    "assign": lambda r: "sk-" + "".join(r.choice(ascii_lowercase + digits) for _ in range(24)),
    "access": lambda r: "AKIA" + "".join(r.choice(ascii_uppercase + digits) for _ in range(16)),
    "hex": lambda r: "".join(r.choice(digits + "abcdef") for _ in range(40)),
}


def test_values_inside_base_spans_are_scored(spark):
    r = random.Random(6)
    rows = [(i, f"secret={KEYS['assign'](r)} w") for i in range(200)]
    got = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(x.spans == "assign:0:34,format:7:34" for x in got) >= 180


@pytest.mark.parametrize("kind", sorted(KEYS))
def test_held_out_credentials_without_a_keyword(spark, kind):
    """Recall on unseen values of each kind where no pattern looks, and precision beside tokens of other kinds."""
    r = random.Random(7)
    make = KEYS[kind]
    label = {"assign": "token: {}", "access": "key {}", "hex": "sum {}"}[kind]
    rows = [(i, label.format(make(r)) + " w") for i in range(150)]
    planted = [make(r) if kind == "assign" else make(r)[:20].replace("AKIA", "ASIA") for _ in range(300)]
    rows += [(1000 + i, f"see {x} there") for i, x in enumerate(planted)]
    words = ["mail{}.example.com", "report-2024-{}-final-draft", "www.example.org/de/{}", "chapter_{}_of_the_book", "version-{}.2.0-release"]
    rows += [(10_000 + i, f"go to {words[i % 5].format(i)} now") for i in range(1500)]
    got = {x.doc_id: x.spans for x in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    fits = [i for i, x in enumerate(planted) if any(map(str.isdigit, x)) and any(map(str.isalpha, x))]
    found = sum(got[1000 + i] == f"format:4:{4 + len(planted[i])}" for i in fits)
    false = sum(bool(v) for i, v in got.items() if i >= 10_000)
    assert found >= 0.9 * len(fits) and false <= 0.01 * (found + 1)
