"""License scans: against plain searches with the same rules, and texts that licenses are known by."""

import random
import re

import pytest

from tidepool.llm import licenses

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
RULES = licenses.rules()


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def spans_of(text):
    """(first, last, rule) of the places that stay, from every rule tried on the whole text."""
    words = words_of(text)
    plain, found = " ".join(words), []
    for r in RULES:
        for m in re.finditer(r["regex"], plain):
            first = plain[: m.start()].count(" ")
            found.append((first, -(first + m.group().count(" ")), r["place"]))
    out, held = [], None
    for first, back, place in sorted(found):
        if held and back >= held[1]:
            continue
        if held and first <= -held[1] and place > held[2]:
            continue
        if held and first > -held[1]:
            out.append(held)
        held = (first, back, place)
    return [(f, -b, p) for f, b, p in [*out, *([held] if held else [])]]


def base_of(text):
    words, out = words_of(text), []
    for phrase, label in licenses.BASE:
        p = phrase.split()
        out += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    return out


def row_of(doc_id, text):
    base, spans = base_of(text), spans_of(text)
    at, labels = [i for i, _ in base], {label for _, label in base}
    every = labels | {RULES[p]["label"] for _, _, p in spans}
    return (doc_id, len(words_of(text)), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)), ",".join(sorted(every)), max((RULES[p]["weight"] for _, _, p in spans), default=0.0))


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


KNOWN = {
    "This work is licensed under the GNU General Public License, version 3.": "gpl,gpl-3.0",
    "Licensed under the Apache License, Version 2.0.": "apache,apache-2.0",
    "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc-4.0",
    "Released under the MIT License.": "mit",
    "SPDX-License-Identifier: LGPL-2.1-or-later": "lgpl-2.1",
    "# SPDX-License-Identifier: BSD-3-Clause": "bsd-3-clause",
    "// SPDX-License-Identifier: MIT": "mit",
    "under the Expat license": "mit",
    "see https://www.gnu.org/licenses/agpl-3.0.html": "agpl-3.0",
    "https://creativecommons.org/licenses/by-sa/3.0/": "cc-by-sa-3.0",
    "Creative Commons Attribution-ShareAlike 4.0 International License": "cc-by-sa-4.0",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software": "mit",
    "Redistribution and use in source and binary forms, with or without modification, are permitted": "bsd",
    "GNU Lesser General Public License v3 or later": "lgpl-3.0",
    "dual licensed: GPLv2 and MPL 2.0": "gpl-2.0,mpl-2.0",
    "released into the public domain": "public-domain",
    "er geht mit Lizenz und by the apache river": "",
    "the house of ccby and mitlicense": "",
}


def test_known_texts(spark):
    rows = list(enumerate(KNOWN))
    got = {r.doc_id: r.labels for r in licenses.scan(frame(spark, rows)).collect()}
    assert {t: got[i] for i, t in rows} == KNOWN


def test_rules_are_whole():
    assert len(RULES) > 300 and len({r["regex"] for r in RULES}) > 300
    

def test_equals_trying_every_rule_everywhere(spark):
    r = random.Random(4)
    parts = [*KNOWN, "GNU", "general public license", "version 2", "or later", "under the terms of the", "licensed under", "CC", "BY", "SA 4.0", "MIT", "License", "Apache", "2.0", "BSD-3-Clause", "all rights reserved", "creative commons", "attribution", "É", "x y", "\n", "the", "only", "spdx-license-identifier:"]
    rows = [(i, " ".join(r.choice(parts) for _ in range(r.randrange(0, 20)))) for i in range(80)]
    got = sorted(tuple(x) for x in licenses.scan(frame(spark, rows)).collect())
    assert got == sorted(row_of(*x) for x in rows)
    spans = {x.doc_id: [(p["first"], p["last"], p["rule"]) for p in x.spans] for x in licenses.detect(frame(spark, rows)).collect()}
    assert spans == {i: spans_of(t) for i, t in rows}


@pytest.mark.parametrize("rows", [[], [(1, None), (1, None), (None, "MIT License"), (2, ""), (2, " .,;\n"), (3, "mit license " * 3000 + "word " * 20_000)]])
def test_awkward_tables(spark, rows):
    docs = frame(spark, rows).selectExpr("*", "1 as words", "2 as found", "3 as `a.b`", "'x' as base")
    assert sorted((tuple(x) for x in licenses.scan(docs).collect()), key=str) == sorted((row_of(*x) for x in rows), key=str)


def drawn(tree, r):
    """A text that a parsed pattern matches."""
    out = ""
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            out += chr(arg)
        elif name == "IN":
            low = [x for o, x in arg if str(o) == "LITERAL"] or [ord("q"), ord("7")]
            out += "7" if str(arg[0][0]) == "RANGE" else "q" if str(arg[0][0]) == "CATEGORY" else chr(r.choice(low))
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            out += "".join(drawn(arg[2], r) for _ in range(r.randint(arg[0], min(arg[1], arg[0] + 2))))
        elif name == "BRANCH":
            out += drawn(r.choice(arg[1]), r)
        elif name == "SUBPATTERN":
            out += drawn(arg[3], r)
    return out


def test_the_gates_drop_nothing():
    """Whatever a rule matches holds its keywords, in many texts drawn from every pattern."""
    r = random.Random(2)
    for rule in RULES:
        body = re._parser.parse(rule["regex"].removeprefix("(?<![^ ])").removesuffix("(?![^ ])"))
        for _ in range(30):
            text = drawn(body, r)
            assert re.search(rule["regex"], text), (rule, text)
            assert all(licenses._spaced(w) in f" {text} " for w in rule["words"]), (rule, text)
