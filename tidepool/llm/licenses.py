"""License scans by ordered signature rules, in DataFrame functions alone.

Texts become words joined by single spaces, so that one spelling of a rule covers all punctuation. A rule is a regular
expression over words, tried only where the text holds all its keywords. Places that lie inside a longer one go, of two that
overlap otherwise the one whose rule comes first in the order stays.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_FROM, _TO = r"(?<![^ ])", r"(?![^ ])"
#: Marks around a place; no word holds them.
_OPEN, _SHUT = "\x01", "\x02"
#: Spans that are resolved before they are put aside: what is copied at each step is no longer.
_CHUNK = 256

# Base phrases and their labels.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

_LATER = r"(?: or (?:any )?(?:later|newer)(?: version)?| only)?"


def _v(major: int, minor: int = 0) -> str:
    """A version as it is written after a name: "v3", "version 2 0", "2 1"; a minor of 0 may be left out."""
    return rf"(?:v ?|ver |version )?{major}" + (rf" {minor}" if minor else "(?: 0)?") + _LATER


_GPL, _LGPL, _AGPL = r"(?:the )?(?:gnu )?general public licen[sc]e", r"(?:gnu )?(?:lesser|library) (?:general )?public licen[sc]e", r"(?:gnu )?affero general public licen[sc]e"
_FSF = r"(?: gpl| lgpl| agpl)?(?: as published by the free software foundation)?(?: either)? "
_CC = r"creative commons"
_CC_KINDS = {
    "by-nc-nd": (r"by nc nd", r"attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?"),
    "by-nc-sa": (r"by nc sa", r"attribution non ?commercial share ?alike"),
    "by-nc": (r"by nc", r"attribution non ?commercial"),
    "by-nd": (r"by nd", r"attribution no ?deriv(?:ative)?s?(?: works)?"),
    "by-sa": (r"by sa", r"attribution share ?alike"),
    "by": (r"by", r"attribution"),
}

#: Families, the more exact first: label, keyword of the name, name, keyword of the short form, short form. Keywords are whole
#: words; one that ends in a star is the beginning of one.
_FAMILIES = [
    ("agpl-3.0", "affero", _AGPL + _FSF + _v(3), "agpl*", r"agpl ?" + _v(3)),
    ("agpl", "affero", _AGPL, "agpl", r"agpl"),
    ("lgpl-3.0", "public", _LGPL + _FSF + _v(3), "lgpl*", r"lgpl ?" + _v(3)),
    ("lgpl-2.1", "public", _LGPL + _FSF + _v(2, 1), "lgpl*", r"lgpl ?" + _v(2, 1)),
    ("lgpl-2.0", "public", _LGPL + _FSF + _v(2), "lgpl*", r"lgpl ?" + _v(2)),
    ("lgpl", "public", _LGPL, "lgpl", r"lgpl"),
    ("gpl-3.0", "general public", _GPL + _FSF + _v(3), "gpl*", r"gpl ?" + _v(3)),
    ("gpl-2.0", "general public", _GPL + _FSF + _v(2), "gpl*", r"gpl ?" + _v(2)),
    ("gpl-1.0", "general public", _GPL + _FSF + _v(1), "gpl*", r"gpl ?" + _v(1)),
    ("gpl", "general public", _GPL, "gnu gpl", r"gnu gpl"),
    ("gfdl-1.3", "free documentation", r"(?:gnu )?free documentation licen[sc]e " + _v(1, 3), "gfdl", r"gfdl " + _v(1, 3)),
    ("gfdl-1.2", "free documentation", r"(?:gnu )?free documentation licen[sc]e " + _v(1, 2), "gfdl", r"gfdl " + _v(1, 2)),
    ("gfdl", "free documentation", r"(?:gnu )?free documentation licen[sc]e", "gfdl", r"gfdl"),
    ("apache-2.0", "apache", r"apache(?: software)? licen[sc]e " + _v(2), "apache", r"apache " + _v(2)),
    ("apache-1.1", "apache", r"apache(?: software)? licen[sc]e " + _v(1, 1), "apache", r"apache " + _v(1, 1)),
    ("apache-1.0", "apache", r"apache(?: software)? licen[sc]e " + _v(1), "apache", r"apache 1 0"),
    ("apache", "apache", r"apache(?: software)? licen[sc]e", "asl", r"asl 2(?: 0)?"),
    ("mit-0", "no attribution", r"mit no attribution(?: licen[sc]e)?", "mit 0", r"mit 0"),
    ("mit", "mit", r"mit(?: x11)? licen[sc]e", "mit x11", r"mit x11"),
    ("mit", "expat", r"expat licen[sc]e", "mit expat", r"mit expat"),
    ("mit", "x11", r"x11 licen[sc]e", "x11 mit", r"x11 mit"),
    ("bsd-4-clause", "bsd", r"(?:original|4 clause|four clause) bsd(?: licen[sc]e)?", "bsd 4 clause", r"bsd 4 clause"),
    ("bsd-3-clause", "bsd", r"(?:new|modified|revised|3 clause|three clause) bsd(?: licen[sc]e)?", "bsd 3 clause", r"bsd 3 clause(?: licen[sc]e)?"),
    ("bsd-2-clause", "bsd", r"(?:simplified|2 clause|two clause|freebsd) bsd(?: licen[sc]e)?", "bsd 2 clause", r"bsd 2 clause(?: licen[sc]e)?"),
    ("bsd-1-clause", "bsd", r"(?:1 clause|one clause) bsd(?: licen[sc]e)?", "bsd 1 clause", r"bsd 1 clause"),
    ("0bsd", "bsd", r"(?:zero clause|0 clause) bsd(?: licen[sc]e)?", "0bsd", r"0bsd"),
    ("bsd", "bsd", r"bsd(?: style)? licen[sc]e", "bsd style", r"bsd style"),
    ("isc", "isc", r"isc licen[sc]e", "openbsd", r"openbsd licen[sc]e"),
    ("mpl-2.0", "mozilla", r"mozilla public licen[sc]e " + _v(2), "mpl", r"mpl " + _v(2)),
    ("mpl-1.1", "mozilla", r"mozilla public licen[sc]e " + _v(1, 1), "mpl", r"mpl " + _v(1, 1)),
    ("mpl-1.0", "mozilla", r"mozilla public licen[sc]e " + _v(1), "mpl", r"mpl 1 0"),
    ("mpl", "mozilla", r"mozilla public licen[sc]e", "mpl licen*", r"mpl licen[sc]e"),
    ("epl-2.0", "eclipse", r"eclipse public licen[sc]e " + _v(2), "epl", r"epl " + _v(2)),
    ("epl-1.0", "eclipse", r"eclipse public licen[sc]e " + _v(1), "epl", r"epl " + _v(1)),
    ("epl", "eclipse", r"eclipse public licen[sc]e", "epl licen*", r"epl licen[sc]e"),
    ("edl-1.0", "eclipse", r"eclipse distribution licen[sc]e(?: " + _v(1) + ")?", "edl", r"edl 1 0"),
    ("cddl-1.1", "common development", r"common development and distribution licen[sc]e " + _v(1, 1), "cddl", r"cddl " + _v(1, 1)),
    ("cddl-1.0", "common development", r"common development and distribution licen[sc]e " + _v(1), "cddl", r"cddl " + _v(1)),
    ("cddl", "common development", r"common development and distribution licen[sc]e", "cddl", r"cddl"),
    ("cpl-1.0", "common public", r"common public licen[sc]e(?: " + _v(1) + ")?", "cpl", r"cpl 1 0"),
    ("eupl-1.2", "european union", r"european union public licen[sc]e " + _v(1, 2), "eupl", r"eupl " + _v(1, 2)),
    ("eupl-1.1", "european union", r"european union public licen[sc]e " + _v(1, 1), "eupl", r"eupl " + _v(1, 1)),
    ("eupl", "european union", r"european union public licen[sc]e", "eupl", r"eupl"),
    ("artistic-2.0", "artistic", r"artistic licen[sc]e " + _v(2), "artistic 2", r"artistic 2 0"),
    ("artistic-1.0", "artistic", r"artistic licen[sc]e " + _v(1), "artistic 1", r"artistic 1 0"),
    ("artistic", "artistic", r"(?:perl )?artistic licen[sc]e", "perl itself", r"same terms as perl itself"),
    ("bsl-1.0", "boost", r"boost software licen[sc]e(?: " + _v(1) + ")?", "bsl", r"bsl 1 0"),
    ("busl-1.1", "business source", r"business source licen[sc]e(?: " + _v(1, 1) + ")?", "busl", r"busl 1 1"),
    ("elastic-2.0", "elastic", r"elastic licen[sc]e(?: " + _v(2) + ")?", "elv2", r"elv2"),
    ("sspl-1.0", "server side", r"server side public licen[sc]e(?: " + _v(1) + ")?", "sspl", r"sspl(?: 1 0| v1)?"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[sc]e", "zlib acknowledgement", r"zlib acknowledgement"),
    ("libpng", "libpng", r"libpng licen[sc]e(?: " + _v(2) + ")?", "libpng 2", r"libpng 2 0"),
    ("unlicense", "unlicense", r"(?:the )?unlicense", "unlicense org", r"unlicense org"),
    ("wtfpl", "do what the", r"do what the f\S+ you want to public licen[sc]e(?: " + _v(2) + ")?", "wtfpl", r"wtfpl"),
    ("psf-2.0", "python software", r"python software foundation licen[sc]e(?: " + _v(2) + ")?", "psf 2", r"psf 2 0"),
    ("python-2.0", "python", r"python licen[sc]e " + _v(2), "python 2 0", r"python 2 0 licen[sc]e"),
    ("ofl-1.1", "open font", r"(?:sil )?open font licen[sc]e(?: " + _v(1, 1) + ")?", "ofl", r"ofl 1 1"),
    ("odbl-1.0", "open database", r"open database licen[sc]e(?: " + _v(1) + ")?", "odbl", r"odbl(?: 1 0| v1 0)?"),
    ("odc-by-1.0", "open data commons", r"open data commons attribution licen[sc]e(?: " + _v(1) + ")?", "odc by", r"odc by(?: 1 0)?"),
    ("pddl-1.0", "public domain dedication", r"(?:open data commons )?public domain dedication and licen[sc]e(?: " + _v(1) + ")?", "pddl", r"pddl(?: 1 0)?"),
    ("cdla-permissive-2.0", "community data", r"community data licen[sc]e agreement permissive(?: " + _v(2) + ")?", "cdla permissive", r"cdla permissive 2 0"),
    ("cdla-sharing-1.0", "community data", r"community data licen[sc]e agreement sharing(?: " + _v(1) + ")?", "cdla sharing", r"cdla sharing 1 0"),
    ("ms-pl", "microsoft public", r"microsoft public licen[sc]e", "ms pl", r"ms pl"),
    ("ms-rl", "microsoft reciprocal", r"microsoft reciprocal licen[sc]e", "ms rl", r"ms rl"),
    ("mulan-psl-2.0", "mulan", r"mulan permissive software licen[sc]e(?: " + _v(2) + ")?", "mulanpsl", r"mulanpsl 2 0"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa open source licen[sc]e", "illinois open", r"university of illinois open source licen[sc]e"),
    ("openssl", "openssl", r"openssl licen[sc]e", "ssleay", r"ssleay licen[sc]e"),
    ("php-3.01", "php", r"php licen[sc]e(?: " + _v(3, 1) + "| 3 01)?", "php 3", r"php 3 01"),
    ("postgresql", "postgresql", r"postgresql licen[sc]e", "postgres licen*", r"postgres licen[sc]e"),
    ("ruby", "ruby", r"ruby licen[sc]e", "terms as ruby", r"same terms as ruby"),
    ("vim", "vim", r"vim licen[sc]e", "charityware", r"charityware"),
    ("upl-1.0", "universal permissive", r"universal permissive licen[sc]e(?: " + _v(1) + ")?", "upl", r"upl 1 0"),
    ("w3c", "w3c", r"w3c (?:software )?(?:notice and )?licen[sc]e", "w3c software", r"w3c software notice"),
    ("cecill-2.1", "cecill", r"cecill (?:free software licen[sc]e )?(?:agreement )?" + _v(2, 1), "cecill 2", r"cecill 2 1"),
    ("cecill", "cecill", r"cecill(?: [bc])? licen[sc]e", "cecill b", r"cecill b"),
    ("beerware", "beer ware", r"beer ware licen[sc]e", "beerware", r"beerware(?: licen[sc]e)?"),
    ("json", "json", r"json licen[sc]e", "good not evil", r"shall be used for good not evil"),
    ("openrail-m", "openrail", r"(?:creativeml )?openrail(?: m)? licen[sc]e", "openrail m", r"openrail m"),
    ("llama", "llama", r"llama [0-9]+(?: [0-9]+)? community licen[sc]e(?: agreement)?", "llama licen*", r"llama licen[sc]e"),
    *[(f"cc-{kind}-{ma}.{mi}", "creative commons", rf"{_CC} {name}(?: {where})?(?: licen[sc]e)? {_v(ma, mi)}(?: {where})?(?: licen[sc]e)?", f"cc {short.split()[0]}", rf"cc {short} {_v(ma, mi)}")
      for where in (r"(?:international|unported|generic)",) for ma, mi in ((4, 0), (3, 0), (2, 5), (2, 0)) for kind, (short, name) in _CC_KINDS.items()],
    *[(f"cc-{kind}", "creative commons", rf"{_CC} {name}(?: licen[sc]e)?", f"cc {short.split()[0]}", rf"cc {short}") for kind, (short, name) in _CC_KINDS.items()],
    ("cc0-1.0", "cc0", r"cc0(?: " + _v(1) + r")?(?: universal)?(?: public domain dedication)?", "cc zero", r"cc zero(?: " + _v(1) + ")?"),
    ("cc0-1.0", "commons zero", r"creative commons zero(?: " + _v(1) + ")?", "cc0 public", r"cc0 public domain"),
    ("cc", "creative commons", r"creative commons licen[sc]e", "cc licensed", r"cc licensed"),
    ("public-domain", "public domain", r"(?:released|placed|dedicated|put) (?:in|into|to) the public domain", "public domain work", r"public domain work"),
    ("all-rights-reserved", "rights reserved", r"all rights reserved", "proprietary", r"proprietary and confidential"),
]

#: Sentences of the licenses themselves, and where they are found on the web: label, keyword, pattern.
_BODIES = [
    ("mit", "permission is hereby", r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("isc", "permission to use", r"permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "neither the name", r"neither the name of (?:\S+ ){1,8}nor the names of (?:its|their|any) contributors"),
    ("bsd-4-clause", "all advertising", r"all advertising materials mentioning features or use of this software must display"),
    ("gpl", "free software you", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "free software you", r"this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("apache-2.0", "may not use", r"you may not use this file except in compliance with the license"),
    ("mpl-2.0", "subject to the", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("epl-2.0", "made available under", r"this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"),
    ("zlib", "provided as is", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("bsl-1.0", "obtaining a copy", r"obtaining a copy of the software and accompanying documentation covered by this license"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("ofl-1.1", "reserved font", r"reserved font name"),
    ("cc0-1.0", "waived all", r"waived all copyright and related or neighboring rights"),
    ("gpl-3.0", "gnu org", r"(?:www )?gnu org licenses gpl 3 0(?: \S+)?"),
    ("gpl-2.0", "gnu org", r"(?:www )?gnu org licenses (?:old licenses )?gpl 2 0(?: \S+)?"),
    ("lgpl-3.0", "gnu org", r"(?:www )?gnu org licenses lgpl 3 0(?: \S+)?"),
    ("agpl-3.0", "gnu org", r"(?:www )?gnu org licenses agpl 3 0(?: \S+)?"),
    ("apache-2.0", "apache org", r"(?:www )?apache org licenses license 2 0(?: \S+)?"),
    ("mit", "opensource org", r"(?:www )?opensource org licenses? mit(?: license)?(?: php)?"),
    ("bsd-3-clause", "opensource org", r"(?:www )?opensource org licenses? bsd 3 clause"),
    ("bsd-2-clause", "opensource org", r"(?:www )?opensource org licenses? bsd 2 clause"),
    ("mpl-2.0", "mozilla org", r"(?:www )?mozilla org mpl 2 0"),
    ("cc0-1.0", "creativecommons org", r"(?:www )?creativecommons org publicdomain zero 1 0"),
    *[(f"cc-{kind}-{ma}.{mi}", "creativecommons org", rf"(?:www )?creativecommons org licenses {short} {ma} {mi}") for ma, mi in ((4, 0), (3, 0), (2, 5), (2, 0)) for kind, (short, _) in _CC_KINDS.items()],
]

_GRANT = r"(?:(?:re)?licen[sc]ed|released|distributed|available|published|provided|covered|shared|offered) under(?: an?| the)?(?: terms(?: and conditions)? of(?: an?| the)?)?"


def rules() -> list[dict]:
    """The rules in order: a license's own sentences and addresses, tags, grants, names, short forms.

    ``words`` are keywords that every place of a rule holds, the rarest first; ``weight`` is how sure a place is.
    """
    out = [{"label": label, "words": [word], "regex": text, "weight": 1.0} for label, word, text in _BODIES]
    for label in dict.fromkeys(label for label, *_ in _FAMILIES):
        name = label.replace("-", " ").replace(".", " ")
        out.append({"label": label, "words": ["spdx", name.split()[0]], "regex": rf"spdx license identifier {name}{_LATER}", "weight": 1.0})
    for at in (1, 3):
        for label, *family in _FAMILIES:
            out.append({"label": label, "words": [family[at - 1], "under"], "regex": rf"{_GRANT} (?:{family[at]})(?: licen[sc]e)?", "weight": 0.95})
    for at, weight in ((1, 0.8), (3, 0.5)):
        for label, *family in _FAMILIES:
            out.append({"label": label, "words": [family[at - 1]], "regex": family[at], "weight": weight})
    for r in out:  # nearly every name ends in the same word, which is rarer than most others
        if re.search(r"licen\[sc\]e(?! ?\)\?)(?!d)", r["regex"].removeprefix(_GRANT).removesuffix("(?: licen[sc]e)?")):
            r["words"].insert(0, "licen*")
    return [r | {"regex": f"{_FROM}(?:{r['regex']}){_TO}", "place": i} for i, r in enumerate(out)]


_RULE = "array<struct<label:string,words:array<string>,regex:string,weight:double,place:int>>"


def normal(text: Column) -> Column:
    """A text's words, A to Z lowered, joined by single spaces."""
    lowered = F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER)
    return F.trim(F.regexp_replace(lowered, _GAPS, " "))


def count_words(text: Column) -> Column:
    """How many words a text of words joined by spaces holds."""
    return F.when(text == "", 0).otherwise(F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit(""))) + 1).cast("bigint")


def _indexes(words: Column, holds) -> Column:
    """Where, from 0, ``holds(word, index)`` is true."""
    return F.filter(F.transform(words, lambda w, i: F.when(holds(w, i), i)), lambda i: i.isNotNull())


def phrase_places(text: Column, phrase: str) -> Column:
    """The word indexes at which a phrase stands."""
    first, *more = phrase.split(" ")

    def holds(word: Column, i: Column, words: Column) -> Column:
        found = word == first
        for step, other in enumerate(more, 1):
            found = found & F.coalesce(F.get(words, i + step) == other, F.lit(False))
        return found

    inside = F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.lit(f" {phrase} "))
    return F.when(inside, F.element_at(F.transform(F.array(F.split(text, " ")), lambda words: _indexes(words, lambda w, i: holds(w, i, words))), 1)).otherwise(F.array().cast("array<int>"))


def rule_places(text: Column, table: list[dict]) -> Column:
    """All places of all rules as (first, back, place, label, weight), in order; ``back`` is the last word's index negated."""
    held = F.from_json(F.lit(json.dumps([r | {"words": [_spaced(w) for w in r["words"]]} for r in table])), _RULE)
    padded = F.concat(F.lit(" "), text, F.lit(" "))
    tried = F.filter(held, lambda r: F.forall(r["words"], lambda w: F.contains(padded, w)))
    marked = F.transform(tried, lambda r: F.struct(r["place"].alias("place"), r["label"].alias("label"), r["weight"].alias("weight"), F.regexp_replace(text, r["regex"], F.lit(f"{_OPEN}$0{_SHUT}")).alias("text")))
    marked = F.filter(marked, lambda m: m["text"] != text)
    split = F.transform(marked, lambda m: F.struct(m["place"].alias("place"), m["label"].alias("label"), m["weight"].alias("weight"), F.split(m["text"], " ").alias("words")))
    ends = F.transform(split, lambda m: F.struct(m["place"].alias("place"), m["label"].alias("label"), m["weight"].alias("weight"), _indexes(m["words"], lambda w, _: F.startswith(w, F.lit(_OPEN))).alias("firsts"), _indexes(m["words"], lambda w, _: F.endswith(w, F.lit(_SHUT))).alias("lasts")))
    return F.sort_array(F.flatten(F.transform(ends, lambda m: F.zip_with(m["firsts"], m["lasts"], lambda a, b: F.struct(a.alias("first"), (-b).alias("back"), m["place"].alias("place"), m["label"].alias("label"), m["weight"].alias("weight"))))))


_SPAN = "struct<first:int,back:int,place:int,label:string,weight:double>"


def resolved(found: Column) -> Column:
    """The places that stay: none lies inside another, and of two that overlap the one of the earlier rule is kept.

    One pass from left to right, the place last taken being open until one that does not overlap it comes. What is closed is
    put aside in chunks, so the pass is linear in the places.
    """

    def step(state: Column, x: Column) -> Column:
        held, p = state["held"], state["open"]
        taken = F.struct(held.alias("held"), x.alias("open"))
        closed = F.struct(F.concat(held, F.array(p)).alias("held"), x.alias("open"))
        inside, apart = x["back"] >= p["back"], x["first"] > -p["back"]
        return F.when(p.isNull(), taken).when(inside, state).when(apart, closed).when(x["place"] < p["place"], taken).otherwise(state)

    none, empty = F.lit(None).cast(_SPAN), F.array().cast(f"array<{_SPAN}>")

    def chunk(state: Column, at: Column) -> Column:
        part = F.slice(found, at, F.lit(_CHUNK))
        return F.aggregate(part, F.struct(empty.alias("held"), state["open"].alias("open")), step, lambda s: F.struct(F.concat(state["held"], F.array(s["held"])).alias("held"), s["open"].alias("open")))

    starts = F.when(F.size(found) > 0, F.sequence(F.lit(1), F.size(found), F.lit(_CHUNK))).otherwise(F.array().cast("array<int>"))
    start = F.struct(F.array().cast(f"array<array<{_SPAN}>>").alias("held"), none.alias("open"))
    spans = F.aggregate(starts, start, chunk, lambda s: F.concat(F.flatten(s["held"]), F.array(s["open"])))
    return F.transform(F.filter(spans, lambda p: p.isNotNull()), lambda p: F.struct(p["first"].alias("first"), (-p["back"]).alias("last"), p["place"].alias("rule"), p["label"].alias("label"), p["weight"].alias("weight")))


def _spaced(keyword: str) -> str:
    return f" {keyword[:-1]}" if keyword.endswith("*") else f" {keyword} "


def likely(text: Column, table: list[dict]) -> Column:
    """Whether a word of the text begins with the first keyword of any rule, by one expression."""
    by_letter: dict[str, list[str]] = {}
    for word in sorted({r["words"][0] for r in table}):
        by_letter.setdefault(word[0], []).append(word[1:-1] if word.endswith("*") else word[1:] + _TO)
    return text.rlike(f"{_FROM}(?:{'|'.join(f'{c}(?:{"|".join(rest)})' for c, rest in by_letter.items())})")


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table: list[dict] | None = None) -> DataFrame:
    """(doc_id, n_words, base, spans) of every row: the base places by label, and the places that the rules find and that stay.

    Places are word indexes from 0. Texts that hold no rule's first keyword are passed over, the others try the rules whose
    keywords they all hold.

    Null or empty text, or one without words: no words and nothing found. Texts of any length are read whole, in time that
    grows with their words and places. Null ids and repeated rows are rows like others. Empty table: no rows. Extra columns:
    ignored.
    """
    table = rules() if table is None else table
    rows = docs.select(F.col(id_col).alias("doc_id"), normal(F.col(text_col)).alias("words"))
    base = F.array(*[F.struct(F.lit(label).alias("label"), phrase_places(F.col("words"), phrase).alias("places")) for phrase, label in BASE])
    found = F.when(likely(F.col("words"), table), rule_places(F.col("words"), table)).otherwise(F.array().cast(f"array<{_SPAN}>"))
    rows = rows.select("doc_id", count_words(F.col("words")).alias("n_words"), base.alias("base"), found.alias("found"))
    return rows.select("doc_id", "n_words", "base", resolved(F.col("found")).alias("spans"))


def scan(docs: DataFrame) -> DataFrame:
    """What ``detect`` finds in ``documents`` as counts and labels; ``score`` is the weight of the surest place, 0 without any."""
    places = F.flatten(F.transform("base", lambda b: b["places"]))
    base = F.transform(F.filter("base", lambda b: F.size(b["places"]) > 0), lambda b: b["label"])
    named = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return detect(docs).select(
        "doc_id", "n_words", F.size(places).cast("bigint").alias("n_base"), F.array_min(places).cast("bigint").alias("first_word"), F.array_max(places).cast("bigint").alias("last_word"),
        named(base).alias("base_labels"), named(F.concat(base, F.transform("spans", lambda p: p["label"]))).alias("labels"), F.coalesce(F.array_max(F.transform("spans", lambda p: p["weight"])), F.lit(0.0)).alias("score"),
    )
