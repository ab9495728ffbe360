"""Each operator against a brute-force version, a library or an exact round trip, on small tables with awkward rows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece as library
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidepool.llm import ann, bpe, html, neardup, packing, secrets, sharding, topk, toxicity
from tidepool.llm import sentencepiece as pieces
from tidepool.llm.partenum import shingles

DATA = "/root/testdata/sf0.001"
WORDS = "the and of idiot läßt über naïve 12 3.5 it's don't ﬁne　x <|endoftext|> a\tb\r\n  tab ===== 日本語 🙂 zzzz".split(" ")


def awkward(spark, rows=None):
    """Null and empty texts, a null id, repeated rows, a very long text, and a column whose name clashes."""
    r = random.Random(5)
    rows = rows or [(i, " ".join(r.choice(WORDS) for _ in range(r.randrange(60)))) for i in range(60)]
    rows = rows + [(901, None), (902, ""), (903, " \t\n"), (None, "no id here at all"), (904, "twice the same"), (904, "twice the same"), (905, "word " * 30000), (906, "x" * 5000)]
    return spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, score double")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def test_token_counts_equal_the_library(spark):
    docs = awkward(spark)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((r.doc_id or -1, len((r.text or "").encode()), len(tokenizer.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect())
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in bpe.token_counts(docs).collect())
    assert got == want and bpe.token_counts(empty(spark)).count() == 0


def test_merging_reaches_every_entry_of_the_vocabulary():
    """So an entry counts as one token whether its merges are done or not."""
    rank = bpe.ranks("byte_bpe_50k.tiktoken")

    class Without:
        def get(self, key, other=None):
            return other if key == self.word else rank.get(key, other)

        def __contains__(self, key):
            return key != self.word and key in rank

    without = Without()
    for word in rank:
        without.word = word
        assert len(word) == 1 or bpe.merged_count(word, without) == 2, word


def test_packing_is_an_exact_cut(spark):
    docs = awkward(spark)  # repeated rows are of one text, so their pieces are alike
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = docs.collect()
    times = Counter(r.doc_id for r in rows)
    ids = {r.doc_id: [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1] for r in rows}
    got = packing.pack(docs).collect()
    places, covered = defaultdict(list), defaultdict(int)
    for p in got:
        part = ids[p.doc_id][p.start : p.start + p.length]
        assert len(part) == p.length and p.doc_tokens == len(ids[p.doc_id])
        assert p.ids_crc32 == zlib.crc32(np.array(part, dtype="<u4").tobytes())
        covered[p.doc_id] += p.length
        places[p.sequence_id].append((p.offset, p.length))
    assert all(covered[d] == len(x) * times[d] for d, x in ids.items())
    assert Counter((p.doc_id, p.start) for p in got) == Counter({(p.doc_id, p.start): times[p.doc_id] for p in got})
    for spots in places.values():
        end = 0
        for offset, length in sorted(spots):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(places) <= -(-sum(len(x) * times[d] for d, x in ids.items()) // 2048) + 1
    assert packing.pack(empty(spark)).count() == 0
    repeated = packing.pack(awkward(spark)).where("doc_id = 904").count()
    assert repeated == 2


def test_column_generation_reaches_the_material_bound():
    r = random.Random(2)
    histogram = Counter(n for _ in range(3000) for n in packing.piece_lengths(int(r.lognormvariate(6, 1.2)) + 1, 2048))
    made = packing.patterns(dict(histogram), 2048)
    used = Counter()
    for parts, times in made:
        assert sum(n * x for x, n in parts) <= 2048
        for x, n in parts:
            used[x] += n * times
    assert used == histogram
    assert sum(t for _, t in made) <= sum(k * v for k, v in histogram.items()) / 2048 + 5


def test_sharding_balances_and_keeps_order(spark):
    docs = awkward(spark, [(10_000 + i, ["same text here", "other"][i % 2] if i < 3000 else f"text {i} " * (i % 40)) for i in range(6000)])
    got = sharding.shard(docs).collect()
    assert len(got) == 6008
    size = Counter()
    slots = defaultdict(list)
    for r in got:
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(size) <= 8
    total, longest = sum(size.values()), max(r.size for r in got)
    assert max(size.values()) - min(size[s] for s in range(8)) <= 2 * longest + total / 8 / 50
    sums = {r.doc_id: (r.size, r.text_crc32) for r in got}
    assert sums[901] == (1, 0) and sums[905] == (150001, zlib.crc32(b"word " * 30000))
    assert sharding.shard(empty(spark)).count() == 0


def test_html():
    page = "<html><head><title>t</title><script>var x='</p>';</script></head><body><nav><a>menu</a></nav><div class='ad'>buy</div><article><h1>Head &amp; title</h1><p><b>one\n two<br>three<p>four</p><div class='comments'>nice!</div><form>mail</form></article><aside>side</aside><footer>&copy; x</footer>"
    assert html.main_text(page) == "Head & title\none two three\nfour"
    assert html.main_text("<nav>only</nav>") == "" and html.main_text("plain text") == "plain text"
    assert html.main_text("<p>" + "x " * 50000) == ("x " * 50000).strip()


def paragraphs(texts):
    return "".join(f"<p>{t}</p>" for t in texts)


def test_html_keeps_lines_beside_a_very_long_one():
    texts = [f"line {i} " + "of some words " * 8 for i in range(30)]
    texts.insert(15, "a long paragraph " * 300)
    want = [" ".join(t.split()) for t in texts]
    links = "<div>" + "".join(f"<div><span><a href='/{i}'>go {i}</a></span></div>" for i in range(30)) + "</div>"
    assert html.main_text(paragraphs(texts)).split("\n") == want
    got = html.main_text(links + paragraphs(texts)).split("\n")
    assert got[-31:] == want and len(got) <= 33
    short = ["Yes.", "No.", "Why?", "So.", "Oh.", "Hm.", "And?", "Well."]
    assert html.main_text(paragraphs(texts[:10] + short + texts[16:])).split("\n") == want[:10] + short + want[16:]


def test_html_keeps_nested_and_sibling_regions():
    a, b, c = (f"{x} has a good many words to say about it " * 6 for x in ("first", "second", "third"))
    a, b, c = a.strip(), b.strip(), c.strip()
    menu = "<div><div><span><a>x</a></span></div></div>" * 5
    siblings = f"{menu}<article><h2>One</h2><p>{a}</p></article><article><h2>Two</h2><p>Short.</p></article><article><h2>Three</h2><p>{b}</p></article>{menu}"
    assert html.main_text(siblings) == f"One\n{a}\nTwo\nShort.\nThree\n{b}"
    assert html.main_text(f"{menu}<main><h1>Title</h1><p>Lead.</p><article><p>{a}</p><p>{b}</p></article></main>{menu}") == f"Title\nLead.\n{a}\n{b}"
    assert html.main_text(f"{menu}<article><h1>Title</h1><p>{a}</p><main><p>{b}</p></main><section><article><p>Aside.</p></article></section><p>{c}</p></article>{menu}") == f"Title\n{a}\n{b}\nAside.\n{c}"
    assert html.main_text(f"<article class='post'><p>{a}</p><article class='comment'><p>{b}</p></article></article><article class='comment'><p>{c}</p></article>") == a
    assert html.main_text(f"<article class='has-sidebar'><p>{a}</p></article>") == a and html.main_text("<p>x</p><article></article>") == "x"


def test_html_extract(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a &lt; b"), (2, None, None), (2, None, None), (None, "v", "")], "page_id long, url string, html string")
    got = sorted((r.page_id or 0, r.text, r.n_chars) for r in html.extract(pages).collect())
    assert got == [(0, "", 0), (1, "a < b", 5), (2, "", 0), (2, "", 0)]
    real = spark.read.parquet(f"{DATA}/pages.parquet")
    assert html.extract(real).where("n_chars > 0").count() == real.count()


def test_secrets(spark):
    key, hexes = "AKIA" + "B7" * 8, "0f" * 20
    rows = [(1, f'x password = "hunter22x" {key} and {hexes}'), (2, "token: short"), (3, f"PassWord:{'a' * 9} API-KEY=AKIA12")]
    rows += [(i, f"secret={hashlib.md5(str(i).encode()).hexdigest()[:18]} w") for i in range(10, 60)]
    got = {r.doc_id: r for r in secrets.scan(awkward(spark, rows)).where("doc_id < 900").collect()}
    assert (got[1].n_assign, got[1].n_access, got[1].n_hex) == (1, 1, 1)
    text = rows[0][1]
    spans = sorted([("assign", text.index("password"), text.index("hunter22x") + 9), ("access", text.index(key), text.index(key) + 20), ("hex", text.index(hexes), text.index(hexes) + 40)], key=lambda s: s[1])
    joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    assert got[1].base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and got[1].spans == joined
    assert got[2].n_assign == 0 and got[2].base_sha256 == hashlib.sha256(b"").hexdigest() and got[3].n_assign == 1
    clean = {r.doc_id: r.text for r in secrets.redact(awkward(spark, rows)).collect()}
    assert "hunter22x" not in clean[1] and clean[2] == "token: short" and clean[901] is None
    assert secrets.scan(empty(spark)).count() == 0


def test_automata_tell_formats_apart():
    r = random.Random(1)
    hexes = ["".join(r.choice("0123456789abcdef") for _ in range(24)) for _ in range(120)]
    hosts = [f"mail{i}.example.com" for i in range(100)]
    formats = secrets.Formats({"hex": hexes[:100]}, secrets.class_pairs(map(secrets.format_of, hosts), [1] * len(hosts)))
    formats.above_ordinary((formats.step(secrets.format_of(h)), 1) for h in hosts)
    assert len(formats.automata) == 1 and sum(map(formats.secret, hexes[100:])) >= 15 and not any(map(formats.secret, hosts))


@pytest.mark.parametrize("hosts", [10, 1500])
def test_many_unlabelled_secrets_are_found(spark, hosts):
    """However many of the candidates are secrets: none of the ordinary ones is taken, and nearly all others are."""
    r = random.Random(3)
    hexes = ["".join(r.choice("0123456789abcdef") for _ in range(20)) for _ in range(700)]
    rows = [(i, f"secret={x} w") for i, x in enumerate(hexes[:100])] + [(100 + i, f"see {x} there") for i, x in enumerate(hexes[100:])]
    rows += [(10_000 + i, f"ask mail{i}.example.com or") for i in range(hosts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.spans for x in secrets.scan(docs).collect()}
    keys = [i for i in range(100, 700) if any(c.isalpha() for c in hexes[i]) and any(c.isdigit() for c in hexes[i])]
    assert sum(got[i] == "format:4:24" for i in keys) >= 0.9 * len(keys)
    assert not any(v for i, v in got.items() if i >= 10_000)
    clean = {x.doc_id: x.text for x in secrets.redact(docs).collect()}
    assert all((clean[i] == "see <secret> there") == (got[i] == "format:4:24") for i in keys)


def brute_groups(rows, width, num):
    sets = {i: (d, set(shingles(t, width).tolist())) for i, (d, t) in enumerate(rows)}
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in sets.items():
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= num * len(a | b):
                parent[find(i)] = find(j)
    least = defaultdict(lambda: None)
    for i, (d, _) in sets.items():
        if d is not None:
            least[find(i)] = d if least[find(i)] is None else min(d, least[find(i)])
    return sorted((-1 if d is None else d, len(s), least[find(i)] if least[find(i)] is not None else -1) for i, (d, s) in sets.items())


@pytest.mark.parametrize(("width", "num"), [(5, 80)])
def test_groups_equal_brute_force(spark, width, num):
    r = random.Random(width)
    base = [[r.choice("abcdefghij") + str(r.randrange(40)) for _ in range(r.choice([2, 12, 60, 150]))] for _ in range(25)]
    rows = []
    for i in range(160):
        words = list(base[i % 25] if i < 110 else base[3])
        for _ in range(r.randrange(4)):
            words[r.randrange(len(words))] = "e" + str(r.randrange(9))
        rows.append((i * 3, " ".join(words)))
    docs = awkward(spark, rows)
    got = sorted((-1 if x.doc_id is None else x.doc_id, x.n_shingles, x.component_id if x.component_id is not None else -1) for x in neardup.groups(docs, width, num).collect())
    assert got == brute_groups([(x.doc_id, x.text) for x in docs.collect()], width, num)


def test_one_of_each(spark):
    docs = awkward(spark, [(1, "a b c d e f g h"), (2, "a b c d e f g h"), (3, "quite another text of some words here")])
    kept = neardup.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 901, 902, 903, 904, 905, 906]
    assert neardup.one_of_each(empty(spark)).count() == 0


def test_one_of_each_by_id_and_set(spark):
    """Repeated ids with different texts, and null ids with equal ones."""
    one, two, three, four = ("a b c d e f g h", "other words that stand here alone", "none names this text at all", "a name and a copy without one")
    near = " ".join(f"w{i}" for i in range(60))
    rows = [(1, one), (2, one), (2, two), (3, two), (None, three), (None, three), (4, four), (None, four), (5, near), (5, near + " z"), (5, near), (6, "="), (6, "!"), (6, "!"), (None, "?"), (None, "?")]
    got = neardup.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [x.text in (near, near + " z") for x in got if x.doc_id == 5] == [True]
    assert sorted((x.doc_id or 0, x.text) for x in got if x.doc_id != 5) == sorted([(1, one), (2, two), (0, three), (4, four), (6, "="), (6, "!"), (0, "?")])


def test_encoding_equals_the_library_and_comes_back(spark):
    docs = awkward(spark)
    model = library.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    encoded = pieces.encode(docs)
    for r in encoded.collect():
        assert r.ids == model.encode(texts[r.doc_id])
    for r in pieces.decode(encoded).collect():
        assert r.text == texts[r.doc_id].replace("ﬁ", "ﬁ")
    assert pieces.digest(empty(spark)).count() == 0


def test_unigram_pass_finds_the_best_path(tmp_path):
    model = pieces.Pieces(public_tokenizers.path("piece_bpe_32k.model"), "unigram")

    def best(text):
        """The best score over all segmentations, by plain recursion."""
        if not text:
            return 0.0
        scores = [model.score_of.get(text[:n], model.spare if n == 1 else None) for n in range(1, min(len(text), model.longest) + 1)]
        return max(s + best(text[n:]) for n, s in enumerate(scores, 1) if s is not None)

    for t in ("a small text", "of the and", "words", "naïve 日", "  two"):
        text = model.model.normalize(t)
        parts = [p for group in model.stream(text) for p in group]
        assert "".join(parts) == text
        assert sum(model.score_of.get(p, model.spare) for p in parts) == pytest.approx(best(text))
    long = model.model.normalize("streaming " * 400).replace("▁", "")
    assert "".join(p for group in model.stream(long) for p in group) == long


def vectors(spark):
    r = np.random.default_rng(4)
    rows = [(i, [float(x) for x in r.standard_normal(16)]) for i in range(1500)]
    rows += [(1500, rows[7][1]), (1501, rows[7][1]), (1502, None), (1503, [None] * 16), (1504, [float("nan")] * 16), (1505, [0.0] * 16), (None, rows[1][1]), (1506, [1.0]), (3, rows[3][1])]
    return spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int")


def test_searches(spark):
    table = vectors(spark)
    rows = {r.vec_id: np.array(r.embedding, dtype=float) for r in table.where("vec_id < 1502").collect()}
    want = {}
    for q in [i for i in rows if i % 100 == 0]:
        d = sorted((float(np.sqrt(((rows[i] - rows[q]) ** 2).sum())), i) for i in rows if i != q)[:10]
        want[q] = d
    got = defaultdict(list)
    for r in ann.nearest(table).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.score, r.vec_id))
    found = sum(len({i for _, i in want[q]} & {i for _, i in got[q]}) for q in want)
    assert found >= 9 * len(want) and all(x == sorted(x) and len(x) == 10 for x in got.values())
    rows[1505] = np.zeros(16)
    got = defaultdict(list)
    for r in topk.top(table).orderBy("query_id", "rank").collect():
        got[r.query_id].append((-r.score, r.vec_id))
    whole = {i: [int(x) for x in np.floor(1024 * v)] for i, v in rows.items()}
    for q in want:
        assert got[q] == sorted((-sum(a * b for a, b in zip(whole[q], whole[i], strict=True)), i) for i in whole if i != q)[:10]
    assert ann.nearest(table.where("vec_id < 0")).count() == 0 and topk.top(table.where("vec_id < 0")).count() == 0
    assert ann.nearest(table.where("vec_id < 3")).count() == 2


def test_toxicity(spark):
    r = random.Random(9)
    prose = "the river runs past old mills and quiet farms where people work all day long".split()
    rows, labels = [], []
    for i in range(900):
        words = [r.choice(prose) for _ in range(40)]
        if i % 5 == 0:
            for w in r.sample(["idiot", "moron", "scumbag", "worthless"], 2):
                words.insert(r.randrange(40), w)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 5 == 0)))
    docs, marks = awkward(spark, rows), spark.createDataFrame(labels + [(5, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, marks)
    got = {x.doc_id: x for x in toxicity.score(docs, model).collect()}
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out for i in held) and sum(got[i].predicted == int(i % 5 == 0) for i in held) >= 0.98 * len(held)
    assert got[902].predicted == 0 and got[901].score == got[902].score
    assert model.score("you idoit and you morron, so worthles") > model.score("the quiet river") and model.lexicon.find("idoit")[1]
    assert model.score('he wrote "idiot moron" there') <= model.score("he is an idiot moron there")
    none = toxicity.train(empty(spark), marks)
    assert toxicity.score(docs, none).count() == docs.count() and toxicity.reject(docs, model).columns == docs.columns


def test_quotations_are_paired_over_the_whole_line():
    lexicon = toxicity.Lexicon({}, {"idiot": 1.0})
    long = "some words that go on and on " * 4

    def inside(text):
        return toxicity.features(text, lexicon)[1:3] == [0.0, float(np.log1p(1))]

    assert not inside(f'"{long}" you idiot, "bye"') and inside(f'"{long} idiot {long}"') and inside(f"„{long} idiot {long}“ and")
    assert inside("“one “two” idiot” x") and inside("‘i don’t say idiot’") and not inside("„a“ idiot „b“") and not inside("«a» idiot «b»")
    assert not inside('open "quote idiot\nends" there') and not inside("it’s an idiot’s") and not inside('one " idiot') and inside('x "idiot"')


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, DATA)
        assert after.columns == docs.columns, name
        before = after.cache()
    model = toxicity.train(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    clean = [(r.doc_id, r.text) for r in docs.collect() if model.score(r.text) < 0.7]
    groups = {d: c for d, _, c in brute_groups(clean, 5, 80)}
    want = {d for d, c in groups.items() if d == c}
    kept = {r.doc_id: r.text for r in before.collect()}
    assert kept.keys() == want
    # Masked texts: what is left and what is masked make up the text, and every base span is masked.
    texts = {r.doc_id: r.text for r in docs.collect()}
    for d, masked in kept.items():
        spans = secrets.base_spans(texts[d])
        if not spans and masked == texts[d]:
            continue
        left, at = masked.split("<secret>"), 0
        for n, part in enumerate(left):
            found = texts[d].find(part, at) if n else 0
            assert found >= 0 and texts[d][found : found + len(part)] == part
            assert not any(s < found + len(part) and e > found for _, s, e, _ in spans)
            at = found + len(part)
        assert at == len(texts[d]) or left[-1] == ""
    # Packed pieces: the ids of the masked texts by the tokenizer library, each once, without gaps in the sequences.
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {d: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for d, t in kept.items()}
    covered, places = Counter(), defaultdict(list)
    for p in corpus_pipeline.run(spark, DATA).collect():
        part = ids[p.doc_id][p.start : p.start + p.length]
        assert len(part) == p.length and p.ids_crc32 == zlib.crc32(np.array(part, dtype="<u4").tobytes())
        covered[p.doc_id] += p.length
        places[p.sequence_id].append((p.offset, p.length))
    assert covered == Counter({d: len(x) for d, x in ids.items()})
    for spots in places.values():
        spots.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(spots, spots[1:], strict=False)) and spots[0][0] == 0 and sum(spots[-1]) <= 2048


def test_names_that_spark_would_parse(spark):
    """Further columns with dots and backticks, some like the operators' own, go through all stages that keep columns."""
    from tidepool.llm import neardup, secrets, toxicity

    rows = [(i, f"one two three four five six {i % 2} password = abcdefgh{i:04d}x", "en", 1.5, f"t{i}", "n") for i in range(6)] + [(None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, `a.b` double, `text.x` string, `_may_be_dropped` string").selectExpr("*", "lang AS `c``d.e`")
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")
    kept = toxicity.reject(docs, toxicity.train(docs, labels), threshold=2.0)
    assert kept.columns == docs.columns and kept.count() == 7
    for out in (secrets.redact(docs), neardup.one_of_each(docs)):
        assert out.columns == docs.columns
        assert {tuple(r)[3:] for r in out.collect()} <= {tuple(r)[3:] for r in docs.collect()}
