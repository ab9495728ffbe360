"""Main text of pages: against a direct reading of generated pages, and on broken, nested and bare markup."""

import html as escapes
import random
import time

import numpy as np

from tidepool.llm import html

WORDS = "rain over the harbour fell for hours while boats came in, slowly; nobody spoke & the lamps <lit> «later» ünd".split()


def sentence(r, low, high):
    return " ".join(r.choice(WORDS) for _ in range(r.randrange(low, high)))


def page(r, wrap, item="a", items=(20, 60)):
    """A page and its article's blocks: lists of short items before and after, one advert, then the article in the given elements."""
    links = "".join(f"<li><{item} href='/{i}'>{sentence(r, 2, 5)}</{item}></li>" for i in range(r.randrange(*items)))
    blocks = [("h1", sentence(r, 3, 8))] + [("p", sentence(r, 25, 90)) for _ in range(r.randrange(4, 9))]
    blocks.insert(3, ("h2", sentence(r, 1, 3)))
    body = "".join(f"<{t}>{escapes.escape(x).replace(' for ', ' <b>for</b> ')}</{t}>" for t, x in blocks)
    opened, closed = "".join(f"<{w}>" for w in wrap), "".join(f"</{w.split()[0]}>" for w in reversed(wrap))
    text = f"<html><head><title>no</title></head><body><div><ul>{links}</ul></div><div class='ad'>buy it now</div>{opened}{body}{closed}<div><ul>{links}</ul></div></body></html>"
    return text, "\n".join(" ".join(x.split()) for _, x in blocks)


def test_generated_pages_equal_their_blocks():
    r = random.Random(11)
    for wrap in ((), ("article",), ("main", "article"), ("div id='c'",), ("div", "div class='body'"), ("section", "div"), ("table", "tr", "td")):
        for _ in range(12):
            text, want = page(r, wrap)
            assert html.main_text(text) == want, wrap


def test_the_clusters_decide(monkeypatch):
    """Pages without article or main elements: with every line as content, the lists win."""
    r = random.Random(3)
    made = [page(r, wrap, "span", (80, 120)) for wrap in ((), ("div",), ("div", "section")) for _ in range(10)]
    assert all(html.main_text(text) == want for text, want in made)
    monkeypatch.setattr(html, "clusters", lambda ratios: np.ones(len(ratios), dtype=bool))
    assert sum(html.main_text(text) != want for text, want in made) > len(made) / 2


def test_clusters_outweigh_an_article_element():
    body = "many good words that make up the text itself " * 8
    teaser = "<article><p>Read on.</p></article>"
    assert html.main_text(f"{teaser}<div><p>{body}</p><p>{body}</p></div>").count(body.strip()) == 2


def test_broken_markup():
    body = "some words of a text " * 10
    assert html.main_text(f"<![foo[bar]]><p>{body}</p><![if !IE]><p>x</p><![endif]><!ELEMENT y>") == f"{body.strip()}\nx"
    assert html.main_text(f"<p>{body}</p><a b='") == body.strip() == html.main_text(f"<p>{body}</p><!-- cut") == html.main_text(f"<p>{body}</p")
    assert html.main_text("1 < 2 and a<3 & b") == "1 < 2 and a<3 & b" and html.main_text("a &amp &lt;b&gt; &#x41;&#66; &nosuch; <") == "a & <b> AB &nosuch; <"
    assert html.main_text("</p></div><p>t</b>u</i></p></p>") == "tu" and html.main_text("<p>\x00</p><p>\ud800a</p>".replace("\ud800", "�"))
    assert html.main_text("<script>var a = '<p>no</p>'; <p>also no") == ""


def test_names_are_evidence():
    body = "plain prose with quite a number of words in it " * 6
    page_ = f"<article><h2 id='social-history'>Social history</h2><p class='notice-board'>The board.</p><p>{body}</p><div class='share-prices'><p>{body}</p></div><div class='share-links'><a>t</a> <a>f</a></div><div class='sidebar-left'><p>{body}</p></div></article>"
    assert html.main_text(page_) == f"Social history\nThe board.\n{body.strip()}\n{body.strip()}"
    assert html.main_text(f"<article><p>The text.</p><article class='comment'><p>{body}</p></article><div class='comment-list'><p>{body}</p></div></article>") == "The text."
    assert html.main_text(f"<article><header><h1>Name</h1><p>share</p></header><p>{body}</p><footer>x</footer></article>") == f"Name\n{body.strip()}"
    assert html.main_text(f"<main><h1>Title</h1><p>Lead.</p><article><p>{body}</p></article><article><p>{body}</p></article></main>") == f"Title\nLead.\n{body.strip()}\n{body.strip()}"


def test_long_and_deep_pages_take_linear_time():
    for unit in ("<b><i>x", "<div>x", "<p><b>t", "<p>a</i></b></div>", "<", "<a ", "<!--", "&", "<![x[ ", "</b", "<ul><li>x", "<article>x"):
        began = time.process_time()
        html.main_text(unit * 20_000)
        assert time.process_time() - began < 4, unit


def test_clashing_columns_and_repeated_rows(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a</p>", "t", 9), (1, "u", "<p>a</p>", "t", 9)], "page_id long, url string, html string, text string, n_chars int")
    assert [tuple(r) for r in html.extract(pages).collect()] == [(1, "u", "a", 1)] * 2
    assert html.extract(pages.where("page_id < 0")).collect() == []
