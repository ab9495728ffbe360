"""HTML extraction: streaming parser events, text-to-tag ratio by line, Gaussian smoothing, threshold clusters.

Parser events become lines (a block's text, the tags met since the line before, the element that holds it). Ratios of text
to tags are smoothed and clustered by a threshold; the text of the clusters is what decides which element is the article.
Element names, classes, ids and roles are evidence beside it: of what never is article text, and of where an article ends.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame

from .common import map_columns

# Names of HTML elements, by what they do, and class words of page furniture.
SILENT = frozenset("script style noscript template head title form button select option textarea input label fieldset iframe svg canvas object menu dialog".split())
OUTSIDE = frozenset("nav aside footer header".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article blockquote body center dd details div dl dt figcaption figure h1 h2 h3 h4 h5 h6 header hgroup hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split())
REGIONS = frozenset("article main".split())
CONTAINERS = frozenset("article body center div html main section table tbody td tr".split())
#: Elements whose class or id says something of all they hold, by a part of a hyphenated word too.
NAMED = frozenset("aside center div dl ol section table ul".split())
FURNITURE = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs byline-share consent cookie cookies "
    "footer form gdpr header masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promotion "
    "sidebar sidebars signup sponsor sponsored subscribe subscription".split()
)
DOUBTFUL = frozenset("alert legal login related share sharing skip social toc toolbar widget widgets".split())
COMMENTS = frozenset("comment comments disqus replies reply respond".split())
ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search".split())
#: Elements that end an open element of the left kind, as the HTML standard has it.
CLOSES = {"p": BLOCKS - {"html", "body", "tbody", "thead", "tfoot", "tr", "td", "th"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
#: What an element is known to be: nothing, doubtful, furniture, silent.
PLAIN, MAYBE, OUT, MUTE = range(4)
#: Spread of the smoothing, in lines; a line is content above this many times the ratios' standard deviation.
SPREAD, SHARE = 1.0, 1.0
#: Characters for each tag beyond which a line is no more content for being longer, so that no long line hides the others.
DENSE = 60
#: How much more a character of a cluster says inside an article or main element.
EVIDENCE = 2


def kind_of(tag: str, attrs: list[tuple[str, str | None]]) -> int:
    """What an element's name, class, id and role say it is.

    A whole class or id counts on any element, a part of a hyphenated one only on elements that hold blocks: a paragraph of
    class ``notice-board`` is a paragraph. A part of an id, and a word that articles use too, only makes doubtful.
    """
    if tag in SILENT:
        return MUTE
    if tag in ("html", "body"):
        return PLAIN
    kind = OUT if tag in OUTSIDE else PLAIN
    for name, value in attrs:
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return MUTE
        if not value:
            continue
        if name == "role" and value.lower() in ROLES:
            kind = max(kind, OUT)
        elif name in ("class", "id"):
            whole = set(value.lower().split())
            parts = {w for token in whole for w in re.split(r"[-_:]+", token)} if tag in NAMED or tag == "article" else whole
            if not COMMENTS.isdisjoint(whole) or name == "class" and not COMMENTS.isdisjoint(parts):
                kind = max(kind, OUT)
            elif tag in REGIONS:
                continue
            elif not FURNITURE.isdisjoint(whole) or name == "class" and not FURNITURE.isdisjoint(parts):
                kind = max(kind, OUT)
            elif not (FURNITURE | DOUBTFUL | COMMENTS).isdisjoint(parts):
                kind = max(kind, MAYBE)
    return kind


class Lines(HTMLParser):
    """Turns parser events into lines and a tree of the elements that hold them, in time linear in the page.

    ``elements`` holds (tag, parent, kind, own): the kind is the gravest of it and those around it, ``own`` its own. A
    ``line`` is (text, tags since the line before, element, characters inside links).
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int]] = []
        self.elements: list[tuple[str, int, int, int]] = [("", 0, PLAIN, PLAIN)]
        self.open: list[tuple[str, int, bool]] = [("", 0, True)]  # tag, element, whether it holds lines
        self.at: dict[str, list[int]] = {}  # by tag: its places in ``open``
        self.holders = [0]  # places in ``open`` of elements that hold lines
        self.parts: list[str] = []
        self.linked = 0
        self.tags = 0

    def element(self) -> int:
        return self.open[self.holders[-1]][1]

    def line(self) -> None:
        text = " ".join("".join(self.parts).split())
        self.parts.clear()
        if text:
            self.lines.append((text, self.tags, self.element(), min(self.linked, len(text))))
            self.tags = 0
        self.linked = 0

    def close_to(self, place: int) -> None:
        """Closes the open elements from a place on; each was opened once, so all closing together is linear."""
        if self.holders[-1] >= place:
            self.line()
        while len(self.open) > place:
            self.at[self.open.pop()[0]].pop()
        while self.holders[-1] >= place:
            self.holders.pop()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in VOID:
            if tag == "hr":
                self.line()
            elif tag == "br":
                self.parts.append(" ")
            return
        while tag in CLOSES.get(self.open[-1][0], ()):
            self.close_to(len(self.open) - 1)
        if tag in BLOCKS and tag in CLOSES.get(self.open[self.holders[-1]][0], ()):
            self.close_to(self.holders[-1])  # an open paragraph ends even inside unclosed phrases
        own = kind_of(tag, attrs)
        holds = tag in BLOCKS or own > PLAIN
        if holds:
            self.line()
            parent = self.element()
            kind = self.elements[parent][2]
            if tag == "h1" and self.elements[parent][0] == "header" and self.at.get("article", self.at.get("main")):
                kind = self.elements[self.elements[parent][1]][2]  # an article's title may stand in its own header
            self.elements.append((tag, parent, max(kind, own), own))
            self.holders.append(len(self.open))
        self.at.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, len(self.elements) - 1 if holds else 0, holds))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if not (places := self.at.get(tag)):
            return
        if places[-1] > self.holders[-1] or self.open[places[-1]][2]:  # a phrase doesn't end outside its block
            self.close_to(places[-1])

    def handle_data(self, data: str) -> None:
        if self.elements[self.element()][2] < MUTE:
            self.parts.append(data)
            if self.at.get("a"):
                self.linked += len(data.strip())

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """``<![`` outside foreign elements begins a bogus comment, whatever the word behind it."""
        end = self.rawdata.find(">", i)
        return end + 1 if end >= 0 else -1

    def read(self, html: str) -> list[tuple[str, int, int, int]]:
        self.feed(html)
        if re.match(r"<[A-Za-z/!?]", self.rawdata):
            self.rawdata = ""  # the page ends inside a tag or a comment
        self.close()
        self.line()
        return self.lines


def clusters(ratios: np.ndarray) -> np.ndarray:
    """Which lines are content: text-to-tag ratios smoothed by a Gaussian, above a share of their spread."""
    reach = np.arange(-3, 4)
    weights = np.exp(-(reach**2) / (2 * SPREAD**2))
    ratios = np.minimum(ratios, DENSE)
    padded = np.pad(ratios, 3, mode="edge")
    smooth = np.convolve(padded, weights / weights.sum(), mode="valid")
    return smooth > min(SHARE * ratios.std(), smooth.max() * 0.999)


def filled(kept: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Adds the gaps that hold no more text than is kept before them, and than is kept after them."""
    out, at = kept.copy(), np.flatnonzero(kept)
    text, whole = np.cumsum(np.where(kept, sizes, 0)), np.cumsum(sizes)
    for a, b in zip(at, at[1:], strict=False):
        if whole[b - 1] - whole[a] <= min(text[a], text[-1] - text[a]):
            out[a:b] = True
    return out


class Page:
    """A parsed page: for each element the text, links and cluster text below it; all sums in one pass over the elements."""

    def __init__(self, elements: list[tuple[str, int, int, int]], lines: list[tuple[str, int, int, int]], content: np.ndarray):
        self.elements, self.lines = elements, lines
        self.size = [len(text) for text, *_ in lines]
        self.content = content.tolist()
        n = len(elements)
        self.region = [False] * n  # inside an article or main element
        for e, (tag, parent, _, _) in enumerate(elements):
            self.region[e] = tag in REGIONS or e > 0 and self.region[parent]
        self.text, self.links, self.votes, self.rows = [0] * n, [0] * n, [0] * n, [0] * n
        for (_, _, e, linked), size, good in zip(lines, self.size, self.content, strict=True):
            if elements[e][2] < OUT:
                self.text[e] += size
                self.links[e] += linked
                self.rows[e] += 1
                if good and 2 * linked <= size:  # next to content, but a link
                    self.votes[e] += size * (EVIDENCE if self.region[e] else 1)
        self.below: list[list[int]] = [[] for _ in range(n)]
        for e in range(n - 1, 0, -1):
            parent = elements[e][1]
            self.below[parent].append(e)
            for sums in (self.text, self.links, self.votes, self.rows):
                sums[parent] += sums[e]

    def article(self) -> int:
        """The element that holds most of the clusters' text, and what belongs to it around it.

        From the page down, into a container while one alone holds more than half of the votes, but not into one of several
        articles of some weight. Then up: to the outermost
        article or main element around it, or else while what an element adds is little and not mostly links.
        """
        at = 0
        while self.below[at]:
            best = max(self.below[at], key=lambda e: self.votes[e])
            tag = self.elements[best][0]
            if 2 * self.votes[best] <= self.votes[at] or tag not in CONTAINERS or self.rows[best] < 2 and tag not in REGIONS | {"html", "body"}:
                break
            beside = sum(self.votes[e] for e in self.below[at] if e != best and self.elements[e][0] == "article")
            if tag == "article" and 10 * beside > self.votes[best]:
                break  # several articles of some weight
            at = best
        if self.region[at]:
            while self.region[self.elements[at][1]]:
                at = self.elements[at][1]
            while self.elements[at][0] not in REGIONS:
                at = self.elements[at][1]
            return at
        while at and (up := self.elements[at][1]) and self.elements[up][0] not in ("html", "body"):
            text, links = self.text[up] - self.text[at], self.links[up] - self.links[at]
            if 3 * links > text or 2 * text > self.text[at]:
                break
            at = up
        return at

    def kept(self) -> np.ndarray:
        """Which lines are the article's."""
        n = len(self.elements)
        at = self.article()
        tag = self.elements[at][0]
        top, dropped = [0] * n, [False] * n  # the child of ``at`` that holds an element, ``at`` itself, or none (-1)
        for e in range(n):
            _, parent, kind, own = self.elements[e]
            top[e] = at if e == at else -1 if e == 0 else e if parent == at else top[parent] if top[parent] != at else -1
            doubtful = own == MAYBE and 2 * self.votes[e] < self.text[e] * (EVIDENCE if self.region[e] else 1)
            dropped[e] = kind >= OUT or doubtful or e > 0 and dropped[parent] and not (self.elements[parent][2] >= OUT > kind)
        inside = np.array([top[e] >= 0 and not dropped[e] for _, _, e, _ in self.lines])
        if tag in REGIONS:
            return inside
        lists = [top[e] not in (at, -1) and self.votes[top[e]] == 0 and 2 * self.links[top[e]] > self.text[top[e]] for _, _, e, _ in self.lines]
        inside &= ~np.array(lists)
        if tag not in ("", "html", "body"):
            return inside
        regions = any(self.elements[e][0] in REGIONS and self.votes[e] for e in self.below[at])
        most = [2 * self.votes[e] > self.text[e] for e in range(n)]
        good = [most[top[e]] and (self.content[i] or top[e] != at) or regions and self.region[e] for i, (_, _, e, _) in enumerate(self.lines)]
        kept = filled(np.array(good) & inside, np.where(inside, self.size, 0)) & inside
        # Paragraphs, headings and lists that directly follow or precede what is kept belong to it.
        loose = [inside[i] and (top[e] == at or self.elements[top[e]][0] not in CONTAINERS) for i, (_, _, e, _) in enumerate(self.lines)]
        for order in (range(1, len(kept)), range(len(kept) - 2, -1, -1)):
            for i in order:
                before = i - 1 if order.step > 0 else i + 1
                kept[i] |= kept[before] and loose[i] and loose[before]
        return kept


def main_text(html: str) -> str:
    """The article's blocks in page order, joined by one line feed.

    Lines whose smoothed text-to-tag ratio passes the threshold are clusters; their text votes for the elements around them
    (see ``Page.article``). All lines of the chosen article or main element stay, short ones too; of another element all but
    lists of links; of a bare page the clusters, small gaps between them and the paragraphs next to them. Furniture inside is
    dropped, doubtful elements where less than half of their text is in clusters. If no line outside furniture is in a
    cluster, all lines outside furniture vote.
    """
    parser = Lines()
    lines = parser.read(html)
    plain = np.array([parser.elements[e][2] < OUT for _, _, e, _ in lines], dtype=bool)
    if not plain.any():
        return ""
    content = clusters(np.array([len(text) / max(tags, 1) for text, tags, _, _ in lines]))
    if not (content & plain).any():
        content = plain
    kept = Page(parser.elements, lines, content).kept()
    return "\n".join(text for (text, *_), good in zip(lines, kept, strict=True) if good)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The main text of every page, from its whole html.

    Null or empty html, or none but furniture: empty text, n_chars 0. Null ids and urls pass through; each row in gives one
    row out, repeated ones too. Empty table: no rows. Extra columns, whatever their names: ignored. Unclosed elements end
    with the page; a tag, comment or declaration that the page ends in is no text; an unknown declaration is a comment. Very
    long pages and deep nesting take time in proportion to their length.
    """

    def make():
        def work(page_id: list, url: list, html: list) -> dict:
            text = [main_text(h) if h else "" for h in html]
            return {"page_id": page_id, "url": url, "text": text, "n_chars": [len(t) for t in text]}

        return work

    rows = pages.selectExpr(f"cast(`{id_col}` as bigint) as page_id", f"`{url_col}` as url", f"`{html_col}` as html")
    return map_columns(rows, "page_id bigint, url string, text string, n_chars bigint", make)
