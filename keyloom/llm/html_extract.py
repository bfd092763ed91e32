"""Main text of web pages by tag-path ratios.

A page is read as blocks: stretches of text between block-level tags, each with its
root-to-leaf path of block tags. Blocks inside elements that never are the article (menus,
headers, footers, forms, hidden parts) are set aside. Parts that are named like a sidebar,
notice, advert or comments have paths of their own, whose ratios their names lower. Text
length and punctuation outside links are summed per path; each sum over the number of blocks
is a ratio r, taken as r / (r + a paragraph's), so that one very long block outweighs no other. These values are smoothed over paths of the same container and fused by
their product. An article or main element only weighs in: paths inside gain and
those outside lose by the share of the page's text that such elements hold. Paths over a
share of the page's spread of fused ratios are content. Headings and short paths go with the
container of the content around them; lists of links don't.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of HTML: elements without an end tag; with code, not text; with text that has no tags; of inline flow; that end an open paragraph.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style".split())
PLAIN = frozenset("textarea title xmp iframe noembed noframes".split())
INLINE = frozenset(
    "math mi mn mo ms mtext mspace mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mstyle mpadded mphantom menclose mtable mtr mtd semantics "
    "annotation annotation-xml svg g defs symbol path rect circle ellipse line polyline polygon text tspan textpath noscript object canvas audio video "
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter nobr output progress q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr img br".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr "
    "main menu nav ol p pre search section table ul".split()
)
#: Siblings that end one another, and the containers beyond which they don't.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
}
#: Elements that never hold the article.
ASIDE = frozenset("head title nav footer aside form button dialog menu fieldset search".split())
#: Of them and header, those that may wrap the whole page.
WRAPPERS = frozenset("form fieldset dialog header".split())
#: Words in class, id, role or aria-label that speak against a part.
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu submenu breadcrumb breadcrumbs "
    "header masthead topbar footer bottombar sidebar sidebars aside rail cookie cookies consent gdpr notice notices notification alert popup modal overlay "
    "comment comments commentlist discussion discussions reactions disqus respond replies reply share sharing social related recommended recommendations newsletter subscribe signup login "
    "search searchbox pagination pager widget widgets toolbar skip copyright complementary contentinfo dialog hidden".split()
)
#: Parts that are the article by their name, whatever else they are called.
MAIN = frozenset(("article", "main"))
#: Elements that hold text of their own.
TEXT = frozenset("h1 h2 h3 h4 h5 h6 p li td th pre dd dt caption figcaption blockquote summary".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements between a block and the container that it goes with.
WITHIN = TEXT | frozenset("ul ol menu dl table thead tbody tfoot tr figure section details hgroup header".split())
PUNCTUATION = re.compile(r"[,.;:!?…。，、；：！？·«»\"“”()-]")
_TAG = re.compile(r"<!--(?:-?>|(.*?)(?:-->|--!>|$))|<([/]?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)(?:>|$)|<[!?/][^>]*(?:>|$)", re.S)
_WORDS = re.compile(r"""\b(class|id|role|aria-label|hidden|style)\b\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_HREF = re.compile(r"\bhref\s*=", re.I)
_PART = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"([a-z])([A-Z])")
#: Shares of the standard deviation and of the greatest of the fused ratios that a path must reach.
SHARE, LEAST = 0.5, 0.02
#: Characters and punctuation marks of a block at which its path is halfway to the greatest value.
PARAGRAPH, STOPS = 80, 1
#: The fused ratio of a part all of whose name speaks against it is multiplied by this; of one with half such a name, by its root.
MARKED = 0.05
#: What speaks against an article within an article.
NESTED = 0.99
#: A path's fused ratio is multiplied by the share of the page's text on its side of article and main, and this.
PRIOR = 0.25


def _against(tag: str, attributes: str, inside_main: bool) -> float:
    """How much speaks against a part: 2 for elements that never hold the article, else up to 1 by its names."""
    if tag in ASIDE or (tag == "header" and not inside_main):
        return 2.0
    if not attributes or tag in MAIN or tag in ("html", "body"):
        return 0.0
    most = 0.0
    for name, value in _WORDS.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden":
            if not value:
                return 2.0
        elif name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return 2.0
        elif name != "id" or not (tag in HEADINGS or (tag == "section" and inside_main)):  # those ids repeat a title
            for token in value.split() if name == "class" else [value]:
                words = _PART.findall(_CAMEL.sub(r"\1 \2", token).lower())
                hits = sum(w in ASIDE_WORDS and not (w == "header" and inside_main) for w in words)
                if hits:
                    most = max(most, hits / len(words))
    return most


class _Page:
    """A page as blocks (element, text, share of the text in links), and trees of its elements, paths and marks.

    Nodes are numbers in the order of their start, each with its parent's number; 0 is what
    holds the page. A path is the same for elements of equal tags on the way to them. A mark
    is an element that something speaks against; an element has the innermost mark around it.
    So a page takes time and memory in proportion to its length, however deep it is.
    """

    def __init__(self, html: str):
        self.blocks: list[tuple[int, str, float]] = []
        self.tag, self.parent, self.path, self.mark, self.holder = [""], [0], [0], [0], [0]
        self.path_parent, self.path_main, self._paths = [0], [False], {}
        self.mark_parent, self.against, self.wrapper, self.around_main = [0], [0.0], [False], [False]
        self._read(html)

    def _open(self, tag: str, parent: int, attributes: str) -> int:
        """A new element; its number."""
        path, main = self.path[parent], self.path_main[self.path[parent]]
        own = self._paths.setdefault((path, tag), len(self.path_parent))
        if own == len(self.path_parent):
            self.path_parent.append(path)
            self.path_main.append(main or tag in MAIN)
        mark = self.mark[parent]
        if tag in MAIN:
            self.around_main[mark] = True
        # an article within another is a comment on it, says HTML
        against = NESTED if tag == "article" and len(self.places[tag]) > 1 else _against(tag, attributes, main)
        if against:
            self.mark_parent.append(mark)
            self.against.append(against)
            self.wrapper.append(tag in WRAPPERS)
            self.around_main.append(False)
            mark = len(self.mark_parent) - 1
        # the first element around a block's own that isn't a part of running text
        self.holder.append(parent if parent and self.tag[parent] not in WITHIN else self.holder[parent])
        self.tag.append(tag)
        self.parent.append(parent)
        self.path.append(own)
        self.mark.append(mark)
        return len(self.tag) - 1

    def _read(self, html: str) -> None:
        opened: list[int] = []  # open elements, the outermost first
        self.places = places = defaultdict(list)  # the depths at which a tag is open, ascending
        endless: set[str] = set()  # names whose end tag doesn't come any more
        text, at, n = [], 0, len(html)
        link, linked = -1, 0  # depth of the open link, and characters of the block inside links

        def add(part):
            nonlocal linked
            text.append(part)
            if link >= 0:
                linked += len("".join(part.split()))

        def flush():
            nonlocal linked
            if text:
                whole = "".join(text)
                words = " ".join(unescape(whole).split())
                if words:
                    self.blocks.append((opened[-1] if opened else 0, words, linked / len("".join(whole.split())) if linked else 0.0))
                text.clear()
            linked = 0

        def pop_to(depth):
            nonlocal link
            while len(opened) > depth:
                places[self.tag[opened.pop()]].pop()
            if link > depth:  # a link without an end goes no further than the element that it is in
                link = -1

        while at < n:
            m = _TAG.search(html, at)
            if m is None:
                add(html[at:])
                break
            if m.start() > at:
                add(html[at : m.start()])
            at = m.end()
            tag = m[3]
            if tag is None:
                continue
            tag = tag.lower()
            if m[2]:
                if tag == "br":
                    text.append(" ")
                elif tag == "a":
                    link = -1
                elif tag not in INLINE:
                    flush()
                    if places.get(tag):
                        pop_to(places[tag][-1])
                continue
            if tag in RAW and not m[4].endswith("/"):
                close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
                at = close.end() if close else n
                continue
            plain = None
            if tag in PLAIN and tag not in endless:
                close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
                plain = (html[at : close.start()], close.end()) if close else None
                if not close:
                    endless.add(tag)
            if tag in INLINE:
                if tag == "br":
                    text.append(" ")
                elif tag == "a":
                    link = len(opened) if _HREF.search(m[4]) else -1
                continue
            flush()
            if tag in VOID:
                continue
            if tag in CLOSES_P and places.get("p"):
                pop_to(places["p"][-1])
            if tag in ENDS:
                ends, within = ENDS[tag]
                bound = max((places[t][-1] for t in within if places.get(t)), default=-1)
                ended = [places[t][k] for t in ends if places.get(t) and (k := bisect_right(places[t], bound)) < len(places[t])]
                if ended:
                    pop_to(min(ended))
            if places.get("head") and (tag == "body" or tag not in ("head", "html", "title", "template")):
                pop_to(places["head"][0])
            places[tag].append(len(opened))
            opened.append(self._open(tag, opened[-1] if opened else 0, m[4]))
            if plain:
                add(plain[0])
                at = plain[1]
                flush()
                pop_to(len(opened) - 1)
        flush()

    def weights(self) -> list[float]:
        """What speaks against the blocks of each mark.

        Nothing speaks against a part that holds an article or main, or most of the page's
        text; but by its whole name it does if an article elsewhere has text.
        """
        marks = range(1, len(self.mark_parent))
        up, never = self.mark_parent, [False]
        for r in marks:
            never.append(never[up[r]] or (self.against[r] > 1 and not self.wrapper[r]))
        held, total = [0.0] * len(up), 0.0
        for element, words, linked in self.blocks:
            if not never[self.mark[element]]:
                held[self.mark[element]] += len(words) * (1 - linked)
                total += len(words) * (1 - linked)
        for r in reversed(marks):
            held[up[r]] += held[r]
            self.around_main[up[r]] |= self.around_main[r]
        bad = [False]
        for r in marks:
            bad.append(bad[up[r]] or (self.against[r] >= 1 and not self.around_main[r]))
        named = any(self.path_main[self.path[e]] and not bad[self.mark[e]] for e, _, _ in self.blocks)
        most = [0.0]
        for r in marks:
            own = self.against[r]
            if not (own > 1 and not self.wrapper[r]) and (self.around_main[r] or (2 * held[r] > total and not (named and own >= 1))):
                own = 0.0
            most.append(max(own, most[up[r]]))
        return most


def main_text(html: str | None) -> str:
    """The page's main text: its content blocks joined by line ends; empty if there is none."""
    page = _Page(html or "")
    weights = page.weights()
    kept = [(page.path[e], e, text, weights[page.mark[e]], linked) for e, text, linked in page.blocks if weights[page.mark[e]] <= 1]
    if not kept:
        return ""
    chosen = content_paths([(p, text, against, linked) for p, _, text, against, linked in kept], page.path_parent, page.path_main)
    # headings under what holds content paths, and lists and short paths in it, go with them
    holders = {page.holder[e] for p, e, _, a, _ in kept if (p, a) in chosen}
    held = [0 in holders]
    for e in range(1, len(page.tag)):
        held.append(e in holders or held[page.parent[e]])

    def goes_along(e, against, linked):
        if page.tag[e] not in TEXT or against >= 1:
            return False
        if page.tag[e] in HEADINGS:
            return held[page.parent[e]]
        return linked <= 0.5 and page.holder[e] in holders

    return "\n".join(t for p, e, t, a, linked in kept if (p, a) in chosen or goes_along(e, a, linked))


def content_paths(blocks: list[tuple[int, str, float, float]], container: list[int], main: list[bool]) -> set[tuple[int, float]]:
    """The (path, what speaks against it) that are content, of blocks (path, text, what speaks against it, share in links)."""
    length: dict[tuple, float] = defaultdict(float)
    marks: dict[tuple, float] = defaultdict(float)
    nodes: dict[tuple, int] = defaultdict(int)
    for path, text, against, linked in blocks:
        length[path, against] += len(text) * (1 - linked)
        marks[path, against] += len(PUNCTUATION.findall(text)) * (1 - linked)
        nodes[path, against] += 1
    paths = list(nodes)
    weight = np.array([nodes[p] for p in paths], dtype=float)
    size = np.array([length[p] for p in paths])
    ratio = size / (size + PARAGRAPH * weight)
    stops = np.array([marks[p] + 1 for p in paths])
    stops = stops / (stops + STOPS * weight)
    siblings: dict[tuple, int] = {}
    group = np.array([siblings.setdefault((container[p], against), len(siblings)) for p, against in paths])
    fused = np.ones(len(paths))
    for values in (ratio, stops):
        smooth = np.bincount(group, values * weight) / np.bincount(group, weight)
        fused *= (values + smooth[group]) / 2
    against = np.array([a for _, a in paths])
    inside = np.array([main[p] for p, _ in paths])
    trusted = size * MARKED**against
    share = trusted[inside].sum() / trusted.sum() if size.any() else float(inside.any())
    fused *= MARKED**against * (PRIOR + np.where(inside, share, 1 - share))
    least = max(SHARE * fused.std(), LEAST * fused.max())
    return {p for p, f in zip(paths, fused) if f >= least}


def extract(pages: DataFrame) -> DataFrame:
    """The main text of every page: (page_id, url, text, n_chars).

    pages needs page_id, url and html; other columns are ignored. The whole html is read.
    Null and empty html and pages without an article give an empty text of 0 characters.
    Rows are independent, so repeated rows give repeated results and an empty table an empty
    one. White space inside a block, line breaks too, becomes one space.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                texts = [main_text(h) for h in part.column(2).to_pylist()]
                columns = [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    source = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return source.mapInArrow(run, f"page_id {dict(source.dtypes)['page_id']}, url string, text string, n_chars long")
