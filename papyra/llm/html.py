"""Main text of web pages: flat text blocks classified by a decision tree.

A page becomes a flat list of text blocks (text between block-level tags). A block's features are its word count, its
link density, the same two of the blocks before and after it, and four flags that its open elements give: inside the
article or main element, outside it on a page that has one, inside elements of a kind or name that pages use for
boilerplate (menus, headers, footers, sidebars, notices, adverts, forms, comments; by element, role, or a word of class
or id), and heading. The tree is grown, by Gini impurity, on the blocks of the small labelled pages below and then
applied to every block. Where the page names its parts, the flags lead; where it names nothing, word counts and link
densities of the block and its neighbours decide. Scripts, styles and markup never become blocks.

Unclosed paragraphs, missing end tags and truncated pages are read as browsers do in these respects: a block tag ends
the block before it, an end tag closes what is open down to its element, text or an element that cannot stand in a head
closes an open head. Character references are decoded. The time is in proportion to the page, whatever its nesting.

Defined results: null, empty or text-free html gives an empty text; white space inside a block (ASCII and other Unicode
space) becomes one space; repeated pages are read alike; an empty table has no rows; other columns of pages are kept,
columns `text` and `n_chars` are replaced.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyra.llm.common import read

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)", re.S)
_LOOSE = re.compile(r"</?[a-zA-Z][^>]*(?:>|\Z)", re.S)
_ATTR = re.compile(r"(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_SKIP = {"script", "style", "noscript", "template", "svg", "head", "iframe", "object", "canvas", "select", "textarea", "button"}
#: What may stand in a head; anything else closes it.
_HEAD = {"base", "basefont", "bgsound", "link", "meta", "title", "noscript", "noframes", "style", "script", "template", "head"}
_RAW = {"script", "style", "textarea", "title", "iframe", "noscript"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_P_ENDS = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "pre", "section", "table", "ul", "figure", "details"}
_BOILER_TAGS = {"nav", "footer", "aside", "form", "menu", "dialog"}
_BOILER_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu"}
#: Words of class and id names of boilerplate, and beginnings of such words.
_BOILER_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "promo", "promotion", "sponsor", "sponsored", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "popup", "modal", "newsletter", "subscribe", "signup", "share", "sharing", "social", "related", "recommended", "breadcrumb", "breadcrumbs", "pagination", "pager", "comment", "comments", "respond", "disqus", "form", "search", "login", "toolbar", "widget", "copyright", "legal", "disclaimer", "skip"}
_BOILER_STEMS = ("advert", "comment", "cookie", "breadcrumb", "newsletter", "promo", "sponsor", "subscri", "disclaim", "popup", "consent", "recommend")
#: Words that also name the frames around an article ("with-sidebar"): an article inside is an article still.
_LAYOUT_WORDS = {"nav", "navbar", "navigation", "menu", "header", "footer", "sidebar", "side", "topbar", "masthead"}
_WORDS = re.compile(r"[a-z0-9]+")
_SPACE = re.compile(r"\s+")


@dataclass
class Block:
    text: str
    words: int
    links: float
    article: bool
    boiler: bool
    heading: bool


class _Element:
    __slots__ = ("article", "boiler", "heading", "layout", "link", "name", "skip")

    def __init__(self, name: str, parent: _Element | None, attrs: str) -> None:
        self.name = name
        up = parent
        self.article = bool(up and up.article) or name in ("article", "main")
        self.skip = bool(up and up.skip) or name in _SKIP
        self.link = bool(up and up.link) or name == "a"
        self.heading = bool(up and up.heading) or (len(name) == 2 and name[0] == "h" and name[1] in "123456")
        boiler = name in _BOILER_TAGS or (name == "header" and not self.article)
        self.layout = bool(up and up.layout) and name not in ("article", "main")
        if attrs and not boiler:
            for m in _ATTR.finditer(attrs):
                kind, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
                if kind in ("class", "id"):
                    if name not in ("body", "html"):
                        words = _WORDS.findall(value)
                        boiler |= any(w.startswith(_BOILER_STEMS) for w in words) or (name not in ("article", "main") and not _BOILER_WORDS.isdisjoint(words))
                        if not self.article:
                            self.layout |= not _LAYOUT_WORDS.isdisjoint(words)
                        elif name not in ("article", "main"):  # an article's own header holds its title
                            boiler |= not _LAYOUT_WORDS.difference(("header", "masthead")).isdisjoint(words)
                elif kind == "role":
                    boiler |= value in _BOILER_ROLES
                    if value in ("main", "article"):
                        self.article, self.layout = True, False
                elif (kind == "hidden" and value != "false") or value == "true":
                    self.skip = True
        self.boiler = bool(up and up.boiler) or boiler


class _Stack:
    """Open elements, with the places of each name and of what is not inline, so that no end tag has to look for its element."""

    def __init__(self) -> None:
        self.items = [_Element("#root", None, "")]
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    @property
    def top(self) -> _Element:
        return self.items[-1]

    def push(self, name: str, attrs: str) -> None:
        at = len(self.items)
        self.items.append(_Element(name, self.items[-1], attrs))
        self.places.setdefault(name, []).append(at)
        if name not in _INLINE:
            self.blocks.append(at)

    def cut(self, at: int) -> None:
        """Closes the element at this place and all inside it."""
        while len(self.items) > at:
            e = self.items.pop()
            self.places[e.name].pop()
            if e.name not in _INLINE:
                self.blocks.pop()

    def close(self, name: str, inline: bool) -> None:
        if at := self.places.get(name):
            if not inline or not self.blocks or self.blocks[-1] <= at[-1]:  # a stray inline end tag does not close blocks
                self.cut(at[-1])

    def shut(self, names: set[str]) -> None:
        """Closes the innermost open block if it is one of these."""
        if self.blocks and self.items[self.blocks[-1]].name in names:
            self.cut(self.blocks[-1])


def blocks(page: str | None) -> list[Block]:
    """Text blocks in page order."""
    if not page:
        return []
    out: list[Block] = []
    stack, parts, linked = _Stack(), [], 0

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = _SPACE.sub(" ", "".join(parts)).strip()
            if text:
                n = text.count(" ") + 1
                top = stack.top
                out.append(Block(text, n, min(1.0, linked / n), top.article, top.boiler or top.layout, top.heading))
            parts, linked = [], 0

    def leave_head() -> None:
        while stack.top.name == "head":
            stack.cut(len(stack.items) - 1)

    def say(raw: str) -> None:
        nonlocal linked
        if stack.top.name == "head" and raw.strip(" \t\n\f\r"):
            leave_head()
        if raw and not stack.top.skip:
            text = _html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if stack.top.link:
                linked += len(text.split())

    at, end = 0, len(page)
    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            say(page[at:])
            break
        m = _TOKEN.match(page, lt)
        m = m or _LOOSE.match(page, lt)
        if not m:
            say(page[at : lt + 1])
            at = lt + 1
            continue
        say(page[at:lt])
        at = m.end()
        if m.re is _LOOSE:
            g = re.match(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)", m[0])
            close, name, attrs = g[1], g[2].lower(), ""
        elif not m[2]:
            continue
        else:
            close, name, attrs = m[1], m[2].lower(), m[3]
        inline = name in _INLINE or name in _SKIP  # what is skipped inside a sentence does not end its block
        if not inline:
            flush()
        if close:
            stack.close(name, inline)
            continue
        if name not in _HEAD:
            leave_head()
        if name in _VOID:
            continue
        shuts = _CLOSES.get(name, ()) if name != "p" and name not in _P_ENDS else {"p"}
        if shuts:
            stack.shut(shuts)
        stack.push(name, attrs)
        if attrs.endswith("/") and name not in _RAW:
            stack.cut(len(stack.items) - 1)
        elif name in _RAW:
            stop = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)
            if not stack.top.skip and name != "title":
                say(page[at : stop.start() if stop else end])
            stack.cut(len(stack.items) - 1)
            at = stop.end() if stop else end
    flush()
    return out


FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "article", "outside", "boiler", "heading")
#: The labelled pages: markup, in which {n} stands for n words, and for each text block 1 if it is main text. The first
#: ones name their parts; the others are told by words and links.
LABELLED = (
    ("<nav><ul><li><a>{1}</a><li><a>{1}</a><li><a>{2}</a></ul></nav><div class=ad>{9}</div><article><h1>{8}</h1><p>{60}</p><p>{2}</p><p>{120}</p></article><footer>{12}</footer>", "000011110"),
    ("<header><a>{2}</a></header><nav><a>{3}</a></nav><main><h1>{11}</h1><p>{1}</p><section class=comments><p>{30}</p></section><p>{44} <a>{9}</a></p></main><footer>{7} <a>{3}</a></footer>", "0011010"),
    ("<div class=cookie-notice><p>{24}</p><div><a>{1}</a></div></div><article><h2>{6}</h2><p><a>{4}</a></p><p>{200}</p><p>{3}</p><div class=comments><p>{40}</p><p>{55}</p></div></article><footer>{6}</footer>", "001111000"),
    ("<aside><p>{60} <a>{6}</a></p></aside><article><p>{3}</p></article><div>{5}</div>", "010"),
    ("<nav><a>{2}</a></nav><article><p>{90}</p><p>{25}</p></article><section><p>{80}</p><p>{33}</p><p>{9}</p></section>", "011000"),
    ("<article><h1>{7}</h1><ul><li><a>{3}</a> {2}</li><li><a>{2}</a></li></ul><p>{14}</p><form><p>{15}</p></form><div class=related-posts><h3>{4}</h3><p>{70}</p></div></article><footer><a>{1}</a></footer>", "11110000"),
    ("<nav><a>{1}</a></nav><div class=ad>{6}</div><article><h1>{7}</h1><p>{1}</p><p>{1}</p><p>{9}</p><p>{1}</p><p>{40}</p><p>{2}</p><p>{1}</p>", "0011111111"),
    ("<article><h1>{5}</h1><p>{1}</p></article>", "11"),
    ("<main><h1>{4}</h1><nav><ul><li><a>{2}</a><li><a>{3}</a></ul></nav><p>{30}</p><div class=share><a>{1}</a></div><p><a>{5}</a></p><aside><a>{4}</a></aside></main>", "1001010"),
    ("<header>{3}</header><main><p>{4}</p></main><footer><a>{1}</a></footer>", "010"),
    ("<article><h1>{2}</h1><p>{8}</p><p><a>{2}</a></p><p>{1}</p></article><nav><a>{1}</a></nav><footer>{2}</footer>", "111100"),
    ("<nav><a>{2}</a></nav><h1>{6}</h1><p>{45}</p><p>{3}</p><p>{66}</p><aside>{40}</aside><footer>{30}</footer>", "0111100"),
    ("<div><a>{2}</a></div><div><a>{1}</a> <a>{1}</a></div><h1>{7}</h1><p>{50}</p><p>{30} <a>{3}</a></p><p>{80}</p><div>{1} <a>{5}</a></div><div><a>{2}</a></div>", "00111100"),
    ("<div><a>{2}</a></div><div>{3} <a>{6}</a></div><p>{14}</p><p>{3}</p><p>{70}</p><div>{3} <a>{7}</a></div><div><a>{3}</a></div>", "0011100"),
    ("<p>{20}</p><p>{5}</p><p>{45}</p>", "111"),
    ("<h1>{6}</h1><p>{80}</p><p>{70}</p><p>{38}</p>", "1111"),
    ("<p>{4}</p><p>{2} <a>{1}</a></p><div>{1}</div>", "111"),
    ("<p>{2}</p><p>{3}</p>", "11"),
    ("<div><a>{2}</a></div><h1>{7}</h1><p>{62}</p><p>{30}</p><div><a>{4}</a></div>", "01110"),
    ("<h2>{9}</h2><p>{19}</p><div><a>{2}</a></div><div>{9}</div>", "1100"),
    ("<p>{1}</p>", "1"),
    ("<div><a>{2}</a></div><h1>{6}</h1><p>{40}</p><p>{90}</p><p>{26}</p>", "01111"),
    ("<nav><a>{2}</a></nav><article><p>{40}</p><p>{6}</p><p>{90}</p><p>{3}</p></article>", "01111"),
    ("<ul><li><a>{1}</a><li><a>{1}</a><li><a>{1}</a><li><a>{2}</a></ul><h2>{9}</h2><p>{33}</p><p>{1}</p><p>{61} <a>{4}</a></p><p>{28}</p><div>{6}</div><div><a>{2}</a> <a>{2}</a></div>", "00001111100"),
    ("<div><a>{1}</a></div><div>{3}</div><div><a>{2}</a></div><h1>{6}</h1><p>{25}</p><p>{40}</p><p>{18}</p><div>{8}</div>", "00011110"),
    ("<div><a>{3}</a></div><p>{35}</p><p>{4}</p><p>{52}</p><p>{22}</p><div>{5} <a>{1}</a></div>", "011110"),
    ("<div><a>{5}</a></div><div>{4} <a>{8}</a></div><div><a>{6}</a></div><div><a>{7}</a></div>", "0000"),
    ("<table><tr><td><a>{1}</a><td><a>{1}</a></tr></table><h1>{5}</h1><p>{110}</p><ul><li>{6}<li>{7}<li>{5}</ul><p>{90}</p><div><a>{3}</a></div><div>{10}</div>", "0011111100"),
    ("<div>{4}</div><div><a>{1}</a></div><div><a>{2}</a></div><h1>{8}</h1><p>{19}</p><p>{75}</p><p>{31}</p><div>{7}</div><div><a>{1}</a></div>", "000111100"),
    ("<div>{2}</div><div><a>{1}</a></div><p>{64}</p><p>{12}</p><p>{47}</p><div>{6}</div>", "001110"),
)


def filled(markup: str) -> str:
    """{n} becomes n words."""
    return re.sub(r"\{(\d+)\}", lambda m: " ".join(["word"] * int(m[1])), markup)


def features(found: list[Block]) -> list[tuple]:
    """FEATURES of each block of a page."""
    none = Block("", 0, 0.0, False, False, False)
    framed = any(b.article for b in found)
    return [
        (b.words, b.links, a.words, a.links, c.words, c.links, b.article, framed and not b.article, b.boiler, b.heading)
        for a, b, c in zip([none, *found], found, [*found[1:], none], strict=False)
    ]


def rows(pages) -> list[tuple]:
    """FEATURES and label of every block of labelled pages."""
    out = []
    for markup, labels in pages:
        x = features(blocks(filled(markup)))
        out += [(*f, int(label)) for f, label in zip(x, labels, strict=True)]
    return out


def grow(found: list[tuple], depth: int = 10) -> tuple:
    """A binary tree as nested (feature, threshold, low side, high side); leaves are True or False. Splits lower the Gini
    impurity most; ties go to the earlier feature and the smaller threshold."""
    good = sum(r[-1] for r in found)
    if depth == 0 or good in (0, len(found)):
        return 2 * good >= len(found)
    best = None
    for f in range(len(FEATURES)):
        values = sorted({r[f] for r in found})
        for a, b in zip(values, values[1:], strict=False):
            cut = (a + b) / 2
            low, high = [r for r in found if r[f] <= cut], [r for r in found if r[f] > cut]
            impurity = sum(2 * s * (1 - s) * len(x) for x in (low, high) for s in [sum(r[-1] for r in x) / len(x)])
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, cut, low, high)
    if best is None:
        return 2 * good >= len(found)
    return best[1], best[2], grow(best[3], depth - 1), grow(best[4], depth - 1)


TREE = grow(rows(LABELLED))


def is_main(tree, x: tuple) -> bool:
    while not isinstance(tree, bool):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


def main_text(page: str | None, tree=TREE) -> str:
    """Blocks that the tree takes for main text, in page order, joined by a line feed."""
    found = blocks(page)
    return "\n".join(b.text for b, x in zip(found, features(found), strict=True) if is_main(tree, x))


@F.pandas_udf(T.StringType())
def _extract(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in pages:
        yield batch.map(main_text, na_action=None)


def extracted(pages: DataFrame) -> DataFrame:
    """pages (html, ...) with `text` and `n_chars` added, in place of columns of those names."""
    return pages.withColumn("text", _extract(F.col("html").cast("string"))).withColumn("n_chars", F.length("text").cast("long"))


def op6_block_tree_html(spark, sf_dir: str) -> DataFrame:
    return extracted(read(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
