"""Main text of web pages by tag-path ratios.

The text nodes of a page are grouped by their root-to-leaf tag path. A path's ratios are its text length and its
punctuation for each node on it: running text has long, punctuated nodes on few paths, menus have many short ones.
The ratios are laid along the page, smoothed, multiplied, and averaged back to paths; paths above the deviation of
the page are content paths. Content paths select content nodes: all article or main elements that hold some of their
text, and the smallest element around nearly all of what is in none. The main text is all text of the content nodes
outside menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments.

A page is one row and is worked on by itself, so pages need no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Container, Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from marketlake.llm.common import by_place

#: Comments, raw elements with their content, declarations, and tags; an unclosed quote does not swallow the page.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|textarea|iframe|svg|math|select|object|canvas)\b[^>]*+>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*+>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)>", re.S | re.I)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
_PUNCTUATION = re.compile(r"[.,;:!?…。、，；：！？]")

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby "
                   "s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements whose text is never main text.
ASIDE = frozenset("nav header footer aside form button fieldset menu dialog head title option datalist".split())
#: The same by a name of class, id or role: the whole of it, or its first or last word.
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation "
    "menu menubar breadcrumb breadcrumbs sidebar footer header masthead cookie cookies consent gdpr notice notices "
    "popup modal overlay newsletter subscribe subscription share sharing social comment comments disqus reply replies "
    "discussion related recommended widget complementary contentinfo search login signup pagination pager toolbar".split())
#: A name with one of these says what an element has, is about or how it is set, not what it is.
STATE_WORDS = frozenset("has no not non with without enabled disabled enable disable allow on off open closed layout free "
                        "category tag topic".split())
#: Aside words that also head sections of articles, and words that make a block of links or the like of them.
TOPICS = frozenset("discussion related recommended notice notices promotion advertising navigation search consent "
                   "subscription".split())
BLOCK_WORDS = frozenset("posts articles links stories pages items list box bar block widget wrapper container".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MAIN = frozenset(("article", "main"))
#: An element of the first kind ends an open element of the second, unless one of the third stands between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
}

SMOOTH = np.array([0.25, 0.5, 0.25])  # three nodes around each, by a bell
NEARLY = 0.95  # of the text on content paths outside articles, for the content node around it

ANALYSIS = pa.struct([("path", pa.string()), ("nodes", pa.int64()), ("chars", pa.int64()), ("punctuation", pa.int64()),
                      ("score", pa.float64()), ("content", pa.bool_())])


def _named(tag: str, kind: str, name: str, in_main: bool) -> bool:
    """Whether a name of class, id or role says that an element stands aside."""
    words = _WORD.findall(_CAMEL.sub(" ", name).lower())
    if not words or not STATE_WORDS.isdisjoint(words):
        return False
    if "".join(words) in ASIDE_WORDS:
        found = {"".join(words)}
    else:
        found = ASIDE_WORDS & {words[0], words[-1]} if tag != "article" else set()
    if not found:
        return False
    # The id of a section is mostly its heading, and so is what a part of an article is called.
    heads = kind == "id" and (in_main or tag == "section") or kind == "class" and in_main and tag == "section"
    return not (heads and found <= TOPICS and BLOCK_WORDS.isdisjoint(words))


def _aside(tag: str, attributes: str, in_main: bool = False) -> int:
    """Whether an element holds no main text: 2 by what it is or as it is hidden, 1 by its class, id or role, else 0."""
    if tag in ASIDE:
        return 2
    if not attributes or tag in ("html", "body", "main"):
        return 0
    named = 0
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "hidden" and value.lower() != "false" or name == "aria-hidden" and value.lower() == "true":
            return 2
        if name == "style" and _UNSEEN.search(value):
            return 2
        if name in ("class", "id", "role") and tag not in HEADINGS and not named:
            named = int(any(_named(tag, name, n, in_main) for n in value.split()))
    return named


class _Page:
    """The text nodes of a page in order, each with its path, its element, its block, and whether it stands aside.

    Aside is -1 for text that never is main text, the outermost element that stands aside by its name, or 0. Names of
    the elements in ``overruled`` do not count.
    """

    def __init__(self, html: str, overruled: Container[int] = ()):
        self.overruled = overruled
        self.paths: list[tuple[int, str]] = [(-1, "")]  # the path above, and the last tag
        self.parent: list[int] = [-1]  # of elements; element 0 is the page
        self.inline: list[bool] = [False]  # of elements
        self.main: list[int] = [0]  # of elements: the outermost article or main element around, or 0
        self.nodes: list[tuple[str, int, int, int, int]] = []  # text, path, element, block, aside
        self._read(html)

    def path(self, at: int) -> str:
        tags = []
        while at > 0:
            at, tag = self.paths[at]
            tags.append(tag)
        return "/".join(reversed(tags))

    def _read(self, html: str) -> None:
        known: dict[tuple[int, str], int] = {}
        stack = [("", 0, 0, 0)]  # tag, path, element, aside
        opened: dict[str, int] = {}
        block, at = 0, 0

        def leave(names: set[str], stops: set[str] | frozenset = frozenset()) -> None:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] in stops:
                    return
                if stack[depth][0] in names:
                    for gone, *_ in stack[depth:]:
                        opened[gone] -= 1
                    del stack[depth:]
                    return

        for m in _TOKEN.finditer(html):
            if m.start() > at and (text := html[at:m.start()]):
                _, path, element, aside = stack[-1]
                self.nodes.append((text, path, element, block, aside))
            at = m.end()
            tag = (m[3] or m[6] or "").lower()
            if not tag:
                continue
            if tag not in INLINE:
                block += 1
            elif tag == "br":
                _, path, element, aside = stack[-1]
                self.nodes.append((" ", path, element, block, aside))
            if m[2] or m[5]:
                if opened.get(tag):
                    leave({tag})
                continue
            if tag in VOID:
                continue
            if tag not in INLINE and opened.get("p"):
                leave({"p"}, {"td", "th", "li", "article", "section", "div"})
            if tag in ENDS and any(opened.get(x) for x in ENDS[tag][0]):
                leave(*ENDS[tag])
            attributes = m[4] or m[7] or ""
            _, path, element, aside = stack[-1]
            if (path, tag) not in known:
                known[path, tag] = len(self.paths)
                self.paths.append((path, tag))
            self.parent.append(element)
            self.inline.append(tag in INLINE)
            me = len(self.parent) - 1
            self.main.append(self.main[element] or (me if tag in MAIN or "articleBody" in attributes else 0))
            if aside >= 0 and (own := _aside(tag, attributes, self.main[element] > 0)):
                aside = -1 if own == 2 else aside or (0 if me in self.overruled else me)
            stack.append((tag, known[path, tag], me, aside))
            opened[tag] = opened.get(tag, 0) + 1
        if at < len(html):
            _, path, element, aside = stack[-1]
            self.nodes.append((html[at:], path, element, block, aside))


def _ratios(page: _Page, named: bool = False) -> dict[int, tuple[int, int, int, float, bool]]:
    """For each path with text outside asides: nodes, characters, punctuation, score, and whether it is content.

    With ``named`` also for text that stands aside by a name.
    """
    sums: dict[int, list[int]] = {}
    order = []
    for text, path, _, _, aside in page.nodes:
        if aside and not (named and aside > 0) or not (bare := text.strip()):
            continue
        s = sums.setdefault(path, [0, 0, 0])
        s[0] += 1
        s[1] += len(bare)
        s[2] += len(_PUNCTUATION.findall(bare))
        order.append(path)
    if not order:
        return {}
    names = {p: i for i, p in enumerate(sums)}
    along = np.array([names[p] for p in order])
    count, chars, marks = np.array([sums[p] for p in names], float).T
    smooth = [np.convolve(np.pad(x[along], 1, mode="edge"), SMOOTH, mode="valid") for x in (chars / count, marks / count)]
    fused = smooth[0] * (1 + smooth[1])
    score = np.bincount(along, fused, len(names)) / count
    limit = fused.std()
    return {p: (*sums[p], float(score[i]), bool(score[i] >= limit)) for p, i in names.items()}


def _content(page: _Page, ratios: dict) -> tuple[set[int], set[int]] | None:
    """The content nodes, elements that hold the main text, and elements in them that do not. None: all of the page.

    Every element with text on a content path is in a content node. Those in an article or main element are widened to
    all of it; of the others, the smallest element around nearly all of their text is one, without the articles in it
    that have no text on a content path, and what lies outside it goes by itself.
    """
    texts = [(path, element, len(text)) for text, path, element, _, aside in page.nodes if not aside and text.strip()]
    chosen = {p for p, r in ratios.items() if r[4]}
    held: set[int] = set()
    if not chosen:  # no path stands out: all articles, and the path with the highest score
        held = {page.main[e] for _, e, _ in texts if page.main[e]}
        if not held:
            return None
        chosen = {max(ratios, key=lambda p: ratios[p][3])}
    weight: dict[int, int] = {}
    for path, element, n in texts:
        if path not in chosen:
            continue
        if page.main[element]:
            held.add(page.main[element])
            continue
        while page.inline[element] and page.parent[element] > 0:
            element = page.parent[element]
        weight[element] = weight.get(element, 0) + n
    if not weight:
        return held, set()
    share = [0] * len(page.parent)
    for element in range(len(page.parent) - 1, -1, -1):  # children come after their parents
        share[element] += weight.get(element, 0)
        if element:
            share[page.parent[element]] += share[element]
    most = max(e for e, n in enumerate(share) if n >= NEARLY * share[0])
    above = {0}  # the page, and what holds a content node that is an article
    for element in held:
        while element and (element := page.parent[element]) not in above:
            above.add(element)
    # The siblings of an element that is itself a block of the text belong to it too.
    if weight.get(most) and page.parent[most] not in above:
        most = page.parent[most] if most else 0
    inside = [False] * len(page.parent)
    for element in range(len(page.parent)):
        inside[element] = element == most or element > 0 and inside[page.parent[element]]
    rest = {e for e in weight if not inside[e]}
    return held | {most} | rest, {m for m in page.main if m and m not in held}


def _empty(page: _Page) -> bool:
    """Whether names alone leave no text of the page."""
    found = {aside for text, _, _, _, aside in page.nodes if aside >= 0 and text.strip()}
    return bool(found) and 0 not in found


def _page(html: str) -> _Page:
    """The page; names that would leave nothing of it do not count where its content paths are."""
    page = _Page(html)
    if _empty(page):
        ratios = _ratios(page, named=True)
        page = _Page(html, {aside for text, path, _, _, aside in page.nodes if aside > 0 and text.strip() and ratios[path][4]})
        if _empty(page):  # names within names, or no path stands out
            page = _Page(html, range(len(page.parent)))
    return page


def main_text(html: str | None, with_paths: bool = False) -> tuple[str, list[dict] | None]:
    """The main text of a page, and if asked for what its tag paths say."""
    if not html:
        return "", [] if with_paths else None
    page = _page(html)
    ratios = _ratios(page)
    content = _content(page, ratios)
    inside = [False] * len(page.parent)
    for element in range(len(page.parent)):
        above = page.parent[element]
        inside[element] = content is None or element not in content[1] and (
            element in content[0] or (above >= 0 and inside[above]))
    blocks: dict[int, list[str]] = {}
    for text, _, element, block, aside in page.nodes:
        if not aside and inside[element]:
            blocks.setdefault(block, []).append(text)
    lines = [" ".join(unescape("".join(parts)).split()) for parts in blocks.values()]
    keys = [f.name for f in ANALYSIS]
    paths = [dict(zip(keys, (page.path(p), *r))) for p, r in ratios.items()] if with_paths else None
    return "\n".join(x for x in lines if x), paths


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text", paths_col: str | None = None) -> DataFrame:
    """``pages`` with the main text in ``text_col`` instead of the html.

    With ``paths_col`` also the tag paths of the page with their figures (path, nodes, chars, punctuation, score,
    content). Blocks are joined by a line feed, white space in a block becomes one blank, character references are
    decoded. A null or empty html gives the empty text, rows that repeat give the same text each, a page of any length is
    read whole. A column that has the name of a result is replaced, others may have any name.
    """
    rest = [f for f in pages.schema if f.name not in (html_col, text_col, paths_col)]
    fields = rest + [T.StructField(text_col, T.StringType(), False)]
    if paths_col:
        fields.append(T.StructField(paths_col, T.ArrayType(T.StructType([
            T.StructField("path", T.StringType()), T.StructField("nodes", T.LongType()),
            T.StructField("chars", T.LongType()), T.StructField("punctuation", T.LongType()),
            T.StructField("score", T.DoubleType()), T.StructField("content", T.BooleanType())]))))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(h, bool(paths_col)) for h in batch.column(0).to_pylist()]
            columns = batch.columns[1:] + [pa.array([t for t, _ in found], pa.string())]
            if paths_col:
                columns.append(pa.array([paths for _, paths in found], pa.list_(ANALYSIS)))
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return by_place(pages, [html_col, *(f.name for f in rest)]).mapInArrow(work, T.StructType(fields))
