"""Main text: pages whose text is known, the pages table against an independent parser, and odd input."""

import random
import re
from html.parser import HTMLParser

import pytest

from marketlake.llm import html
from marketlake.llm.queries import QUERIES

PAGES = {
    "template": ('<html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">Menu, item.</a>'
                 '</ul></nav><!-- ad --><div class="ad">Buy this, now.</div><article><h1>A title</h1><p><b>First &amp; foremost.<br>'
                 "<p>Second\n  one,&nbsp;here.</article><footer>&copy; x</footer></body></html>",
                 "A title\nFirst & foremost.\nSecond one, here."),
    "no article": ("<body><div id=top-menu><a>Home</a><a>News</a></div><div class=wrap><div class=post><h2>Head</h2>"
                   "<p>Long running text, with commas, and stops. It goes on, and on.</p><p>More of the text, as long as before. Yes.</p>"
                   "<p>Short.</p></div><div class='sideBar'><p>Other pages, to read.</p></div></div><div class='cookie-notice'>We use"
                   " cookies, a lot of them, on every page you read here.</div></body>",
                   "Head\nLong running text, with commas, and stops. It goes on, and on.\nMore of the text, as long as before. Yes.\nShort."),
    "comments": ("<main><article><p>Text.</p><section id=comments><article class=comment><p>I disagree, and say so at length."
                 "</p></article></section></article><form>Mail: <input></form><aside>Aside.</aside></main>", "Text."),
    "inline": ("<article><p>one<b>two</b> <i>three</i>\n<a href=x>four</a>.<p>five<ul><li>six<li>seven</ul></article>",
               "onetwo three four.\nfive\nsix\nseven"),
    "references": ("<article>&lt;b&gt; &#233;&#x1F600; &am &amp x &copy;</article>", "<b> é😀 &am & x ©"),
    "hidden": ("<article><p hidden>no<p style='display: none'>no<p aria-hidden=true>no<p>yes</article>", "yes"),
    "unclosed quote": ("<article><p class='x>one</p><p>two</p></article>", None),
    "no markup": ("just text,\n as it is", "just text, as it is"),
    "raw": ("<article><style>p{}</style><script>if (a<b) c()</script>text<template>t</template><svg><text>s</text></svg></article>", "text"),
    "only tags": ("<div><p></p></div>", ""),
    "broken": ("</p></div><<p><article", None),
}


STORY = "<p>A long story, with commas, and stops. It goes on.</p><p>Its second part, as long as the first. Yes.</p>"
TOLD = "A long story, with commas, and stops. It goes on.\nIts second part, as long as the first. Yes."


@pytest.mark.parametrize("opening", [
    '<div style="overflow:hidden">', '<div class="overflow-hidden">', '<div id="content" class="has-sidebar">', '<article class="no-comments">',
    '<article class="post category-social">', '<section id="discussion">', '<article><section id="discussion">', '<article><section id="related-work">',
    '<div class="share-enabled">', '<div data-hidden="x">', '<div class="content-with-sidebar">', '<div title="display:none">'])
def test_loose_names_drop_nothing(opening):
    assert html.main_text(f"<body>{opening}{STORY}</body>")[0] == TOLD
    beside = f"<body><article><p>Before it, some text.</p>{opening.replace('<article', '<div')}{STORY}</article></body>"
    assert html.main_text(beside)[0] == f"Before it, some text.\n{TOLD}"


def test_headings_and_links_are_not_asides():
    source = '<article><p>One, two. <a href="/the-hidden-cost">Three.</a></p><h2 id="related-work">Related work</h2><p>Four.</p></article>'
    assert html.main_text(source)[0] == "One, two. Three.\nRelated work\nFour."


def test_names_that_would_empty_the_page_are_overruled():
    assert html.main_text(f'<body><div class="widget">{STORY}</div><div class="menu"><a>Home</a><a>News</a></div></body>')[0] == TOLD
    assert html.main_text(f'<div class="widget"><div class="banner">{STORY}</div></div>')[0] == TOLD
    assert html.main_text("<nav>Home</nav><p hidden>no</p>")[0] == ""


@pytest.mark.parametrize("name", ["sidebar", "side-bar", "top-ad", "adSlot", "cookie-notice", "related-posts", "post comments"])
def test_names_of_asides_still_count(name):
    for attribute in ("class", "id"):
        assert html.main_text(f'<article>{STORY}<div {attribute}="{name}"><p>Other things, to read.</p></div></article>')[0] == TOLD


CARDS = "".join(f"<article><h3><a>Card {i}</a></h3></article>" for i in range(3))
SHORT = "<p>An intro, of one line, that is shorter.</p>"
CONTENT = {
    "teasers beside": (f"<body><div><h1>Head</h1>{STORY}</div><div>{CARDS}</div></body>", "Head\n" + TOLD),
    "teasers below": (f"<body><div><h1>Head</h1>{STORY}<div>{CARDS}</div></div></body>", "Head\n" + TOLD),
    "some in an article": (f"<body><div>{STORY}</div><article>{STORY}<h4>End</h4></article></body>", f"{TOLD}\n{TOLD}\nEnd"),
    "two sections": (f"<body><div class=x><section>{STORY}{STORY}</section><section>{STORY}</section></div></body>", "\n".join([TOLD] * 3)),
    "intro beside body": (f"<body><div><div>{SHORT}</div><div>{STORY}{STORY}</div></div></body>",
                          "\n".join(["An intro, of one line, that is shorter.", TOLD, TOLD])),
}


@pytest.mark.parametrize("case", CONTENT)
def test_every_content_node_is_kept(case):
    source, want = CONTENT[case]
    assert html.main_text(source)[0] == want


def test_all_text_on_content_paths_comes_out():
    r = random.Random(5)

    def tree(depth):
        tag = r.choice(["div", "section", "article", "div", "ul", "main"])
        parts = [tree(depth - 1) if depth and r.random() < 0.6 else f"<{(t := r.choice(['p', 'h2', 'p']))}>{' '.join(f'w{r.randrange(10**9)},' for _ in range(r.choice([1, 2, 30])))}</{t}>"
                 for _ in range(r.randint(1, 4))]
        return f"<{tag}>{''.join(parts)}</{tag}>"

    for _ in range(300):
        source = f"<body>{tree(4)}{tree(3)}</body>"
        got = html.main_text(source)[0]
        page = html._Page(source)
        ratios = html._ratios(page)
        assert all(" ".join(text.split()) in got for text, path, *_ in page.nodes if text.strip() and ratios[path][4])


@pytest.mark.parametrize("case", PAGES)
def test_known_pages(case):
    source, want = PAGES[case]
    got, paths = html.main_text(source, True)
    assert want is None or got == want
    assert all(p["nodes"] > 0 and p["chars"] >= p["nodes"] for p in paths)


def test_paths_tell_content_from_menus():
    menu = "".join(f"<div><span><a>Item {i}</a></span></div>" for i in range(20))
    source = f"<body>{menu}<div class=x><p>{'Words, and words. ' * 9}</p><p>{'Words, and words. ' * 9}</p></div></body>"
    text, paths = html.main_text(source, True)
    assert {p["path"]: p["content"] for p in paths} == {"body/div/span/a": False, "body/div/p": True}
    assert text == "\n".join(["Words, and words. " * 8 + "Words, and words."] * 2)


class Article(HTMLParser):
    """All text inside article, blocks split at h1 and p: enough for the pages table."""

    def __init__(self):
        super().__init__()
        self.inside, self.blocks = False, [""]

    def handle_starttag(self, tag, attrs):
        self.inside = self.inside or tag == "article"
        self.blocks += [""] if tag in ("h1", "p") else []

    def handle_endtag(self, tag):
        self.inside = self.inside and tag != "article"
        self.blocks += [""] if tag in ("h1", "p") else []

    def handle_data(self, data):
        self.blocks[-1] += data if self.inside else ""


def test_pages_table(spark, sf):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = QUERIES["op10_html_extraction"](spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        parser = Article()
        parser.feed(pages[r.page_id].html)
        parser.close()
        want = "\n".join(x for x in (" ".join(b.split()) for b in parser.blocks) if x)
        assert (r.text, r.url, r.n_chars) == (want, pages[r.page_id].url, len(want))


def test_odd_tables(spark):
    rows = [(None, None, "t", 1), (1, "", None, None), (1, "<p>x</p>", "a", 2), (1, "<p>x</p>", "a", 2),
            (2, "<div>" * 5_000 + "deep", "b", 3), (3, "<p>" + "long, text. " * 50_000, "c", 4)]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string, n_chars long")
    got = html.extract(pages, paths_col="paths")
    assert got.columns == ["page_id", "n_chars", "text", "paths"]
    assert sorted((r.page_id or 0, r.text[:20], len(r.text)) for r in got.collect()) == sorted([
        (0, "", 0), (1, "", 0), (1, "x", 1), (1, "x", 1), (2, "deep", 4), (3, "long, text. long, te", 599_999)])
    assert html.extract(pages.limit(0)).count() == 0


def test_no_shuffle(spark, sf):
    plan = QUERIES["op10_html_extraction"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange|Join", plan)
