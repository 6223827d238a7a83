"""Main text of pages: the style tree against a plain version of its statistics, and what it alone removes."""

import math
import re
import time
from collections import Counter, defaultdict
from html import unescape

import pytest
from pyspark.sql import functions as F

from convspan.llm import pagetext

SF = "/root/testdata/sf0.001"
COLUMNS = "page_id long, url string, html string"
PAGE = """<html><head><title>T</title></head><body><nav><a>menu</a></nav><div class="ad">buy</div><article><h1>Head &amp; tail</h1><p>One<b>two</b> three
four<p>Five <script>x("</p>")</script>six<ul><li>a<li>b</ul><section class="comments"><p>c1</p></section><form><input></form></article><footer>f</footer></body></html>"""


def text_of(html, known=None):
    return pagetext.main_text(pagetext.parse(html), known)


def texts(frame):
    return {r.page_id: r.text for r in pagetext.extract_main_text(frame).collect()}


def plain_tree(pages):
    """host -> node -> (content, shape, weight) by counting every page's rows in a dictionary."""
    seen = Counter((host, *row) for host, html in pages for row in pagetext.statistics(html, host))
    every = Counter()
    for (_, *row), n in seen.items():
        every[tuple(row)] += n

    def share(counts, kind):
        held = [n for (k, _), n in counts.items() if k == kind]
        return math.exp(-sum(n * math.log(n) for n in held) / sum(held)) if held else None

    def by_node(counts):
        out = defaultdict(dict)
        for (*node, kind, value), n in counts.items():
            out[tuple(node)][kind, value] = n
        return {k: (share(c, pagetext.CONTENT), share(c, pagetext.SHAPE), c[pagetext.PAGES, 0] - 1) for k, c in out.items()}

    alike, out = by_node(every), {}
    for (host, node), (content, shape, pages_) in by_node(seen).items():
        content_, shape_, all_pages = alike[(node,)]
        other = min(all_pages, pagetext.OTHER_PAGES)
        if weight := pages_ + other:
            mixed = lambda a, b: None if a is None else (a * pages_ + b * other) / weight  # noqa: B023, E731
            out[host, node] = mixed(content, content_), mixed(shape, shape_), float(weight)
    return out


def article_of(html):
    """What the table's pages hold, by their article element."""
    inside = re.search(r"<article>(.*?)(</article>|$)", html, re.S)[1]
    blocks = [re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]*>", "", x))).strip() for x in re.split(r"</?(?:p|h1|li|ul|div)>|<br>", inside)]
    return "\n".join(x for x in blocks if x)


def unnamed(html):
    """A page of the table with elements that say nothing of what they are."""
    for tag in ("nav", "article", "footer"):
        html = html.replace(f"<{tag}>", f"<div class={tag[0]}>").replace(f"</{tag}>", "</div>")
    return html.replace('class="ad"', "class=x")


def test_main_text(spark):
    assert text_of(PAGE) == "Head & tail\nOnetwo three four\nFive six\na\nb"
    rows = [(k, f"http://h.example/{k}", f"<body><div><p>About our site</p></div><div class=x><p>story number {k} tells of {k * 7}</p></div></body>") for k in range(12)]
    rows += [(90, None, None), (91, "x", ""), (92, "http://h.example/0", rows[0][2]), (93, "http://one.example/", "plain < text & more")]
    got = {r.page_id: r for r in pagetext.extract_main_text(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert got[3].text == "story number 3 tells of 21" and got[3].n_chars == len(got[3].text)
    assert got[90].text == got[91].text == "" and got[0].text == got[92].text and got[93].text == "plain < text & more"
    assert pagetext.extract_main_text(spark.createDataFrame([], COLUMNS)).count() == 0


def test_style_tree_against_plain_counts(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select(pagetext.host_of().alias("host"), "html")
    want = plain_tree([(r.host, r.html) for r in pages.collect()])
    got = {(r.host, r.node): (r.content, r.shape, r.weight) for r in pagetext.style_tree(pages).collect()}
    assert got.keys() == want.keys()
    for key, values in want.items():
        assert all(a is b is None or abs(a - b) < 1e-9 for a, b in zip(values, got[key], strict=True))


def test_tree_alone_finds_the_article_of_table_pages(spark):
    """Pages whose elements do not say what they are: the tree removes every menu, advert and footer and keeps every article."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").collect()
    got = texts(spark.createDataFrame([(r.page_id, r.url, unnamed(r.html)) for r in pages], COLUMNS))
    assert all(got[r.page_id] == article_of(r.html) for r in pages)
    for r in pages[:50]:
        assert text_of(unnamed(r.html)) != article_of(r.html)


def test_style_tree_drops_what_a_site_repeats(spark):
    rows = [(k, f"http://h.example/{k}", f"<body><div class=top>About our site</div><div class=story>story number {k} tells of {k * 7}</div></body>") for k in range(40)]
    assert set(texts(spark.createDataFrame(rows, COLUMNS)).values()) == {f"story number {k} tells of {k * 7}" for k in range(40)}


def test_tags_are_a_prior(spark):
    """Teasers that are articles go if they are alike on all pages; a menu that is new on each of very many pages stays."""
    page = "<body><article class=teaser>read this too</article><div class=post>story {0} of {1}<p class=related>see {0}</p></div><nav>path {0}</nav></body>"
    rows = [(k, f"http://h.example/{k}", page.format(k, k * 7)) for k in range(1000)]
    got = texts(spark.createDataFrame(rows, COLUMNS))
    assert all(got[k] == f"story {k} of {k * 7}\nsee {k}\npath {k}" for k in range(1000))
    assert text_of(page.format(1, 7)) == "read this too\nstory 1 of 7\nsee 1"


def test_low_branches_inside_articles_go(spark):
    page = "<body><article><h1>title {0}</h1><p>story {0} of {1}</p><div class=box><p>All rights reserved</p></div></article></body>"
    rows = [(k, f"http://h.example/{k}", page.format(k, k * 7)) for k in range(3000)]
    got = texts(spark.createDataFrame(rows, COLUMNS))
    assert all(got[k] == f"title {k}\nstory {k} of {k * 7}" for k in range(3000))


@pytest.mark.parametrize("name", ["no-sidebar", "has-sidebar", "header-fixed", "layout-sidebar-left", "comments-open"])
def test_words_of_wrappers(name):
    for holder in ("article", "main"):
        for page in (
            f"<html class={name}><body><{holder}><p>story</p></{holder}></body></html>", f"<html><body class='x {name}'><{holder}><p>story</p></{holder}></body></html>",
            f"<body><div id={name}><div class={name}><{holder} class={name} id={name}><p>story</p></{holder}></div></div><div class=sidebar>other</div></body>",
        ):
            assert text_of(page) == "story"
    assert text_of(f"<html id={name}><body class={name}><p>story</p><div class=menu>other</div></body></html>") == "story"


def test_words_of_classes_are_a_prior(spark):
    page = "<body class=no-sidebar><div class=has-sidebar><div class=menu>site menu</div><div class=story>story {0} of {1}</div></div></body>"
    rows = [(k, f"http://h.example/{k}", page.format(k, k * 7)) for k in range(40)] + [(99, "http://few.example/", page.replace("story", "tale").format(1, 2) + "<p>few</p>")]
    got = texts(spark.createDataFrame(rows, COLUMNS))
    assert all(got[k] == f"story {k} of {k * 7}" for k in range(40))
    assert got[99] == "tale 1 of 2\nfew"


def test_pages_of_the_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = texts(pages)
    assert all(got[r.page_id] == article_of(r.html) for r in pages.collect())


def test_large_trees_are_joined_page_by_page(spark, monkeypatch):
    rows = [(k, f"http://h{k % 3}.example/{k}", f"<body><div class=top>Site {k % 3}</div><div class=story>story {k}</div></body>") for k in range(60)]
    frame = spark.createDataFrame([*rows, rows[0], (None, None, None)], COLUMNS)
    wanted = Counter(map(tuple, pagetext.extract_main_text(frame).collect()))
    monkeypatch.setattr(pagetext, "BROADCAST_NODES", 0)
    assert Counter(map(tuple, pagetext.extract_main_text(frame).collect())) == wanted


def test_odd_pages(spark):
    """Very long and very deep pages in little time; columns with the names that are used inside."""
    began = time.time()
    deep = "<div>" * 20_000 + "<b>" * 20_000 + "text" + "</i>" * 20_000 + "</b></div>" * 20_000
    assert text_of(deep) == "text"
    assert text_of("<b><div>" + "<i>" * 20_000 + "x" + "</b>" * 20_000) == "x"
    assert text_of("<article>" * 10_000 + "y" + "</article>" * 10_000) == "y"
    assert text_of("<p>" + "word " * 1_000_000) == ("word " * 1_000_000).strip()
    assert time.time() - began < 20
    frame = spark.createDataFrame([(1, "http://a.example/", "<p>one</p>")], COLUMNS)
    odd = frame.withColumns({c: F.lit(1) for c in ("host", "nodes", "node", "page", "text", "n_chars")})
    assert list(map(tuple, pagetext.extract_main_text(odd).collect())) == [(1, "http://a.example/", "one", 3)]
