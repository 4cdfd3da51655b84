import math
import time
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import html_text
from sparkloom.llm.html_text import Page, main_text

PROSE = "<p>" + "Sentences that go on for a while, as prose does. " * 6 + "</p>"


class Tree(HTMLParser):
    """A plain tree of well-formed markup: [tag, children, own text]."""

    def __init__(self):
        super().__init__()
        self.root = ["#root", [], ""]
        self.stack = [self.root]

    def handle_starttag(self, tag, attrs):
        node = [tag, [], ""]
        self.stack[-1][1].append(node)
        self.stack.append(node)

    def handle_endtag(self, tag):
        self.stack.pop()

    def handle_data(self, data):
        self.stack[-1][2] += data


def measured(node):
    """(C, T, LC, LT) of a subtree, by plain recursion."""
    c, t, lc, lt = sum(not x.isspace() for x in node[2]), 0, 0, 0
    for child in node[1]:
        cc, ct, clc, clt = measured(child)
        c, t, lc, lt = c + cc, t + ct + 1, lc + clc, lt + clt + (child[0] == "a")
    return c, t, c if node[0] == "a" else lc, lt


def brute_density(node, body):
    c, t, lc, lt = measured(node)
    bc, _, blc, _ = measured(body)
    t, lc, lt, plain = max(t, 1), max(lc, 1), max(lt, 1), max(c - lc, 1)
    return c / t * math.log(max(c * t / (lc * lt), 1)) / math.log(math.log(c * lc / plain + blc / bc * c + math.e)) if c else 0.0


MADE = f"""<html><body><div><a href="1">one</a><a href="2">two links</a></div>
<div><span>x</span><div>{PROSE * 3}<p>See <a href="3">this</a> too.</p></div></div><div><p>A short line.</p></div><ul><li><a href="4">four</a></li></ul></body></html>"""


def test_densities_match_plain_recursion():
    tree = Tree()
    tree.feed(MADE)
    body = tree.root[1][0][1][0]
    flat = []

    def walk(node):
        flat.append(node)
        for child in node[1]:
            walk(child)

    walk(tree.root)
    page = Page(MADE)
    assert page.tag == [n[0] for n in flat]
    assert page.densities() == pytest.approx([brute_density(n, body) for n in flat])
    sums = [sum(brute_density(c, body) for c in n[1]) for n in flat]
    inside = [i for i in range(page.body, page.end[page.body])]
    assert page.main()[0] == max(inside, key=lambda i: (sums[i], -i))


def test_density_decides():
    """Nothing here is marked: links and a line without weight go, dense blocks stay."""
    text = main_text(MADE)
    assert text.count("as prose does") == 18 and "See this too." in text
    assert "two links" not in text and "short line" not in text and "four" not in text
    two = f"<body><ul><li><a href=1>a</a></li><li><a href=2>b</a></li></ul><div>{PROSE * 4}</div><section>{PROSE * 2}</section><div><a href=3>link</a> tail</div>"
    assert main_text(two).count("as prose does") == 36
    path = Page(two)
    assert len(path.main()) == 2  # the second block is as dense as the least dense element of the path


def test_threshold_of_the_path(monkeypatch):
    """With the largest density of the path for a threshold, the block beside it would be lost."""
    page = Page(f"<body><p>a</p><p>b</p><p>c</p><div>{PROSE * 4}</div><section>{PROSE}</section>")
    dense = page.densities()
    best, beside = page.tag.index("div"), page.tag.index("section")
    assert dense[page.body] <= dense[beside] < dense[best]
    assert page.main() == [best, beside]


@pytest.mark.parametrize("opening", ['<div class="content no-sidebar">', '<div id="page" class="site header-fixed">', '<div class="sidebar">', "<form action=x>", '<div class="menu-less">'])
def test_marks_do_not_take_the_article(opening):
    assert main_text(f"<body><nav><a href=1>m</a></nav>{opening}<h1>T</h1>{PROSE * 4}</div><footer>f</footer>").startswith("T\nSentences")


def test_nothing_is_lost_inside_an_article():
    inner = '<section id="related-work"><h2>Related</h2><p>x</p></section><div class="market-share"><p>share</p></div><p class="legal">legal</p><ul><li><a href=1>Chapter 1</a></li><li><a href=2>Chapter 2</a></li></ul>'
    assert main_text(f"<body><article><h1>T</h1>{PROSE}{inner}</article>").split("\n")[2:] == ["Related", "x", "share", "legal", "Chapter 1", "Chapter 2"]


@pytest.mark.parametrize("gone", ['<div class="ad">x</div>', '<div class="cookie-banner">x</div>', '<div id="comments"><p>x</p></div>', "<aside>x</aside>", "<div role=navigation>x</div>", "<div hidden>x</div>", '<ul class="share-buttons"><li>x</li></ul>', "<script>x</script>"])
def test_boilerplate_goes(gone):
    assert main_text(f"<body><article>{PROSE}{gone}</article>{gone}") == main_text(f"<body><article>{PROSE}</article>")


def test_deep_and_long_pages():
    began = time.time()
    n = 20_000
    assert main_text("<b>" * n + "x") == "x"
    assert main_text("<b>" * n + "<hr>" * n + "x") == "x"
    assert main_text("<div>" * n + "x</p>" + "</div>" * n) == "x"
    assert len(main_text(f"<article>{'<p>word &amp; word</p>' * n}</article>").split("\n")) == n
    assert time.time() - began < 20


def test_pages_table(spark):
    page = "<html><body><nav><a href=x>menu</a></nav><article><h1>T &amp; t</h1><p><b>Bold.<br><p>Two\n lines <a href=y>link</a></article><div class='ad'>buy</div><div id=comments>mine</div><footer>f</footer>"
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (3, "u", ""), (4, "u", "<p>broken <b"), (None, "u", "<p>no id")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit(7))
    got = sorted(((r.page_id, r.text, r.n_chars) for r in html_text.extract_pages(df).collect()), key=str)
    assert got == sorted([(1, "T & t\nBold.\nTwo lines link", 26), (2, "", 0), (3, "", 0), (3, "", 0), (4, "broken", 6), (None, "no id", 5)], key=str)
    assert html_text.extract_pages(df.limit(0)).count() == 0
