"""Whole texts of generated pages against plain recursion, and markup that once lost text."""

import math
import random

import pytest

from sparkloom.llm.html_text import BOILERPLATE, PROSE, main_text
from tests.llm.test_html import PROSE as LINES
from tests.llm.test_html import Tree, brute_density, measured

ARTICLE = f"<h1>T</h1>{LINES * 3}"


@pytest.mark.parametrize("opening", ['<p title="the hidden truth">', "<p title='class=\"ad\"'>", '<p data-x="a hidden b" lang=en>', "<p data-hidden=1>", '<p alt="x" title=" role=navigation ">'])
def test_attribute_values_hide_nothing(opening):
    assert "Kept line." in main_text(f"<body>{ARTICLE}{opening}Kept line.</p></body>")
    inside = opening.replace("<p", "<div", 1)
    assert main_text(f"<body>{inside}{ARTICLE}</div></body>") == main_text(f"<body><div>{ARTICLE}</div></body>") != ""


@pytest.mark.parametrize("opening", ["<div hidden>", "<div class=x hidden>", '<div hidden="">', "<div HIDDEN=until-found id=y>", '<div class="ad">', "<div class=ad>", "<div ID='comments'>", '<div title="ok" class="x advert">'])
def test_attributes_hide(opening):
    assert "gone" not in main_text(f"<body><article>{ARTICLE}{opening}gone</div></article></body>")


def test_two_articles():
    small = "<article><h1>First</h1><p>Only one line here.</p></article>"
    text = main_text(f"<body><nav><a href=1>m</a></nav>{small}<article>{ARTICLE}</article><footer>f</footer></body>")
    assert text.split("\n")[:3] == ["First", "Only one line here.", "T"]
    apart = main_text(f"<body><div><div>{small}</div></div><div><article>{ARTICLE}</article></div><ul><li><a href=1>m</a></li></ul></body>")
    assert apart.split("\n")[:3] == ["First", "Only one line here.", "T"] and not apart.endswith("m")


def test_closing_paragraph():
    assert main_text(f"<body><nav><a href=1>m</a></nav><h1>T</h1><div>{LINES * 4}</div><p>The end.</p><p class=copyright>c</p><ul><li><a href=1>more</a></li></ul></body>").split("\n")[-1] == "The end."


def test_articles_of_readers():
    text = main_text(f"<body><article class='post'>{ARTICLE}</article><article class=comment>{LINES}mine</article><article id='comment-2'><p>yours</p></article><article class='ad'>buy</article></body>")
    assert text == main_text(f"<body><article>{ARTICLE}</article></body>")


class Plain:
    """The rules of the module by recursion over a tree of well-formed markup."""

    def __init__(self, source, marks):
        self.marks, self.order, self.up = marks, {}, {}
        tree = Tree()
        tree.feed(source)
        self.body = tree.root[1][0][1][0]
        self._walk(tree.root, None)
        total = measured(tree.root)[0]
        self.all = self._landmarks(tree.root)
        self.gone = set()
        self._drop(tree.root, False, total)

    def _walk(self, node, parent):
        self.up[id(node)] = parent
        self.order[id(node)] = (len(self.order), node)
        for child in node[1]:
            self._walk(child, node)

    def _landmarks(self, node):
        return (node[0] in ("article", "h1", "main")) + sum(map(self._landmarks, node[1]))

    def _drop(self, node, gone, total):
        most = 2 * measured(node)[0] > total and self._landmarks(node) == self.all
        gone = gone or (node[0] in BOILERPLATE and not most)
        if gone:
            self.gone.add(id(node))
        for child in node[1]:
            self._drop(child, gone, total)

    def dense(self, node):
        return 0.0 if id(node) in self.gone else brute_density(node, self.body)

    def found(self):
        nodes = [n for _, n in sorted(self.order.values(), key=lambda x: x[0])]
        below = lambda n, top: n is top or (self.up[id(n)] is not None and below(self.up[id(n)], top))
        inside = [n for n in nodes if below(n, self.body)]
        best = max((n for n in inside if id(n) not in self.gone), key=lambda n: (sum(self.dense(c) for c in n[1]), -self.order[id(n)][0]))
        path = [best]
        while path[-1] is not self.body:
            path.append(self.up[id(path[-1])])
        least, found = min(map(self.dense, path)), {id(best)}
        for n in inside:
            if any(n is p for p in path) or below(n, best) or not self.dense(n):
                continue
            beside, parent = any(self.up[id(n)] is p for p in path), self.up[id(best)]
            c, _, links, _ = measured(n)
            if beside and (self.dense(n) >= least or n[0] == "h1"):
                found.add(id(n))
            elif 2 * links < c and (n[0] == "article" or (beside and self.up[id(n)] is parent and n[0] in PROSE)):
                found.add(id(n))
        own = {id(p) for p in path[1:] if p[2].strip() and self._own(p) >= least}
        return found, own

    def _own(self, node):
        c, (bc, _, blc, _) = sum(not x.isspace() for x in node[2]), measured(self.body)
        return c * math.log(max(c, 1)) / math.log(math.log(c / max(c, 1) + blc / bc * c + math.e))

    def text(self):
        found, own = self.found()
        blocks = []

        def walk(node, whole):
            whole = (whole or id(node) in found) and id(node) not in self.gone
            if (whole or id(node) in own) and node[2].strip():
                blocks.append(" ".join(node[2].split()))
            for child in node[1]:
                walk(child, whole)

        walk(self.body, False)
        return sorted(blocks)


def generated(rng):
    """A well-formed page of blocks with text in leaves only, so that a block is a leaf's text."""
    words = lambda n: " ".join(rng.choice(("alpha", "be", "gamma", "d", "epsilon", "zeta", "eta")) for _ in range(n))

    def block(depth):
        kind = rng.random()
        if depth > 3 or kind < 0.5:
            tag = rng.choice(("p", "p", "p", "h1", "h2", "div", "blockquote", "article"))
            return f"<{tag}>{words(rng.choice((1, 2, 8, 40, 90)))}</{tag}>"
        if kind < 0.62:
            return f"<ul>{''.join(f'<li><a>{words(rng.randint(1, 4))}</a></li>' for _ in range(rng.randint(1, 6)))}</ul>"
        tag = rng.choice(("div", "div", "section", "article", "main", "nav", "aside", "footer", "header"))
        return f"<{tag}>{''.join(block(depth + 1) for _ in range(rng.randint(1, 5)))}</{tag}>"

    return f"<html><body>{''.join(block(0) for _ in range(rng.randint(1, 7)))}</body></html>"


def test_generated_pages_match_plain_recursion():
    rng, kept = random.Random(8), 0
    for _ in range(400):
        page = generated(rng)
        got = main_text(page)
        want = Plain(page, None).text()
        # a link is inline: its block is the item's text, which here is the link's alone
        assert sorted(filter(None, got.split("\n"))) == want, page
        kept += bool(want)
    assert kept > 300
