"""Main text of web pages by composite text density.

The density of an element is its characters a tag, lowered by the links among them (densities()).
The element whose children's densities have the largest sum holds the main text; what else is at
least as dense as the least dense element on its path to the body belongs to it, and so do articles and paragraphs
beside it (main()).

Density cannot tell some boilerplate from prose: a reader's comment is as dense as an article. Marks
are a prior for that: elements whose tag, role or whole class or id token names boilerplate have density
0 and leave no text; of articles only those marked as remarks or adverts. An element that holds most of the text is
not marked unless an article, main or h1 stands outside it.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import per_text, table, whole_text, with_texts

BATCH_CHARS = 4 << 20
# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter output picture progress q ruby rp rt s samp small span strike strong sub sup time tt u var wbr br".split())
TEXTLESS = frozenset("head title script style noscript template select option textarea input iframe object embed svg canvas button".split())
BOILERPLATE = frozenset("nav header footer aside form dialog menu fieldset".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Where an implied end tag looks no further up.
SCOPE = frozenset("html body table ul ol dl td th article section main div nav aside header footer form blockquote template".split())
#: Class, id and role say nothing of these.
UNMARKED = frozenset("html body main article p h1 h2 h3 h4 h5 h6 blockquote pre table tr td th tbody thead dl dt dd figure".split())
LANDMARKS = frozenset("article main h1".split())
#: Blocks of prose that go with the main text beside them.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure".split())
# Words of class, id and role that mark boilerplate, and words that say no more beside them.
MARKERS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs "
    "header masthead footer sidebar aside complementary contentinfo cookie cookies consent gdpr notice notices alert alerts popup modal dialog newsletter subscribe "
    "subscription signup login share sharing social related recommended comment comments reply replies disqus widget search copyright pagination pager toolbar".split()
)
REMARKS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion comment comments reply replies disqus".split())
BESIDE = frozenset("site page top bottom left right main primary secondary box list area block bar wrap wrapper container slot section links items item form thread posts post articles buttons message 1 2 3 4".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)|</[^>]*(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>][^\s=/>]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for t in RAW}


@lru_cache(maxsize=1 << 16)
def names_boilerplate(token: str) -> bool:
    """Whether a whole class, id or role token is made of marking words and words that say no more."""
    found = [w for w in re.split("[-_]+", token.lower()) if w]
    return all(w in MARKERS or w in BESIDE for w in found) and not MARKERS.isdisjoint(found)


@lru_cache(maxsize=1 << 16)
def _read(attributes: str) -> tuple[bool, bool, bool]:
    """(hidden, boilerplate, remark) of a tag's attributes: the attribute hidden, and whether class, id or role names boilerplate, and such as an article element may be."""
    hidden, tokens = False, []
    for name, value in _ATTRIBUTE.findall(attributes):
        name = name.lower()
        hidden = hidden or name == "hidden"
        if name in ("class", "id", "role"):
            tokens += [token for token in value.strip("\"'").split() if names_boilerplate(token)]
    return hidden, bool(tokens), any(not REMARKS.isdisjoint(re.split("[-_]+", token.lower())) for token in tokens)


class Page:
    """The elements of a page in document order, with what each one's subtree holds.

    chars are all characters but white space, tags the elements below, link_chars and link_tags those in links.
    """

    def __init__(self, source: str):
        self.tag, self.parent, self.mark, self.named, self.textless = ["#root"], [-1], [False], [False], [False]
        self.own, self.body = [0], 0
        #: (element, text) in page order; element -1 is a boundary between blocks.
        self.events: list[tuple[int, str]] = []
        self._parse(source)
        n = len(self.tag)
        self.end = list(range(1, n + 1))
        self.chars, self.tags, self.link_chars, self.link_tags, landmarks = list(self.own), [0] * n, [0] * n, [0] * n, [0] * n
        for i in range(n - 1, 0, -1):
            p, link = self.parent[i], self.tag[i] == "a"
            self.end[p] = max(self.end[p], self.end[i])
            landmarks[i] += self.tag[i] in LANDMARKS
            landmarks[p] += landmarks[i]
            self.chars[p] += self.chars[i]
            self.link_chars[i] = self.chars[i] if link else self.link_chars[i]
            self.link_chars[p] += self.link_chars[i]
            if not self.textless[i]:
                self.tags[p] += self.tags[i] + 1
                self.link_tags[p] += self.link_tags[i] + link
        self.dropped = [False] * n
        for i in range(1, n):
            most = 2 * self.chars[i] > self.chars[0] and landmarks[i] == landmarks[0]
            self.dropped[i] = self.dropped[self.parent[i]] or self.textless[i] or (self.mark[i] and not most)

    def _text(self, text: str, i: int) -> None:
        if text and not self.textless[i]:
            text = html.unescape(text) if "&" in text else text
            self.events.append((i, text))
            self.own[i] += sum(map(len, text.split()))

    def _parse(self, source: str) -> None:
        stack, at, boundary = [0], 0, (-1, "")
        #: depths of the open elements by tag, of those an implied end tag stops at, and of blocks
        open_, scopes, blocks = defaultdict(list), [0], [0]

        def close(depth: int) -> None:
            while len(stack) > depth:
                tag = self.tag[stack.pop()]
                open_[tag].pop()
                for kept, depths in ((tag in SCOPE, scopes), (tag not in INLINE, blocks)):
                    if kept:
                        depths.pop()

        while m := _TOKEN.search(source, at):
            if m.start() > at:
                self._text(source[at : m.start()], stack[-1])
            at = m.end()
            slash, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not name or (m[2] is None and not m[0].endswith(">")):
                continue
            tag = name.lower()
            if tag == "br":
                self._text(" ", stack[-1])
                continue
            inline = tag in INLINE
            if not inline:
                self.events.append(boundary)
            if slash:
                if open_[tag] and not (inline and blocks[-1] > open_[tag][-1]):
                    close(open_[tag][-1])
                continue
            if tag in ("html", "body") and open_[tag]:
                continue
            if not inline:
                last = max([open_[t][-1] for t in CLOSES.get(tag, ("p",)) if open_[t]], default=0)
                if last and last >= scopes[-1]:
                    close(last)
            i, p, depth = len(self.tag), stack[-1], len(stack)
            self.tag.append(tag)
            self.parent.append(p)
            self.own.append(0)
            hidden, named, remark = _read(attributes) if attributes else (False, False, False)
            self.mark.append(tag in BOILERPLATE or (remark if tag == "article" else named and tag not in UNMARKED))
            self.named.append(named)
            self.textless.append(self.textless[p] or tag in TEXTLESS or hidden)
            if tag == "body" and not self.body:
                self.body = i
            if tag in RAW:
                end = _RAW_END[tag].search(source, at)
                self._text(source[at : end.start() if end else len(source)], i)
                at = end.end() if end else len(source)
            elif tag not in VOID and not (attributes.endswith("/") and tag in ("svg", "path", "use")):
                stack.append(i)
                open_[tag].append(depth)
                if tag in SCOPE:
                    scopes.append(depth)
                if not inline:
                    blocks.append(depth)
        self._text(source[at:], stack[-1])

    def densities(self) -> list[float]:
        """The composite text density of every element, 0 for marked ones and those without text.

        C / T * ln(C * T / (LC * LT)) / ln(ln(C * LC / (C - LC) + C * LC_body / C_body + e)), where C
        characters and T tags are an element's, LC and LT those of links, and counts of 0 are read as 1.
        """
        share = self.link_chars[self.body] / max(1, self.chars[self.body])
        return [0.0 if gone else density(c, t, lc, lt, share) for c, t, lc, lt, gone in zip(self.chars, self.tags, self.link_chars, self.link_tags, self.dropped, strict=True)]

    def main(self) -> list[int]:
        """The elements that hold the main text, as a list; a negative number -i - 1 is the own text of element i.

        First the element below the body with the largest sum of its children's densities, the outermost
        of equals. The threshold is the least density on the path from it to the body, the body included; every element
        beside the path, and the own text of every element on it, that is as dense belongs to the main text.
        Less dense elements do, unless most of their text is links or their class, id or role names boilerplate: an h1 beside the
        path, an article element anywhere, and blocks of prose with the same parent as the first element.
        """
        dense = self.densities()
        sums = [0.0] * len(dense)
        for i in range(1, len(dense)):
            sums[self.parent[i]] += dense[i]
        best = max((i for i in range(self.body, self.end[self.body]) if not self.dropped[i]), key=lambda i: (sums[i], -i), default=self.body)
        path = [best]
        while path[-1] > self.body:
            path.append(self.parent[path[-1]])
        threshold, on_path, found = min(dense[i] for i in path), set(path), [best]
        share = self.link_chars[self.body] / max(1, self.chars[self.body])
        for i in path[1:]:
            if self.own[i] and density(self.own[i], 0, 0, 0, share) >= threshold:
                found.append(-i - 1)
        for i in range(self.body + 1, self.end[self.body]):
            p = self.parent[i]
            if i in on_path or not dense[i] or best < i < self.end[best]:
                continue
            beside, plain = p in on_path, 2 * self.link_chars[i] < self.chars[i] and not self.named[i]
            if beside and (dense[i] >= threshold or self.tag[i] == "h1"):
                found.append(i)
            elif plain and (self.tag[i] == "article" or (beside and p == self.parent[best] and self.tag[i] in PROSE)):
                found.append(i)
        return found

    def text(self) -> str:
        found = set(self.main())
        whole = [False] * len(self.tag)
        for i in range(len(whole)):
            whole[i] = not self.dropped[i] and (i in found or (i > 0 and whole[self.parent[i]]))
        blocks, run = [], []
        for i, piece in self.events:
            if i < 0:
                if run:
                    blocks.append(" ".join("".join(run).split()))
                    run = []
            elif whole[i] or -i - 1 in found:
                run.append(piece)
        blocks.append(" ".join("".join(run).split()))
        return "\n".join(b for b in blocks if b)


def density(chars: int, tags: int, link_chars: int, link_tags: int, share: float) -> float:
    """The composite text density of an element with these counts; share is that of linked characters in the body."""
    if not chars:
        return 0.0
    t, lc, lt, plain = max(1, tags), max(1, link_chars), max(1, link_tags), max(1, chars - link_chars)
    return chars / t * math.log(max(1.0, chars * t / (lc * lt))) / math.log(math.log(chars * lc / plain + share * chars + math.e))


def main_text(source: str | None) -> str:
    return Page(source).text() if source else ""


def _extract(sources: list[str]) -> pd.DataFrame:
    return pd.DataFrame({"text": [main_text(h) for h in sources]})


def extract_pages(pages: DataFrame) -> DataFrame:
    """The main text of every page.

    Null or empty html has an empty text; broken markup is read as far as it goes, in time linear in
    the elements however deep they nest. Attributes are read one by one, so words in their values hide nothing. Of several article
    elements all are kept that no mark or majority of links speaks against. Repeated rows give repeated results; columns other than page_id, url and
    html are ignored; no rows give none.
    """
    found = with_texts(pages, [F.col("page_id").cast("long"), "url"], per_text(whole_text("html"), "text string", lambda: _extract, BATCH_CHARS))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op10_html_text": op10_html_text}
ORACLES: dict[str, str] = {}
