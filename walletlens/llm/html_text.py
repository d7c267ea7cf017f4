"""Main text of web pages by tree scoring.

A page is cut into blocks, the runs of text between block-level tags. Each block passes points, one
plus its commas plus its length, discounted by the share of its letters inside links, to the element
that holds it and, thinning out, to that element's ancestors. The best container is kept, widened to
the ``article`` or ``main`` around it, together with siblings that score well themselves. Without
such an element, siblings are also kept for their own text: sentences with few links, lists, tables
and code without links, and headings above what is kept; where all siblings are kept, the same is
done one level up. Elements
that are never article text (navigation, headers, footers, sidebars, notices, adverts, forms,
scripts, comments), by tag, role or class, are left out before scoring and from the result.

The kept blocks are joined in page order by line breaks, with character references decoded and white
space within a block turned into single spaces. Tags left open, cut off or closed twice are repaired
as browsers do in the cases that matter here. Every page is processed whole, by itself.

Null, empty or blank html, and pages without text: an empty text. Html without any tag: its text.
Null url or id, repeated rows: kept as they are. Very long pages: one is in memory at a time with its
batch. Empty table: no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*)(>|\Z)|<[!?/][^>]*(?:>|\Z)|<(?:[a-zA-Z][^>]*)\Z""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")

#: HTML element kinds.
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option optgroup p pre section select "
    "summary table tbody td tfoot th thead tr ul".split()
)
_EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg".split())
#: A start tag of the left ends an open element of the right, up to the nearest of the bounds.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: Elements that hold no article text.
_LEFT_OUT = frozenset(
    "aside button canvas datalist dialog dir fieldset footer form head input label legend menu nav object optgroup "
    "option select".split()
)
_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
#: First or last words of classes and ids that are hardly ever article text, and of those that may be.
_BAD_WORDS = frozenset(
    "ad ads adsense advert advertisement adverts adslot alert aside banner breadcrumb breadcrumbs captcha comment "
    "commentlist comments consent cookie cookies copyright cta disqus footer gdpr header login masthead menu modal nav "
    "navbar navigation newsletter notice notification outbrain pager pagination paywall popup promo promoted promotion "
    "replies reply respond share sharebar sharing sidebar signup skip sponsor sponsored subscribe subscription taboola "
    "toolbar topbar widget".split()
)
_DOUBTFUL_WORDS = frozenset("byline discussion feedback recommended recommendations related responses search social".split())
_BAD, _DOUBTFUL = 0.02, 0.5
_ENOUGH = 0.5
_GOOD_WORDS = frozenset("article body content entry main page post story text".split())
_LAYOUT = frozenset("has have no not is with without".split())
_SPLIT_NAME = re.compile(r"[^a-zA-Z0-9]+|(?<=[a-z])(?=[A-Z])")

_PARAGRAPHS = frozenset("blockquote caption dd dt figcaption h1 h2 h3 h4 h5 h6 li p pre summary td th".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Kept beside the best container if they hold no links.
_LINKLESS = frozenset("dl ol pre table ul".split())
_SENTENCE = re.compile(r"""[.!?\u2026\u3002\uff01\uff1f]["'\u201d\u2019)\]]*(?:\s|\Z)""")
_RIGHTS = re.compile(r"\u00a9|\bcopyright\b|\ball rights reserved\b", re.I)
#: Longer blocks need no sentence mark and are no mere note of rights.
_LONG = 80
_BONUS = {"article": 25.0, "main": 20.0}
_LEVELS = 5


class _Page:
    """Elements and blocks of one page. An element is an index into the lists; 0 is the page itself."""

    def __init__(self) -> None:
        self.tag = [""]
        self.parent = [0]
        self.out = [False]
        self.factor = [1.0]
        self.bonus = [0.0]
        self.blocks: list[tuple[int, str, int]] = []  # element, text, letters inside links
        self.stack = [0]
        self.open: dict[str, int] = {}
        self.pieces: list[str] = []
        self.linked = 0

    def text(self, raw: str) -> None:
        if raw and not self.out[self.stack[-1]]:
            raw = html.unescape(raw) if "&" in raw else raw
            self.pieces.append(raw)
            if self.open.get("a"):
                self.linked += len(raw.strip())

    def end_block(self) -> None:
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            if text:
                self.blocks.append((self._holder(), text, self.linked))
            self.pieces, self.linked = [], 0

    def _holder(self) -> int:
        """The nearest open block element."""
        return next((e for e in reversed(self.stack) if self.tag[e] in _BLOCKS), 0)

    def _pop(self) -> None:
        tag = self.tag[self.stack.pop()]
        self.open[tag] -= 1

    def _pop_to(self, tag: str) -> None:
        while self.tag[self.stack[-1]] != tag:
            self._pop()
        self._pop()

    def start(self, tag: str, attributes: str, closed: bool) -> None:
        if tag in _BLOCKS:
            self.end_block()
            if self.open.get("p"):
                self._pop_to("p")
            ended, bounds = _ENDS.get(tag, ((), ()))
            if any(self.open.get(x) for x in ended):
                for depth in range(len(self.stack) - 1, 0, -1):
                    name = self.tag[self.stack[depth]]
                    if name in bounds:
                        break
                    if name in ended:
                        del_to = len(self.stack) - depth
                        for _ in range(del_to):
                            self._pop()
                        break
        elif tag == "br":
            self.text(" ")
        if tag in _EMPTY:
            return
        above = self.stack[-1]
        inside_article, inside_main = bool(self.open.get("article")), bool(self.open.get("main"))
        judged = attributes or tag in _SPECIAL
        out, factor, bonus = _judge(tag, attributes, inside_article, inside_main) if judged else (False, 1.0, 0.0)
        self.tag.append(tag)
        self.parent.append(above)
        self.out.append(self.out[above] or out)
        self.factor.append(factor)
        self.bonus.append(bonus)
        if not (closed and tag not in _BLOCKS):
            self.stack.append(len(self.tag) - 1)
            self.open[tag] = self.open.get(tag, 0) + 1

    def end(self, tag: str) -> None:
        if tag in _BLOCKS:
            self.end_block()
        elif tag == "br":
            self.text(" ")
        if self.open.get(tag):
            self._pop_to(tag)


_SPECIAL = _LEFT_OUT | frozenset(_BONUS) | {"header"}


def _judge(tag: str, attributes: str, inside_article: bool, inside_main: bool) -> tuple[bool, float, float]:
    """Whether an element is left out, the weight of its name, and its points before any text."""
    named = (inside_article or inside_main) and (tag == "section" or tag in _HEADINGS)  # ids of these name topics
    factor, bonus = 1.0, _BONUS.get(tag, 0.0)
    if tag in ("html", "body", "article", "main"):
        return False, factor, bonus
    if tag in _LEFT_OUT or (tag == "header" and not inside_article):
        return True, factor, bonus
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True, factor, bonus
        if name == "role" and value.lower() in _ROLES:
            return True, factor, bonus
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True, factor, bonus
        if name in ("class", "id"):
            for token in html.unescape(value).split():
                words = [word.lower() for word in _SPLIT_NAME.split(token) if word]
                if not words or _LAYOUT.intersection(words):
                    continue
                if not ((words[-1] == "header" and inside_article) or (name == "id" and named)):
                    if _BAD_WORDS.intersection((words[0], words[-1])):
                        factor = min(factor, _BAD)
                    elif _DOUBTFUL_WORDS.intersection((words[0], words[-1])):
                        factor = min(factor, _DOUBTFUL)
                if _GOOD_WORDS.intersection(words):
                    bonus = max(bonus, 10.0)
    return False, factor, bonus


def _read(source: str) -> _Page:
    page = _Page()
    at, size = 0, len(source)
    while at < size:
        found = _TOKEN.search(source, at)
        if found is None:
            page.text(source[at:])
            break
        page.text(source[at : found.start()])
        at = found.end()
        if not found[2] or not found[4]:
            continue
        tag = found[2].lower()
        if found[1]:
            page.end(tag)
        elif tag in _RAW:
            if tag not in ("svg", "noscript", "template") or not found[3].rstrip().endswith("/"):
                close = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(source, at)
                at = size if close is None else source.find(">", close.start()) + 1 or size
        else:
            page.start(tag, found[3], found[3].rstrip().endswith("/"))
    page.end_block()
    return page


def main_text(source: str | None) -> str:
    """The article of a page, one block a line."""
    page = _read(source or "")
    if not page.blocks:
        return ""
    count = len(page.tag)
    points, length, linked = [0.0] * count, [0] * count, [0] * count
    worths, texts = [0.0] * count, [0] * count
    weight = [1.0] * count
    for element in range(1, count):
        weight[element] = weight[page.parent[element]] * page.factor[element]
    for element, text, in_links in page.blocks:
        plain = 1 - min(1.0, in_links / len(text))
        worth = (1 + text.count(",") + min(len(text) / 100, 3.0)) * plain
        worths[element] += worth
        texts[element] += 1
        worth *= weight[element]
        if weight[element] > _BAD:
            length[element] += len(text)
            linked[element] += in_links
        holder = page.parent[element] if page.tag[element] in _PARAGRAPHS else element
        for level in range(_LEVELS):
            points[holder] += worth / (1 + level)
            if not holder:
                break
            holder = page.parent[holder]
    for element in range(count - 1, 0, -1):  # children come after their parents
        length[page.parent[element]] += length[element]
        linked[page.parent[element]] += linked[element]
        worths[page.parent[element]] += worths[element]
        texts[page.parent[element]] += texts[element]
    poor = [page.factor[e] < 1 and worths[e] * page.factor[e] < _ENOUGH * texts[e] for e in range(count)]

    def score(element: int) -> float:
        plain = 1 - min(1.0, linked[element] / max(1, length[element]))
        return (points[element] + page.bonus[element]) * plain if points[element] else 0.0

    holders = [e for e in range(1, count) if points[e] and not page.out[e] and weight[e] > _BAD]
    holders = [e for e in holders if page.tag[e] not in ("html", "body")]
    holders = [e for e in holders if page.tag[e] not in _PARAGRAPHS or page.tag[e] in ("td", "blockquote")]
    best = max(holders, key=lambda e: (score(e), -e), default=0)
    above, around = best, 0
    while above:
        if page.tag[above] == "article" or (page.tag[above] == "main" and not around):
            around = above
        above = page.parent[above]
    best = around or best
    kept = {best}
    for element in range(1, count):
        if page.parent[element] == page.parent[best] and best and not page.out[element] and not poor[element]:
            dense = linked[element] / max(1, length[element])
            if dense < 0.3 and score(element) >= max(10.0, 0.2 * score(best)):
                kept.add(element)
    loose = 0
    if best and not around:
        kept |= _beside(page, best, length, linked)
        loose = page.parent[best]
    inside = [False] * count
    for element in range(count):
        inside[element] = element in kept or (element > 0 and inside[page.parent[element]] and not poor[element])
    return "\n".join(
        text
        for element, text, in_links in page.blocks
        if inside[element] or (element == loose != 0 and in_links < 0.3 * len(text) and _reads_as_text(text))
    )


def _reads_as_text(text: str) -> bool:
    return len(text) > _LONG or (_SENTENCE.search(text) is not None and _RIGHTS.search(text) is None)


def _beside(page: _Page, best: int, length: list[int], linked: list[int]) -> set[int]:
    """Elements around ``best`` that are kept for their own text, nearest first."""
    children: dict[int, list[int]] = {}
    reads, heads, plain = ([False] * len(page.tag) for _ in range(3))
    for element, text, in_links in page.blocks:
        reads[element] = reads[element] or (in_links < 0.3 * len(text) and _reads_as_text(text))
        heads[element] = heads[element] or page.tag[element] in _HEADINGS
        plain[element] = plain[element] or (page.tag[element] == "p" and not in_links and not _RIGHTS.search(text))
    for element in range(len(page.tag) - 1, 0, -1):  # children come after their parents
        reads[page.parent[element]] |= reads[element]
        heads[page.parent[element]] |= heads[element]
        plain[page.parent[element]] |= plain[element]
        if length[element] and not page.out[element]:
            children.setdefault(page.parent[element], []).append(element)

    kept: set[int] = set()
    level = best
    while level and page.tag[level] not in ("html", "body"):
        above = page.parent[level]
        follows = False  # whether what comes next, headings aside, is kept
        whole = True
        for element in children.get(above, []):  # from the last to the first
            if element == level:
                follows = True
                continue
            dense = linked[element] / length[element]
            if page.tag[element] in _HEADINGS:
                keep = follows and dense < 0.3
            else:
                section = heads[element] and plain[element]  # a heading and a paragraph without links
                linkless = page.tag[element] in _LINKLESS and not linked[element]
                keep = dense < 0.3 and page.factor[element] == 1 and (reads[element] or section or linkless)
                follows = keep
            whole = whole and keep
            if keep:
                kept.add(element)
        if not whole:
            break
        level = above
    return kept


@F.arrow_udf(StringType())
def _extract(pages: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in pages:
        yield pa.array([main_text(page) for page in batch.to_pylist()], pa.string())


def extract(html_column: Column | str) -> Column:
    """The main text of a column of html; never null."""
    return _extract(html_column)


def page_texts(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars (code points)."""
    found = pages.select("page_id", "url", extract("html").alias("text"))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))
