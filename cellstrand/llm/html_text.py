"""Main text of web pages by the maximum-scoring subsequence of their tokens.

A page is a sequence of words and tags.  Words score positive and tags negative, with
weights from labelled pages; a linear scan finds the contiguous region with the
largest sum.  A tag weighs the more the rarer it stands within content.  A word weighs
what the elements around it tell: each name (tag, class token, id, role) has a weight
by how its words were shared between content and the rest of the labelled pages, so
words of menus, adverts or footers score below zero, and less in a link.  The text of
the region is the main text, without the parts whose words score below zero and
without elements that are never read (scripts, styles, form fields).

Labelled pages are those that mark their content themselves with ``article`` or
``main``; a bounded sample of them is enough for a few dozen weights.  Names that the
sample knows little of start from `BOILERPLATE`, as if seen a few times.  A name counts
for nothing on an element that holds the page's content: a ``main``, the first
``article``, or more than half of the words of a page that has neither.  On a page
whose ``article`` or ``main`` holds a fair part of its words, words outside weigh
against the region, as they do in every labelled page, and tags inside weigh little.

Text is decoded and white space inside a block becomes one space; blocks are
joined in page order by one space.

Defined cases: null or empty html gives an empty text; broken, unclosed and
truncated markup is read as far as it goes; with no labelled page the default
weights hold; a page without a word that scores is empty; repeated rows get equal
results; time is linear in the page.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_sample, map_rows

# HTML elements by what they do to text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
PROSE = tuple("p br b i em strong span h1 h2 h3 h4 h5 h6 blockquote code pre sub sup".split())
PARTING = tuple("html body div section article main table".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
CLOSES_OWN = {"li": ("li", "p"), "tr": ("td", "th", "tr", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "option": ("option",)}
UNREAD = frozenset("head title script style noscript template svg math iframe object embed select textarea button input canvas audio video map datalist".split())
CONTENT = frozenset("article main".split())
#: Elements within the text whose end breaks no line.
QUIET = frozenset("svg select template".split())
#: Names of elements that are seldom content, as tags and as class tokens, ids or roles.
BOILERPLATE_TAGS = frozenset("nav menu footer aside form dialog header".split())
BOILERPLATE = frozenset(
    """ad ads adbox adslot adsense adsbygoogle advert adverts advertisement advertising sponsor sponsored promo promos promotion banner
    cookie cookies consent gdpr notice notices alert alerts popup modal overlay
    comment comments commentlist disqus respond replies sidebar complementary widget widgets
    nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager header masthead topbar footer contentinfo copyright
    share sharing social related recommended recommendations newsletter subscribe subscription signup login""".split()
)
#: First parts of a name that say that the rest is not meant, or is the text's own head.
NOT_MEANT = frozenset("no has with without hide category tag".split())
OWN_HEAD = frozenset("post entry article story content section".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|textarea|iframe)\b[^<>]*>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^<>]*>"
    r"|<(/?[a-zA-Z][^\s<>/]*)((?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*)>"
    r"|<(/?[a-zA-Z][^\s<>/]*)([^<>]*)>"
    r"|[^<]+|<",
    re.S | re.I,
)
_CONTENT = re.compile(r"<(?:article|main)\b", re.I)
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PARTS = re.compile(r"[-_]+")


@dataclass(frozen=True)
class ScoreWeights:
    """What a word or tag adds to a region's score."""

    tags: dict[str, float] = field(default_factory=lambda: dict.fromkeys(PROSE, -0.05) | dict.fromkeys(PARTING, -1.5))
    tag: float = -0.375
    word: float = 1.0
    link_word: float = 0.2
    #: Words outside the content element of a page whose content is marked.
    outside: float = -1.0
    #: What a tag inside of marked content weighs of its weight.
    inside_tag: float = 0.02
    #: By name of an element around a word; the lowest of them is added to the word's weight.
    names: dict[str, float] = field(default_factory=dict)
    boilerplate: float = -3.0


def _boilerplate(token: str) -> bool:
    """Whether a class token, id or role is one of the names, or begins or ends with one."""
    if token in BOILERPLATE:
        return True
    parts = [p for p in _PARTS.split(token) if p]
    if len(parts) < 2 or parts[0] in NOT_MEANT or (parts[0] in OWN_HEAD and parts[-1] == "header"):
        return False
    return parts[0] in BOILERPLATE or parts[-1] in BOILERPLATE


def _names(tag: str, attributes: str) -> list[str]:
    """The tag and, with a dot before, the class tokens, ids and roles."""
    out = [tag]
    if attributes:
        for m in _NAMED.finditer(attributes):
            out += ["." + t.lower() for t in (m[2] or m[3] or m[4] or "").split()]
    return out


def word_count(text: str) -> int:
    """Words, or an eighth of the characters where few spaces part them."""
    return max(len(text.split()), len(text.strip()) // 12)


class Page:
    """Tokens of a page in order, and its elements.

    ``tokens`` has (text or None for a tag, tag name, element); an element has a parent,
    names, the number of readable words in it and flags: unread, in content, in a link.
    """

    def __init__(self, page: str) -> None:
        self.tokens: list[tuple[str | None, str, int]] = []
        self.parent, self.names, self.words = [-1], [[]], [0]
        self.unread, self.content, self.link = [False], [False], [False]
        self.main, self.within = [], [False]
        stack: list[tuple[int, str, int]] = []  # element, tag, place of the next block element at or above
        open_: Counter = Counter()

        def close(to: int) -> None:
            while len(stack) > to:
                element, tag, _ = stack.pop()
                open_[tag] -= 1
                self.words[self.parent[element]] += self.words[element]

        for m in _TOKEN.finditer(page):
            at = stack[-1][0] if stack else 0
            name = m[2] or m[4]
            if name is None:
                body = m[0]
                if body[0] != "<" or body == "<":
                    self.tokens.append((body, "", at))
                    if not self.unread[at]:
                        self.words[at] += word_count(body)
                continue
            name = name.lower()
            attributes = m[3] or m[5] or ""
            if name[0] == "/":
                name = name[1:]
                if open_[name]:
                    k = len(stack) - 1
                    while stack[k][1] != name:
                        k -= 1
                    close(k)
                at = stack[-1][0] if stack else 0
                if name not in QUIET:
                    self.tokens.append((None, name, at))
                continue
            ends = CLOSES_OWN.get(name) or (("p",) if name in CLOSES_P else ())
            while ends and stack and (k := stack[-1][2]) >= 0 and stack[k][1] in ends:
                last = stack[k][1] == name
                close(k)
                if last:
                    break
            at = stack[-1][0] if stack else 0
            element = len(self.parent)
            self.parent.append(at)
            self.names.append(_names(name, attributes))
            self.words.append(0)
            self.unread.append(self.unread[at] or name in UNREAD)
            self.content.append(self.content[at] or name in CONTENT)
            self.link.append(self.link[at] or name == "a")
            self.within.append(self.within[at] or name == "main")
            if name in CONTENT and not self.unread[at]:
                self.main.append(element)
            self.tokens.append((None, name, element))
            if name not in VOID and not attributes.endswith("/"):
                open_[name] += 1
                stack.append((element, name, len(stack) if name not in INLINE else stack[-1][2] if stack else -1))
        close(0)

    def holders(self) -> set[int]:
        """Elements whose names tell nothing, as they hold the content: each ``main`` and the
        first ``article`` (the first in ``main``, if any) with all around them; on a page
        without either, those with more than half of the words."""
        mains = [e for e in self.main if self.names[e][0] == "main"]
        articles = [e for e in self.main if self.names[e][0] == "article"]
        inner = [e for e in articles if self.within[e]]
        found: set[int] = set()
        for e in [*mains, *(inner or articles)[:1]]:
            while e > 0 and e not in found:
                found.add(e)
                e = self.parent[e]
        if not self.main:
            found.update(e for e in range(1, len(self.parent)) if 2 * self.words[e] > self.words[0])
        return found


def _seldom(name: str) -> bool:
    """Whether a name (see `_names`) is one of those that are seldom content."""
    return _boilerplate(name[1:]) if name[0] == "." else name in BOILERPLATE_TAGS


def _telling(names: list[str]) -> list[str]:
    """The names that words are weighed by: not tags that may hold anything."""
    return [n for n in names if n[0] == "." or n in BOILERPLATE_TAGS]


def _lowest(found: Page, weights: ScoreWeights) -> list[float]:
    """For each element the lowest weight of a name on it or around it, 0 at most.

    Within an ``article`` or ``main`` only names of `BOILERPLATE` weigh: others that were
    seen outside only, so far, may well be there.
    """
    holders = found.holders()
    seldom: dict[str, bool] = {}
    out = [0.0] * len(found.parent)
    for e in range(1, len(out)):
        lowest, names = out[found.parent[e]], found.names[e]
        inside = found.content[e]
        if e not in holders and names[0] not in ("html", "body") and not (names[0] == "header" and inside):
            for n in _telling(names):
                if n not in seldom:
                    seldom[n] = _seldom(n)
                if seldom[n] or not inside:
                    lowest = min(lowest, weights.names.get(n, weights.boilerplate if seldom[n] else 0.0))
        out[e] = lowest
    return out


def scored(page: str | None, weights: ScoreWeights = ScoreWeights()) -> list[tuple[str | None, str, float]]:
    """The tokens that are read: (text or None for a tag, tag name, score)."""
    found = Page(page or "")
    lowest = _lowest(found, weights)
    counts = [0, 0]  # readable words outside and inside of marked content
    sizes = []
    for text, _, e in found.tokens:
        n = word_count(text) if text is not None and not found.unread[e] else 0
        sizes.append(n)
        if n and lowest[e] >= 0:
            counts[found.content[e]] += n
    marked = counts[1] > 0 and 3 * counts[1] >= counts[0]
    out = []
    for (text, tag, e), n in zip(found.tokens, sizes, strict=True):
        if found.unread[e]:
            if text is None and tag not in QUIET:
                out.append((None, tag, 0.0))
            continue
        inside = marked and found.content[e]
        if text is None:
            weight = weights.tags.get(tag, weights.tag)
            out.append((None, tag, weight * weights.inside_tag if inside else weight))
            continue
        if inside and lowest[e] < 0:  # an advert within the content parts nothing
            continue
        each = weights.outside if marked and not found.content[e] else weights.link_word if found.link[e] else weights.word
        out.append((text, "", n * (each + lowest[e])))
    return out


def extract(page: str | None, weights: ScoreWeights = ScoreWeights()) -> str:
    """The main text of a page."""
    read = scored(page, weights)
    best = total = 0.0
    begin = first = last = 0
    for k, (_, _, score) in enumerate(read):
        total += score
        if total <= 0:
            total, begin = 0.0, k + 1
        elif total > best:
            best, first, last = total, begin, k + 1
    out = []
    for text, tag, score in read[first:last]:
        if text is None:
            if tag not in INLINE:
                out.append(" ")
        elif score >= 0:
            out.append(text)
    return " ".join(html.unescape("".join(out)).split())


def page_counts(page: str | None) -> tuple[Counter, Counter]:
    """Of a labelled page: (tag, in content?) counts, words as ``#word`` and ``#link``, and
    (name, in content?) counts of the words under each name; empty if it has no label."""
    found = Page(page or "")
    tags: Counter = Counter()
    names: Counter = Counter()
    if not found.main:
        return tags, names
    holders = found.holders()
    under: list[frozenset[str]] = [frozenset()]
    for e in range(1, len(found.parent)):
        up = under[found.parent[e]]
        under.append(up if e in holders else up.union(_telling(found.names[e])))
    for text, tag, e in found.tokens:
        if found.unread[e]:
            continue
        inside = found.content[e]
        if text is None:
            tags[tag, inside] += 1
        elif n := word_count(text):
            tags["#link" if found.link[e] else "#word", inside] += n
            for name in under[e]:
                names[name, inside] += n
    return tags, names


_LABELS = re.compile(r"<(/?)(?:article|main)\b", re.I)
SCALES = (1.5, 3.0, 4.5, 6.0)


def unlabelled(page: str) -> str:
    """A page with ``div`` for ``article`` and ``main``, and without classes, ids and roles."""
    return _NAMED.sub("", _LABELS.sub(r"<\1div", page))


def likeness(found: str, wanted: str) -> float:
    """F1 of the words of two texts."""
    a, b = Counter(found.split()), Counter(wanted.split())
    n = a.total() + b.total()
    return 2 * (a & b).total() / n if n else 1.0


def fit(df: DataFrame, id_col: str = "page_id", html_col: str = "html", sample_pages: int = 400, trial_pages: int = 100) -> ScoreWeights:
    """Weights from at most ``sample_pages`` labelled pages: those with the smallest id hash.

    How much tags weigh against words is the first of `SCALES` with which the pages,
    their labels taken off, come nearest to what the labels say, over ``trial_pages``.
    """
    tags: Counter = Counter()
    names: Counter = Counter()
    rows = hash_sample(df.select(id_col, html_col), id_col, sample_pages, F.col(html_col).rlike(r"(?i)<(article|main)\b")).collect()
    for r in rows:
        one, two = page_counts(r[1])
        tags.update(one)
        names.update(two)
    if not tags:
        return ScoreWeights()
    tried = [weights_of(tags, names, scale) for scale in SCALES]
    trials = [(unlabelled(r[1]), extract(r[1], tried[0])) for r in rows[:trial_pages]]
    return max(tried, key=lambda w: round(sum(likeness(extract(page, w), wanted) for page, wanted in trials), 6))


def weights_of(tags: Counter, names: Counter, scale: float = SCALES[0]) -> ScoreWeights:
    """A tag weighs by its share outside content, smoothed towards a quarter.

    A name weighs the logarithm of the odds of content among its words over those of
    all words, between -3 and 0, as if it had been seen in 20 words of average odds more,
    or, if it is one of `BOILERPLATE`, in 200 words outside.
    """
    share = lambda name: (tags[name, False] + 0.5) / (tags[name, True] + tags[name, False] + 2)
    seen = {n for n, _ in tags if n[0] != "#"}
    inside, outside = (1 + tags["#word", x] + tags["#link", x] for x in (True, False))
    known = {}
    for name in {n for n, _ in names}:
        prior = (0.1, 200.0) if _seldom(name) else (20 * inside / (inside + outside), 20 * outside / (inside + outside))
        odds = math.log((names[name, True] + prior[0]) / (names[name, False] + prior[1])) - math.log(inside / outside)
        known[name] = min(0.0, max(-3.0, odds))
    return ScoreWeights(
        tags={n: -scale * share(n) - 0.001 for n in seen},
        tag=-scale / 4,
        word=max(0.2, 1 - share("#word")),
        link_word=max(0.1, 0.5 - share("#link")),
        names=known,
    )


def main_text(df: DataFrame, weights: ScoreWeights, html_col: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Per page: the columns to keep and ``text``, its main text."""

    def work():
        def step(columns):
            *kept, pages = columns
            return dict(zip(keep, kept, strict=True)) | {"text": [extract(p, weights) for p in pages]}

        return step

    rows = df.select(*keep, F.col(html_col).cast("string"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1])
    return map_rows(rows, work, f"{kinds}, text string")
