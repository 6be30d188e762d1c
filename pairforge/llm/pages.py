"""Operator 8: main text of web pages by two passes of block rules."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import only, slices

# Frequent function words of the four languages of the corpus.
STOP_WORDS = frozenset(
    """a an and are as at be been but by for from had has have he her his if in into is it its not of on or she that
    the their there they this to was we were which who will with would you
    aber als am an auch auf aus bei das dass dem den der des die ein eine einem einen einer er es für hat ich im in ist
    man mit nach nicht noch oder sich sie sind über um und von war werden wie wird zu zum zur
    au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas plus pour
    que qui sa se ses son sont sur un une vous y à été être
    al con como de del el ella ellos en entre era es está esta este fue ha la las le lo los más me no nos o para pero por
    que se sin sobre su sus también un una y ya""".split()
)
# Elements without an end tag, and those that begin a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer
    form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary
    table tbody td tfoot th thead title tr ul""".split()
)
# Elements that never hold article text, and names that mark such parts.
OUTSIDE = frozenset(
    """applet aside audio button canvas datalist dialog embed fieldset footer form frame frameset head iframe input label
    legend map menu nav noembed noframes noscript object optgroup option script select style svg template textarea title
    video""".split()
)
# Last words of names that mark parts outside the text, of names that only speak against it, words that
# say how a part is laid out, and words that make a name a property of the whole.
STRONG = re.compile(
    r"ads?|advert\w*|adsense|banner|breadcrumbs?|comments?|consent|cookies?|disqus|footer|gdpr|login|masthead|menu|modal|nav|navbar|"
    r"navigation|newsletter|notices?|pager|pagination|popup|promo\w*|related|repl(?:y|ies)|respond|sidebar|sponsor\w*|subscribe|toolbar"
)
WEAK = re.compile(r"byline|copyright|disclaimer|form|header|hidden|share|sharing|skip|social|tags?|widget")
LAYOUT = frozenset(
    """area bar block body bottom box button column container content group holder inner item items left line link links list main
    outer panel right row section slot text thread top unit wrap wrapper zone""".split()
)
WHOLE = frozenset("has no with without".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
_CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}


CONTAINERS = frozenset("article body center details div main section table td th".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


class Place(NamedTuple):
    """What holds for the text at a place of the page."""

    outside: bool = False  # in a part that never holds article text
    weak: bool = False  # in a part whose name speaks against it
    article: bool = False  # in an article or main element
    link: bool = False
    heading: bool = False
    container: int = 0


class Block(NamedTuple):
    text: str
    linked: int  # characters in links
    place: Place


@lru_cache(4096)
def _name_mark(name: str) -> int:
    """2 for a name of a part outside the text, 1 for one that speaks against it, else 0.

    The last word that does not tell the layout decides: ``comment-list`` is a list of
    comments, ``hidden-gem`` is a gem, and ``has-sidebar`` is said of a whole page.
    """
    words = [w for w in re.split(r"[\W_\d]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()) if w]
    if not words or words[0] in WHOLE:
        return 0
    while len(words) > 1 and words[-1] in LAYOUT:
        words.pop()
    return 2 if STRONG.fullmatch(words[-1]) else 1 if WEAK.fullmatch(words[-1]) else 0


class Blocks(HTMLParser):
    """Cuts a page into blocks."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, Place]] = []
        self.counts: dict[str, int] = {}
        self.found: list[Block] = []
        self.text: list[str] = []
        self.linked = self.containers = 0
        self.place = Place()

    def flush(self) -> None:
        if self.text:
            joined = " ".join("".join(self.text).split())
            if joined:
                self.found.append(Block(joined, self.linked, self.place))
            self.text.clear()
        self.linked = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS or tag in OUTSIDE:
            self.flush()
        elif tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        for other in _CLOSES.get(tag, ()):
            if self.open and self.open[-1][0] == other:
                self._pop()
        self.open.append((tag, self._entered(tag, dict(attrs))))
        self.counts[tag] = self.counts.get(tag, 0) + 1
        self.place = self.open[-1][1]

    def _entered(self, tag: str, named: dict[str, str | None]) -> Place:
        outside, weak, article, link, heading, container = self.place
        mark = 0
        if tag not in ("html", "body"):
            names = f"{named.get('class') or ''} {named.get('id') or ''}".split()
            mark = max(map(_name_mark, names), default=0)
            if (named.get("role") or "").lower() in ROLES or "hidden" in named:
                mark = 2
        if tag in ("article", "main") and mark == 0:
            # an article inside a part left open by mistake is an article still
            outside, article = outside and any(self.counts.get(t) for t in ("aside", "footer", "form", "nav")), True
        if tag in CONTAINERS:
            self.containers += 1
            container = self.containers
        return Place(
            outside or mark == 2 or tag in OUTSIDE or (tag == "header" and not article),
            weak or mark == 1,
            article,
            link or tag == "a",
            tag in HEADINGS or (heading and tag not in BLOCKS),
            container,
        )

    def _pop(self) -> None:
        self.counts[self.open.pop()[0]] -= 1
        self.place = self.open[-1][1] if self.open else Place()

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS or tag in OUTSIDE:
            self.flush()
        if self.counts.get(tag):
            while self.open[-1][0] != tag:
                self._pop()
            self._pop()

    def handle_data(self, data: str) -> None:
        self.text.append(data)
        if self.place.link:
            self.linked += len(data.strip())


class Rules(NamedTuple):
    """Lengths in code points, link density as a share of them, stop-word density as a share of the words."""

    short: int = 40
    long: int = 120
    link_share: float = 0.33
    low: float = 0.1
    high: float = 0.25


def first_pass(block: Block, has_article: bool, rules: Rules = Rules()) -> str:
    """``good``, ``bad``, or undecided: ``near`` (some prose), ``poor`` (hardly any), ``short`` and ``heading``.

    An article element is a prior: inside it half the length and half the density do;
    outside, on a page that has one, it takes twice the length, and what is near is poor.
    """
    text, linked, place = block
    if place.outside or linked > rules.link_share * len(text):
        return "bad"
    if len(text) < rules.short:
        return "bad" if place.weak or (linked and not place.article) else "heading" if place.heading else "short"
    prior = 0.5 if place.article else 1.0
    words = text.lower().split()
    density = sum(_BARE.sub("", w) in STOP_WORDS for w in words) / len(words)
    if density >= rules.high * prior and len(text) > rules.long * (2 if has_article and not place.article else prior):
        return "good"
    if place.weak:
        return "bad"
    if place.heading:
        return "heading"
    return "near" if density >= rules.low * prior and (place.article or not has_article) else "poor"


_BARE = re.compile(r"^\W+|\W+$")
DECIDED = ("good", "bad")


def second_pass(labels: list[str], containers: list[int]) -> list[bool]:
    """Undecided blocks take the label of their nearest decided neighbours.

    Neighbours in the same container come first; where it has none, those of the page, whose
    ends count as bad. ``near`` is good if one of both sides is, ``poor`` if all are; ``short`` follows
    the closer one, on a tie the one behind it; a ``heading`` follows the one behind, if there is one.
    """
    n = len(labels)

    def sweep(order: range, end: int) -> tuple[list[int], list[int | None]]:
        last, own = end, {}
        page, same = [end] * n, [None] * n
        for i in order:
            page[i], same[i] = last, own.get(containers[i])
            if labels[i] in DECIDED:
                last = own[containers[i]] = i
        return page, same

    before, own_before = sweep(range(n), -1)
    after, own_after = sweep(range(n - 1, -1, -1), n)
    good = [label == "good" for label in labels] + [False]  # both ends, -1 and n, are bad
    out = []
    for i, label in enumerate(labels):
        if label in DECIDED:
            out.append(good[i])
            continue
        sides = [s for s in (own_before[i], own_after[i]) if s is not None] or [before[i], after[i]]
        if label == "near":
            out.append(any(good[s] for s in sides))
        elif label == "poor":
            out.append(all(good[s] for s in sides))
        elif label == "heading":
            out.append(good[sides[-1]])
        else:
            out.append(good[min(sides, key=lambda s: (abs(s - i), s < i))])
    return out


def main_text(html: str, rules: Rules = Rules()) -> str:
    """Main text of one page; see :func:`extract`."""
    parser = Blocks()
    parser.feed(html)
    parser.close()
    parser.flush()
    blocks = parser.found
    has_article = any(b.place.article and not b.place.outside for b in blocks)
    labels = [first_pass(b, has_article, rules) for b in blocks]
    if "good" not in labels:  # nothing to inherit from: a page of short or strange text is its undecided blocks
        chosen = [label not in DECIDED and (b.place.article or not has_article) for b, label in zip(blocks, labels)]
    else:
        chosen = second_pass(labels, [b.place.container for b in blocks])
    return " ".join(b.text for b, good in zip(blocks, chosen) if good)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars``: main text of every page, from the whole html.

    First pass: blocks in parts that hold no article text (menus, footers, forms, adverts,
    comments and so on, by element, role or name) and blocks made of links are bad; all others
    are judged by stop-word density, length and link density. An article element only moves
    these bounds, and a name like ``share`` or ``tags`` only asks for proof by them. Second
    pass: blocks too short or too mixed to tell take the label of their nearest decided
    neighbours. On a page where the first pass finds no good block, the undecided ones are
    the text, those in an article element if it has one.

    One row per input row, without a shuffle: repeated rows and repeated or null ids stay,
    null and empty pages give an empty text, extra columns are dropped, an empty table
    gives an empty table. A page is parsed in one go, in time linear in its length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = [main_text(html) if html else "" for html in batch.column("html").to_pylist()]
            counts = pa.array(list(map(len, out)), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), counts], ["page_id", "url", "text", "n_chars"]
            )

    rows = only(pages, page_id=(id_col, "bigint"), url=(url_col, "string"), html=(html_col, "string"))
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
