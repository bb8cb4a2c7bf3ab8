"""Main text of web pages by two passes over their blocks.

Markup is read once into blocks, the runs of text between block-level tags. The first pass looks at
a block alone: its place (menus, headers, footers, sidebars, notices, adverts, forms and reader
comments are boilerplate by their element, role, or a word of their class or id), its link
density, its length and its density of stop words. Short blocks and blocks between the thresholds
stay ambiguous. In the second pass these take the label of the nearest decided neighbour in
the same region, the following one if two are as near and disagree.

A region is the inside of ``article`` or ``main``, or all the rest. If a page has such an element
with text, only what is inside counts as main text; there a long block is good whatever its words,
and blocks without any decided neighbour are good.

Stop words of English, French, German and Spanish are known. Where the long blocks of a page
together have too few of them, its language is not known, and length and link density decide alone. Code,
table cells and list items without stop words are ambiguous, not bad.

Elements such as ``svg`` or ``button`` are skipped from their tag to its own end tag; a tag that is
self-closing, or has no end tag, skips nothing else.

Words of class and id say nothing about ``body``, ``main`` and an ``article`` that is not part of
another one, nor do those behind a state word (``has-sidebar``, ``no-ads``). What surrounds ``main``
is not boilerplate by such a word; nor is what surrounds an article, unless a longer article or
main text stands outside of all that is (readers' comments and teasers are articles, too).
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A block of fewer characters is too short to be judged alone.
SHORT = 70
#: Share of a block's characters in links from which on it is boilerplate.
LINKED = 0.5
#: Shares of stop words from which on a block outside an article is good, or may be.
MANY_STOPS, SOME_STOPS = 0.30, 0.15

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = frozenset(
    """a an and are as at be but by for from had has have he her his i in is it its not of on or
    she that the their they this to was were which will with you
    au aux avec ce ces dans de des du elle en est et il ils je la le les leur mais ne nous on ou par
    pas pour qu que qui sa se son sur un une vous
    als am an auch auf aus bei das dass dem den der des die ein eine einem einen einer er es für
    hat ich im in ist mit nicht noch sich sie sind so und von war wie wird zu zum zur
    al como con de del e el ella en es esta este fue ha la las lo los más no o para pero por que
    se si sin su sus un una y ya""".split()
)
# Elements, roles and words of class and id that name boilerplate.
_BOILER_TAGS = frozenset("nav footer aside form menu dialog".split())
_BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert".split())
_BOILER_WORDS = frozenset(
    """ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments
    consent cookie cookies copyright disclaimer disqus footer header login masthead menu modal nav
    navbar navigation newsletter notice notices popup promo promoted related respond reply replies
    share sharing sidebar signup social sponsor sponsored subscribe toolbar widget""".split()
)
_STATES = frozenset("has no not with without".split())
_REGION_TAGS = frozenset(["article", "main"])
_CONTAINERS = _BOILER_TAGS | _REGION_TAGS | frozenset("header section div ul ol table body".split())
_BREAKS = _CONTAINERS | frozenset(
    """address blockquote br caption center dd details dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6
    hgroup hr html legend li p pre summary tbody td tfoot th thead tr""".split()
)

_MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)
      | <(script|style|iframe|textarea|title)\b.*?(?:</\1\s*>|\Z)
      | <(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>
      | </?[a-zA-Z][^>]*(?:>|\Z)
      | <[!?][^>]*(?:>|\Z)""",
    re.S | re.I | re.X,
)
_SKIPPED = frozenset("noscript template svg object select button".split())
#: A further start tag of these ends the one before.
_NOT_NESTED = frozenset(["select", "button"])
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NAME_PARTS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
_LETTERS = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    """A run of text, where it stands, and what has been decided about it."""

    text: str
    linked: int
    boiler: bool
    inside: bool
    item: bool
    plain: bool = True
    label: str = ""


@dataclass
class _Open:
    """An open container: boilerplate by its element or role, or by a word of its class or id."""

    tag: str
    boiler: bool
    word: bool


@dataclass
class _Unit:
    """A main or an article not inside another: the containers named by a word around it, its length."""

    around: list[_Open]
    boiler: bool
    size: int = 0


@dataclass
class _Place:
    """Where blocks stand: boilerplate by element or role, containers named by a word, the unit,
    and whether that is an article."""

    boiler: bool
    named: list[_Open] = field(default_factory=list)
    unit: _Unit | None = None
    article: bool = False


def _is_boiler(tag: str, attributes: str, inside: bool) -> bool:
    if tag in _BOILER_TAGS or (tag == "header" and not inside):
        return True
    found = _ATTRIBUTE.findall(attributes)
    return any(n.lower() == "role" and "".join(v).strip().lower() in _BOILER_ROLES for n, *v in found)


def _is_named(attributes: str) -> bool:
    for name, *values in _ATTRIBUTE.findall(attributes):
        for one in "".join(values).split() if name.lower() != "role" else ():
            words = [w.lower() for w in _NAME_PARTS.findall(one)]
            if words and words[0] not in _STATES and not _BOILER_WORDS.isdisjoint(words):
                return True
    return False


def _skips(found: list[re.Match]) -> dict[int, int]:
    """The number of the end tag of each skipped element, by the number of its start tag."""
    ends: dict[int, int] = {}
    opened: dict[str, list[int]] = {tag: [] for tag in _SKIPPED}
    for i, m in enumerate(found):
        tag = (m[3] or "").lower()
        if tag not in _SKIPPED:
            continue
        if m[2]:
            if opened[tag]:
                ends[opened[tag].pop()] = i
        elif not (m[4] or "").rstrip().endswith("/"):
            if tag in _NOT_NESTED:
                opened[tag].clear()
            opened[tag].append(i)
    return ends


def _clear_names(units: list[_Unit]) -> None:
    """Names of containers around the longest articles count no more."""
    sizes = [(u, any(c.word for c in u.around)) for u in units if not u.boiler and u.size]
    longest = max((u.size for u, named in sizes if not named), default=0)
    for unit, _ in sizes:
        if unit.size >= longest:
            for container in unit.around:
                container.word = False


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page in order; character references are decoded, white space collapsed."""
    out: list[Block] = []
    stack: list[_Open] = []
    units: list[_Unit] = []
    places: list[_Place] = [_Place(False)]  # of what is outside of, and inside of each open container
    of_block: list[_Place] = []
    pieces: list[str] = []
    state = {"links": 0, "linked": 0, "item": False, "code": 0, "table": 0}

    def close() -> None:
        text = " ".join("".join(pieces).split())
        pieces.clear()
        if text:
            place = places[-1]
            plain = not (state["item"] or state["code"] or state["table"])
            out.append(Block(text, state["linked"], place.boiler, place.unit is not None, state["item"], plain))
            of_block.append(place)
            if place.unit and not place.boiler and len(place.named) == len(place.unit.around):
                place.unit.size += len(text)
        state["links"] = state["linked"] = 0

    def enter(tag: str, attributes: str) -> None:
        outer = places[-1]
        region = tag in _REGION_TAGS and not outer.article
        boiler = _is_boiler(tag, attributes, outer.unit is not None)
        opened = _Open(tag, boiler, not region and tag != "body" and _is_named(attributes))
        if tag == "main":
            for container in outer.named:
                container.word = False
        stack.append(opened)
        named = [*outer.named, opened] if opened.word else outer.named
        unit = outer.unit
        if region:
            unit = _Unit(named, outer.boiler or boiler)
            units.append(unit)
        places.append(_Place(outer.boiler or boiler, named, unit, outer.article or tag == "article"))

    def add(raw: str) -> None:
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            pieces.append(text)
            if state["links"]:
                state["linked"] += len("".join(text.split()))

    at = 0
    marks = list(_MARKUP.finditer(page))
    ends = _skips(marks)
    skipped = -1
    for i, found in enumerate(marks):
        if i <= skipped:
            at = found.end()
            continue
        add(page[at : found.start()])
        at = found.end()
        skipped = ends.get(i, -1)
        tag = (found[3] or "").lower()
        if not tag:
            continue
        closing = found[2] == "/"
        if tag == "a":
            state["links"] = max(0, state["links"] + (-1 if closing else 1))
        if tag not in _BREAKS:
            continue
        close()
        if tag == "li":
            state["item"] = not closing
        elif tag == "pre" or tag == "table":
            kind = "code" if tag == "pre" else "table"
            state[kind] = max(0, state[kind] + (-1 if closing else 1))
        if tag not in _CONTAINERS:
            continue
        if not closing:
            enter(tag, found[4] or "")
        elif any(o.tag == tag for o in stack):
            while stack.pop().tag != tag:
                places.pop()
            places.pop()
    add(page[at:])
    close()
    _clear_names(units)
    for block, place in zip(out, of_block, strict=True):
        block.boiler = place.boiler or any(c.word for c in place.named)
    return out


def _stops(block: Block) -> tuple[int, int]:
    """Stop words and words of a block."""
    words = _LETTERS.findall(block.text.lower())
    return sum(w in STOP_WORDS for w in words), len(words)


def _length(text: str) -> int:
    """Characters; one of the East Asian scripts says as much as about three letters."""
    return len(text) if text.isascii() else sum(3 if c >= "\u2e80" else 1 for c in text)


def _linked(block: Block) -> bool:
    return block.linked >= LINKED * sum(len(w) for w in block.text.split())


def _is_known(blocks: list[Block]) -> bool:
    """Whether the long blocks that are judged by their words have stop words at all."""
    judged = [b for b in blocks if not (b.boiler or b.inside) and _length(b.text) >= SHORT and not _linked(b)]
    stops, words = (sum(x) for x in zip(*map(_stops, judged), strict=True)) if judged else (0, 0)
    return not judged or stops >= SOME_STOPS * max(words, 1)


def _first_pass(block: Block, known: bool) -> str:
    """good, bad, or an ambiguous label: near or short; ``known``: the page's language has stop words."""
    if block.boiler:
        return "bad"
    if _linked(block) and (block.item or not block.inside):
        return "bad"
    if not block.inside and "\N{COPYRIGHT SIGN}" in block.text:
        return "bad"
    if (len(block.text) if known else _length(block.text)) < SHORT:
        return "short"
    if block.inside or not known:
        return "good"
    stops, words = _stops(block)
    if stops >= MANY_STOPS * max(words, 1):
        return "good"
    return "near" if stops >= SOME_STOPS * max(words, 1) else "bad" if block.plain else "short"


def _second_pass(region: list[Block], inside: bool) -> None:
    labels = [b.label for b in region]
    before: list[int | None] = []
    last = None
    for i, label in enumerate(labels):
        last = i if label in ("good", "bad") else last
        before.append(last)
    following = None
    for i in range(len(region) - 1, -1, -1):
        if labels[i] in ("good", "bad"):
            following = i
            continue
        near = [(abs(i - j), -j, j) for j in (before[i], following) if j is not None]
        if near:
            region[i].label = labels[min(near)[2]]
        else:
            region[i].label = "good" if inside or labels[i] == "near" else "bad"


def main_text(page: str | None) -> str:
    """The main text of a page, its blocks joined by newlines; null and empty pages have none."""
    blocks = blocks_of(page or "")
    known = _is_known(blocks)
    for block in blocks:
        block.label = _first_pass(block, known)
    within = [b for b in blocks if b.inside and not b.boiler]
    if within:
        _second_pass(within, True)
        return "\n".join(b.text for b in within if b.label == "good")
    _second_pass(blocks, False)
    return "\n".join(b.text for b in blocks if b.label == "good")


def extract(pages: DataFrame, html_column: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the main text of ``html_column`` as ``out``, and without that column.

    A null or empty page, and one without main text, gives the empty string. Repeated rows
    are kept; the other columns pass unchanged.
    """
    if out in pages.columns and out != html_column:
        raise ValueError(f"the table already has a column {out}")
    kept = [c for c in pages.columns if c != html_column]
    rows = pages.select(*kept, html_column)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p) for p in batch.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(kept)], pa.array(texts, pa.string())], names=[*kept, out]
            )

    return rows.mapInArrow(run, pages.select(*kept, F.lit("").alias(out)).schema)
