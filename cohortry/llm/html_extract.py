"""Main text of web pages as a maximum-scoring subsequence.

A page is a sequence of words and tags. Words score by where they stand, tags score below
zero; the weights are log-odds learned from labelled pages. One linear scan finds the
contiguous region with the largest sum. Words in it that score below zero themselves,
such as those of an advert inside an article, are left out; such a block costs the region
no more than its opening tag, however long it is.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cohortry.llm.labelled_pages import PAGES
from cohortry.llm.shared import in_tasks, portions, spread_rows, with_fields

# Kinds of elements in HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
RAW = set("script style noscript template iframe svg math object canvas audio video textarea select title".split())
IN_HEAD = set("base basefont bgsound head html link meta noscript script style template title".split())
CLOSES_PARAGRAPH = set("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
CLOSES_ITS_LIKE = {"li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
ZONES = {"nav": "menu", "header": "header", "footer": "footer", "aside": "sidebar", "form": "form", "button": "form", "fieldset": "form", "dialog": "notice", "menu": "menu", "article": "article", "main": "article"}
# Words in class, id and role that name a part of a page.
HINTS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs",
    "header": "header masthead banner topbar",
    "footer": "footer colophon copyright contentinfo",
    "sidebar": "sidebar aside widget widgets related recommended complementary trending popular teaser",
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay disclaimer announcement paywall",
    "advert": "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion promoted",
    "form": "form search login signup subscribe subscription newsletter",
    "share": "share sharing social follow",
    "comment": "comment comments commentlist respond reply replies discussion disqus",
    "article": "article content post entry story main body text",
}
HINT_OF = {word: zone for zone, words in HINTS.items() for word in words.split()}
# A name that begins or ends so tells a state of the page ("has-sidebar", "ad-free"), and does not name a part.
STATES = (set("has have with without no".split()), set("free enabled disabled allowed open closed".split()))
# Names of lists of other pages, whose articles are no main text.
LISTS = set("related recommended complementary trending popular teaser".split())
WORTHY = "article"
CLIP, LEAST_TAG, WORD_FLOOR = 4.0, -0.35, 1.0

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|(?=<)|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)[^>]*(?:>|\Z)|[^<]+|<",
    re.S,
)
_NODE = re.compile(r"<(?:article|main)\b|role\s*=\s*[\"']?\s*(?:article|main)\b", re.I)
_NAMED = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@dataclass
class PageModel:
    words: dict[str, float] = field(default_factory=dict)
    tags: dict[str, float] = field(default_factory=dict)

    def word(self, zone: str, block: str, linked: bool) -> float:
        total = self.words.get("zone " + zone, 0.0) + self.words.get("block " + block, 0.0) + self.words.get("linked" if linked else "free", 0.0)
        if zone == WORTHY:
            return max(total, WORD_FLOOR)
        return min(total, -WORD_FLOOR) if zone else total

    def tag(self, name: str) -> float:
        return self.tags.get(name, LEAST_TAG)


class Marks(NamedTuple):
    """What attributes say of an element: hidden, zones by role, zones hinted at by class or id, a list of other pages."""

    hidden: bool = False
    roles: frozenset[str] = frozenset()
    hints: frozenset[str] = frozenset()
    listed: bool = False


def _marks(attributes: str) -> Marks:
    hidden, roles, hints, listed = False, set(), set(), False
    for key, a, b, c in _NAMED.findall(attributes):
        key, value = key.lower(), a or b or c
        if key in ("hidden",) or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and "display:none" in value.replace(" ", "").lower()):
            hidden = True
        elif key in ("class", "id", "role"):
            for name in value.split():
                parts = [p.lower() for p in _PART.findall(name)]
                found = {HINT_OF[p] for p in parts if p in HINT_OF}
                if key == "role":
                    roles |= found
                elif len(parts) > 1 and (parts[0] in STATES[0] or parts[-1] in STATES[1]):
                    hints |= found & {WORTHY}
                else:
                    hints |= found
                    listed = listed or not LISTS.isdisjoint(parts)
    if WORTHY in roles:
        hints &= {WORTHY, "comment", "advert"}
    return Marks(hidden, frozenset(roles), frozenset(hints), listed)


def _zone(name: str, hidden: bool, hinted: frozenset[str], outer: str) -> str:
    """The zone an element opens, or the one around it. Zones that are no main text hold to their end."""
    if name in ("html", "body"):
        return outer
    if outer and outer not in (WORTHY, "form", "header"):
        return outer
    if hidden:
        return "notice"
    own = ZONES.get(name)
    if outer == "form":
        return WORTHY if own == WORTHY else outer
    if outer == "header":
        return outer
    apart = hinted - {WORTHY}
    if own and own != WORTHY:
        return own
    if own == WORTHY:
        other = apart & {"comment", "advert"} or (apart & {"sidebar"} if WORTHY not in hinted else frozenset())
        return sorted(other)[0] if other and name != "main" else WORTHY
    if name in INLINE and not apart & {"advert", "comment", "notice"}:
        return outer
    if apart and (WORTHY not in hinted or apart & {"comment", "header", "footer", "advert"}):
        return sorted(apart)[0]
    return WORTHY if WORTHY in hinted and not apart else outer


class Around(NamedTuple):
    """The elements that enclose a place: how firmly they are no main text, the wrappers named so only by
    class or id (how many; the innermost, linked to the next), and the main-text elements (all, and those
    outside the innermost wrapper)."""

    firm: int = 0
    wrappers: int = 0
    inner: tuple | None = None
    nodes: int = 0
    outside: int = 0


class Wrappers:
    """Elements whose class or id hints at a part that is no main text, though they hold the main text.

    An <article> or <main> in such an element is main text, and the hint says nothing of the element. Not so
    inside elements that are apart by name, role or being hidden. Comments, adverts and lists of other pages
    give way to a <main> only. If articles stand outside of it, or in fewer of such elements, its articles
    stay what it is hinted to be.
    """

    def __init__(self) -> None:
        self.nodes: list[Around] = []

    def enter(self, name: str, marks: Marks, start: int, around: Around) -> Around:
        if name in ("html", "body"):
            return around
        named = _zone(name, marks.hidden, marks.roles, "")
        hinted = _zone(name, marks.hidden, marks.roles | marks.hints, "")
        if named == WORTHY:
            if hinted == WORTHY and around.firm < (2 if name == "main" else 1):
                self.nodes.append(around)
                around = around._replace(nodes=around.nodes + 1)
            return around
        if named and named != "form":
            return around._replace(firm=2)
        if not named and hinted not in ("", WORTHY):
            firm = max(around.firm, int(marks.listed or hinted in ("comment", "advert")))
            return around._replace(firm=firm, wrappers=around.wrappers + 1, inner=(start, around.inner), outside=around.nodes)
        return around

    def ignored(self) -> set[int]:
        """Where those elements start."""
        fewer, total = {}, 0
        for n, count in sorted(Counter(a.wrappers for a in self.nodes).items()):
            fewer[n] = total
            total += count
        found: set[int] = set()
        for around in self.nodes:
            if fewer[around.wrappers] <= around.outside:
                inner = around.inner
                while inner and inner[0] not in found:
                    found.add(inner[0])
                    inner = inner[1]
        return found


def tokens(page: str) -> Iterator[tuple[str, str, str, bool, bool, str]]:
    """(kind, zone, block, linked, cut, value): ``text`` with its place, or ``tag`` with its name.

    ``cut`` holds inside a part of an open article that is no main text.
    """
    wrappers = Wrappers()
    if _NODE.search(page):
        for _ in _scan(page, frozenset(), wrappers):
            pass
    return _scan(page, wrappers.ignored(), None)


def _scan(page: str, ignored: set[int] | frozenset[int], wrappers: Wrappers | None) -> Iterator[tuple[str, str, str, bool, bool, str]]:
    """Tokens, with no zone from the class or id of elements that start at ``ignored``; ``wrappers`` is told of all elements."""
    stack: list[tuple[str, str]] = []
    zone, linked, raw, depth, worthy, head = "", 0, None, 0, 0, False
    around, enclosing = Around(), []
    for match in _TOKEN.finditer(page):
        piece = match.group()
        name = match.group(2) or match.group(5)
        if raw is not None:
            if name and name.lower() == raw:
                depth += -1 if (match.group(1) or match.group(4)) else 0 if piece.endswith("/>") or raw in ("script", "style", "title", "textarea") else 1
                if depth <= 0:
                    raw = None
            continue
        if head:
            # closed by its end tag, or by text or the first tag that cannot stand in it
            closing = bool(match.group(1) or match.group(4))
            if name and name.lower() in RAW & IN_HEAD and not closing and not piece.endswith("/>"):
                raw, depth = name.lower(), 1
            if name and (name.lower() in IN_HEAD or closing):
                head = not (closing and name.lower() == "head")
                continue
            if not name and (piece.startswith(("<!", "<?")) or not piece.strip()):
                continue
            head = False
        if not name:
            if not piece.startswith(("<!", "<?")):
                block = next((n for n, _ in reversed(stack) if n not in INLINE), "")
                yield "text", zone, block, linked > 0, worthy > 0 and zone != WORTHY, piece
            continue
        name = name.lower()
        closing = bool(match.group(1) or match.group(4))
        if name == "head":
            head = not closing and not piece.endswith("/>")
            yield "tag", zone, "", False, worthy > 0 and zone != WORTHY, name
            continue
        if name in RAW:
            if not closing and not piece.endswith("/>"):
                raw, depth = name, 1
            yield "tag", zone, "", False, worthy > 0 and zone != WORTHY, name
            continue
        yield "tag", zone, "", False, worthy > 0 and zone != WORTHY, name
        if name in VOID:
            continue
        if closing:
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if at is None:
                continue
            linked -= sum(n == "a" for n, _ in stack[at:])
            worthy -= sum(z == WORTHY for _, z in stack[at:])
            zone = stack[at][1]
            del stack[at:]
            if wrappers:
                around = enclosing[at]
                del enclosing[at:]
            continue
        shut = {"p"} if name in CLOSES_PARAGRAPH else CLOSES_ITS_LIKE.get(name)
        if shut:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in shut:
                    linked -= sum(n == "a" for n, _ in stack[i:])
                    worthy -= sum(z == WORTHY for _, z in stack[i:])
                    zone = stack[i][1]
                    del stack[i:]
                    if wrappers:
                        around = enclosing[i]
                        del enclosing[i:]
                    break
                if stack[i][0] not in INLINE:
                    break
        if not piece.endswith("/>"):
            outer, attributes = zone, match.group(3)
            marks = _marks(attributes) if attributes and attributes.strip() else Marks()
            if wrappers:
                enclosing.append(around)
                around = wrappers.enter(name, marks, match.start(), around)
            if zone == "header" and name in ("h1", "h2") and worthy:
                zone = WORTHY
            else:
                zone = _zone(name, marks.hidden, marks.roles | (marks.hints & {WORTHY} if match.start() in ignored else marks.hints), outer)
            stack.append((name, outer))
            worthy += outer == WORTHY
            linked += name == "a"


def fit(pages: list[str]) -> PageModel:
    """Weights as log-odds of standing in main text, from pages marked with ⟦ and ⟧."""
    counts: dict[bool, Counter] = {True: Counter(), False: Counter()}
    tags: dict[bool, Counter] = {True: Counter(), False: Counter()}
    for page in pages:
        inside = [i for i, c in enumerate(page) if c in "⟦⟧"]
        first, last = (inside[0], inside[-1]) if inside else (len(page), len(page))
        main, at = False, 0
        for kind, zone, block, linked, _, value in tokens(page):
            if kind == "tag":
                at = page.find("<", at)
                tags[first <= at <= last][value] += 1
                at += 1
                continue
            at = max(at, page.find(value, at))
            for part in re.findall(r"[⟦⟧]|[^⟦⟧\s]+", value):
                if part in "⟦⟧":
                    main = part == "⟦"
                else:
                    counts[main].update(["zone " + zone, "block " + block, "linked" if linked else "free"])
    total = {k: sum(v for f, v in c.items() if f in ("linked", "free")) + 2 for k, c in counts.items()}
    odds = lambda f: float(np.log((counts[True][f] + 0.5) / total[True]) - np.log((counts[False][f] + 0.5) / total[False]))
    words = {f: float(np.clip(odds(f), -CLIP, CLIP)) for f in set(counts[True]) | set(counts[False])}
    for zone in HINTS:
        words.setdefault("zone " + zone, -CLIP if zone != WORTHY else CLIP)
    whole = {k: sum(c.values()) + 2 for k, c in tags.items()}
    cost = lambda t: np.log((tags[True][t] + 0.5) / whole[True]) - np.log((tags[False][t] + 0.5) / whole[False])
    return PageModel(words, {t: float(np.clip(cost(t), LEAST_TAG, -0.05)) for t in set(tags[True]) | set(tags[False])})


def best_region(scores: np.ndarray) -> tuple[int, int]:
    """[first, end) of the contiguous run with the largest sum, the earliest if several; empty if none is above zero."""
    if not len(scores):
        return 0, 0
    ends = np.cumsum(scores)
    before = np.r_[0.0, ends[:-1]]
    lowest = np.minimum.accumulate(before)
    gain = ends - lowest
    end = int(gain.argmax())
    if gain[end] <= 0:
        return 0, 0
    return int(np.flatnonzero(before[: end + 1] == lowest[end])[-1]), end + 1


def main_text(page: str | None, model: PageModel) -> str:
    """The main text: character references decoded, blocks joined by one space."""
    found = list(tokens(page or ""))
    known: dict[tuple[str, str, bool], float] = {}
    scores = np.empty(len(found))
    weights = np.zeros(len(found))
    for i, (kind, zone, block, linked, cut, value) in enumerate(found):
        if kind == "tag":
            scores[i] = 0.0 if cut else model.tag(value)
            continue
        key = (zone, block, linked)
        weight = known.get(key)
        if weight is None:
            weight = known[key] = model.word(*key)
        weights[i] = weight
        scores[i] = 0.0 if cut else weight * len(value.split())
    first, end = best_region(scores)
    out: list[str] = []
    for i in range(first, end):
        kind, *_, value = found[i]
        if kind == "tag":
            if value not in INLINE:
                out.append(" ")
        elif weights[i] > 0:
            out.append(references.unescape(value))
        elif value.strip():
            out.append(" ")
    return " ".join("".join(out).split())


def extract(pages: DataFrame, model: PageModel | None = None) -> DataFrame:
    """``pages`` with ``text``, the main text of ``html``, and ``n_chars``, its code points.

    Null or empty html, and pages without a region above zero, give an empty text. Columns
    ``text`` and ``n_chars`` are replaced, all others kept; every page has a row.
    """
    model = model or fit(PAGES)
    pages = pages.drop("text", "n_chars")
    at = pages.columns.index("html")
    schema = with_fields(pages, "text string, n_chars bigint")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, at, 8_000_000):
            texts = [main_text(h, model) for h in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*batch.schema.names, "text", "n_chars"]
            )

    return in_tasks(spread_rows(pages, "html"), task, schema)
