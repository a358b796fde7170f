"""Main text of web pages by two passes of block rules.

First pass: a block is boilerplate in an element that says so, or where most of it is links; content where it is long
enough and dense enough in function words. The rest, short and sparse blocks, is open. Second pass: an open block takes
the label of its nearest decided neighbours. Elements and class names are features beside these densities: they mark what
can't be told by density (comments, notices and adverts are prose too), and an article element that holds most of the
dense text frames the main text.

The parser is linear in a page's length, however deep and unbalanced its elements are.

Defined cases: null or empty html gives an empty text; an end cut off inside a tag or comment is dropped; very long pages
are read whole; between equally near neighbours of different labels, articles, headings and long blocks are content;
repeated pages give a row each; an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.shared import small_batches
from siltstone.llm.stopwords import ALL

# Elements and names.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
SKIPPED = frozenset("head script style noscript template iframe noframes noembed object applet svg canvas audio video map select datalist button textarea fieldset input nav footer aside dialog menu search title".split())
ARTICLE = frozenset("article main".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense banner banners sponsor sponsored promo promotion promos cookie cookies consent gdpr notice notices alert disclaimer popup modal overlay newsletter subscribe subscription "
    "signup signin login register sidebar sidebars aside menu menus nav navbar navigation navi breadcrumb breadcrumbs footer foot masthead comment comments commentlist disqus reply replies respond share sharing social related recommended recommendations "
    "widget widgets pagination pager paging toolbar skip copyright legal hidden".split()
)
WEAK_NAMES = frozenset("header top topbar hero".split())
BODY_NAMES = frozenset("article articles body content entry main post posts story stories text".split())
#: Words of class names that say nothing about what an element holds.
PLAIN = frozenset(
    "area articles article bar block body bottom box btn button buttons center col column container content count desktop element elements entry fixed float full global group head heading holder icon icons inline inner item items js label layout left "
    "link links list main mini mobile module news outer page panel part placement post posts primary region right row secondary section side site slot small sticky stories story tertiary text tile title tool tools top unit view wide wrap wrapper zone".split()
)
#: What may stand in a head; anything else ends it.
HEAD_ONLY = frozenset("html head base basefont bgsound link meta title noscript noframes style script template".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Whose end tags don't reach across a scope.
SCOPED = frozenset("li dt dd td th tr p".split())
AUTO_CLOSED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
#: What an implied end tag doesn't reach across.
SCOPES = frozenset("ul ol dl table td th div article section main body html aside nav footer header form blockquote".split())

TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WORD = re.compile(r"[^\W\d_]+")
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")

LONG, SHORT, DENSE, SPARSE, LINKS = 200, 70, 0.30, 0.12, 0.5


@dataclass
class Block:
    text: str
    link_chars: int
    skipped: bool
    article: bool
    heading: bool
    form: bool = False


class _Open:
    """An element that hasn't ended: what it adds for the text inside."""

    __slots__ = ("name", "block", "adds", "ended")

    def __init__(self, name: str, adds: tuple[bool, ...]):
        self.name, self.block, self.adds, self.ended = name, name in BLOCKS, adds, False


class _Parser:
    """Open elements in a stack, and of each name where they lie in it, so that no tag needs a walk over all of them."""

    def __init__(self) -> None:
        self.blocks: list[Block] = []
        self.run: list[tuple[str, bool]] = []
        self.stack: list[_Open] = []
        self.places: dict[str, list[int]] = {}
        self.scopes: list[int] = []
        self.block_places: list[int] = []
        #: Open elements that are skipped, an article, a link, a heading, a form.
        self.depth = [0, 0, 0, 0, 0]

    def text(self, raw: str) -> None:
        if raw:
            self.run.append((html.unescape(raw) if "&" in raw else raw, self.depth[2] > 0))

    def end_block(self) -> None:
        """What has been read since the last boundary is a block."""
        if self.run:
            text = " ".join("".join(t for t, _ in self.run).split())
            if text:
                links = sum(len("".join(t.split())) for t, linked in self.run if linked)
                self.blocks.append(Block(text, links, self.depth[0] > 0, self.depth[1] > 0, self.depth[3] > 0, self.depth[4] > 0))
            self.run = []

    def start(self, name: str, raw: str) -> None:
        if name == "br":
            self.run.append((" ", False))
            return
        if name not in HEAD_ONLY and self.stack and self.stack[-1].name == "head":
            self.end_block()
            self._cut(len(self.stack) - 1)  # its end tag may be left out
        if name in BLOCKS:
            self.end_block()
            self._close_implied(name)
        elif name == "a" and self.places.get("a"):
            self.end("a")
        if name in VOID:
            return
        attributes = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(raw)} if raw.strip(" /") else {}
        article = name in ARTICLE or attributes.get("role") == "main" or attributes.get("itemprop") == "articleBody"
        adds = (_skips(name, attributes, self.depth[1] > 0), article, name == "a", name in HEADINGS, name == "form")
        if name not in BLOCKS and not any(adds) and not self.places.get(name):
            return  # an inline element that changes nothing
        at = len(self.stack)
        self.stack.append(_Open(name, adds))
        self.places.setdefault(name, []).append(at)
        if name in SCOPES:
            self.scopes.append(at)
        if name in BLOCKS:
            self.block_places.append(at)
        for i, x in enumerate(adds):
            self.depth[i] += x

    def _ended(self, e: _Open) -> None:
        e.ended = True
        self.places[e.name].pop()
        for i, x in enumerate(e.adds):
            self.depth[i] -= x

    def _cut(self, at: int) -> None:
        """End everything from a place of the stack on."""
        while len(self.stack) > at:
            e = self.stack.pop()
            if not e.ended:
                self._ended(e)
            for places in (self.scopes, self.block_places):
                if places and places[-1] == len(self.stack):
                    places.pop()

    def _last(self, name: str) -> int:
        return places[-1] if (places := self.places.get(name)) else -1

    def _close_implied(self, name: str) -> None:
        """End what a block's start tag ends: an open paragraph, and of lists and tables what may not hold it; nothing
        outside the innermost scope."""
        ends = AUTO_CLOSED.get(name, frozenset())
        while True:
            at = max(self._last("p"), *(self._last(x) for x in ends)) if ends else self._last("p")
            if at < 0 or self.scopes and self.scopes[-1] > at:
                return
            found = self.stack[at].name
            self._cut(at)
            if found == name or not ends:
                return

    def end(self, name: str) -> None:
        if name == "br":
            self.run.append((" ", False))
            return
        if name in BLOCKS:
            self.end_block()
        at = self._last(name)
        if at < 0 or name in SCOPED and self.scopes and self.scopes[-1] > at:
            return
        if name not in BLOCKS and self.block_places and self.block_places[-1] > at:
            self._ended(self.stack[at])  # an inline element that is closed behind a block's start: only its own effect ends
        else:
            self._cut(at)


def _named(attributes: dict[str, str], names: frozenset[str]) -> bool:
    """Whether a class or id is made of such names: one of them, and else only words that say nothing, so that
    "share-buttons" is and "share-price" isn't."""
    for token in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        words = {w.lower() for w in PARTS.findall(token)}
        if words & names and words <= names | PLAIN and not (names is WEAK_NAMES and words & BODY_NAMES):
            return True
    return False


def _skips(name: str, attributes: dict[str, str], in_article: bool) -> bool:
    """Whether an element says that it isn't the article's text."""
    if name in ("html", "body", "article", "main"):
        return False
    if name in SKIPPED or name == "header" and not in_article:
        return True
    if not attributes:
        return False
    if attributes.get("role", "").lower() in ROLES or "hidden" in attributes or attributes.get("aria-hidden") == "true" or HIDDEN.search(attributes.get("style", "")):
        return True
    return _named(attributes, NAMES) or not in_article and _named(attributes, WEAK_NAMES)


def parse_blocks(page: str) -> list[Block]:
    """The blocks of a page in order, with what the rules look at."""
    p = _Parser()
    at, n = 0, len(page)
    lower = None
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            p.text(page[at:])
            break
        c = page[lt + 1 : lt + 2]
        if not (c.isalpha() and c.isascii() or c in ("/", "!", "?")) or c == "":
            p.text(page[at : lt + 1])
            at = lt + 1
            continue
        p.text(page[at:lt])
        if c in "!?":
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 2)
                at = n if end < 0 else end + 3
            else:
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
            continue
        m = TAG.match(page, lt)
        if m:
            closing, name, raw, at = m[1], m[2].lower(), m[3], m.end()
        else:
            end = page.find(">", lt)
            if end < 0:
                break
            inner = page[lt + 1 : end]
            closing, at = inner[:1] if inner[:1] == "/" else "", end + 1
            name, _, raw = inner.lstrip("/").partition(" ")
            name = name.strip("/").lower()
        if closing:
            p.end(name)
            continue
        if name in RAW and not raw.endswith("/"):
            p.end_block()
            if lower is None:
                lower = page.lower()
                if len(lower) != n:  # some letters change their length
                    lower = re.sub(r"[A-Z]+", lambda x: x[0].lower(), page)
            end = lower.find(f"</{name}", at)
            if end < 0:
                break
            gt = page.find(">", end)
            at = n if gt < 0 else gt + 1
            continue
        p.start(name, raw)
    p.end_block()
    return p.blocks


def density(text: str) -> float:
    """Share of function words among the words."""
    words = WORD.findall(text.lower())
    return sum(w in ALL for w in words) / max(1, len(words))


def classify(blocks: list[Block]) -> list[bool]:
    """Whether each block is content.

    First pass: boilerplate in an element that says so, or where most characters are links (but for an article's heading,
    and for a whole paragraph of an article that is dense in function words); content where it is dense in function words,
    or long and not sparse in them; boilerplate where it is long and sparse outside an article; else open. Second pass: an
    open block takes the label of the nearest decided blocks before and behind it: content if both are, or if one is and it
    is a heading, or stands in an article, or isn't short.

    A form is boilerplate, but where more than half of the dense characters stand in forms: then the page is one. An article
    element frames the text where at least half of the dense characters stand in one; then blocks outside are boilerplate.
    Where no block of such a frame is dense, the language has no function words here: its blocks without links are content.
    Where no block of the page is dense and nothing frames it, blocks without links are content if they are long in bytes,
    and open if they aren't short.
    """
    linked = [b.link_chars > LINKS * len(b.text.replace(" ", "")) for b in blocks]
    found = [density(b.text) if not b.skipped and len(b.text) >= SHORT else 0.0 for b in blocks]
    dense = [0.0 if x else d for d, x in zip(found, linked, strict=True)]
    if any(b.form for b in blocks):
        in_forms, others = (sum(len(b.text) for b, d in zip(blocks, dense, strict=True) if d >= SPARSE and b.form == side) for side in (True, False))
        if in_forms <= others:
            blocks = [replace(b, skipped=b.skipped or b.form) for b in blocks]
            found, dense = ([0.0 if b.form else d for b, d in zip(blocks, line, strict=True)] for line in (found, dense))
    free = [not b.skipped and not x for b, x in zip(blocks, linked, strict=True)]
    inside, outside = (sum(len(b.text) for b, d in zip(blocks, dense, strict=True) if d >= SPARSE and b.article == side) for side in (True, False))
    framed = any(b.article and not b.skipped for b in blocks) and inside >= outside
    foreign = not framed and not any(d >= SPARSE for d in dense)
    labels: list[bool | None] = []
    for b, x, d, own in zip(blocks, free, dense, found, strict=True):
        size = len(b.text)
        if b.skipped or framed and not b.article:
            labels.append(False)
        elif not x:
            prose = b.article and size >= SHORT and (own >= DENSE and b.text[-1] in ".!?…" or own >= SPARSE and size >= LONG)
            labels.append(True if prose else None if b.heading and b.article else False)
        elif "©" in b.text and size < LONG and not b.article:
            labels.append(False)
        elif foreign:
            width = len(b.text.encode("utf-8", "surrogatepass"))
            labels.append(True if width >= LONG else None)
        elif size < SHORT:
            labels.append(None)
        elif d >= DENSE or size >= LONG and d >= SPARSE or b.article and d >= SPARSE:
            labels.append(True)
        else:
            labels.append(None if d >= SPARSE or b.article else False)
    if framed and True not in labels:
        return [b.article and label is None for b, label in zip(blocks, labels, strict=True)]
    # The nearest decided block, that isn't in an element of its own kind, before and behind each.
    before, behind = ([None] * len(blocks) for _ in range(2))
    for out, order in ((before, range(len(blocks))), (behind, reversed(range(len(blocks))))):
        last: list[bool | None] = [None, None]
        for i in order:
            out[i] = last[blocks[i].article]
            if labels[i] is not None and not blocks[i].skipped:
                last[blocks[i].article] = labels[i]
    result = []
    for b, label, *sides in zip(blocks, labels, before, behind, strict=True):
        if label is None:
            near = [x for x in sides if x is not None]
            label = bool(near) and (all(near) or any(near) and (b.article or b.heading or len(b.text) >= SHORT))
        result.append(label)
    return result


def main_text(page: str | None) -> str:
    blocks = parse_blocks(page or "")
    return " ".join(b.text for b, keep in zip(blocks, classify(blocks), strict=True) if keep)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    small_batches(pages.sparkSession)
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))

    def extract(batches):
        for b in batches:
            texts = [main_text(h) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")
