"""Main text of web pages by two passes over their blocks.

A page is cut into blocks at block-level tags. The first pass labels blocks without
context: containers that never hold an article (menus, page headers and footers,
sidebars, forms, adverts, notices, comments, scripts) and blocks made of links are
bad; long blocks with enough stop words are good; the rest is undecided. The second
pass gives undecided blocks the label of their nearest decided neighbours of the same
region; when these disagree, the nearer one counts, and blocks in a region without
decided ones are good. Blocks that are bad by their container, and lists of links
inside an article, do not pass their label on. Where a page marks its article (``article`` or ``main``),
blocks outside it are bad.

A class or id names a bad container when its head word is a bad name (``cookie-notice``,
``sidebar-left``). Words behind has, no or with are states of something else, names
whose head is another word (``social-post``) are only doubtful, and no class or id rules
out a whole page, article or main part. Blocks in a doubtful container count when their
words say so, short ones by their neighbours in the same container.

One pass over the pages, no shuffle. Results for odd rows: a null or empty page has an
empty text; repeated rows get equal results; null ids and urls are kept; an empty table
gives an empty result; other columns play no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.llm.words import column

# Function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    "the of and to in a is that for it as was with be by on not he his but at are this have "
    "from or had an they which one you were all her she there would their we him been has "
    "der die das und ist in den von zu mit sich des auf für nicht ein eine im dem es auch als "
    "an er hat aus bei wie oder war nach wird sind noch einer um am sie nur "
    "le la les de des et est en un une du que qui dans pour pas sur au par plus ne se ce il "
    "avec son sa mais ou nous vous leur cette être "
    "el los las y que se del por con no una su para es al lo como más pero sus ya o este sí "
    "porque esta entre cuando muy sin sobre también me hasta hay donde quien".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section "
    "summary table tbody td tfoot th thead tr ul".split()
)
RAW = frozenset("script style noscript template iframe textarea title svg math object select head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BAD_TAGS = frozenset("nav footer aside form button menu dialog fieldset".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
BAD_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion "
    "banner cookie cookies consent gdpr notice notices alert popup modal overlay nav navbar navigation menu "
    "menubar breadcrumb breadcrumbs sidebar footer comment comments disqus reply replies respond share sharing "
    "social related recommended newsletter subscribe subscription signup login widget pagination pager toolbar "
    "skip hidden masthead topbar".split()
)
#: In front of the state of another part of the page.
STATES = frozenset("has have no not with without is hide hides show shows enable enabled disable disabled".split())
#: Behind the head word of a name.
LAYOUT = frozenset(
    "left right top bottom primary secondary list item items box wrap wrapper container inner outer content body area "
    "section block bar link links slot unit text title form row column col panel group button buttons icon icons".split()
)
#: In front of a bad name: a container of both.
WHOLE = frozenset("content main article post entry page layout".split())
#: Elements that no class or id makes bad.
UNNAMED = frozenset("html body main article".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
REGIONS = frozenset(("article", "main"))
TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
LOOSE_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)>?")
ATTRIBUTE = re.compile(r"""([A-Za-z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAME = re.compile(r"[a-z]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
WORD = re.compile(r"[^\W\d_]+")
LONG, STOPS_HIGH, LINKS_HIGH = 70, 0.3, 0.5
TEXTS = "page_id long, url string, text string, n_chars long"


@dataclass
class Block:
    """Decoded text, characters inside links, whether its containers are bad, the number
    of the region it is in (0: none), whether it is a heading, and the number of the
    doubtful container it is in (0: none)."""

    text: str
    linked: int
    bad: bool
    region: int
    heading: bool = False
    doubt: int = 0


@dataclass
class _Open:
    """An open element and what it adds to the blocks inside."""

    name: str
    bad: bool
    region: int
    doubt: int = 0


@dataclass
class _Reader:
    blocks: list[Block] = field(default_factory=list)
    stack: list[_Open] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    links: int = 0
    regions: int = 0
    doubts: int = 0
    breaks: int = 0
    current: str = ""

    def close_block(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            top = self.stack[-1] if self.stack else _Open("", False, 0)
            self.blocks.append(Block(text, self.linked, top.bad, top.region, self.current in HEADINGS, top.doubt))
        self.parts, self.linked, self.breaks, self.current = [], 0, 0, ""

    def add(self, raw: str) -> None:
        if not raw:
            return
        text = unescape(raw) if "&" in raw else raw
        self.parts.append(text)
        if not text.isspace():
            self.breaks = 0
        if self.links:
            self.linked += len(text.strip())

    def open(self, name: str, attributes: str) -> None:
        if name == "br":
            self.breaks += 1
            if self.breaks > 1:
                self.close_block()
            else:
                self.parts.append(" ")
            return
        if name in BLOCKS:
            self.close_block()
            self.current = name
        if name == "a":
            self.links += 1
        if name in VOID or name == "p" or attributes.endswith("/"):
            return
        top = self.stack[-1] if self.stack else _Open("", False, 0)
        bad, region, doubt = top.bad, top.region, top.doubt
        if not bad:
            named = _named(attributes, bool(region)) if name not in UNNAMED else 0
            bad = name in BAD_TAGS or (name == "header" and not region) or named == 2 or _is_bad(attributes)
            if named == 1:
                self.doubts += 1
                doubt = self.doubts
        if name in REGIONS and not region and not bad:
            self.regions += 1
            region, doubt = self.regions, 0
        self.stack.append(_Open(name, bad, region, doubt))

    def close(self, name: str) -> None:
        if name in BLOCKS:
            self.close_block()
        if name == "a":
            self.links = max(0, self.links - 1)
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at].name == name:
                del self.stack[at:]
                break
            if self.stack[at].name in BLOCKS and name not in BLOCKS:
                break  # a stray inline end tag does not close blocks


def _attributes(attributes: str) -> Iterator[tuple[str, str]]:
    for match in ATTRIBUTE.finditer(attributes) if attributes.strip() else ():
        yield match.group(1).lower(), (match.group(2) or match.group(3) or match.group(4) or "").lower()


def _named(attributes: str, inside: bool) -> int:
    """2 if a class or id names a container without article text, 1 if it may, else 0."""
    names = BAD_NAMES if inside else BAD_NAMES | {"header"}
    worst = 0
    for key, value in _attributes(attributes):
        for token in value.split() if key in ("class", "id") else ():
            words = NAME.findall(token)
            if not names.intersection(words):
                continue
            if STATES.intersection(words):
                continue
            while len(words) > 1 and words[-1] in LAYOUT and words[-1] not in names:
                words.pop()
            sure = words[-1] in names and not WHOLE.intersection(words)
            worst = max(worst, 2 if sure else 1)
    return worst


def _is_bad(attributes: str) -> bool:
    """Whether role or style mark a container that holds no article text."""
    for key, value in _attributes(attributes):
        if key == "role" and value in BAD_ROLES:
            return True
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and HIDDEN.search(value)):
            return True
    return False


def blocks_of(html: str) -> list[Block]:
    """Blocks of a page in its order."""
    reader, at, n = _Reader(), 0, len(html)
    low = None
    while at < n:
        mark = html.find("<", at)
        if mark < 0:
            reader.add(html[at:])
            break
        reader.add(html[at:mark])
        follows = html[mark + 1 : mark + 2]
        if follows in ("!", "?"):
            if html.startswith("<!--", mark):
                end = html.find("-->", mark + 4)
                at = n if end < 0 else end + 3
            else:
                end = html.find(">", mark)
                at = n if end < 0 else end + 1
            continue
        match = TAG.match(html, mark) or LOOSE_TAG.match(html, mark)
        if not match:  # a lone angle bracket is text
            reader.add("<")
            at = mark + 1
            continue
        at = match.end()
        name = match.group(2).lower()
        if match.group(1):
            if name not in RAW:
                reader.close(name)
            continue
        if name in RAW:
            if match.group(3).endswith("/"):
                continue
            low = low or html.lower()
            end = low.find(f"</{name}", at)
            if end < 0 and name == "head":
                end = low.find("<body", at)
                at = at if end < 0 else end
                continue
            close = -1 if end < 0 else html.find(">", end)
            at = n if close < 0 else close + 1
            continue
        reader.open(name, match.group(3))
    reader.close_block()
    return reader.blocks


def label(blocks: list[Block]) -> list[bool]:
    """Whether each block is main text."""
    marked = any(b.region and not b.bad for b in blocks)
    first: list[bool | None] = []
    for block in blocks:
        if _outside(block, marked) or _is_links(block):
            first.append(False)
            continue
        words = WORD.findall(block.text.lower())
        stops = sum(w in STOP_WORDS for w in words)
        if len(block.text) >= LONG and words and stops >= STOPS_HIGH * len(words):
            first.append(True)
        elif len(block.text) >= LONG and not block.region and stops == 0:
            first.append(False)
        else:
            first.append(None)
    silent = [_outside(b, marked) or (b.region > 0 and _is_links(b)) for b in blocks]
    decided = [i for i, x in enumerate(first) if x is not None and not silent[i]]
    out, before = [], 0
    for i, own in enumerate(first):
        while before < len(decided) and decided[before] < i:
            before += 1
        if own is not None:
            out.append(own)
            continue
        near = [decided[k] for k in (before - 1, before) if 0 <= k < len(decided) and blocks[decided[k]].region == blocks[i].region]
        if blocks[i].doubt:
            near = [k for k in near if blocks[k].doubt == blocks[i].doubt]
        labels = {first[k] for k in near}
        if len(labels) == 1:
            out.append(bool(labels.pop()))
        elif labels:
            distance = {bool(first[k]): abs(k - i) for k in near}
            out.append(distance[True] <= distance[False])
        else:
            out.append(not blocks[i].doubt)
    return out


def _outside(block: Block, marked: bool) -> bool:
    """Bad by its container, which says nothing about its neighbours."""
    return block.bad or (marked and not block.region)


def _is_links(block: Block) -> bool:
    """Made of links, and not a heading of the article."""
    return block.linked > LINKS_HIGH * len(block.text) and not (block.heading and block.region)


def main_text(html: str | None) -> str:
    """Main text of one page, one line for each block."""
    blocks = blocks_of(html or "")
    return "\n".join(b.text for b, good in zip(blocks, label(blocks), strict=True) if good)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of ``pages``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in column(batch, "html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [column(batch, "page_id"), column(batch, "url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(read, TEXTS)
