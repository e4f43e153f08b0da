"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. Pass one decides a block by its place and its text:
blocks inside page furniture (menus, headers, footers, sidebars, notices, adverts, forms, comments) are
bad; outside of article and main elements blocks that are mostly links are bad, long blocks with many
stop words are good, and long ones with few are bad; inside of one only long blocks with many stop words
are decided, as good. Stop words are of few languages: long blocks in other scripts than Latin, or on a
page whose long blocks all lack stop words, are good where they hold the end of a sentence. All others
stay open. In pass two an open block takes the label of the nearest decided neighbours in its own
container: good if either side is good at the least distance; in a container without decided blocks, an
article or main element makes them good and anything else bad.
So an article keeps its titles, link paragraphs, cells and formulas.

Names of classes and ids mark furniture by any of their words. Those inside an article or main element,
and those of such an element and of the elements around it, do so only if the whole name says so: if it
has nothing but furniture words and what may follow them (``comments-area``, ``related-posts``), or,
inside, if a furniture word ends it (``reader-comments``; but not ``post-header``). For names tell of the
page's layout and topic too (``has-sidebar``, ``comments-open``, ``category-social``, ``related-work``).

Defined cases: null or empty html gives an empty text; unclosed elements end with the page; an open
tag, comment, script or style that the page's end cuts off is dropped; repeated rows are extracted
row by row; an empty table gives an empty table; extra columns are not read. No text is capped.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from piiguard.llm.common import released
from piiguard.llm.quality_rules import STOP_WORDS

# Element names by role.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hr html "
    "legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul br".split()
)
RAW_TAGS = frozenset("script style noscript template iframe noframes noembed xmp textarea title svg object canvas audio video select".split())
#: Of these, elements that a page's end does not swallow when they are never closed.
PARSED_TAGS = frozenset("svg object canvas audio video select".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Only these, and what is inside of math, can close themselves.
FOREIGN_TAGS = frozenset(["svg", "math"])
FURNITURE_TAGS = frozenset("nav header footer aside form dialog menu button fieldset head".split())
MAIN_TAGS = frozenset(["article", "main"])
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of class and id names that mark page furniture.
FURNITURE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsbygoogle banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header "
    "masthead menu modal nav navbar navigation newsletter notice notices notification paywall popup promo promoted promotion related reply replies respond share sharing sidebar "
    "signup skyscraper social sponsor sponsored subscribe subscription toolbar widget widgets alert login pager pagination recommended".split()
)
#: Names that hold the main text although a furniture word may be part of them.
MAIN_NAMES = frozenset("article articlebody content entry maincontent mainbody post postbody story storybody".split())

#: What may follow furniture words in a name that says as a whole that its element is furniture.
NAME_ENDS = frozenset("area article articles bar block body box buttons container content div entries icons inner item items label latest links list outer popular post posts primary recent secondary section slot stories thread tools unit wrap wrapper".split())
#: Words before a furniture word that say its absence, or that the name is of the layout or the topic.
NAME_STARTS = frozenset("category has hide no tag topic with without".split())
#: Inline elements that an open paragraph may end in.
FORMATS = frozenset("b i em strong u span font small".split())

LONG_CHARS = 60
LOW_STOPS, MANY_STOPS = 0.12, 0.20
MOST_LINKS = 0.5

_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(>|\Z)""", re.S)
#: A slash at the end that is part of an unquoted value.
_UNQUOTED_SLASH = re.compile(r"""=\s*[^\s"'=]*/$""")
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_STYLE_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_STOPS = frozenset(STOP_WORDS)
#: Letters of scripts beyond Latin, and ends of sentences in any.
_OTHER_LETTERS = re.compile(r"[^\W\d_\u0000-\u036f\u1e00-\u1eff]")
_SENTENCE_END = re.compile(r"""[.!?…](?=[\s"'»”’)\]]|$)|[。！？｡।॥؟۔։።៕]""")


def _says_furniture(parts: list[str], in_main: bool, holds_main: bool) -> bool:
    """Whether the words of one name mark furniture."""
    if not FURNITURE_NAMES.intersection(parts) or "".join(parts) in MAIN_NAMES or in_main and parts[-1] == "header":
        return False
    if not (in_main or holds_main):
        return True
    if parts[0] in FURNITURE_NAMES and FURNITURE_NAMES.union(NAME_ENDS).issuperset(parts):
        return True
    return not holds_main and parts[-1] in FURNITURE_NAMES and parts[0] not in NAME_STARTS


def _is_furniture(tag: str, attrs: str, in_main: bool, holds_main: bool) -> bool:
    """Whether an element is page furniture. A header inside an article is part of it.

    ``holds_main``: it is an article or main element or around one.
    """
    if tag in FURNITURE_TAGS and not (tag == "header" and in_main):
        return True
    if not attrs:
        return False
    if _STYLE_HIDDEN.search(attrs) or re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", attrs, re.I):
        return True
    for m in _NAMED.finditer(attrs):
        value = m[1].strip("\"'")
        if m[0][:4].lower() == "role":
            if value.lower() in FURNITURE_ROLES and not (value.lower() == "banner" and in_main):
                return True
            continue
        if tag not in ("html", "body") and any(_says_furniture([p.lower() for p in _NAME_PARTS.findall(name)], in_main, holds_main) for name in value.split()):
            return True
    return False


@dataclass
class Block:
    container: int  # number of the innermost article or main element, 0 outside
    bad: bool
    parts: list[str] = field(default_factory=list)
    link_chars: int = 0
    label: int | None = None  # 1 good, 0 bad
    text: str = ""


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page in order, with decoded and collapsed text; empty ones are left out."""
    out, around = _blocks(page, frozenset())
    # elements do not depend on what is furniture: a second reading knows which ones hold a main element
    return _blocks(page, frozenset(around))[0] if around else out


def _blocks(page: str, holding: frozenset[int]) -> tuple[list[Block], set[int]]:
    """Blocks, and where the elements begin that are or hold an article or main element within furniture.

    ``holding`` are such places, known from an earlier reading.
    """
    out: list[Block] = []
    around: set[int] = set()
    stack: list[tuple[str, bool, int, bool, int, int]] = []  # tag, furniture, container, link, place, last one that is no format
    opened: Counter[str] = Counter()  # how many elements of a tag are open
    containers = 0

    def shut_from(depth: int) -> None:
        for element in stack[depth:]:
            opened[element[0]] -= 1
        del stack[depth:]

    now = Block(0, False)

    def close() -> None:
        nonlocal now
        now.text = " ".join(html.unescape("".join(now.parts)).split())
        if now.text:
            out.append(now)
        top = stack[-1] if stack else ("", False, 0, False)
        now = Block(top[2], top[1])

    def text(piece: str) -> None:
        if piece:
            now.parts.append(piece)
            if stack and stack[-1][3]:
                now.link_chars += len(piece.split()) and len(" ".join(piece.split()))

    pos, end = 0, len(page)
    while pos < end:
        m = _MARKUP.search(page, pos)
        if not m:
            text(page[pos:])
            break
        text(page[pos : m.start()])
        pos = m.end()
        if m[2] is None and m[6] is None:
            continue
        closing, tag, attrs, shut = (m[1], m[2], m[3], m[4]) if m[2] is not None else (m[5], m[6], m[7], m[8])
        tag = tag.lower()
        if not shut:
            break  # the page ends inside a tag
        if closing:
            if tag == "br":
                now.parts.append(" ")
            if opened[tag]:
                depth = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag)
                block = any(s[0] in BLOCK_TAGS for s in stack[depth:])
                changed = stack[-1][1:3] != (stack[depth - 1][1:3] if depth else (False, 0))
                shut_from(depth)
                if block or changed:
                    close()
            elif tag in BLOCK_TAGS:
                close()
            continue
        if tag in FOREIGN_TAGS or opened["math"]:
            if attrs.endswith("/") and not _UNQUOTED_SLASH.search(attrs):
                continue
        if tag in RAW_TAGS:
            over = re.compile(f"</{re.escape(tag)}[^>]*(?:>|\\Z)", re.I).search(page, pos)
            if not over:
                if tag in PARSED_TAGS:
                    continue
                break
            pos = over.end()
            now.parts.append(" ")
            continue
        if tag == "br":
            now.parts.append(" ")
            continue
        if tag in VOID_TAGS:
            if tag in BLOCK_TAGS:
                close()
            continue
        if tag in BLOCK_TAGS:
            # an open paragraph, item or cell ends where the next block begins
            while stack and (stack[-1][0] == "p" or tag == stack[-1][0] and tag in ("li", "td", "th", "tr", "dt", "dd", "option")):
                shut_from(len(stack) - 1)
            if tag in ("p", "div", "article", "section", "ul", "ol", "table", "h1", "h2", "h3", "h4", "h5", "h6") and stack and stack[-1][0] in FORMATS:
                depth = stack[-1][5]
                if depth >= 0 and stack[depth][0] == "p":
                    shut_from(depth)
        top = stack[-1] if stack else ("", False, 0, False)
        furniture = top[1] or _is_furniture(tag, attrs, top[2] > 0, pos in holding)
        container = top[2]
        if tag in MAIN_TAGS or 'role="main"' in attrs:
            containers += 1
            container = containers
            if furniture:
                around.add(pos)
                for element in reversed(stack):
                    if element[4] in around:  # so are those around it
                        break
                    around.add(element[4])
        plain = (stack[-1][5] if stack else -1) if tag in FORMATS else len(stack)
        stack.append((tag, furniture, container, top[3] or tag == "a", pos, plain))
        opened[tag] += 1
        if tag in BLOCK_TAGS or furniture != top[1]:
            close()
    close()
    return out, around


def _stop_share(text: str) -> float:
    words = text.split()
    return sum(w.lower() in _STOPS for w in words) / len(words)


def label(blocks: list[Block]) -> None:
    """Both passes over the blocks of a page."""
    judged = [(b, _stop_share(b.text)) for b in blocks if not b.bad and len(b.text) >= LONG_CHARS and (b.container or b.link_chars <= MOST_LINKS * len(b.text))]
    known = any(share >= LOW_STOPS for _, share in judged)
    for b in blocks:
        if b.bad or not b.container and b.link_chars > MOST_LINKS * len(b.text):
            b.label = 0
    for b, share in judged:
        if share >= MANY_STOPS:
            b.label = 1
        elif b.container:
            continue
        elif not known or 2 * len(_OTHER_LETTERS.findall(b.text)) > len(b.text):
            b.label = 1 if _SENTENCE_END.search(b.text) else None  # stop words tell nothing of this language
        elif share < LOW_STOPS:
            b.label = 0
    groups: dict[int, list[Block]] = {}
    for b in blocks:
        if not b.bad:
            groups.setdefault(b.container, []).append(b)
    for container, own in groups.items():
        before = _nearest(own)
        after = _nearest(own[::-1])[::-1]
        for b, (d0, l0), (d1, l1) in zip(own, before, after, strict=True):
            if b.label is not None:
                continue
            near = min(d0, d1)
            if near == len(own) + 1:
                good = container > 0
            else:
                good = (d0 == near and l0 == 1) or (d1 == near and l1 == 1) or container > 0 and 1 in (l0, l1)
            b.label = -1 if good else -2
    for b in blocks:
        b.label = {-1: 1, -2: 0}.get(b.label, b.label)


def _nearest(own: list[Block]) -> list[tuple[int, int]]:
    """Distance to and label of the decided block before each block."""
    out, d, last = [], len(own) + 1, 0
    for b in own:
        out.append((d, last))
        d, last = (1, b.label) if b.label in (0, 1) else (min(d + 1, len(own) + 1), last)
    return out


def main_text(page: str | None) -> str:
    blocks = blocks_of(page or "")
    label(blocks)
    return " ".join(b.text for b in blocks if b.label == 1)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row of ``pages`` (page_id, url, html)."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([main_text(h.as_py()) for h in batch.column(2)], pa.string())], schema=schema)

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string").select("*", F.length("text").cast("long").alias("n_chars"))


# ----------------------------------------------------------------------------------------------
def op6_html_extraction(spark, sf_dir):
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op6_html_extraction": op6_html_extraction}
ORACLES: dict[str, str] = {}
