"""Main text of web pages by tag-path ratios (op10).

Every text node has a root-to-leaf path of tags, with their class and id. Per page and path, text
length and punctuation are summed over the nodes; both are smoothed with those of the container
around the node (the article or main element, else the nearest container that is no list or table),
fused by a product, and paths above a share of the best score are content.
All blocks of a page compete. A paragraph also stays where the mean block of its path and
container comes near that of the best, so that a short part beside a long one does. Names are
weights: outside of an article or main element, where there is one, a tenth of the score counts, and a
twentieth in furniture; they decide where an article is hardly longer than what stands around it.
A block most of which is links is scored by itself, its linked text at a fifth, and unsmoothed are
paths most of whose text is links: so link lists, tag clouds and "read more" go from an article too,
with the headings that stand over nothing else.
Furniture is what HTML names so (navigation, footers, asides) and forms, page headers and elements
with a word of furniture in class, id or role, unless they hold the article or most of the page's
text. Scripts, styles, heads and controls hold no text at all.

Work is linear in the page: no character of markup is looked at again, and open elements are found
by their name's last place. Edge cases: null or empty html and pages without text give an empty
text; unclosed and truncated markup closes at the end of its container, a tag that another one
interrupts is dropped; repeated rows and empty tables work; further columns pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|iframe|svg|title)\b[^<>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^<]*(?=<|\Z)", re.S | re.I)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# Elements of the HTML standard and common names of page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split())
#: Where an open paragraph or item cannot be closed from within.
CONTAINERS = frozenset("article aside blockquote body div dl fieldset figure footer form header html main nav ol section table td th tr ul".split())
ROOTS = frozenset("article aside body div footer form header html main nav section".split())
#: Elements that may stand in a head; any other one, or text, ends a head that is still open.
HEAD_TAGS = frozenset("head html base basefont bgsound link meta noscript script style template title".split())
FURNITURE_TAGS = frozenset("aside dialog footer menu nav".split())
TEXTLESS_TAGS = frozenset("button head select datalist input option".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FURNITURE_NAMES = frozenset("ad ads advert adverts advertisement alert alerts banner breadcrumb breadcrumbs comment comments complementary contentinfo cookie cookies consent disqus footer form header masthead menu nav navbar navigation newsletter notice notices popup promo promoted related replies share sharing sidebar social sponsor sponsored subscribe toolbar widget".split())
PUNCTUATION = frozenset(".,;:!?…。，、；：！？")
CLOSES_P = BLOCKS - {"body", "html", "head"}


#: A block of which more than so much is linked counts a fifth of its linked characters only, without smoothing.
MOSTLY, LINKED_WEIGHT = 0.5, 0.2


def is_suspect(tag: str, attributes: str, inside: bool) -> bool:
    """Furniture unless it wraps the page's text; inside: within an article or main element, whose own header holds the title."""
    if tag == "form" or tag == "header" and not inside:
        return True
    if tag in ("html", "body", "article", "main") or "=" not in attributes:
        return False
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        value = a or b or c
        words = {w.lower() for w in NAME_PARTS.findall(value)} | {re.sub("[^a-z]", "", w) for w in value.lower().split()}
        if words & FURNITURE_NAMES and not (inside and words & {"header"}):
            return True
    return False


#: What an element holds.
ARTICLE, MAIN, H1 = 1, 2, 4
HOLDS = {"article": ARTICLE, "main": MAIN, "h1": H1}


class Tree:
    """Elements of a page in page order, each after its parent; element 0 is the page."""

    def __init__(self) -> None:
        self.parent, self.suspect, self.chars, self.holds = [0], [False], [0], [0]
        self.articles = 0

    def add(self, parent: int, tag: str, suspect: bool) -> int:
        self.parent.append(parent)
        self.suspect.append(suspect)
        self.chars.append(0)
        self.holds.append(HOLDS.get(tag, 0))
        self.articles += tag == "article"
        return len(self.parent) - 1

    def hidden(self) -> list[bool]:
        """Suspects and what is in them, but for those that hold the article or, where no element is named so, most of the page's text."""
        for i in range(len(self.parent) - 1, 0, -1):
            self.chars[self.parent[i]] += self.chars[i]
            self.holds[self.parent[i]] |= self.holds[i]
        out, named = [False], self.holds[0] & (ARTICLE | MAIN)
        for i in range(1, len(self.parent)):
            wraps = False
            if self.suspect[i]:
                share, held = self.chars[i] / (self.chars[0] or 1), self.holds[i]
                wraps = held & MAIN or held & ARTICLE and (held & H1 or self.articles == 1 or share > 0.5) or not named and (held & H1 and share > 0.5 or share > 0.75)
            out.append(out[self.parent[i]] or self.suspect[i] and not wraps)
        return out


class Open(NamedTuple):
    """An open element, with what its descendants need to know about the elements around them."""

    tag: str
    textless: bool
    furniture: bool  # by its tag or one around it
    element: int
    linked: bool
    path: int  # number of its path of blocks with their names
    block: str  # tag of the nearest block
    root: int  # the outermost article or main element, else the nearest root
    inside: bool  # an article or main element
    container: int  # place of the nearest container among the open elements


class Block(NamedTuple):
    furniture: bool
    path: int
    tag: str
    root: int
    inside: bool
    text: str
    linked: float  # share of its text in links


ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}


def text_blocks(html: str) -> list[Block]:
    """Each block with text, in page order; what of it stands in furniture as a block of its own."""
    found: list[tuple[Open, list[tuple[str, int, bool]]]] = []
    tree = Tree()
    page = Open("", False, False, 0, False, 0, "", 0, False, -1)
    stack: list[Open] = []
    places: dict[str, list[int]] = {}  # of each tag among the open elements
    paths: dict[tuple[int, str, str], int] = {}
    parts: list[tuple[str, int, bool]] = []
    leaf: Open | None = None

    def flush() -> None:
        nonlocal leaf, parts
        if parts:
            if leaf:
                found.append((leaf, parts))
            parts = []
        leaf = None

    def close(at: int) -> bool:
        """Close all from place at on; whether a block is among them."""
        blocks = False
        while len(stack) > at:
            tag = stack.pop().tag
            places[tag].pop()
            blocks |= tag in BLOCKS
        return blocks

    def last(tag: str) -> int:
        return places[tag][-1] if places.get(tag) else -1

    def end_head() -> None:
        if 0 <= last("head") < 3:
            close(last("head"))

    def add(raw: str) -> None:
        nonlocal leaf
        space = raw.isspace()
        if not space and stack and stack[-1].tag == "head":
            end_head()
        top = stack[-1] if stack else page
        if top.textless:
            return
        if leaf is None and not space:
            leaf = top
        tree.chars[top.element] += 0 if space or top.furniture else len(raw)
        parts.append((unescape(raw), top.element, top.linked))

    at = 0
    for m in MARKUP.finditer(html):
        if m.start() > at:
            add(html[at : m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        top = stack[-1] if stack else page
        if m[2]:
            place = last(tag)
            if place >= 0 and (tag in BLOCKS or place >= top.container) and close(place) or tag in BLOCKS:
                flush()
            continue
        if tag not in HEAD_TAGS:
            end_head()
        if tag in ("br", "wbr"):
            if tag == "br" and parts:
                parts.append((" ", parts[-1][1], False))
            continue
        if tag in BLOCKS:
            flush()
            top = stack[-1] if stack else page
            place = max([last(x) for x in ENDS.get(tag, ())] + [last("p") if tag in CLOSES_P else -1])
            if place >= max(top.container, 0):
                close(place)
        if tag in VOID or m[4].endswith("/"):
            continue
        top = stack[-1] if stack else page
        element = tree.add(top.element, tag, is_suspect(tag, m[4], top.inside))
        block = tag in BLOCKS
        names = " ".join(a or b or c for _, a, b, c in ATTRIBUTE.findall(m[4])) if block and "=" in m[4] else ""
        main = tag in ("article", "main")
        places.setdefault(tag, []).append(len(stack))
        stack.append(
            Open(
                tag, top.textless or tag in TEXTLESS_TAGS, top.furniture or tag in FURNITURE_TAGS, element, top.linked or tag == "a", paths.setdefault((top.path, tag, names), len(paths) + 1) if block else top.path, tag if block else top.block,
                top.root if top.inside else element if main or tag in ROOTS else top.root, top.inside or main, len(stack) if tag in CONTAINERS else top.container,
            )
        )
    if at < len(html):
        add(html[at:])
    flush()
    hidden, out = tree.hidden(), []
    for place, all_parts in found:
        for furniture in (False, True):
            own = [x for x in all_parts if (place.furniture or hidden[x[1]]) == furniture]
            text = " ".join("".join(x[0] for x in own).split()) if own else ""
            if text:
                chars = sum(len(x[0].strip()) for x in own)
                out.append(Block(furniture, place.path, place.block, place.root, place.inside, text, sum(len(x[0].strip()) for x in own if x[2]) / (chars or 1)))
    return out


#: What the score of a block outside of the article or main element counts, where a page has one, and that of one in furniture.
OUTSIDE, FURNITURE = 0.1, 0.05
#: Share of the best mean score from which a paragraph stays by itself.
ALONE = 0.5


class Sums:
    """Blocks, their length and punctuation as scored, their text and the linked part of it."""

    def __init__(self) -> None:
        self.n, self.chars, self.marks, self.text, self.linked = 0, 0.0, 0.0, 0, 0.0

    def add(self, chars: float, marks: int, text: int, linked: float) -> None:
        self.n += 1
        self.chars += chars
        self.marks += marks
        self.text += text
        self.linked += linked


def main_text(html: str, smoothing: float = 0.7, share: float = 0.15) -> str:
    blocks = text_blocks(html)
    if not blocks:
        return ""
    paths: dict[tuple[int, bool], Sums] = {}
    roots: dict[tuple[int, bool], Sums] = {}
    sizes = []
    for b in blocks:
        size = len(b.text) * (1 - (1 - LINKED_WEIGHT) * b.linked if b.linked > MOSTLY else 1), sum(c in PUNCTUATION for c in b.text)
        sizes.append(size)
        paths.setdefault((b.path, b.furniture), Sums()).add(*size, len(b.text), b.linked * len(b.text))
        roots.setdefault((b.root, b.furniture), Sums()).add(*size, len(b.text), b.linked * len(b.text))
    if all(b.furniture for b in blocks):
        return ""
    with_main = any(b.inside and not b.furniture for b in blocks)
    prior = lambda b: (OUTSIDE if with_main and not b.inside else 1.0) * (FURNITURE if b.furniture else 1.0)

    def scores(b: Block, size: tuple[float, int]) -> tuple[float, float]:
        """By the whole text of the block's path and container, and by their mean block."""
        if b.linked > MOSTLY:
            return (prior(b) * size[0] * (1 + size[1]),) * 2
        path, root = paths[b.path, b.furniture], roots[b.root, b.furniture]
        weight = 0.0 if path.linked > MOSTLY * path.text else smoothing
        smooth = lambda x, y: (1 - weight) * x + weight * y
        whole = smooth(path.chars, root.chars) * (1 + smooth(path.marks, root.marks))
        return prior(b) * whole, prior(b) * smooth(path.chars / path.n, root.chars / root.n) * (1 + smooth(path.marks / path.n, root.marks / root.n))

    scored = [scores(b, size) for b, size in zip(blocks, sizes, strict=True)]
    best, best_mean = max(scored)

    def content(b: Block, whole: float, mean: float) -> bool:
        if b.linked > MOSTLY:
            return mean >= share * best_mean
        by_itself = b.tag not in ROOTS or roots[b.root, b.furniture].n > 2
        return whole >= share * best or (by_itself and mean >= ALONE * best_mean)

    kept = [content(b, *s) for b, s in zip(blocks, scored, strict=True)]
    # A heading goes with the blocks up to the next heading; a page's title, and one with no block after it, stays where its container does.
    section: list[bool] = []
    for i in range(len(blocks) - 1, -1, -1):
        b = blocks[i]
        if b.furniture or b.tag not in HEADINGS:
            section.append(kept[i])
            continue
        root = roots[b.root, b.furniture]
        kept[i] = prior(b) * root.chars * (1 + root.marks) >= share * best if b.tag == "h1" or not section else any(section)
        section = []
    return "\n".join(b.text for b, keep in zip(blocks, kept, strict=True) if keep)


def extract(pages: DataFrame, html: str = "html", into: str = "text", smoothing: float = 0.7, share: float = 0.15) -> DataFrame:
    """pages without their html column and with the main text."""
    rest = [c for c in pages.columns if c not in (html, into)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(h, smoothing, share) if h else "" for h in batch.column(0).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], texts], names=[*rest, into])

    schema = T.StructType([*[pages.schema[c] for c in rest], T.StructField(into, T.StringType())])
    return small_batches(pages).select(F.col(html).cast("string").alias(html), *rest).mapInArrow(run, schema)
