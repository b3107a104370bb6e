"""Main text of web pages: flat text blocks classified by a decision tree (operator 3)."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, tidy
from .labelled import PAGES

# Elements whose content is never text, elements that end a block of text, and elements without content.
_SILENT = "script style noscript template svg math iframe object select textarea head title canvas audio video".split()
_BREAKS = set(
    "address article aside blockquote body br button center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html label legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_HEADINGS = {f"h{i}" for i in range(1, 7)}
# Elements around an article; boxes that hold blocks; words in class, id or role that hint at what a box holds, and
# words that say nothing beside them.
_AROUND = set("nav footer aside menu button dialog fieldset label legend".split())
_BOXES = _AROUND | set("article body div form header main section".split())
_AROUND_WORDS = set(
    "ad ads adv advert adverts advertisement advertising alert banner breadcrumb breadcrumbs complementary consent cookie cookies copyright "
    "disclaimer footer gdpr legal login masthead menu modal nav navbar navigation newsletter notice notices notification overlay "
    "pager pagination popup prevnext privacy promo promoted recommended related share sharing sidebar sidenav signup skip social "
    "sponsored subscribe subscription toc toolbar topbar widget".split()
)
_READER_WORDS = set("comment comments commentlist disqus replies reply responses reviews".split())
_NEUTRAL_WORDS = set("area bar block bottom box bg col column container content group inner item left link links list message outer right section site text top wrap wrapper".split())
_ARTICLE, _EDGE, _HINT, _READERS, _HEADER, _HEADING, _ITEM = (1 << i for i in range(7))

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{'|'.join(_SILENT)})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|(?=<body\b)|\Z)"
    r"|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*|[^>]*)>|<[!?/][^>]*>",
    re.S | re.I,
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORDS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass
class Block:
    text: str
    words: int
    linked: int  # of these within links
    flags: int  # of the element itself
    box: int


@dataclass
class Box:
    """An element that holds blocks; `words` counts the running text in it, of blocks that are mostly no links, `own` what no box in it holds."""

    parent: int
    flags: int
    words: int = 0
    own: int = 0
    blocks: int = 0


def _hints(rest: str) -> int:
    """What class, id and role say: a name counts if all of its parts are known words, so `with-sidebar` says nothing."""
    out = 0
    low = rest.lower()
    if "class" not in low and "id" not in low and "role" not in low:
        return out
    if re.search(r"\bhidden\b|display\s*:\s*none", re.sub(r"\b(class|id)\s*=\s*(\"[^\"]*\"|'[^']*')", "", low)):
        out |= _EDGE
    for found in _NAMES.finditer(rest):
        for name in (found[1] or found[2] or found[3] or "").split():
            parts = set(_WORDS.findall(_CAMEL.sub(" ", name).lower()))
            if parts & _READER_WORDS and parts <= _READER_WORDS | _NEUTRAL_WORDS:
                out |= _READERS
            elif parts & _AROUND_WORDS and parts <= _AROUND_WORDS | _NEUTRAL_WORDS:
                out |= _HINT
            elif "header" in parts and parts <= {"header"} | _NEUTRAL_WORDS:
                out |= _HEADER
    return out


def _flags(name: str, rest: str) -> int:
    out = 0
    if name in ("html", "body"):
        return out
    if name in ("article", "main"):
        out |= _ARTICLE
    elif name in _AROUND:
        out |= _EDGE
    elif name == "form":
        out |= _HINT
    elif name == "header":
        out |= _HEADER
    elif name in _HEADINGS:
        out |= _HEADING
    elif name in ("li", "td", "th", "dd", "dt"):
        out |= _ITEM
    return out | _hints(rest) if rest else out


def blocks(page: str) -> tuple[list[Block], list[Box]]:
    """The flat text blocks of a page in their order, those without text left out, and the boxes they stand in."""
    out: list[Block] = []
    boxes = [Box(-1, 0)]
    stack: list[tuple[str, int, int]] = [("", 0, 0)]  # element, flags since its box, box
    parts: list[tuple[str, bool]] = []
    links, at = 0, 0

    def flush(flags: int, box: int) -> None:
        text = " ".join(html.unescape("".join(x for x, _ in parts)).split())
        if text:
            linked = sum(len(html.unescape(x).split()) for x, inside in parts if inside)
            out.append(Block(text, n := len(text.split()), min(n, linked), flags, box))
        parts.clear()

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            parts.append((page[at : m.start()], links > 0))
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if name in _BREAKS:
            flush(*stack[-1][1:])
        if m["end"]:
            if name == "a":
                links = max(0, links - 1)
            if any(x == name for x, *_ in stack):
                while stack.pop()[0] != name:
                    pass
        elif name == "a":
            links += 1
        elif name not in _VOID and not m["rest"].endswith("/"):
            if name in _BREAKS and stack[-1][0] in ("p", *_HEADINGS):  # a block ends an open paragraph or heading
                stack.pop()
            elif name == stack[-1][0] and name in ("li", "dt", "dd", "tr", "td", "th", "option"):
                stack.pop()
            flags, box = _flags(name, m["rest"]), stack[-1][2]
            if name in _BOXES or flags & (_HINT | _READERS):
                boxes.append(Box(box, flags & ~(_HEADING | _ITEM)))
                stack.append((name, flags & (_HEADING | _ITEM), len(boxes) - 1))
            else:
                stack.append((name, stack[-1][1] | flags, box))
        if name in _BREAKS:
            links = 0
    if at < len(page):
        parts.append((page[at:], links > 0))
    flush(*stack[-1][1:])
    for b in out:
        if 2 * b.linked < b.words:
            box = b.box
            boxes[box].own += b.words - b.linked
            while box >= 0:
                boxes[box].words += b.words - b.linked
                boxes[box].blocks += 1
                box = boxes[box].parent
    return out, boxes


#: Share of a page's running text that the box of its main text holds at least, or an article's element; and of a box's text, that
#: is its own if it is no wrapper.
MOST, ARTICLE, OWN = 0.45, 0.2, 0.1


def _bulk(boxes: list[Box]) -> list[int]:
    """The boxes that hold most of the running text, from the page down to the largest element of an article, or where there is
    none, to the first box that has text of its own."""
    around = [0]
    for b in boxes[1:]:
        around.append(around[b.parent] | b.flags)
    articles = [i for i, b in enumerate(boxes) if b.flags & _ARTICLE and not around[i] & (_EDGE | _READERS) and b.words > ARTICLE * boxes[0].words]
    if articles:
        out = [max(articles, key=lambda i: boxes[i].words)]
        while out[-1]:
            out.append(boxes[out[-1]].parent)
        return out[::-1]
    out, below = [0], {}
    for i, b in enumerate(boxes):
        below.setdefault(b.parent, []).append(i)
    while boxes[out[-1]].own <= OWN * boxes[out[-1]].words:
        best = max((i for i in below.get(out[-1], ()) if boxes[i].blocks > 1), key=lambda i: boxes[i].words, default=0)
        if not best or boxes[best].words < MOST * boxes[0].words:
            break
        out.append(best)
    return out


def _places(boxes: list[Box]) -> list[tuple[int, bool]]:
    """What each box and those around it say, and whether it lies in the innermost box of most of the text.

    A hint or a header around most of the text says nothing about it, nor does a hint around an article.
    """
    bulk = _bulk(boxes)
    main = bulk[-1]
    out: list[tuple[int, bool]] = []
    for i, b in enumerate(boxes):
        above, inside = out[b.parent] if b.parent >= 0 else (0, False)
        own = b.flags & ~(_HINT | _HEADER) if i in bulk else b.flags
        if own & _ARTICLE:
            above &= ~_HINT
        out.append((above | own, inside or i == main))
    return out


#: The features of a block, in the order of `features`.
FEATURES = (
    "words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "in_bulk",
    "in_article", "at_edge", "hinted", "by_readers", "in_header", "heading", "item",
)
#: How many of these tell of words and links.
DENSITY = 7


def features(page: list[Block], boxes: list[Box]) -> np.ndarray:
    """A row for each block: words and link density of it and its neighbours, whether it stands in the box of most of the running
    text, and what else it stands in."""
    words = np.array([b.words for b in (page[0], *page, page[-1])], float)  # the first and the last are their own neighbours
    density = np.array([b.linked / b.words for b in (page[0], *page, page[-1])], float)
    places = _places(boxes)
    inside = np.array([places[b.box][1] for b in page], float)
    flags = np.array([places[b.box][0] | b.flags for b in page], int)
    kinds = [flags & x > 0 for x in (_ARTICLE, _EDGE, _HINT, _READERS, _HEADER, _HEADING, _ITEM)]
    return np.stack([words[1:-1], density[1:-1], words[:-2], density[:-2], words[2:], density[2:], inside, *kinds], 1)


@dataclass
class Tree:
    """A node: rows whose feature is at most the limit go to `low`; a leaf has the share of main text in `share`."""

    share: float
    feature: int = -1
    limit: float = 0.0
    low: Tree | None = None
    high: Tree | None = None

    def keep(self, row: np.ndarray) -> bool:
        node = self
        while node.low is not None:
            node = node.low if row[node.feature] <= node.limit else node.high
        return node.share > 0.5


def grow(x: np.ndarray, y: np.ndarray, depth: int = 5, least: int = 12) -> Tree:
    """A decision tree by the Gini impurity."""
    node = Tree(float(y.mean()) if len(y) else 0.0)
    if depth == 0 or len(y) < 2 * least or node.share in (0.0, 1.0):
        return node
    best = (1e-9, 0, 0.0)
    whole = node.share * (1 - node.share) * len(y)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for limit in (values[:-1] + values[1:]) / 2:
            low = x[:, f] <= limit
            n = int(low.sum())
            if least <= n <= len(y) - least:
                a, b = y[low].mean(), y[~low].mean()
                gain = whole - a * (1 - a) * n - b * (1 - b) * (len(y) - n)
                if gain > best[0] + 1e-9:
                    best = (gain, f, float(limit))
    if best[0] <= 1e-9:
        return node
    _, node.feature, node.limit = best
    low = x[:, node.feature] <= node.limit
    node.low, node.high = grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least)
    return node


def variants(page: str) -> list[str]:
    """A labelled page as it is (twice, as most are), and without the help of its names, of its elements, and of both."""
    bare = re.sub(r"\s(?:class|id|role)=(?:\"[^\"]*\"|'[^']*')", "", page)
    plain = [re.sub(r"(</?)(?:article|main|nav|aside|footer|header|section|form)\b", r"\1div", x) for x in (page, bare)]
    return [page, page, bare, *plain]


def labelled_rows(pages: tuple[str, ...] = PAGES) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of labelled pages in their variants, which is the table that the tree is grown from."""
    xs, ys = [], []
    for page in (v for p in pages for v in variants(p)):
        found, boxes = blocks(page)
        xs.append(features(found, boxes))
        ys += [b.text[0] == "+" for b in found]
    return np.concatenate(xs), np.array(ys, float)


def trained(pages: tuple[str, ...] = PAGES) -> Tree:
    """A tree grown from labelled pages."""
    return grow(*labelled_rows(pages))


def main_text(page: str | None, tree: Tree) -> str:
    """The main text of a page, a line for each block."""
    found, boxes = blocks(page or "")
    return "\n".join(b.text for b, row in zip(found, features(found, boxes)) if tree.keep(row)) if found else ""


def extract_text(pages: DataFrame, labelled: tuple[str, ...] = PAGES) -> DataFrame:
    """page_id, url, text, n_chars (code points) of each row of pages (page_id, url, html).

    The page is cut into flat blocks at block elements and line breaks; scripts, styles, comments in the markup and the
    content of form controls are no text. Character references are decoded and white space in a block becomes one space.
    A decision tree grown from `labelled` keeps or drops each block, by the words and link densities of it and its
    neighbours, by whether most of the page's running text is around it, and by the elements and names it stands in; names are weak
    evidence, which does not count around most of the text. Kept blocks are joined by a line feed. A null or empty page, or one
    without main text, has an empty text. Rows are looked at one by one; null ids and repeated rows pass through.
    """
    tree = trained(labelled)

    def run(batches):
        for batch in batches:
            texts = [main_text(x, tree) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return rows.mapInArrow(tidy(run), "page_id long, url string, text string, n_chars long")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
