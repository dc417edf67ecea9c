"""Main text of web pages by the maximum-scoring subsequence.

A page is a sequence of words and tags. Words score positive and tags negative, by weights
learned from labelled pages; words in links and in elements that are boilerplate by their
nature (menus, forms, notices, ...) weigh against a region. One linear scan finds the
contiguous region with the largest sum. The region grows to the element that holds all of
it (its nearest article, if it lies in one), and the text of that element is returned,
without the boilerplate elements inside.

Labelled pages are those that mark their content with an ``article`` or ``main`` element: a
word's or tag's weight is the logarithm of its rate inside over its rate outside, kept
positive for words and negative for tags.

A class or id marks boilerplate by its words, unless they deny it (``no-sidebar``) or the
element stands around the page's own text: it holds a ``main``, or all articles of a page
without one, or, if the mark tells a layout's state (``sidebar-right``), most of the words.

Text: character references decoded, white space within a block one space, blocks trimmed,
empty ones left out, the rest joined by a line end in page order. ``br`` is white space.

Defined results: null and empty pages, pages without words outside tags, and pages that hold
nothing but boilerplate give an empty text; unclosed elements end with their parent; a cut
tag at the end is dropped, a comment or script without end takes the rest of the page. Ids
and other columns play no part, so they may be null or repeat.

Scale: two narrow passes over the pages. The first sums a few dozen counts per partition; the
second needs no shuffle. Time is linear in a page's length, however long.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import per_text

#: Elements without content of their own.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is raw text up to their end tag.
RAW = frozenset("script style textarea title noscript template xmp iframe noembed noframes svg math".split())
#: Elements that do not break a line.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Elements that are no part of a page's main text.
BOILERPLATE = frozenset(
    "nav header footer aside form script style noscript template iframe button select option textarea input dialog menu svg math canvas object audio video map head title fieldset datalist noembed noframes".split()
)
#: Words in ``class`` and ``id`` of elements that are none either.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adbox adslot banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar side aside "
    "footer header masthead comment comments commentlist discussion respond reply replies disqus cookie cookies consent gdpr notice notices notification alert popup modal overlay "
    "share sharing social related recommended newsletter subscribe subscription signup login paywall widget toolbar pagination pager skip hidden".split()
)
#: Those of elements that list articles of their own.
LISTS = frozenset("comment comments commentlist discussion respond reply replies disqus related recommended".split())
#: Pieces before a mark that deny it, and behind it that tell how a layout around it stands.
DENY = frozenset("has have no not non with without".split())
STATES = frozenset("left right top bottom inside outside fixed sticky static open opened closed close collapsed expanded shown visible on off enabled disabled active".split())
AROUND = frozenset("layout page container wrap wrapper template grid columns column".split())
WEAK, STRONG, LISTING = 1, 2, 3
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
CONTENT = frozenset(("article", "main"))

#: An element that starts ends an open one, if that lies above none of the bounds.
_BLOCKS_END_P = frozenset(
    "address article aside blockquote details dialog div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "body": ("head",)}
_BOUND = frozenset("ul ol dl table select article section div body html td th blockquote main".split())

_MARKUP = re.compile(r"<!--|<!|<\?|</?[A-Za-z][^\s/>]*")
#: One attribute after the other, each with its value, so that no value is taken for a name.
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
_NAMES = re.compile("class|id|role|hidden", re.I)
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_PIECE = re.compile(r"[^a-z]+")

WORD, LINK = "word", "word in a link"
#: Used where no page is labelled.
DEFAULT_WEIGHTS = {WORD: 1.0, LINK: 0.2, "tag": -2.0}


def _tag_end(page: str, at: int) -> int:
    """Place behind the ``>`` of a tag; quoted values may hold one. -1: the tag is cut."""
    while True:
        close = page.find(">", at)
        if close < 0:
            return -1
        quote = min((q for q in (page.find('"', at, close), page.find("'", at, close)) if q >= 0), default=-1)
        if quote < 0:
            return close + 1
        if page[quote - 1] not in "= \n\t":
            at = quote + 1
            if at > close:
                return close + 1
            continue
        other = page.find(page[quote], quote + 1)
        if other < 0:
            return close + 1
        at = other + 1


def attributes_of(text: str) -> list[tuple[str, str]]:
    """Names, lowered, and values of the attributes that say what an element is for."""
    if not text or not _NAMES.search(text):
        return []
    found = ((m[1].lower(), m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text))
    return [(name, value) for name, value in found if name in ("class", "id", "role", "hidden", "aria-hidden")]


def is_boilerplate(tag: str, attributes: list[tuple[str, str]]) -> bool:
    """Whether an element is boilerplate whatever it holds."""
    if tag in BOILERPLATE:
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    for name, value in attributes:
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "role" and value.lower() in ROLES:
            return True
    return False


def mark_of(tag: str, attributes: list[tuple[str, str]]) -> int:
    """What class and id say: 0, or the strongest of WEAK (a mark with the state of a layout),
    STRONG and LISTING. Denied marks (``has-sidebar``) say nothing."""
    named = [value for name, value in attributes if name in ("class", "id")]
    if not named or tag in ("html", "body") or tag in CONTENT and all("comment" not in value.lower() for value in named):
        return 0
    found = 0
    for value in named:
        for token in value.split():
            pieces = [p for p in _PIECE.split(_CAMEL.sub("-", token).lower()) if p]
            for k, piece in enumerate(pieces):
                if piece in DENY:
                    break
                if piece in MARKS:
                    behind = pieces[k + 1 :]
                    listing = piece in LISTS
                    weak = behind and all(p in STATES or p in AROUND and not listing for p in behind)
                    found = max(found, WEAK if weak else LISTING if listing else STRONG)
    return found


class Node:
    """An element: whether it is boilerplate, stands in a link, in marked content; what its
    class and id say; its place in the order of start tags."""

    __slots__ = ("tag", "parent", "bad", "start", "depth", "link", "content", "mark")

    def __init__(self, tag, parent, bad, start, mark=0):
        self.tag, self.parent, self.bad, self.start, self.mark = tag, parent, bad, start, mark
        self.depth = parent.depth + 1 if parent else 0
        self.link = tag == "a" or tag in INLINE and parent.link
        self.content = tag in CONTENT or bool(parent and parent.content)


def read_page(page: str) -> list[tuple]:
    """The page in order: ``(text, None, node)`` for text, ``(None, tag, node)`` for tags,
    ``node`` being the element around the text or the one the tag opens or ends."""
    root = node = Node("", None, False, 0)
    out: list[tuple] = []
    nodes = [root]
    opened: Counter = Counter()  # open elements by name, so that stray end tags cost nothing
    at = 0
    while at < len(page):
        mark = _MARKUP.search(page, at)
        stop = mark.start() if mark else len(page)
        if stop > at:
            out.append((page[at:stop], None, node))
        if not mark:
            break
        head = mark[0]
        if head == "<!--":
            close = page.find("-->", mark.end())
            at = close + 3 if close >= 0 else len(page)
            continue
        close = _tag_end(page, mark.end())
        if close < 0:
            break
        at = close
        if head in ("<!", "<?"):
            continue
        if head[1] == "/":
            tag = head[2:].lower()
            if opened[tag]:
                while node.tag != tag:
                    opened[node.tag] -= 1
                    node = node.parent
                out.append((None, tag, node))
                opened[tag] -= 1
                node = node.parent
            continue
        tag = head[1:].lower()
        holder = _closed(node, tag, opened)
        while node is not holder:
            opened[node.tag] -= 1
            node = node.parent
        attributes = page[mark.end() : close - 1]
        known = attributes_of(attributes)
        bad = node.bad or is_boilerplate(tag, known)
        child = Node(tag, node, bad, len(out), 0 if bad else mark_of(tag, known))
        nodes.append(child)
        out.append((None, tag, child))
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b", re.I).search(page, at)
            if not end:
                break
            if not child.bad:
                out.append((page[at : end.start()], None, child))
            at = _tag_end(page, end.end())
            if at < 0:
                break
        elif tag not in VOID and not attributes.endswith("/"):
            node = child
            opened[tag] += 1
    if any(n.mark for n in nodes):
        _heed_marks(out, nodes)
    return out


def _heed_marks(pieces: list[tuple], nodes: list[Node]) -> None:
    """Marked elements are boilerplate with all below, but for those around the page's own
    text: a ``main``, all articles, or (a weak mark) most words that no strong mark covers."""
    place = {id(n): k for k, n in enumerate(nodes)}
    above = [place[id(n.parent)] if n.parent else 0 for n in nodes]  # parents come first
    words, free, mains, articles = ([0] * len(nodes) for _ in range(4))
    covered, within = [False] * len(nodes), [False] * len(nodes)
    for k, n in enumerate(nodes):
        covered[k] = n.mark >= STRONG or k > 0 and covered[above[k]]
        within[k] = k > 0 and (within[above[k]] or nodes[above[k]].tag == "article")
        if n.tag in CONTENT and not n.bad and n.mark < STRONG:
            mains[k] = int(n.tag == "main")
            articles[k] = int(n.tag == "article" and not within[k])
    for text, _, n in pieces:
        if text and not n.bad:
            k, size = place[id(n)], len(text.split())
            words[k] += size
            free[k] += 0 if covered[k] else size
    for k in range(len(nodes) - 1, 0, -1):
        for sums in (words, free, mains, articles):
            sums[above[k]] += sums[k]
    for k, n in enumerate(nodes):
        holds = not mains[0] and articles[k] and articles[k] == articles[0]
        around = mains[k] or (holds or 2 * free[k] > free[0] if n.mark == WEAK else n.mark == STRONG and holds and 2 * words[k] > words[0])
        n.bad = n.bad or n.mark > 0 and not around or k > 0 and n.parent.bad


def _closed(node: Node, tag: str, opened: Counter) -> Node:
    """The element a new one goes into, after those that it ends by its start."""
    ends = [t for t in (*_ENDS.get(tag, ()), *(("p",) if tag in _BLOCKS_END_P else ())) if opened[t]]
    holder = node
    while ends and holder.parent:
        if holder.tag in ends:
            return holder.parent
        if holder.tag in _BOUND:
            break
        holder = holder.parent
    return node


def _inside(node: Node, tags: frozenset) -> Node | None:
    """The nearest element around that is one of ``tags``."""
    while node and node.tag not in tags:
        node = node.parent
    return node


def counts_of(page: str) -> Counter:
    """``(kind, inside)`` of words and tags of a page that marks its content."""
    pieces = read_page(page)
    if not any(tag in CONTENT for _, tag, _ in pieces if tag):
        return Counter()
    found: Counter = Counter()
    for text, tag, node in pieces:
        inside = not node.bad and node.content
        if tag:
            found[tag, inside] += 1
        elif n := len(text.split()):
            found[LINK if node.link else WORD, inside] += n
    return found


def weights_from(counts: dict[tuple[str, bool], int]) -> dict[str, float]:
    """Words positive and tags negative, by their rates inside and outside of content."""
    total = {side: sum(n for (_, s), n in counts.items() if s == side) for side in (True, False)}
    if not total[True] or not total[False]:
        return dict(DEFAULT_WEIGHTS)
    out = {}
    for kind in {k for k, _ in counts}:
        inside, outside = counts.get((kind, True), 0) + 1, counts.get((kind, False), 0) + 1
        rate = math.log(inside / (total[True] + 1)) - math.log(outside / (total[False] + 1))
        out[kind] = max(0.1, rate) if kind in (WORD, LINK) else min(-0.5, rate)
    return {**DEFAULT_WEIGHTS, **out}


def best_region(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous run with the largest sum, the first and then the
    shortest of equals; ``(0, 0)`` if no sum is above zero."""
    best, region, total, start = 0.0, (0, 0), 0.0, 0
    for k, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, k
        total += score
        if total > best:
            best, region = total, (start, k + 1)
    return region


def main_text(page: str | None, weights: dict[str, float]) -> str:
    if not page:
        return ""
    pieces = read_page(page)
    default = weights["tag"]
    scores = []
    for text, tag, node in pieces:
        if tag:
            scores.append(weights.get(tag, default))
        elif text.isspace():
            scores.append(0.0)
        else:
            words = len(text.split())
            scores.append(-words * weights[WORD] if node.bad else words * weights[LINK if node.link else WORD])
    start, end = best_region(scores)
    if start == end:
        return ""
    holders = [node for text, _, node in pieces[start:end] if text and not node.bad and not text.isspace()]
    # All lie in what holds the first and the last of them in the order of start tags.
    top = _common(min(holders, key=lambda n: n.start), max(holders, key=lambda n: n.start))
    top = _inside(top, frozenset(("article",))) or _inside(top, CONTENT) or _block(top)
    return block_text(pieces, top)


def _common(a: Node, b: Node) -> Node:
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
    return a


def _block(node: Node) -> Node:
    """The nearest element that can hold several blocks."""
    while node.parent and (node.tag in INLINE or node.tag in ("p", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "ul", "ol", "dl", "dt", "dd", "figure", "figcaption")):
        node = node.parent
    return node


def block_text(pieces: list[tuple], top: Node) -> str:
    """Text of an element's blocks without the boilerplate inside."""
    blocks: list[str] = []
    current: list[str] = []
    within: dict[int, bool] = {}

    def under(node: Node) -> bool:
        path = []
        while node is not None and id(node) not in within and node is not top:
            path.append(node)
            node = node.parent
        answer = node is top or node is not None and within[id(node)]
        within.update((id(n), answer) for n in path)
        return answer

    def flush():
        words = html.unescape("".join(current)).split()
        if words:
            blocks.append(" ".join(words))
        current.clear()

    for text, tag, node in pieces:
        if not under(node):
            continue
        if tag:
            if tag in ("br", "wbr"):
                current.append(" " if tag == "br" else "")
            elif tag not in INLINE:
                flush()
        elif not node.bad:
            current.append(text)
    flush()
    return "\n".join(blocks)


def learn_weights(pages: DataFrame) -> dict[str, float]:
    """Weights from all pages that mark their content. Unknown tag names are counted
    together, so the result has a few dozen rows, whatever the pages hold."""
    known = VOID | RAW | INLINE | BOILERPLATE | _BLOCKS_END_P | _BOUND | {"html", "head", "body", "li", "dt", "dd", "tr", "thead", "tbody", "tfoot", "caption", "figcaption", "summary", WORD, LINK}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for page in batch.column(0).slice(at, 64).to_pylist():
                    for (kind, inside), n in counts_of(page or "").items():
                        total[kind if kind in known else "tag", inside] += n
        keys = sorted(total)
        yield pa.record_batch([pa.array([k for k, _ in keys], pa.string()), pa.array([i for _, i in keys], pa.bool_()), pa.array([total[k] for k in keys], pa.int64())], ["kind", "inside", "n"])

    summed = pages.select("html").mapInArrow(count, "kind string, inside boolean, n long").groupBy("kind", "inside").agg(F.sum("n").alias("n"))
    return weights_from({(r["kind"], r["inside"]): r["n"] for r in summed.collect()})  # known kinds only


def extracted(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Per page: ``page_id, url, text, n_chars``."""
    weights = learn_weights(pages) if weights is None else weights

    def make():
        return lambda texts: [[main_text(t, weights) for t in texts]]

    found = pages.select("page_id", "url", per_text(pa.schema([("text", pa.string())]), make)("html")["text"].alias("text"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
