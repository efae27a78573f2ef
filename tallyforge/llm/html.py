"""Main text of web pages: the best contiguous region by word and tag scores, cut to its content blocks."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: What a region pays to go on behind an element that is dropped outside the content: less than a word.
DROPPED_COST = 0.5
#: Bound of the training sample: pages that mark their content themselves, in the order of their hashes.
SAMPLE_PAGES = 2_000

# Element names by role, and words that name boilerplate in class, id and role attributes.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script style title textarea noscript template iframe svg"
BLOCKS = set(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section "
    "select summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = set(
    "aside audio button canvas datalist dialog footer form head iframe input label menu nav noscript object option "
    "script select style svg template textarea title video".split()
)
CONTENT = {"article", "main"}
#: An open element ends where one of these begins inside it.
ENDED_BY = {"p": BLOCKS - {"br"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
ENDED_BY |= {"td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}}
_SUSPECT = (
    r"(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|popup|modal|cookies?|consent|notice|gdpr|"
    r"newsletter|subscribe|signup|login|sidebar|side|widget|nav\w*|menu|breadcrumbs?|pagination|pager|toolbar|"
    r"header|masthead|foot\w*|copyright|comments?|respond|replies|disqus|reactions|related|recommend\w*|share\w*|"
    r"social|follow|tags?|meta|complementary|contentinfo|navigation|search)"
)
SUSPECT = re.compile(rf"(?:^|[\s_-]){_SUSPECT}(?:$|[\s_-])", re.I)
#: A name of such words only, which names its element as a whole.
WHOLE = re.compile(rf"(?:^|\s){_SUSPECT}(?:[_-]+{_SUSPECT})*(?:$|\s)", re.I)
HEADER = re.compile(r"(?<![^\s_-])header(?![^\s_-])", re.I)
#: Blocks of running text, which adjoin others of the element around them.
RUNNING = set("address blockquote body br center h1 h2 h3 h4 h5 h6 head header hgroup hr html p pre".split())
NAMES = VOID | BLOCKS | DROPPED | CONTENT | set("a abbr b bdi bdo cite code del dfn em i ins kbd mark q s samp small "
                                                "span strong sub sup time u var".split())  # fmt: skip

TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<(?P<raw>" + RAW.replace(" ", "|") + r")\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<close2>/?)(?P<name2>[a-z][^\s/>]*)(?P<rest2>[^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.I | re.S,
)
MARKS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


@dataclass(eq=False)
class Element:
    """An open or closed element: ``gone`` says why it may be boilerplate, ``dropped`` whether it goes.

    ``home`` is the article or main around it, ``box`` the innermost element that is no running text.
    """

    name: str
    parent: Element | None = None
    suspect: bool = False
    gone: str = ""
    words: int = 0
    holds: set[str] = field(default_factory=set)
    dropped: bool = False

    def __post_init__(self) -> None:
        up = self.parent
        self.home = self if self.name in CONTENT else up and up.home
        self.box = self if up is None or self.name in BLOCKS - RUNNING else up.box
        self.around = self if up is None or self.name in BLOCKS or self.name == "a" else up.around


@dataclass
class Item:
    """A text or tag of a page.

    ``inside``: within a content element; ``dropped``: in or of an element that
    is boilerplate by name; ``edge``: the tag that opens such an element; ``at``:
    the innermost element it is in.
    """

    key: str
    text: str = ""
    words: int = 0
    block: bool = False
    inside: bool = False
    dropped: bool = False
    edge: bool = False
    at: Element | None = None


@dataclass
class Weights:
    """Score of a word by the element around it, and of a tag; unseen keys go by their name."""

    seen: dict[str, float] = field(default_factory=dict)

    def of(self, item: Item) -> float:
        """Words score above zero, the more so in elements that hold content; tags below, the more so outside it.

        What is boilerplate by name goes anyway, so it costs nothing inside the content and little outside it.
        """
        if item.dropped:
            return -DROPPED_COST if item.edge and not item.inside else 0.0
        share = self.seen.get(item.key)
        if share is None:
            share = 0.1 if _suspicious(item.key) else 0.9
        return item.words * max(0.01, 2 * share - 1) if item.words else -0.1 - 5 * (1 - share)


def _suspicious(key: str) -> bool:
    return key.endswith("!") or key.rstrip("!").split(":")[-1].strip("/") in DROPPED | {"header", "a", "li", "ul"}


def _gone(name: str, marks: str, inside: bool) -> str:
    """Why an element may be boilerplate: by its ``tag``, as a ``whole`` or in ``part`` by its names, or not at all."""
    if name in {"html", "body", *CONTENT}:
        return ""
    if name in DROPPED - {"form"} or (name == "header" and not inside):
        return "tag"
    if WHOLE.search(marks) and not (inside and name == "header"):
        return "whole"
    if inside:
        marks = HEADER.sub(" ", marks)
    return "part" if name == "form" or SUSPECT.search(marks) else ""


def _settle(elements: list[Element]) -> None:
    """Decide which elements are dropped, parents before children.

    None goes that holds main. A form, or an element that is named so only in
    part, as a wrapper of the page may be, also stays when it holds an article
    or most of the page's words.
    """
    for e in reversed(elements[1:]):
        e.parent.words += e.words
        e.parent.holds |= e.holds | ({e.name} & CONTENT)
    for e in elements[1:]:
        holds = "main" in e.holds or (e.gone == "part" and (e.holds or 2 * e.words > elements[0].words))
        if holds:
            e.suspect = False
        e.dropped = e.parent.dropped or (bool(e.gone) and not holds)
        e.suspect = e.suspect or e.parent.suspect


def items_of(page: str) -> list[Item]:
    """Tags and texts of a page in order, with raw-text elements and comments left out."""
    items: list[Item] = []
    elements = [Element("body")]
    stack = list(elements)
    opened: Counter[str] = Counter()  # open elements by name, so that an end tag of none needs no look at the stack

    def add_text(raw: str) -> None:
        text = html.unescape(raw) if "&" in raw else raw
        words = len(text.split())
        if text:
            stack[-1].words += words
            items.append(Item("", text, words, at=stack[-1]))

    at = 0
    for token in TOKEN.finditer(page):
        if token.start() > at:
            add_text(page[at : token.start()])
        at = token.end()
        name = (token["name"] or token["name2"] or "").lower()
        if not name:
            continue
        closing = bool(token["close"] or token["close2"])
        known = f"{'/' * closing}{name if name in NAMES else 'other'}"
        if closing:
            ended = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].name == name), 0) if opened[name] else 0
            items.append(Item(known, block=name in BLOCKS, at=stack[-1]))
            if ended:
                items[-1].at = stack[ended - 1]
                opened.subtract(e.name for e in stack[ended:])
                del stack[ended:]
            continue
        while len(stack) > 1 and name in ENDED_BY.get(stack[-1].name, ()):
            opened[stack.pop().name] -= 1
        rest = token["rest"] or token["rest2"] or ""
        marks = " ".join(m[1] or m[2] or m[3] or "" for m in MARKS.finditer(rest)) if "=" in rest else ""
        gone = _gone(name, marks, stack[-1].home is not None)
        own = Element(name, stack[-1], gone in {"whole", "part"} and name != "form", gone)
        elements.append(own)
        items.append(Item(known, block=name in BLOCKS, edge=True, at=own))
        if name not in VOID and not rest.endswith("/"):
            stack.append(own)
            opened[name] += 1
    if at < len(page):
        add_text(page[at:])
    _settle(elements)
    for item in items:
        own = item.at
        item.inside, item.dropped = own.home is not None, own.dropped
        item.edge = item.edge and own.dropped and not own.parent.dropped
        if item.text:
            item.key = f"word:{own.around.name}{'!' * own.suspect}"
        elif item.key[0] != "/":
            item.key += "!" * (own.suspect and not own.parent.suspect)
    return items


def best_region(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous run of the largest sum above zero, the first of equals; (0, 0) if none."""
    best, span, total, start = 0.0, (0, 0), 0.0, 0
    for i, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > best:
            best, span = total, (start, i + 1)
    return span


def _whole(items: list[Item], start: int, end: int) -> tuple[int, int]:
    """The region with the rest of the article or main it begins and ends in, or adjoining text of its element."""
    texts = [i for i in range(start, end) if items[i].words and not items[i].dropped]
    if not texts:
        return start, end
    first, last = items[texts[0]].at, items[texts[-1]].at
    if first.home is None:
        while start > 0 and (items[start - 1].dropped or items[start - 1].at.box is first.box):
            start -= 1
    if last.home is None:
        while end < len(items) and (items[end].dropped or items[end].at.box is last.box):
            end += 1
    if first.home is not None or last.home is not None:
        for i, item in enumerate(items):
            if item.at.home is not None and item.at.home is first.home:
                start = min(start, i)
            if item.at.home is not None and item.at.home is last.home:
                end = max(end, i + 1)
    return start, end


def main_text(page: str | None, weights: Weights) -> str:
    """Blocks of the best region, without boilerplate elements inside it, joined by line ends."""
    if not page:
        return ""
    items = items_of(page)
    start, end = _whole(items, *best_region([weights.of(item) for item in items]))
    blocks, held = [], []
    for item in items[start:end]:
        if item.text:
            if not item.dropped:
                held.append(item.text)
        elif item.block:
            blocks.append("".join(held))
            held = []
    blocks.append("".join(held))
    return "\n".join(text for block in blocks if (text := " ".join(block.split())))


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> Weights:
    """Weights from pages that label their content with an article or main element.

    At most ``SAMPLE_PAGES`` such pages are taken, by the hash of their ids;
    Spark counts how often each tag, and words in each kind of element, lie
    inside and outside the content, without what is dropped by name. Keys are element names, so their number is
    bounded. Without labelled pages, names alone decide.
    """
    labelled = pages.where(F.lower(F.col(html_col)).rlike("<(article|main)[\\s>]"))
    chosen = labelled.select(F.col(id_col).alias("id")).orderBy(F.xxhash64("id"), "id").limit(SAMPLE_PAGES).distinct()
    sample = labelled.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).join(F.broadcast(chosen), "id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, bool], int] = {}
        for batch in batches:
            for page in batch.column(0).to_pylist():
                for item in items_of(page):
                    if item.dropped:
                        continue
                    at = item.key, item.inside
                    seen[at] = seen.get(at, 0) + (item.words if item.text else 1)
        keys, inside = [k for k, _ in seen], [i for _, i in seen]
        yield pa.RecordBatch.from_pydict({"key": keys, "inside": inside, "n": pa.array(seen.values(), pa.int64())})

    counted = sample.select("html").mapInArrow(count, "key string, inside boolean, n bigint")
    rows = counted.groupBy("key").agg(
        F.sum(F.col("n") * F.col("inside").cast("int")).alias("held"), F.sum("n").alias("n")
    )
    return Weights({r["key"]: (r["held"] + 0.5) / (r["n"] + 1.0) for r in rows.collect()})


def text_column(weights: Weights):
    """A column function from html to main text."""

    @F.arrow_udf(StringType())
    def of(pages: pa.Array) -> pa.Array:
        return pa.array([main_text(p.as_py(), weights) for p in pages], pa.string())

    return of


def extract(pages: DataFrame, weights: Weights, keep: list, html_col: str = "html") -> DataFrame:
    """Columns ``keep`` of each row with ``text`` and ``n_chars``, its code points.

    Null and empty pages, and pages without content, give an empty text;
    pages cut off in a tag, comment or script are read up to there. Repeated
    rows come back alike. No shuffle.
    """
    kept = pages.select(*keep).columns
    found = pages.select(*keep, text_column(weights)(F.col(html_col)).alias("main_text"))
    return found.select(
        *[f"`{c}`" for c in kept], F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars")
    )
