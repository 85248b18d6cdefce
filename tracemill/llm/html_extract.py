"""Main text of web pages by consensus of a host's pages on the path of its content container.

Each page's containers are scored; the best one votes for its generalised path (tags with their class words, without
numbers). Votes are summed per host in Spark, and every page is cut again with the path that won on its host; a page
without such a container keeps its own best one, and so does a page of another template: one whose containers of the
winning path hold little beside its best one. A title and a standfirst before the container belong to it.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm import common

BLOCKS = frozenset((
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main nav ol option p pre section select summary table tbody td tfoot th thead title tr ul"
).split())
#: Elements without an end tag; elements whose text is not part of a page's text; those that hold raw text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("nav header footer aside form script style noscript template iframe object svg canvas button select textarea dialog head menu".split())
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "template")
CONTAINERS = frozenset("article main section div td body".split())
#: Class words or ids that are, or begin with, a name of what is no part of an article; those of them that name texts of readers.
NOISE = re.compile(
    r"(?:^| )(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|sidebar\w*|side|aside|footer|header|masthead|comments?|respond|"
    r"replies|disqus|cookies?\w*|consent|gdpr|notices?|popup|modal|newsletter|subscribe|signup|login|share|sharing|social|related|recommend\w*|widget\w*|"
    r"pagination|pager|toolbar|copyright|legal|disclaimer|alert)(?:$|[-_ ])"
)
READERS = re.compile(r"(?:^| )(?:comments?|respond|replies|disqus)(?:$|[-_ ])")
#: Names that count after other parts of a class word too (``post-comments``), unless the part before only says whether there is one.
PREFIX = r"(?:^| )(?:(?!(?:no|has|have|with|without|hide|show|allow)[-_])[a-z0-9]+[-_]+)+"
INNER_READERS = re.compile(PREFIX + r"(?:comments?|respond|replies|disqus)(?:$|[-_ ])")
INNER_NOISE = re.compile(
    PREFIX + r"(?:ads?|adverts?|advertisement|promos?|sponsors?|nav|navigation|menu|breadcrumbs?|sidebar|footer|newsletter|subscribe|signup|login|share|sharing|"
    r"social|related|pagination|pager|toolbar|popup|modal|copyright|disclaimer)(?:$|[-_ ])|(?:^| )(?:site|page|global|top|main)[-_]header(?:$| )"
)
DEPTH = 100
#: Containers of the winning path worth less than this share of the page's best one hardly hold its text.
FAIR = 0.25
#: A best container without this share of the page's text outside links gives way to the next one around it.
MOST = 0.75
TITLE_HEADER = ("article", "main")
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
#: An element that opens closes open ones of these tags up to the nearest of the others.
CLOSES = {"p": ({"p"}, set()), "li": ({"li", "p"}, {"ul", "ol", "menu"}), "tr": ({"tr", "td", "th", "p"}, {"table"}), "td": ({"td", "th", "p"}, {"tr", "table"}),
          "th": ({"td", "th", "p"}, {"tr", "table"}), "dt": ({"dt", "dd", "p"}, {"dl"}), "dd": ({"dt", "dd", "p"}, {"dl"}), "option": ({"option"}, {"select"})}
ENDS_P = BLOCKS - {"br", "li", "td", "th", "tr", "dd", "dt", "option", "tbody", "thead", "tfoot", "caption", "legend", "summary", "body", "head", "html", "title"}


@dataclass
class Node:
    tag: str
    path: str
    noise: bool
    parent: Node | None
    blocks: list[str] = field(default_factory=list)
    chars: int = 0
    linked: int = 0
    skips: bool = False
    hushes: bool = False
    readers: bool = False
    #: Where it begins and ends in the page, and how much text outside links came before these places.
    begin: int = 0
    end: int = 0
    before: int = 0
    until: int = 0


def general(tag: str, attributes: str) -> tuple[str, bool, bool, bool]:
    """``tag.class`` with numbers taken off the class words; whether class, id or role name something else than content;
    whether they name texts of readers; whether the element is hidden.
    """
    found = {name.lower(): a or b or c for name, a, b, c in ATTRIBUTE.findall(attributes)} if attributes else {}
    classes = [re.sub(r"[-_]?\d+", "", x.lower()) for x in html.unescape(found.get("class", "")).split()]
    named = " ".join([*classes, found.get("id", "").lower()])
    readers = (READERS.search(named) or INNER_READERS.search(named)) is not None
    noise = readers or (NOISE.search(named) or INNER_NOISE.search(named)) is not None or found.get("role", "").lower() in ("navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert")
    hidden = "hidden" in found or re.search(r"(?:^|\s)hidden(?:\s|$)", ATTRIBUTE.sub("", attributes)) is not None or "display:none" in found.get("style", "").replace(" ", "").lower()
    return ".".join([tag, *sorted(set(filter(None, classes)))]), noise, readers, hidden


def wrappers(named: list[Node], articles: list[Node], chars: int) -> frozenset[int]:
    """Places of the elements named as noise that hold the longest article or main, or most of the page's text outside links.

    Those named for texts of readers must hold every article and most of the text: such texts are often articles and long.
    """
    own: dict[int, int] = {}  # text of an article without that of articles in it
    above: list[Node] = []
    for a in articles:
        while above and above[-1].end <= a.begin:
            above.pop()
        own[a.begin] = a.until - a.before
        if above:
            own[above[-1].begin] -= own[a.begin]
        above.append(a)
    places = sorted(p for p, n in own.items() if n > 0)
    longest = [p for p in places if own[p] == max(own.values())]

    def holds(node: Node, of: list[int]) -> int:
        return bisect_left(of, node.end) - bisect_left(of, node.begin)

    def kept(node: Node) -> bool:
        most = 2 * (node.until - node.before) > chars
        if node.readers:
            return most and 0 < len(places) == holds(node, places)
        return most or holds(node, longest) > 0

    return frozenset(n.begin for n in named if kept(n))


class Page:
    """Text blocks of a page under each of its containers, without skipped elements and noise that is no wrapper of the text."""

    def __init__(self, source: str):
        kept = self._read(source, frozenset())
        if kept:
            self._read(source, kept)

    def _read(self, source: str, kept: frozenset[int]) -> frozenset[int]:
        """Read the page with the noise at the ``kept`` places; the places of what should be kept."""
        self.nodes: list[Node] = []
        self.leads: list[tuple[Node, Node, str]] = []  # (element, container right around it, text) of first headings and paragraphs
        self.root = Node("", "", False, None)
        stack, quiet, buffer, links, at = [self.root], 0, [], 0, 0
        holders = [self.root]  # open containers; beyond DEPTH of them a container counts as part of its parent
        named, articles, hushed, chars = [], [], 0, 0  # without what is skipped by its tag or hidden

        def flush() -> None:
            text = " ".join(html.unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                for n in reversed(stack):
                    if n.tag in ("h1", "p"):
                        self.leads.append((n, holders[-1], text))
                    if n.tag in CONTAINERS or n.tag in ("h1", "p"):
                        break
                for n in holders:
                    n.blocks.append(text)
                    n.chars += len(text)
                    n.linked += len(text) if links else 0

        def close(index: int) -> None:
            nonlocal quiet, hushed, links
            if any(n.tag in BLOCKS for n in stack[index:]):
                flush()
            for n in reversed(stack[index:]):
                links -= n.tag == "a"
                quiet -= n.skips
                hushed -= n.hushes
                n.end, n.until = at, chars
                if n is holders[-1]:
                    holders.pop()
            del stack[index:]

        while at < len(source):
            found = TOKEN.search(source, at)
            text = source[at:found.start() if found else len(source)]
            if text and not quiet:
                buffer.append(text)
            if text and not hushed and not links:
                chars += len(text.strip())
            if not found:
                break
            at = found.end()
            tag = (found[2] or "").lower()
            if not tag:
                continue
            if found[1]:
                index = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
                if index:
                    close(index)
                elif tag in BLOCKS:
                    flush()
                continue
            if tag in BLOCKS:
                flush()
            ends, walls = CLOSES.get(tag, (set(), set()))
            if tag in ENDS_P:
                ends = ends | {"p"}
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in walls or stack[i].tag in CONTAINERS:
                    break
                if stack[i].tag in ends:
                    close(i)
            if tag in VOID:
                continue
            step, noise, readers, hidden = general(tag, found[3])
            holds = tag in CONTAINERS and len(holders) <= DEPTH
            node = Node(tag, f"{stack[-1].path}/{step}" if holds else stack[-1].path, noise, stack[-1], readers=readers, begin=found.start(), before=chars)
            if found[3].rstrip().endswith("/") and tag not in CONTAINERS:
                continue
            stack.append(node)
            links += tag == "a"
            inner_header = tag == "header" and any(n.tag in TITLE_HEADER for n in stack[:-1])
            bare = tag in ("html", "body", "article", "main")
            node.hushes = (tag in SKIPPED and not inner_header) or (hidden and not bare)
            hushed += node.hushes
            if noise and not bare and not hushed:
                named.append(node)
            if tag in TITLE_HEADER and not hushed:
                articles.append(node)
            if node.hushes or (noise and not bare and node.begin not in kept):
                node.skips = True
                quiet += 1
            if tag in CONTAINERS and not quiet and len(holders) <= DEPTH:
                self.nodes.append(node)
                holders.append(node)
            if tag in RAW:
                end = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
                at = end.start() if end else len(source)
        flush()
        for n in stack:
            n.end, n.until = len(source), chars
        return wrappers(named, articles, chars) if named else frozenset()

    def best(self) -> Node:
        """The container with the most text outside links, the deepest of equals.

        If much of the page's text lies beside it and it is no article or main, the least container around it that holds most.
        """
        node = max(self.nodes, key=lambda n: (_worth(n), n.path.count("/")), default=self.root)
        most, places = MOST * _plain(self.root), {id(n) for n in self.nodes}
        while node is not self.root and node.tag not in TITLE_HEADER and _plain(node) < most:
            node = node.parent
            while node is not self.root and id(node) not in places:
                node = node.parent
        return node

    def text(self, path: str | None) -> str:
        """Blocks of all containers with the path, in page order, after the title and standfirst before them.

        The page's own best container is used without a match, and where the matches hold too little beside it and it is
        not in something named as noise that they are not in.
        """
        best = self.best()
        chosen = [n for n in self.nodes if n.path == path and n.blocks]
        outer = [n for n in chosen if not any(m is not n and _within(n, m) for m in chosen)]
        if not outer or (sum(map(_worth, outer)) < FAIR * _worth(best) and not _noisy(best, outer)):
            outer = [best]
        return " ".join([*self.before(outer), *(" ".join(n.blocks) for n in outer)])

    def before(self, chosen: list[Node]) -> list[str]:
        """The page's only h1, if it lies before the chosen containers in one around them, and the paragraphs from there to them."""
        titles = {n.begin for n, _, _ in self.leads if n.tag == "h1"}
        if len(titles) != 1 or chosen == [self.root]:
            return []
        title, first = min(titles), min(n.begin for n in chosen)
        return [text for n, around, text in self.leads if title <= n.begin < first and (around is self.root or all(_within(c, around) for c in chosen))]


def _plain(node: Node) -> int:
    return max(0, node.chars - 2 * node.linked)


def _worth(node: Node) -> float:
    """Text outside links; semantic containers count double."""
    return _plain(node) * (2.0 if node.tag == "article" else 1.5 if node.tag == "main" else 0.5 if node.tag == "body" else 1.0)


def _within(node: Node, other: Node) -> bool:
    while node is not None:
        if node is other:
            return True
        node = node.parent
    return False


def _noisy(node: Node, others: list[Node]) -> bool:
    while node is not None:
        if node.noise and not any(_within(o, node) for o in others):
            return True
        node = node.parent
    return False


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One vote per page, summed per task."""
    for batch in batches:
        total: dict[tuple[str, str], int] = {}
        for host, source in zip(batch["host"].to_pylist(), batch["html"].to_pylist(), strict=True):
            best = Page(source or "").best()
            if best.path and best.chars:
                total[host, best.path] = total.get((host, best.path), 0) + 1
        keys = list(total)
        yield pa.RecordBatch.from_pydict({
            "host": pa.array([h for h, _ in keys], pa.string()), "path": pa.array([p for _, p in keys], pa.string()), "votes": pa.array([total[k] for k in keys], pa.int64()),
        })


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [Page(source or "").text(path) for source, path in zip(batch["html"].to_pylist(), batch["path"].to_pylist(), strict=True)]
        yield batch.drop_columns(["html", "path"]).append_column("text", pa.array(texts, pa.string()))


def host_of(url):
    """Host of a url column in lower case, without user and port; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page, with the container path that wins on its host.

    A page on which that path holds under FAIR of its own best container keeps that one instead.

    A null or empty page has an empty text. Pages without a host share one vote of their own. Equal votes: the first
    path. Repeated rows and null ids stay rows of their own. An empty table gives an empty result. The winners (one row
    per host) are joined on the host; Spark broadcasts them only below its size limit and splits hot hosts beyond.
    """
    rows = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url"), pages[html_col].alias("html"), host_of(pages[url_col]).alias("host"))
    votes = rows.select("host", "html").mapInArrow(_votes, "host string, path string, votes long").groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    winners = common.stored(votes.groupBy("host").agg(F.min_by("path", F.struct(-F.col("votes"), "path")).alias("path")), "host-paths")
    schema = rows.select("page_id", "url").schema.add("text", "string")
    cut = rows.join(winners, "host", "left").select("page_id", "url", "html", "path").mapInArrow(_texts, schema)
    return cut.withColumn("n_chars", F.length("text").cast("long"))


def op2_html_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.documents(spark, sf_dir, "pages"))
