"""Main text of web pages by consensus of each host's pages.

Each page scores its containers by the running text in them, less what is linked.
Containers are named by their path of generalised tags and classes; Spark sums the
scores of each path over its host, and each page is extracted again from the
container at its host's winning path.

Markup is read by HTML's own rules in one pass; every step is linear in the page,
whatever its tags, and no depth is too great.  What is dropped as page furniture is
decided after the whole page was read, so a name never drops the article inside.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import prepare, stored

#: Elements without an end tag, and those whose content is no markup.  Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
#: Elements that start a block of text of their own.  Fixed values of HTML.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An element's start ends an open one of these kinds, unless one of the others was opened since.  Fixed values of HTML.
LISTS = frozenset("ul ol dl menu dir table td th article section main aside nav blockquote body".split())
CLOSES = {
    "li": (("li",), LISTS), "dt": (("dt", "dd"), LISTS), "dd": (("dt", "dd"), LISTS),
    "tr": (("td", "th", "tr"), frozenset(("table",))), "td": (("td", "th"), frozenset(("table", "tr"))), "th": (("td", "th"), frozenset(("table", "tr"))),
    "option": (("option",), frozenset(("select",))),
}
P_SCOPE = frozenset("table td th caption button object template html body".split())
#: End tags don't reach beyond these.
BOUNDS = frozenset("article main body".split())
CONTAINER = frozenset("article main section div body td center blockquote".split())

#: Elements that hold no text of a page, and those that frame one.
NO_TEXT = frozenset("script style noscript template iframe svg button select option textarea input label title head object embed canvas audio video".split())
FRAME = frozenset("nav header footer aside form dialog menu".split())
#: Words of classes, ids and roles.  A name that ends in one of the first, but for
#: fillers, is furniture; one of the second is readers' comments; the third may be either.
STRONG = frozenset("ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login nav navbar navigation menu breadcrumb breadcrumbs sidebar aside rail widget widgets footer header masthead topbar toolbar related recommended recommendations share sharing social pager pagination skip complementary contentinfo".split())
READER = frozenset("comment comments commentlist replies respond disqus".split())
WEAK = frozenset("discussion search tag tags".split())
FILLER = frozenset("area list section wrapper wrap container box block inner outer bar panel slot unit top bottom left right".split())
BODY = frozenset("content main article body text post entry story".split())
NEGATED = frozenset("has no with without not is".split())
KEPT, SOFT, NAMED, COMMENT, FRAMED, GONE = range(6)
#: Share of the page's best score that its containers at the host's path must have to be taken.
FAIR = 0.25

ATTRIBUTE = re.compile(r"""[\s/]*+(=?[^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|(?!["'])([^\s>]*+)))?+""")
#: As ``ATTRIBUTE``, but with a name or a sign; a value may end in a slash.
_NAMED = ATTRIBUTE.pattern.replace(r"(=?[^\s/>=]*+)", r"(?:=?[^\s/>=]++|=)").replace("([^", "(?:[^")
TAG = re.compile(rf"<(/?)([a-zA-Z][^\s/>]*+)((?>{_NAMED}|[\s/]++)*+)>")
PARTS = re.compile(r"[a-z]{2,}|[A-Z]+[a-z]+|[A-Z]{2,}")
WHITE = re.compile(r"\s+")


@functools.lru_cache(4096)
def kind_of(name: str) -> int:
    """What one class, id or role says of its element."""
    parts = [p.lower() for p in PARTS.findall(name)]
    if not parts or not NEGATED.isdisjoint(parts):
        return KEPT
    while len(parts) > 1 and parts[-1] in FILLER:
        parts.pop()
    if parts[-1] in READER:
        return COMMENT
    if parts[-1] in STRONG and BODY.isdisjoint(parts):
        return NAMED
    return SOFT if any(p in STRONG or p in WEAK or p in READER for p in parts) else KEPT


@functools.lru_cache(4096)
def described(tag: str, attributes: str) -> tuple[int, str]:
    """How strongly an element is furniture, and its generalised name: tag and sorted classes, digits as one ``#``."""
    found: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        found.setdefault(name.lower(), a or b or c)  # the first of a name counts
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    classes = unescape(found.get("class", "")).split()
    kind = GONE if hidden or tag in NO_TEXT else FRAMED if tag in FRAME else KEPT
    if kind == KEPT and tag not in ("html", "body", "main"):
        kind = max((kind_of(n) for n in (*classes, *unescape(found.get("id", "")).split(), *found.get("role", "").split())), default=KEPT)
        # Headings and what stands in a line of text don't go for a name that may be either.
        kind = min(kind, SOFT) if tag in HEADINGS else kind
        kind = KEPT if kind == SOFT and (tag not in BLOCK or tag in HEADINGS) else kind
    return kind, ".".join([tag, *sorted(re.sub(r"\d+", "#", c.lower()) for c in classes)])


class Node:
    __slots__ = ("article", "controls", "drop", "first", "flow", "heads", "inside", "kind", "last", "link", "linked", "links", "main", "name", "own", "parent", "path", "readers", "runs", "size", "tag")

    def __init__(self, tag: str, parent: Node | None, attributes: str) -> None:
        self.tag, self.parent = tag, parent
        self.own, self.name = described(tag, attributes) if parent else (KEPT, "")
        #: The path's digest: paths themselves would take memory with the square of the depth.
        self.path = hashlib.blake2b((parent.path if parent else b"") + b">" + self.name.encode("utf-8", "surrogatepass"), digest_size=8).digest()
        #: The strongest kind of this and the elements around it.
        self.kind = max(self.own, parent.kind) if parent else self.own
        self.link = tag == "a" or (parent is not None and parent.link)
        #: Whether this stands in an article or the page's main part.
        self.main = parent is not None and (parent.main or parent.tag in ("article", "main"))
        # Of all blocks inside: characters, linked ones, running ones; links and form
        # controls; headlines; the largest article; whether readers' comments are inside.
        self.size = self.linked = self.runs = self.links = self.controls = self.article = self.heads = 0
        self.first, self.last, self.readers = 1 << 60, -1, False
        self.drop = self.inside = False
        self.flow = 0.0

    def readable(self) -> str:
        steps, at = [], self
        while at.parent is not None:
            steps.append(at.name)
            at = at.parent
        return ">".join(reversed(steps))


class Page:
    """One pass over a page's markup: text blocks, each with the element it stands in."""

    def __init__(self, html: str) -> None:
        self.blocks: list[tuple[Node, str, int]] = []  # element, text, its linked characters
        self.root = self.node = Node("#page", None, "")
        self.nodes: list[Node] = []
        self.stack: list[Node] = []
        self.open: dict[str, list[int]] = {}  # tag -> places in the stack
        self.text: list[str] = []
        self.linked = 0
        self._read(html)
        self._flush()
        self._weigh()
        self._settle()

    def _flush(self) -> None:
        text = WHITE.sub(" ", "".join(self.text)).strip()
        if text:
            self.blocks.append((self.node, text, min(self.linked, len(text))))
        self.text, self.linked = [], 0

    def _say(self, raw: str) -> None:
        if raw and self.node.kind < GONE:
            text = unescape(raw)
            self.text.append(text)
            if self.node.link:
                self.linked += len(text.strip())

    @staticmethod
    def _cuts(node: Node) -> bool:
        """Whether an element ends the block around it: blocks do, and what may be dropped later, but nothing hidden in a line."""
        return node.tag in BLOCK or KEPT < node.own < GONE

    def _leave(self, place: int) -> None:
        """Close open elements down to the one at ``place`` of the stack."""
        while len(self.stack) > place:
            node = self.stack[-1]
            if self._cuts(node):
                self._flush()
            self.stack.pop()
            self.open[node.tag].pop()
            self.node = node.parent

    def _last(self, tags) -> int:
        """The place of the innermost open element of these tags; -1 without one."""
        return max((places[-1] for t in tags if (places := self.open.get(t))), default=-1)

    def _start(self, tag: str, attributes: str) -> None:
        if tag in BLOCK:
            if (place := self._last(("p",))) > self._last(P_SCOPE):
                self._leave(place)
            if tag in CLOSES:
                tags, scope = CLOSES[tag]
                # Of cells and rows the outermost within the scope is closed.
                while (place := self._last(tags)) > self._last(scope - {tag}):
                    self._leave(place)
            self._flush()
        if tag in VOID:
            if tag == "input":
                self.node.controls += 1
            return
        node = Node(tag, self.node, attributes)
        if self._cuts(node):
            self._flush()
        if tag in ("textarea", "select", "button"):
            node.parent.controls += 1
        if tag == "a":
            node.links += 1
        self.open.setdefault(tag, []).append(len(self.stack))
        self.stack.append(node)
        self.nodes.append(node)
        self.node = node

    def _read(self, html: str) -> None:
        at, n, endless = 0, len(html), set()
        while (start := html.find("<", at)) >= 0:
            if found := TAG.match(html, start):
                self._say(html[at:start])
                at = found.end()
                end, tag, attributes = found.groups()
                tag = tag.lower()
                if end:
                    places = self.open.get(tag)
                    if places and (tag in BOUNDS or tag == "html" or places[-1] > self._last(BOUNDS)):
                        self._leave(places[-1])
                    elif tag in ("p", "br"):  # they start what they end
                        self._flush() if tag == "p" else self.text.append("\n")
                elif tag == "br":
                    self.text.append("\n")
                elif tag in RAW:
                    if tag not in endless:
                        if close := re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(html, at):
                            at = close.end()
                        elif tag in ("script", "style"):
                            at = n  # without an end, only code runs to the end of the page
                        else:
                            endless.add(tag)
                else:
                    self._start(tag, attributes)
                continue
            mark = html[start + 1 : start + 2]
            if html.startswith("<!--", start):
                self._say(html[at:start])
                if html.startswith(">", start + 4) or html.startswith("->", start + 4):
                    at = html.index(">", start) + 1
                else:
                    closes = [e + k for e, k in ((html.find("-->", start + 4), 3), (html.find("--!>", start + 4), 4)) if e >= 0]
                    at = min(closes, default=n)
            elif html.startswith("<![CDATA[", start):
                self._say(html[at:start])
                close = html.find("]]>", start)
                at = close + 3 if close >= 0 else n
            elif mark in ("!", "?") and mark or (mark == "/" and html[start + 2 : start + 3] not in ("", *"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")):
                self._say(html[at:start])
                close = html.find(">", start)
                at = close + 1 if close >= 0 else n
            elif mark.isascii() and mark.isalpha() or mark == "/" and start + 2 < n:
                self._say(html[at:start])
                at = n  # the page ends in a tag
            else:
                self._say(html[at : start + 1])
                at = start + 1
        self._say(html[at:])

    def _weigh(self) -> None:
        """Sum what the blocks say of each element, the inner ones first."""
        for k, (node, text, linked) in enumerate(self.blocks):
            node.size += len(text)
            node.linked += linked
            node.runs += max(0, len(text) - 2 * linked)
            node.first, node.last = min(node.first, k), max(node.last, k)
        for node in reversed(self.nodes):
            up = node.parent
            if node.tag in ("article", "main") and node.own == KEPT:
                node.article = max(node.article, node.runs)
            up.size += node.size
            up.linked += node.linked
            up.runs += node.runs
            up.links += node.links
            up.heads += node.heads + (node.tag == "h1" and node.size > 0)
            up.controls += node.controls
            up.article = max(up.article, node.article)
            up.readers = up.readers or node.readers or node.own == COMMENT
            up.first, up.last = min(up.first, node.first), max(up.last, node.last)

    def _holds(self, node: Node) -> bool:
        """Whether the page's text is inside: its largest article, or most of its running text."""
        whole = self.root
        return node.article == whole.article if whole.article else 2 * node.runs > whole.runs

    def _furniture(self, node: Node, spared: int) -> bool:
        own, tag = node.own, node.tag
        if own == GONE:
            return True
        if own <= spared and own != KEPT:
            return False
        if own == FRAMED:
            if tag in ("header", "footer", "nav", "aside"):
                return not (self.root.article and self._holds(node))
            return not self._holds(node)
        if own == COMMENT:
            return not (self.root.article and self._holds(node))
        if own == NAMED:
            # A banner that holds the article's only headline is part of it.
            if node.main and node.heads == self.root.heads == 1 and 5 * node.linked < 2 * node.size:
                return False
            return not self._holds(node)
        dense = 5 * node.linked >= 2 * node.size
        if own == SOFT:
            return (dense or node.controls > 0 or node.readers) and not self._holds(node)
        # Menus without a name: almost all linked, before or after all running text.
        return not self.root.article and node.links > 2 and tag in ("ul", "ol", "div", "table", "p", "section") and 5 * node.linked >= 4 * node.size and not self.text_at[0] <= node.last <= self.text_at[1] and not self.text_at[0] <= node.first <= self.text_at[1] and not node.first <= self.text_at[0] <= node.last

    def _settle(self) -> None:
        """Drop furniture by what the whole page says.

        An element that holds the page's text never goes for its name.  A page
        that would come out empty falls back on what was dropped for the weakest reason.
        """
        running = [k for k, (_, text, linked) in enumerate(self.blocks) if len(text) - 2 * linked >= 40]
        self.text_at = (running[0], running[-1]) if running else (-1, 1 << 60)
        before = self.blocks
        for spared in (KEPT, SOFT, NAMED, COMMENT, FRAMED):
            for node in self.nodes:
                up = node.parent
                node.drop = up.drop or self._furniture(node, spared)
                # An article's own header keeps its headings.
                if node.drop and node.tag in HEADINGS and node.own == KEPT and self._titled(node):
                    node.drop = False
            self.blocks = [b for b in before if not b[0].drop]
            if self.blocks or not before:
                break

    def _titled(self, node: Node) -> bool:
        head = node.parent
        for _ in range(3):  # a heading stands in its header or in a group there
            if head is None or head.tag not in ("hgroup", "div"):
                break
            head = head.parent
        if head is None or head.tag != "header" or head.own != FRAMED or head.parent.drop:
            return False
        return head.parent.tag in ("article", "main") or (head.parent.parent is not None and head.parent.parent.tag == "article")

    def scores(self) -> dict[bytes, float]:
        """Path of each container -> its score; containers further out share the text but hold more of the page's rest."""
        for node in (self.root, *self.nodes):
            node.flow = 0.0
        for node, text, linked in self.blocks:
            node.flow += max(0.0, len(text) - 2.0 * linked) + 20 * len(re.findall(r"[.,;:!?](?:\s|$)", text))
        total: dict[bytes, float] = {}
        for node in reversed(self.nodes):
            flow = node.flow
            if flow and node.tag in CONTAINER:
                total[node.path] = total.get(node.path, 0.0) + flow * (1.5 if node.tag in ("article", "main") else 1.0)
                flow *= 0.9
            node.parent.flow += flow
        # A body whose tags were left out: text directly below the page.
        if self.root.flow and not any(n.tag == "body" for n in self.nodes):
            total[self.root.path] = self.root.flow
        return total

    def _headline(self, first: Node) -> Node | None:
        """The page's only headline, if it stands before the text that starts in ``first`` and isn't part of any furniture."""
        heads = [n for n in self.nodes if n.tag == "h1" and n.size and not n.drop]
        if len(heads) != 1 or heads[0].inside or heads[0].first >= first.first or 2 * heads[0].linked > heads[0].size:
            return None
        return heads[0]

    def extract(self, path: bytes | None) -> tuple[str, str | None]:
        """Blocks below the containers at ``path`` and the headline before them; and that path as text.

        The page's own best container is taken where it has none at ``path``, or where those have
        less than ``FAIR`` of its score: then the host's path isn't this page's article.
        """
        own = self.scores()
        if own and own.get(path, 0.0) < FAIR * max(own.values()):
            path = min(own, key=lambda p: (-round(own[p], 3), p))
        self.root.inside = path is None or path == self.root.path
        places = [n for n in self.nodes if n.path == path]
        for node in self.nodes:
            node.inside = node.parent.inside or node.path == path
        if places and (head := self._headline(places[0])):
            for node in self.nodes:
                node.inside = node.inside or node is head or (node.parent.inside and not node.drop)
        text = "\n".join(text for node, text, _ in self.blocks if node.inside)
        return text, places[0].readable() if places else None


def host(url):
    """A URL's host in lower case; empty if it has none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def vote(pages: DataFrame) -> DataFrame:
    """``host`` and the ``path`` (a digest) that its pages' containers score highest; ties go to the smallest digest.

    Each page has the same say.  A task sums its pages' votes of a batch before the
    shuffle, so a host of very many pages sends few rows.
    """
    prepare(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[tuple[str, bytes], int] = {}
            for name, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                found = Page(html or "").scores()
                most = max(found.values(), default=0)
                for path, score in found.items():
                    if most:
                        out[name, path] = out.get((name, path), 0) + round(1_000_000 * score / most)
            yield pa.RecordBatch.from_pydict({"host": pa.array([k[0] for k in out], pa.string()), "path": pa.array([k[1] for k in out], pa.binary()), "score": pa.array(out.values(), pa.int64())})

    votes = pages.select(host("url").alias("host"), "html").mapInArrow(run, "host string, path binary, score long")
    sums = votes.groupBy("host", "path").agg(F.sum("score").alias("score"))
    return sums.groupBy("host").agg(F.min_by("path", F.struct(-F.col("score"), F.col("path"))).alias("path"))


def extract(pages: DataFrame) -> DataFrame:
    """One row a page: ``page_id``, ``url``, ``text``, ``n_chars``, ``path`` (of the container that was taken).

    Pages without a container at their host's winning path, or with little of their text in it,
    fall back to their own best one; text of a page without a body element is its body's.  A null or empty html has the empty text and a null path; pages without a host vote
    together; ties of scores go to the smallest digest of a path; repeated rows
    stay; an empty table gives no rows; other columns are ignored.  A page of furniture alone is taken as its text.
    """
    winners = stored(vote(pages), "host-paths")
    kind = dict(pages.dtypes)["page_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Page(h or "").extract(p) for h, p in zip(batch.column("html").to_pylist(), batch.column("path").to_pylist(), strict=True)]
            texts = [t for t, _ in found]
            yield pa.RecordBatch.from_pydict({"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64()), "path": pa.array([p for _, p in found], pa.string())})

    joined = pages.select("page_id", "url", "html", host("url").alias("host")).join(winners, "host", "left").select("page_id", "url", "html", "path")
    return joined.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long, path string")
