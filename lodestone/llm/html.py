"""Main text of web pages by consensus host paths.

Pass one scores the containers of every page by the text of their paragraphs, less what lies in links, and votes for
the path of the best one: tags and classes from the body down, digits generalised. Spark sums the votes per host and
path. Pass two takes from every page the containers with its host's winning path, in page order, or those with the path
of the page's own best where that path isn't there, and returns their blocks without menus, forms, notices, comments and
the like. The page itself is a container, as a body without its tag; where that has won on a host, each page has its own
best. A page whose containers have no score (links make up half of every paragraph) gives all its blocks. Of a header
inside an article, headings stay and the rest (bylines, dates, buttons) goes. An article that goes on in a node beside
the best one, of the same tag and another class, is that of the node around both.

Edge cases: null or empty html and pages without text give the empty text; a null URL, or one without
`://`, belongs to the host ''; ties between paths go to the greater score, then to the path first in order; repeated
rows are extracted each on its own (and vote each); an empty table gives no rows; other columns are ignored. Markup that
is broken off is read as far as it goes, in time in proportion to the page.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lodestone.llm.common import ascii_lower, cut, map_batches

#: Up to this many hosts' paths are broadcast to the pages; of more, pages are shuffled by host (AQE splits hot ones).
BROADCAST_HOSTS = 100_000

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)")
#: What follows a tag's name, up to its end; a bracket in a quoted value doesn't end it. Nothing is read twice.
_REST = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*"|'[^']*')?+)*+>""")
_ATTRIBUTE = re.compile(r"""(?<![a-zA-Z-])([a-zA-Z-]++)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]++))|(?<![\w"'=-])(hidden)(?![\w=-])""")
_RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "object", "audio", "video", "canvas"}
_VOID = {"br", "img", "hr", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
_BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_CLOSES_P = _BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot"}
_CONTAINER = {"#page", "article", "main", "section", "div", "td", "body", "center", "blockquote"}
_DROPPED = {"nav", "header", "footer", "aside", "form", "menu", "button", "select", "dialog", "head", "label", "fieldset"}
_ROLES = {"navigation", "banner", "complementary", "contentinfo", "search", "form", "alert", "dialog", "menu", "menubar", "toolbar"}
_BAD = re.compile(
    r"(?:nav\w*|menu\w*|sidebar\w*|side|aside|rail|footer\w*|foot|header|masthead|topbar|ads?|adv|advert\w*|adsense|banner\w*|promo\w*|sponsor\w*|comments?|commentlist|respond|repl(?:y|ies)|disqus\w*|discussion|feedback"
    r"|shar(?:e|ing)\w*|social\w*|related\w*|recommend\w*|cookies?|consent|gdpr|notices?|alert\w*|warning|popups?|modal\w*|overlay|subscrib\w*|newsletter\w*|signup|login|forms?|search\w*|breadcrumbs?|paginat\w*|pager|widget\w*|tags|tagcloud|skip|copyright|legal|disclaimer|teaser\w*|paywall|toolbar)"
)
#: Bad names that an article may have beside a good one: `legal-text`.
_EITHER = re.compile(r"legal|warning|teaser")
_HEADINGS, _FRAMES = {"h1", "h2", "h3", "h4", "h5", "h6"}, {"div", "hgroup", "section", "span", "a", "header"}
_GOOD = re.compile(r"(?:article|post|entry|content|story|main|body|text|prose)(?:s|body|text|content)?")
_BREAK = re.compile(r"[-_\d]+")
_LIST = {"ul", "ol", "dl", "table", "div", "section", "article"}
_ITEM = {"li", "dt", "dd", "tr", "td", "th", "option"}
_PARAGRAPH = {"p", "pre", "li", "dd", "blockquote", "h1", "h2", "h3", "h4", "td"}
_SPACE = re.compile(r"\s+")


@dataclass
class Node:
    tag: str
    classes: tuple[str, ...] = ()
    parent: Node | None = None
    dropped: bool = False
    main: bool = False
    children: list = field(default_factory=list)
    score: float = 0.0
    depth: int = 0
    fits: int = 0  # how many steps of the path asked for lead here, -1 beside it
    inside: bool = False  # in an article
    heads: bool = False  # in an article's header, of which only headings stay
    plain: int = 0  # characters outside links, of all that stands below
    linked: int = 0

    def step(self) -> str:
        return ".".join((self.tag, *sorted({re.sub(r"\d+", "#", c) for c in self.classes})))

    def path(self) -> str:
        steps, node = [], self
        while node is not None and node.tag not in ("html", "#page"):
            steps.append(node.step())
            node = node.parent
        return "/".join(reversed(steps))


def _good(classes: tuple[str, ...]) -> bool:
    return any(_GOOD.fullmatch(part) for c in classes for part in _BREAK.split(c.lower()))


def _bad_name(names: str) -> bool:
    for name in names.lower().split():
        parts = [x for x in re.split(r"[-_]+", name) if x]
        if parts and parts[0] in ("has", "no", "is", "not"):
            continue
        named = list(itertools.takewhile(lambda p: p not in ("with", "without"), parts))
        bad = [p for p in (re.sub(r"\d+$", "", p) for p in named) if _BAD.fullmatch(p)]
        if bad and not (_GOOD.fullmatch(parts[-1]) and all(_EITHER.fullmatch(p) for p in bad)):
            return True
    return False


def _node(tag: str, raw: str, parent: Node) -> Node:
    attributes = {}
    if raw and not raw.isspace():
        for m in _ATTRIBUTE.finditer(raw):
            attributes.setdefault((m[1] or m[5]).lower(), m[2] or m[3] or m[4] or "")
    classes = attributes.get("class", "")
    own_header = tag == "header" and parent.inside
    whole = own_header or tag in ("html", "body", "main", "article")
    heads = own_header or parent.heads and tag in _FRAMES
    dropped = parent.dropped or (tag in _DROPPED and not own_header) or (parent.heads and not heads and tag not in _HEADINGS and tag not in _VOID) or "hidden" in attributes or attributes.get("aria-hidden") == "true" or attributes.get("role", "").lower() in _ROLES
    dropped = dropped or "display:none" in attributes.get("style", "").replace(" ", "").lower() or (not whole and _bad_name(f"{classes} {attributes.get('id', '')}"))
    main = tag in ("article", "main") or attributes.get("role") in ("main", "article") or attributes.get("itemprop") == "articleBody"
    return Node(tag, tuple(classes.split()), parent, dropped, main, depth=parent.depth + (tag != "html"), inside=parent.inside or tag == "article", heads=heads)


def parse(html: str) -> Node:
    """The page's tree; children are nodes and pieces of raw text. Time is in proportion to the page: nothing is searched again, and of open nodes only those that a tag can end are looked at."""
    root = Node("#page")
    open_nodes, blocks, items = [root], [0], []  # blocks, items: places of open blocks and paragraphs, and of open lists and items
    opened: Counter[str] = Counter()
    at, words, whole = 0, [], True

    def flush() -> None:
        if words:
            if not open_nodes[-1].heads:
                open_nodes[-1].children.append("".join(words))
            words.clear()

    def close(k: int) -> None:
        """Ends the open nodes from place k on."""
        for x in open_nodes[k:]:
            opened[x.tag] -= 1
        del open_nodes[k:]
        while blocks and blocks[-1] >= k:
            blocks.pop()
        while items and items[-1] >= k:
            items.pop()

    while True:
        i = html.find("<", at)
        if i < 0:
            words.append(html[at:])
            break
        words.append(html[at:i])
        follows = html[i + 1 : i + 2]
        name = _NAME.match(html, i + 1) if follows == "/" or follows.isascii() and follows.isalpha() else None
        if name is None:
            if html.startswith("<!--", i):
                end = html.find("-->", i + 4)
                at = len(html) if end < 0 else end + 3
            elif follows and follows in "!?/":
                end = html.find(">", i)
                at = len(html) if end < 0 else end + 1
            else:
                words.append("<")
                at = i + 1
            continue
        rest = _REST.match(html, name.end()) if whole else None
        if rest is None:  # its quotes don't match up to the end of the page; neither will those of later tags
            whole = False
            end = html.find(">", name.end())
            if end < 0:  # a tag that the end of the page cuts off
                break
        else:
            end = rest.end() - 1
        raw, tag, at = html[name.end() : end], name[2].lower(), end + 1
        flush()
        if name[1]:
            if opened[tag]:
                k = len(open_nodes) - 1
                while open_nodes[k].tag != tag:
                    k -= 1
                close(k)
            continue
        if tag in _RAW and not raw.endswith("/"):
            stop = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(html, at)
            at = stop.end() if stop else len(html)
            continue
        if tag in _CLOSES_P and open_nodes[blocks[-1]].tag == "p":
            close(blocks[-1])
        if tag in _ITEM:
            for k in reversed(items):
                if open_nodes[k].tag == tag:
                    close(k)
                    break
                if open_nodes[k].tag in _LIST:
                    break
        node = _node(tag, raw, open_nodes[-1])
        open_nodes[-1].children.append(node)
        if tag not in _VOID and not raw.endswith("/"):
            if tag in _BLOCK:
                blocks.append(len(open_nodes))
            if tag in _LIST or tag in _ITEM:
                items.append(len(open_nodes))
            opened[tag] += 1
            open_nodes.append(node)
    flush()
    return root


def text_blocks(node: Node) -> list[str]:
    """Blocks of text in page order, without dropped parts."""
    blocks: list[str] = []
    words: list[str] = []

    def flush() -> None:
        text = _SPACE.sub(" ", unescape("".join(words))).strip()
        words.clear()
        if text:
            blocks.append(text)

    stack: list = [node]
    while stack:  # a block's end is marked by None
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            words.append(x)
        elif x is node or not x.dropped:
            if x.tag in ("br", "wbr"):
                words.append(" " if x.tag == "br" else "")
            elif x.tag in _BLOCK:
                flush()
                stack.append(None)
            stack.extend(reversed(x.children))
    flush()
    return blocks


def containers(root: Node, path: str | None = None) -> list[Node]:
    """Nodes that may hold an article, last in the page first, with their scores: a paragraph counts in full where it stands and half one level up. With a path, each node knows whether that leads to it."""
    steps = path.split("/") if path else []
    found, order, stack = [], [], [(root, -1)]  # order: nodes, each behind its parent, with the place of the parent
    while stack:
        x, up = stack.pop()
        if x.dropped:
            continue
        if x.tag not in ("html", "#page"):
            x.fits = x.parent.fits + 1 if 0 <= x.parent.fits < len(steps) and x.step() == steps[x.parent.fits] else -1
        elif x.parent is not None:
            x.fits = x.parent.fits
        if x.tag in _CONTAINER:
            found.append(x)
        stack.extend((c, len(order)) for c in x.children if isinstance(c, Node))
        order.append((x, up))
    measured, holders = [[0, 0] for _ in order], [-1] * len(order)
    for k, (x, up) in enumerate(order):
        holders[k] = k if x.tag in _CONTAINER else holders[up]
        measured[k][0] = x.plain = sum(len(c) - c.count(" ") for c in x.children if isinstance(c, str))
    for k in range(len(order) - 1, -1, -1):  # characters, and those in links, of a node's own text, without that of containers in it
        x, up = order[k]
        if x.tag == "a":
            measured[k][1] = measured[k][0]
            x.plain, x.linked = 0, x.plain + x.linked
        if up >= 0:
            order[up][0].plain += x.plain
            order[up][0].linked += x.linked
        if up >= 0 and x.tag not in _CONTAINER:
            measured[up][0] += measured[k][0]
            measured[up][1] += measured[k][1]
    for k, (x, up) in enumerate(order):
        worth = measured[k][0] - 2 * measured[k][1]
        if worth > 0 and (x.tag in _PARAGRAPH or x.tag in _CONTAINER):
            holder, share = k if x.tag in _CONTAINER else holders[up], 1.0
            while holder >= 0 and share > 0.2:
                order[holder][0].score += worth * share
                share /= 2
                above = order[holder][1]
                holder = holders[above] if above >= 0 else -1
    for x in found:
        if x.main or _good(x.classes):
            x.score *= 1.3
    return found


def best_container(found: list[Node]) -> Node | None:
    best = max(found, key=lambda x: x.score, default=None)
    if best is None or best.score <= 0:
        return None
    up = best
    while up is not None:  # to the article around it, with its title
        if up.main and up.score > 0:
            return up
        up = up.parent
    while best.parent is not None and best.parent.tag in _CONTAINER and (best.parent.tag not in ("body", "#page") and _good(best.parent.classes) or _goes_on(best)):
        best = best.parent
    return best


def _goes_on(x: Node) -> bool:
    """Whether the article goes on in a node beside x: one of its tag, of another class, with at least half its score."""
    beside = (c for c in x.parent.children if isinstance(c, Node) and c is not x and c.tag == x.tag)
    return any(not c.dropped and 2 * c.score >= x.score and c.step() != x.step() for c in beside)


def text_under(html: str, path: str) -> str:
    """The blocks of all containers with the path, in page order; without those that are nothing but links, if there are others."""
    n = path.count("/") + 1
    fits = [x for x in reversed(containers(parse(html), path)) if x.fits == n]
    told = [x for x in fits if x.score > 0 or (x.plain >= 20 and 5 * x.plain >= x.linked)]
    return "\n".join(block for x in told or fits for block in text_blocks(x))


def extract(html: str, path: str | None) -> str:
    """The text under the path, if the page has it, else under the path of its own best container, else all of it."""
    text = text_under(html, path) if path else ""
    if not text:
        root = parse(html)
        best = best_container(containers(root))
        text = text_under(html, best.path()) if best is not None and best is not root else ""
        text = text or "\n".join(text_blocks(root))
    return text


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def page_votes(pages: DataFrame) -> DataFrame:
    """host, path and score of the best container of every page that has one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for host, html in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True):
                best = best_container(containers(parse(html or "")))
                if best is not None:
                    rows.append((host, best.path(), best.score))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=["host", "path", "score"])

    return map_batches(pages.select(host_of(F.col("url")).alias("host"), "html"), run, "host string, path string, score double")


def host_paths(pages: DataFrame) -> DataFrame:
    """host and the path that most of its pages vote for."""
    votes = page_votes(pages).groupBy("host", "path").agg(F.count("*").alias("votes"), F.sum(F.round("score").cast("long")).alias("score"))
    ranked = F.max_by("path", F.struct("votes", "score", F.translate("path", "".join(map(chr, range(33, 127))), "".join(map(chr, range(126, 32, -1)))))).alias("path")
    return votes.groupBy("host").agg(ranked)


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, path (the host's), text."""
    paths = cut(host_paths(pages).withColumnRenamed("host", "_host"))
    if paths.count() <= BROADCAST_HOSTS:
        paths = F.broadcast(paths)
    joined = pages.select("page_id", "url", "html").join(paths, host_of(F.col("url")) == F.col("_host"), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(h or "", p) for h, p in zip(b.column("html").to_pylist(), b.column("path").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), b.column("path"), pa.array(texts, pa.string())], names=["page_id", "url", "path", "text"])

    schema = StructType([pages.schema["page_id"], pages.schema["url"], StructField("path", StringType()), StructField("text", StringType())])
    return map_batches(joined.select("page_id", "url", "path", "html"), run, schema)
