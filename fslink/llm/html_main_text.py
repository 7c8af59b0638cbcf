"""Main text of web pages by tree scoring.

A forgiving tokenizer builds a tree of elements (void elements, unclosed paragraphs and cells, raw
text of scripts and styles, comments).  Parts that never hold the article go: scripts, styles,
menus, headers, footers, sidebars, forms, notices, adverts and reader comments, known by element,
role, or the words in class and id.  Words of class and id spare a part that also bears a name of
the article or holds most of the page's unlinked text; a page of which they leave nothing, or next
to nothing, is read again without them.  Every paragraph then passes points, one plus its commas plus
one per hundred characters up to three, to its parent in full, to its grandparent by half and to
further ancestors by less; a container's points are discounted by its link density.  The best
container is kept, with those of its siblings whose points come near its own or whose text has few
links.  Its text is returned block by block.

Character references are decoded; white space within a block becomes one space; blocks are joined
by an empty line.  A page's time and memory are in proportion to its length, however deep its
elements nest and however many end tags match nothing: about 400 bytes an element and one page at a
time in a task.  Defined results: a null or empty page, or one of no text, gives the empty string;
repeated rows give the same text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML's element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul br".split())
DROPPED = frozenset("script style textarea title noscript template iframe xmp noembed noframes head nav aside footer form button select option input dialog svg canvas object applet audio video menu fieldset label datalist".split())
CLOSES_P = BLOCK - {"html", "body", "br", "td", "th", "tr", "tbody", "thead", "tfoot", "li", "dd", "dt"}
SELF_NESTING = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}
ALIKE = {"dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "thead": {"thead", "tbody", "tfoot"}, "tbody": {"thead", "tbody", "tfoot"}, "tfoot": {"thead", "tbody", "tfoot"}}
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
# Words of class and id that name what isn't the article, and what is.
AWAY = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup paywall "
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toolbar header masthead footer copyright sidebar aside rail widget widgets related recommended recommendations more-stories trending popular share sharing social follow "
    "comment comments reply replies respond discussion disqus feedback review-list login search skip toc tags tagcloud".split()
)
TOWARD = frozenset("article content main post entry story body text page column".split())
# Whole classes that name the article whatever its share of the page; words of readers' remarks, which may outweigh it.
NAMES = frozenset("article content main post entry story".split())
READERS = frozenset("comment comments reply replies respond discussion disqus".split())
# A class that begins with one of these tells what stands beside the part: has-sidebar.
BESIDE = frozenset("has have no with without".split())
# Words that only say that a part stands at the head of another.
HEADS = frozenset("header masthead banner".split())
# Shares of the page's unlinked text that spare a part: alone, and with a word of TOWARD.
SHARE_ALONE, SHARE_NAMED = 2 / 3, 1 / 4
# Characters under which a page is read again, and how many times as many a second reading must give.
SCANT, FAR_MORE = 140, 4

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</[a-zA-Z][^>]*(?:>|\Z)|<[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>|<[a-zA-Z][^>]*(?:>|\Z)", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?", re.S)
_UNSEEN = re.compile(r"display\s*:\s*none", re.I)
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I | re.A) for tag in RAW}
_SPACE = re.compile(r"\s+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])|[^A-Za-z]+")


class Node:
    __slots__ = ("tag", "parent", "children", "attributes", "points")

    def __init__(self, tag: str, parent: Node | None, attributes: dict[str, str] | None = None):
        self.tag, self.parent, self.children, self.attributes, self.points = tag, parent, [], attributes or {}, 0.0


class _Open:
    """The open elements, outermost first, with the depths at which each tag and any block is open;
    so an end tag costs no walk, however deep the page."""

    def __init__(self, top: Node):
        self.nodes, self.depths, self.blocks = [top], {}, []

    def push(self, node: Node) -> None:
        self.depths.setdefault(node.tag, []).append(len(self.nodes))
        if node.tag in BLOCK:
            self.blocks.append(len(self.nodes))
        self.nodes.append(node)

    def close(self, depth: int) -> None:
        """Closes the element at ``depth`` and all within it."""
        while len(self.nodes) > depth:
            node = self.nodes.pop()
            self.depths[node.tag].pop()
            if node.tag in BLOCK:
                self.blocks.pop()

    def deepest(self, tags: Iterable[str]) -> int:
        """The depth of the innermost open element of these tags; 0 if there is none."""
        return max((d[-1] for tag in tags if (d := self.depths.get(tag))), default=0)


def _attributes(mark: str, start: int) -> dict[str, str]:
    found = {}
    for m in _ATTRIBUTE.finditer(mark, start):
        found.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return found


def parse(page: str) -> Node:
    """The page's tree; a child is a Node or a decoded string."""
    top = Node("#top", None)
    open_ = _Open(top)
    at = 0
    while True:
        found = _TOKEN.search(page, at)
        text = page[at : found.start()] if found else page[at:]
        if text:
            open_.nodes[-1].children.append(html.unescape(text))
        if not found:
            return top
        at = found.end()
        mark = found[0]
        if mark[1] in "!?":
            if mark.startswith("<![CDATA["):
                open_.nodes[-1].children.append(mark[9:].removesuffix("]]>"))
            continue
        name = _NAME.match(mark)
        tag = name[1].lower()
        if mark[1] == "/":
            if depth := open_.deepest((tag,)):
                open_.close(depth)
            elif tag == "br":
                open_.nodes[-1].children.append(Node("br", open_.nodes[-1]))
            continue
        if tag in CLOSES_P:
            if open_.blocks and open_.nodes[open_.blocks[-1]].tag == "p":
                open_.close(open_.blocks[-1])
        elif tag in SELF_NESTING:
            depth = open_.deepest(ALIKE.get(tag, (tag,)))
            if depth > open_.deepest(SELF_NESTING[tag]):
                open_.close(depth)
        here = open_.nodes[-1]
        made = Node(tag, here, _attributes(mark, name.end()) if len(mark) > name.end() + 1 else None)
        here.children.append(made)
        if tag in VOID or mark.endswith("/>") and tag not in RAW and tag not in BLOCK:
            continue
        if tag in RAW:
            end = _RAW_END[tag].search(page, at)
            close = page.find(">", end.end()) if end else -1
            at = len(page) if close < 0 else close + 1
            continue
        open_.push(made)


def _tokens(node: Node) -> list[str]:
    found = []
    for key in ("class", "id"):
        for word in node.attributes.get(key, "").split():
            found.append(word.lower())
            found += [x.lower() for x in _CAMEL.split(word) if x]
    return found


def away(node: Node, in_article: bool) -> bool:
    """Whether a part never belongs to the article, by its element, role or being hidden."""
    own = node.attributes
    if node.tag in DROPPED or node.tag == "header" and not in_article:
        return True
    return bool(own) and ("hidden" in own or own.get("aria-hidden", "").lower() == "true" or own.get("role", "").lower() in ROLES or _UNSEEN.search(own.get("style", "")) is not None)


def named_away(node: Node, words: frozenset[str]) -> set[str]:
    """The words of class and id that say that a part isn't the article."""
    if node.tag in ("body", "html", "article", "main") or not node.attributes:
        return set()
    found = set()
    for key in ("class", "id"):
        for word in node.attributes.get(key, "").split():
            parts = [x.lower() for x in _CAMEL.split(word) if x]
            if parts and parts[0] in BESIDE:
                continue
            told = words.intersection([word.lower(), *parts])
            # entry-header holds the article's headline.
            if not (told <= HEADS and NAMES.intersection(parts)):
                found |= told
    return found


def spared(node: Node, found: set[str], share: float) -> bool:
    """Whether a part of such words may be the article all the same, by its other words and its
    share of the page's unlinked text."""
    whole = {x.lower() for key in ("class", "id") for x in node.attributes.get(key, "").split()}
    if found & READERS:
        return share >= SHARE_ALONE and bool(whole & TOWARD)
    return bool(whole & NAMES) or share >= SHARE_ALONE or (share >= SHARE_NAMED and any(x in TOWARD for x in _tokens(node)))


def prune(top: Node, words: frozenset[str] = AWAY) -> None:
    """Takes all parts away that never belong to the article, or that ``words`` in class and id
    name and nothing spares."""
    work, named = [(top, False)], {}
    while work:
        node, in_article = work.pop()
        in_article |= node.tag == "article"
        node.children = [c for c in node.children if isinstance(c, str) or not away(c, in_article)]
        for c in node.children:
            if not isinstance(c, str):
                work.append((c, in_article))
                if found := named_away(c, words):
                    named[c] = found
    if not named:
        return
    known = measure(top)
    total = max(1, known[top][0] - known[top][1])
    work = [top]
    while work:
        node = work.pop()
        node.children = [c for c in node.children if isinstance(c, str) or c not in named or spared(c, named[c], (known[c][0] - known[c][1]) / total)]
        work += [c for c in node.children if not isinstance(c, str)]


def measure(top: Node) -> dict[Node, tuple[int, int, int, bool]]:
    """Characters, characters in links, commas, and whether there is a block within, of each node."""
    order, work = [], [top]
    while work:
        node = work.pop()
        order.append(node)
        work += [c for c in node.children if not isinstance(c, str)]
    found: dict[Node, tuple[int, int, int, bool]] = {}
    for node in reversed(order):
        chars = links = commas = 0
        block = False
        for c in node.children:
            if isinstance(c, str):
                chars += len(_SPACE.sub(" ", c).strip())
                commas += sum(map(c.count, ",،、，"))
            else:
                a, b, d, e = found[c]
                chars, links, commas = chars + a, links + b, commas + d
                block |= e or (c.tag in BLOCK and c.tag != "br")
        found[node] = (chars, chars if node.tag == "a" else links, commas, block)
    return found


def best_parts(top: Node) -> list[Node]:
    """The container of the article and those of its siblings that belong to it, in page order."""
    known = measure(top)
    scored: list[Node] = []
    for node, (chars, _, commas, block) in known.items():
        loose = sum(len(c.strip()) for c in node.children if isinstance(c, str))
        if chars == 0 or node.tag not in BLOCK or node.tag in ("html", "br", "hr") or (block and loose < 80) or node.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            continue
        points = 1 + commas + min(chars // 100, 3)
        above, level = (node if block else node.parent), 0
        while above is not None and above.tag != "#top" and level < 5:
            if above.points == 0:
                scored.append(above)
            above.points += points / (1, 2, 6, 9, 12)[level]
            above, level = above.parent, level + 1
    if not scored:
        return [top]

    def worth(node: Node) -> float:
        chars, links, _, _ = known[node]
        bonus = 25 * (node.tag in ("article", "main") or node.attributes.get("role") == "main") + 10 * any(x in TOWARD for x in _tokens(node)) - 10 * (node.tag in ("ul", "ol", "li", "dl", "td", "th"))
        return (node.points + bonus) * (1 - links / max(1, chars))

    best = max(scored, key=worth)
    # An article or main element around the best container is the article.
    node = best
    while node := node.parent:
        if node.tag in ("article", "main"):
            best = node
    if best.parent is None or best.tag in ("article", "main", "body", "#top") and not any(isinstance(c, Node) and c.tag == best.tag and c is not best for c in best.parent.children):
        return [best]
    limit = max(10.0, 0.2 * worth(best))
    parts = []
    for c in best.parent.children:
        if isinstance(c, str):
            continue
        chars, links, _, _ = known[c]
        density = links / max(1, chars)
        if c is best or (c.points and worth(c) >= limit) or chars > 80 and density < 0.25 or 0 < chars <= 80 and density == 0:
            parts.append(c)
    return parts


def blocks(parts: list[Node]) -> list[str]:
    """The text of each block, white space made one space, empty ones left out."""
    out: list[str] = []
    line: list[str] = []

    def close() -> None:
        text = _SPACE.sub(" ", "".join(line)).strip()
        if text:
            out.append(text)
        line.clear()

    for part in parts:
        close()
        work: list = [part]
        while work:
            x = work.pop()
            if x is None:
                close()
            elif isinstance(x, str):
                line.append(x)
            else:
                if x.tag in BLOCK:
                    close()
                    work.append(None)
                work += x.children[::-1]
        close()
    return out


def _text(page: str, words: frozenset[str]) -> tuple[str, bool]:
    """The text of the best parts, and whether they are or lie in an article or main element."""
    top = parse(page)
    prune(top, words)
    parts = best_parts(top)
    return "\n\n".join(blocks(parts)), any(x.tag in ("article", "main") for x in parts)


def main_text(page: str | None) -> str:
    """The page's article, its blocks joined by an empty line."""
    if not page:
        return ""
    text, sure = _text(page, AWAY)
    first = text
    # Readers' remarks are taken for the article only where nothing else was left.
    for words in (READERS,) if first else (READERS, frozenset()):
        if not text or (len(text) < SCANT and not sure):
            again, _ = _text(page, words)
            if len(again) > FAR_MORE * len(text):
                text = again
    return text


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each page (page_id, url, html)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                texts = [main_text(x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
