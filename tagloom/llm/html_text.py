"""Main text of HTML pages by composite text density.

Each page is read by a tolerant tokenizer into a tree of its block elements; inline elements are counted as tags of the block that holds them. What can be no article is left
out before: heads, scripts, styles, forms, navigation, page headers, footers, asides, hidden elements, and elements whose class, id or role names
them as adverts, notices, sidebars, comments and the like. For every block the density is its characters per tag, adjusted by its share of characters
and tags in links and by the share of link characters of the whole body; a block's sum is that of the densities of its children. The block of largest sum is the text's
subtree. The smallest density on the path from it to the body is the threshold: elsewhere, a block that reaches it contributes its own largest-sum subtree. The
chosen subtree grows to the article element around it, or shrinks to the only one in it if that holds a third of its characters, so that short paragraphs and
headings of the article stay; without one, a heading right before a chosen block stays too. A form that is around all text is read like a div. The texts of its blocks, in page order, are the result.

Character references are decoded; white space (Unicode's, no-break space and line breaks by br included) inside a block becomes one space; blocks are trimmed and joined by \\n.
Table cells, list items and preformatted texts are blocks.

Defined cases: a null page is empty and an empty page has the empty text, as has one without text outside of what is left out; broken markup is read as far
as it goes (unclosed elements end with their parents, stray end tags are ignored, an unclosed comment or script hides the rest); of two blocks of equal sums the first in page
order is taken; repeated rows count each; an empty table gives no rows; other columns are ignored. Pages are read whole, in one pass, with an explicit
stack, so that neither length nor depth has a limit.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tagloom.runtime import ship, small_batches

# The element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu "
    "nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES = {  # a start tag of the key ends open elements of the values, up to one of the last list
    "li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th caption", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"),
    "tbody": ("tbody thead tfoot tr td th caption", "table"), "thead": ("tbody thead tfoot tr td th caption", "table"), "tfoot": ("tbody thead tfoot tr td th caption", "table"),
    "option": ("option", "select"), "optgroup": ("option optgroup", "select"), "body": ("head", "html"),
}
CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSES.items()}
IN_HEAD = frozenset("base link meta noscript script style template title".split())  # all others end an open head
SCOPE = frozenset("table td th caption html button object".split())  # what a search for an open p ends at
# What is left out whatever its density.
DROPPED = frozenset("head script style noscript template nav footer aside form button select option textarea iframe object embed svg canvas dialog menu search audio video noembed noframes title".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense adslot banner sponsor sponsored promo promotion werbung anzeige publicite publicidad nav navbar navigation menu breadcrumb breadcrumbs sidebar footer "
    "header masthead cookie cookies consent gdpr notice notices newsletter subscribe subscription signup paywall popup modal overlay alert share sharing social related recommended "
    "recommendations trending pagination pager toolbar login search copyright disclaimer".split()
)
TALK = frozenset("comment comments commentlist disqus respond replies reply kommentar kommentare commentaire commentaires comentario comentarios".split())
HAVING = frozenset("has no with without".split())  # before a name: the element has, or lacks, such a part
OWN = frozenset("article post entry story content main body page".split())  # with one of these, "header" may be the article's own

TAG = re.compile(r"<(?:!--(?:>|->|.*?(?:--!?>|\Z))|(?P<end>/)?(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+)(?:>|\Z)|[!?/][^>]*+(?:>|\Z))", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
ENDS = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Node:
    __slots__ = ("chars", "density", "drop", "kids", "link_chars", "link_tags", "name", "own", "parent", "sum", "tags", "text")

    def __init__(self, name: str, parent: Node | None, drop: bool, text: str | None = None) -> None:
        self.name, self.parent, self.drop, self.text = name, parent, drop, text
        self.kids: list[Node] = []
        self.tags = self.link_tags = self.chars = self.link_chars = 0
        self.density = self.sum = 0.0
        self.own = False  # an article or what stands for one


def named(attributes: dict[str, str]) -> list[str]:
    """The lower-case words of class and id, without those that a word like "has" precedes."""
    out: list[str] = []
    for value in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        words = [w.lower() for w in PIECES.findall(value)]
        out += [w for k, w in enumerate(words) if not (k and words[k - 1] in HAVING)]
    return out


def left_out(name: str, attributes: dict[str, str], in_article: bool) -> bool:
    """Whether an element can be no part of an article, by its name and attributes."""
    if name in ("html", "body"):
        return False
    if name in DROPPED:
        return True
    if not attributes:
        return name == "header" and not in_article
    if "hidden" in attributes or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", ""), re.I):
        return True
    if attributes.get("itemprop", "").lower() == "comment" or attributes.get("itemtype", "").lower().endswith("/comment"):
        return True
    if name in ("article", "main"):  # these are left out if a whole class or id says so
        return not TALK.isdisjoint(f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split())
    words = named(attributes)
    if not TALK.isdisjoint(words) or name == "header" and not in_article or attributes.get("role", "").lower() in ROLES:
        return True
    found = NAMES.intersection(words)
    if found == {"header"} and (in_article or not OWN.isdisjoint(words)):
        return False
    return bool(found)


class Reader:
    """Builds the tree of block elements, with runs of text between them as leaves. What is left out takes no text."""

    def __init__(self, forms: bool) -> None:
        self.root = Node("html", None, False)
        self.forms = forms  # whether forms may hold the article
        self.stack: list[tuple[str, Node, bool]] = []  # open elements: name, the node that takes their text, whether a link
        self.opened: dict[str, int] = {}  # how many of each name are open
        self.run: list[str] = []
        self.links = 0  # open links
        self.articles = 0  # open articles
        self.tags = self.link_tags = self.link_chars = 0  # of the run at hand

    def at(self) -> Node:
        return self.stack[-1][1] if self.stack else self.root

    def put(self, text: str) -> None:
        at = self.at()
        if at.drop:
            if self.stack[-1][0] != "head" or not text.strip():
                return
            self.pop()
        if "&" in text:
            text = html.unescape(text)
        self.run.append(text)
        if self.links:
            self.link_chars += len(" ".join(text.split()))

    def flush(self) -> None:
        """Ends the run: a block's text up to here."""
        at, text = self.at(), " ".join("".join(self.run).split())
        if text:
            leaf = Node("", at, False, text)
            leaf.chars, leaf.tags, leaf.link_tags, leaf.link_chars = len(text), self.tags, self.link_tags, min(self.link_chars, len(text))
            at.kids.append(leaf)
        else:
            at.tags += self.tags
            at.link_tags += self.link_tags
        self.run.clear()
        self.tags = self.link_tags = self.link_chars = 0

    def push(self, name: str, node: Node, link: bool = False) -> None:
        self.stack.append((name, node, link))
        self.opened[name] = self.opened.get(name, 0) + 1
        self.links += link
        self.articles += name in ("article", "main")

    def pop(self) -> None:
        name, node, link = self.stack[-1]
        if name in BLOCK and not node.drop:
            self.flush()
        self.stack.pop()
        self.opened[name] -= 1
        self.links -= link
        self.articles -= name in ("article", "main")

    def close(self, names: frozenset[str], stops: frozenset[str]) -> None:
        """Ends the open elements of these names above the nearest of the stops."""
        if not any(self.opened.get(n) for n in names):
            return
        lowest = len(self.stack)
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] in names:
                lowest = k
            elif self.stack[k][0] in stops:
                break
        while len(self.stack) > lowest:
            self.pop()

    def close_inline(self, name: str) -> None:
        """Ends an inline element; blocks opened within it stay open."""
        if not self.opened.get(name):
            return
        for k in range(len(self.stack) - 1, -1, -1):
            other, node, link = self.stack[k]
            if other == name:
                if any(x in BLOCK for x, _, _ in self.stack[k + 1 :]):
                    self.stack[k] = ("", node, False)
                    self.opened[name] -= 1
                    self.opened[""] = self.opened.get("", 0) + 1
                    self.links -= link
                else:
                    while len(self.stack) > k:
                        self.pop()
                return
            if other in ("td", "th", "table", "body"):
                return

    def end(self, name: str) -> None:
        if name in ("html", "body") or name in VOID:
            return
        if name not in BLOCK and name not in DROPPED:
            return self.close_inline(name)
        if self.opened.get(name):
            while self.stack[-1][0] != name:
                self.pop()
            self.pop()
        elif name in BLOCK and not self.at().drop:
            self.flush()

    def start(self, name: str, rest: str) -> bool:
        """Whether the element's content is left out."""
        if self.stack and self.stack[-1][0] == "head" and name not in IN_HEAD:
            self.pop()
        attributes: dict[str, str] = {}
        if rest.strip(" \t\r\n/"):
            for a in ATTRIBUTE.finditer(rest):
                attributes.setdefault(a[1].lower(), html.unescape(a[2] or a[3] or a[4] or ""))
        if name in BLOCK:
            self.close(frozenset(("p",)), SCOPE)
            if name in HEADING and self.stack and self.stack[-1][0] in HEADING:
                self.pop()
        if name in CLOSES:
            self.close(*CLOSES[name])
        if name == "a":
            self.close_inline("a")
        here = self.at()
        if name in ("html", "body"):
            return here.drop
        drop = here.drop or left_out(name, attributes, self.articles > 0) and not (name == "form" and self.forms)
        if name in VOID:
            if not drop:
                if name in BLOCK:
                    self.flush()
                self.run.append("\n" if name == "br" else "")
                self.tags += 1
        elif name in RAW:
            pass
        elif here.drop:
            self.push(name, here)
        elif drop:
            if name in BLOCK:
                self.flush()
            self.push(name, Node(name, here, True))
        elif name in BLOCK:
            self.flush()
            node = Node(name, here, False)
            node.own = name in ("article", "main") or attributes.get("itemprop") == "articleBody" or attributes.get("role") in ("article", "main")
            here.kids.append(node)
            self.push(name, node)
        else:
            link = name == "a" and "href" in attributes
            self.tags += 1
            self.link_tags += link
            self.push(name, here, link)
        return drop

    def read(self, page: str) -> Node:
        at, size = 0, len(page)
        while at < size:
            m = TAG.search(page, at)
            begin = m.start() if m else size
            if begin > at:
                self.put(page[at:begin])
            if m is None:
                break
            at = m.end()
            name = (m["name"] or "").lower()
            if m["end"]:
                self.end(name)
            elif name:
                drop = self.start(name, m["rest"])
                if name in RAW:
                    end = ENDS[name].search(page, at)
                    if not drop:  # text as it stands
                        self.flush()
                        self.put(page[at : end.start() if end else size].replace("&", "&amp;"))
                        self.flush()
                    at = (page.find(">", end.start()) + 1 or size) if end else size
        while self.stack:
            self.pop()
        self.flush()
        return self.root


def parse(page: str, forms: bool = False) -> Node:
    """The tree of the blocks that are not left out."""
    return Reader(forms).read(page)


def in_order(root: Node) -> list[Node]:
    """All nodes of a subtree, parents before children, in page order."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(reversed(node.kids))
    return out


def composite_density(chars: int, tags: int, link_chars: int, link_tags: int, body_share: float) -> float:
    """Characters per tag, times a logarithm that falls as links hold more of the characters and tags."""
    if chars == 0:
        return 0.0
    plain = max(chars - link_chars, 1)
    links, tags, link_tags = max(link_chars, 1), max(tags, 1), max(link_tags, 1)
    base = math.log(chars / plain * links + body_share * chars + math.e)
    return chars / tags * math.log(max(chars / links * tags / link_tags, 1.0)) / math.log(base)


def weigh(nodes: list[Node]) -> None:
    """Counts, densities and sums of all nodes, from the leaves up."""
    for node in reversed(nodes):
        up = node.parent
        if up is not None:
            up.chars += node.chars
            up.link_chars += node.link_chars
            up.tags += node.tags + (node.text is None)
            up.link_tags += node.link_tags
    share = nodes[0].link_chars / nodes[0].chars if nodes[0].chars else 0.0
    for node in reversed(nodes):
        node.density = composite_density(node.chars, node.tags, node.link_chars, node.link_tags, share)
        if node.parent is not None:
            node.parent.sum += node.density


def chosen(nodes: list[Node]) -> list[Node]:
    """The subtrees that hold the main text, in page order."""
    best: dict[Node, Node] = {}  # of each node: the largest sum in its subtree, itself if a leaf
    for node in reversed(nodes):
        top = node
        for kid in node.kids:
            if best[kid].sum > top.sum:
                top = best[kid]
        best[node] = top
    top = best[nodes[0]]
    path = [top]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    article = next((n for n in path if n.own and n.name == "article"), None) or next((n for n in path if n.own), None)
    if article is None:  # the subtree may hold the article and more
        within = [n for n in in_order(top) if n.own]
        within = [n for n in within if n.name == "article"] or within
        article = within[0] if len(within) == 1 and 3 * within[0].chars >= top.chars else None
    if article is not None:
        return [article]
    threshold = min(n.density for n in path)
    marked = {top}
    above = set(path)
    todo = [nodes[0]]
    while todo:
        node = todo.pop()
        if node is top:
            continue
        if node not in above and node.density >= threshold and node.density > 0:
            marked.add(best[node])
        todo.extend(node.kids)
    for node in nodes:  # headings right before what is chosen
        for k in range(len(node.kids) - 2, -1, -1):
            if node.kids[k].name in HEADING and node.kids[k + 1] in marked:
                marked.add(node.kids[k])
    return [n for n in nodes if n in marked]


def main_text(page: str) -> str:
    """The main text of a page."""
    nodes = in_order(parse(page))
    if len(nodes) == 1 and "<form" in page.lower():  # one form may be around everything
        nodes = in_order(parse(page, forms=True))
    weigh(nodes)
    if nodes[0].chars == 0:
        return ""
    out: list[str] = []
    seen: set[Node] = set()
    for node in chosen(nodes):
        for leaf in in_order(node):
            if leaf.text is not None and leaf not in seen:
                seen.add(leaf)
                out.append(leaf.text)
    return "\n".join(out)


def extract_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    ship(pages.sparkSession)
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h or "") for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    own = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), pages[html_col].cast("string").alias("html"))
    return own.mapInArrow(run, "page_id long, url string, text string, n_chars long")
