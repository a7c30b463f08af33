"""Main text of web pages by tree scoring.

A page becomes a tree of elements. Each paragraph-like block gives points for its length and commas to its container
and half as many to each ancestor further up; a container's points are discounted by the share of its text that is
inside links. The best container is kept, or the article (else the main or otherwise likely container) that it lies
in, with those of its siblings that score well or are headings, lists, tables or prose with few links. Within what is
kept, menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are left out.

What an element is called is weighed against what it holds: one that is named like a sidebar, menu, header or form but
has nine tenths of the page's prose is a wrapper and stays; half will do if it has a neutral name beside that one.
Reader comments go however long they are; what is only named like them, has nine tenths of the prose and the page's
first heading, which does not speak of comments, is a wrapper too.

Blocks come in page order, one per line, white space inside a block as one space, character references decoded.

Edge cases: null or empty html, or a page without main text, gives an empty text; unclosed and misnested tags are
closed as browsers would, so that everything is read; time and memory grow with a page's length, however deep it
nests; repeated rows yield a row each; an empty table yields no row.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, slices, tidy

#: Elements by what they are, as HTML names them.
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr keygen basefont bgsound".split())
RAW = frozenset("script style noscript template textarea title iframe noframes noembed xmp svg math object canvas audio video select".split())
LITERAL = frozenset("script style textarea title iframe noframes noembed xmp noscript".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
PARAGRAPH = frozenset("p pre blockquote td th dd dt li h1 h2 h3 h4 h5 h6 figcaption caption summary address".split())
#: Beside the best container these are kept unless a quarter of their text is links.
PROSE = frozenset("p pre blockquote ul ol dl table figure h1 h2 h3 h4 h5 h6".split())
ASIDE = frozenset("nav header footer aside menu dialog button search label".split())
FORM = frozenset("form fieldset".split())
CONTAINERS = frozenset("div section article main td table tbody blockquote html center".split())
CLOSES_P = BLOCK - frozenset("body html caption tbody td tfoot th thead tr optgroup option legend".split())
#: An opening tag ends an open element of these names, not reaching past the second set.
IMPLIED = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir".split())),
    "dt": (frozenset("dt dd".split()), frozenset(["dl"])),
    "dd": (frozenset("dt dd".split()), frozenset(["dl"])),
    "tr": (frozenset("tr td th".split()), frozenset("table tbody thead tfoot".split())),
    "td": (frozenset("td th".split()), frozenset("tr table".split())),
    "th": (frozenset("td th".split()), frozenset("tr table".split())),
    "tbody": (frozenset("tbody thead tfoot tr td th".split()), frozenset(["table"])),
    "thead": (frozenset("tbody thead tfoot tr td th".split()), frozenset(["table"])),
    "tfoot": (frozenset("tbody thead tfoot tr td th".split()), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
#: Words in a class, id or role that mark what is no main text.
UNLIKELY = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adbox|adslot|banner|promo\w*|sponsor\w*|sidebar\w*|side|aside|nav\w*|menu\w*|breadcrumbs?|toolbar|pager|pagination|"
    r"footer\w*|foot|header\w*|masthead|topbar|comments?|comment-?list|disqus|respond|replies|reader-?comments?|cookies?\w*|consent\w*|gdpr|notices?|alerts?|popup\w*|modal\w*|"
    r"overlay|newsletter\w*|subscribe\w*|subscription|signup|login|search\w*|share\w*|sharing|social\w*|related\w*|recommend\w*|widget\w*|skip\w*|tags?|"
    r"hidden|sr-only|noprint|navigation|complementary|contentinfo|alertdialog)(?:$|[\s_-])",
    re.I,
)
#: Such words for readers' comments, and endings that tell a state of a wrapper instead.
COMMENTS = re.compile(r"(?:^|[_-])(?:comments?|comment-?list|disqus|respond|replies)(?:$|[_-])", re.I)
STATE = re.compile(r"[_-](?:open|closed|enabled|disabled|allowed|on|off)$", re.I)
#: Shares of a page's prose that make an element a wrapper: one with a neutral name as well, and any other.
WRAPPER, MISNAMED = 0.5, 0.9
#: Classes, ids and roles that by themselves mark a main container.
LIKELY = frozenset("article main content post entry story main-content article-body article-content post-body post-content entry-content story-body page-content hentry".split())
#: A container that says which parts it has beside its text.
BESIDE = re.compile(r"(?:has|with|without|no)[_-]", re.I)
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Words in a heading that tell a section of readers' comments.
REMARKS = re.compile(r"\b(?:comments?|repl(?:y|ies)|responses?|respond|discussion|conversation|thoughts)\b", re.I)
HEADING = frozenset("h1 h2 h3".split())
CLOSING = {name: re.compile(f"</{name}", re.I) for name in LITERAL}
TAG = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|!--|[!?/])")
BROKEN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("at", "block", "children", "depth", "hidden", "label", "name", "parent")

    def __init__(self, nodes: list[Node], name: str, parent: Node | None, hidden: bool = False, label: str = ""):
        self.name, self.parent, self.hidden, self.label = name, parent, hidden, label
        self.at, self.children, self.depth = len(nodes), [], 0 if parent is None else parent.depth + 1
        #: The nearest block element, itself included.
        self.block: Node = self if parent is None or name in BLOCK else parent.block
        nodes.append(self)


def attributes_of(raw: str) -> tuple[str, bool]:
    """(class, id and role names, whether it is hidden) by a tag's attributes: by their names, never by words in other values."""
    labels, hidden = [], False
    for name, a, b, c in ATTRIBUTE.findall(raw):
        name, value = name.lower(), a or b or c
        if name in ("class", "id", "role"):
            labels.append(value)
        elif name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true" or name == "style" and UNSEEN.search(value):
            hidden = True
    return " ".join(x for x in labels if x), hidden


def tree(html: str) -> list[Node]:
    """The page's elements in page order, its root first; texts are strings among the children, references decoded."""
    nodes: list[Node] = []
    root = node = Node(nodes, "html", None)
    at, end = 0, len(html)
    opened: dict[str, list[Node]] = {}  # open elements by name, outermost first, so that no tag walks up to find one

    def text(a: int, b: int) -> None:
        if b > a:
            node.children.append(unescape(html[a:b]))

    def leave(to: Node) -> None:
        """Closes all elements below ``to``."""
        nonlocal node
        while node is not to:
            opened[node.name].pop()
            node = node.parent

    while at < end:
        lt = html.find("<", at)
        if lt < 0:
            text(at, end)
            break
        text(at, lt)
        m = TAG.match(html, lt)
        if m is None and (m := BROKEN_TAG.match(html, lt)) is None:
            if lt + 1 < end and (html[lt + 1].isalpha() or html[lt + 1] == "/") and html.find(">", lt) < 0:
                break  # a tag that the end of the page cuts off
            node.children.append("<")
            at = lt + 1
            continue
        at = m.end()
        if m[2] is None:
            if m[0] == "<!--":
                close = html.find("-->", at)
                at = end if close < 0 else close + 3
            else:
                close = html.find(">", at)
                at = end if close < 0 else close + 1
            continue
        name = m[2].lower()
        if m[1]:
            if opened.get(name):
                leave(opened[name][-1].parent)
            continue
        if name in CLOSES_P and node.block.name == "p":
            leave(node.block.parent)
        if rule := IMPLIED.get(name):
            # Of the elements that it ends, the outermost one below the nearest element that it does not reach past.
            scope = max((opened[x][-1].depth for x in rule[1] if opened.get(x)), default=0)
            ends = [o[i] for x in rule[0] if (o := opened.get(x)) and (i := bisect_right(o, scope, key=lambda n: n.depth)) < len(o)]
            if ends:
                leave(min(ends, key=lambda n: n.depth).parent)
        attributes = m[3]
        if name in LITERAL and not attributes.endswith("/"):
            close = CLOSING[name].search(html, at)
            at = end if close is None or (gt := html.find(">", close.end())) < 0 else gt + 1
            continue
        if name == "body" or name == "html":
            continue
        label, hidden = "", False
        if attributes:
            label, hidden = attributes_of(attributes)
        child = Node(nodes, name, node, hidden or name in RAW, label)
        node.children.append(child)
        if name not in VOID and not attributes.endswith("/"):
            node = child
            opened.setdefault(name, []).append(child)
    return nodes


def likely(n: Node) -> bool:
    return n.name in ("article", "main") or bool(n.label) and not LIKELY.isdisjoint(n.label.lower().split())


def wrappers(nodes: list[Node], gone: list[bool], remarks: list[Node]) -> list[Node]:
    """Of elements named like readers' comments, those that hold nearly all prose and the page's first heading.

    A heading over comments says so; then they are comments.
    """
    if not remarks:
        return []
    named = {n.at for n in remarks}
    size, last = [0] * len(nodes), list(range(len(nodes)))
    for n in reversed(nodes):
        if gone[n.at] and n.at not in named:
            size[n.at] = 0
        elif n.name == "a":
            size[n.at] = 0
        else:
            size[n.at] += sum(len(c.strip()) for c in n.children if isinstance(c, str))
        if n.parent is not None:
            size[n.parent.at] += size[n.at]
            last[n.parent.at] = max(last[n.parent.at], last[n.at])
    out_of = -1  # the end of the last element that goes for another reason
    for n in nodes:
        if n.at <= out_of:
            continue
        if gone[n.at] and n.at not in named:
            out_of = last[n.at]
        elif n.name in HEADING:
            title = " ".join(c for x in nodes[n.at : last[n.at] + 1] for c in x.children if isinstance(c, str))
            if REMARKS.search(title):
                return []
            return [r for r in remarks if r.at < n.at <= last[r.at] and size[r.at] >= MISNAMED * size[0] > 0]
    return []


def left_out(nodes: list[Node]) -> list[bool]:
    """Of each element, whether it is no main text by what it is, is called and holds; what lies below is not marked."""
    size = len(nodes)
    inside = [False] * size  # an article or main element
    gone = [False] * size  # for certain
    doubtful = [0.0] * size  # unless it has such a share of the prose
    remarks: list[Node] = []  # named like readers' comments
    for n in nodes[1:]:
        up, k = n.parent.at, n.at
        inside[k] = inside[up] or n.name in ("article", "main")
        if n.hidden or n.name in ASIDE and not (n.name == "header" and inside[up]):
            gone[k] = True
        elif n.name in FORM:
            doubtful[k] = WRAPPER
        elif n.label and not likely(n):
            names = [x for x in n.label.split() if not BESIDE.search(x)]
            if any(COMMENTS.search(x) and not STATE.search(x) for x in names):
                gone[k] = True
                remarks.append(n)
            elif odd := [x for x in names if UNLIKELY.search(x)]:
                doubtful[k] = WRAPPER if len(odd) < len(names) else MISNAMED
    for n in wrappers(nodes, gone, remarks):
        gone[n.at] = False
    if any(doubtful):
        # Text outside links of each element, without that of elements that go for certain.
        prose = [0] * size
        for n in reversed(nodes):
            if not gone[n.at]:
                prose[n.at] = 0 if n.name == "a" else prose[n.at] + sum(len(c.strip()) for c in n.children if isinstance(c, str))
                if n.parent is not None:
                    prose[n.parent.at] += prose[n.at]
        for k in range(1, size):
            gone[k] = gone[k] or prose[k] < doubtful[k] * prose[0] or doubtful[k] > 0 == prose[k]
    return gone


def blocks(nodes: list[Node], gone: list[bool]) -> list[tuple[Node, str, int]]:
    """(nearest block element, text, length inside links) of every block of prose, in page order."""
    out: list[tuple[Node, str, int]] = []
    parts: list[str] = []
    linked = 0
    owner = nodes[0]

    def flush() -> None:
        nonlocal linked
        if parts:
            if t := SPACE.sub(" ", "".join(parts)).strip():
                out.append((owner, t, min(linked, len(t))))
            parts.clear()
        linked = 0

    stack: list = [(nodes[0], 0, False)]
    while stack:
        node, i, link = stack.pop()
        children = node.children
        while i < len(children):
            c = children[i]
            i += 1
            if isinstance(c, str):
                parts.append(c)
                if link:
                    linked += len(c)
                continue
            if c.name == "br":
                parts.append(" ")
                continue
            if gone[c.at]:
                if c.name in BLOCK:
                    flush()
                continue
            stack.append((node, i, link))
            if c.name in BLOCK:
                flush()
                owner = c
            node, i, link, children = c, 0, link or c.name == "a", c.children
        if node.block is node:
            flush()
            owner = node.parent.block if node.parent is not None else node
    return out


def whole(best: Node) -> Node:
    """The article that the best container lies in, else the nearest main or likely container, else itself."""
    if best.name in ("article", "main"):
        return best
    found, up = best if likely(best) else None, best.parent
    while up is not None:
        if up.name in ("article", "main"):
            return up
        if found is None and likely(up):
            found = up
        up = up.parent
    return found or best


def main_text(html: str | None) -> str:
    """The main text of one page."""
    if not html:
        return ""
    nodes = tree(html)
    root, size = nodes[0], len(nodes)
    gone = left_out(nodes)
    found = blocks(nodes, gone)
    if not found:
        return ""
    score, text, linked = [0.0] * size, [0] * size, [0] * size
    for owner, t, inside in found:
        text[owner.at] += len(t)
        linked[owner.at] += inside
        if len(t) >= 25:
            to = owner.parent if owner.name in PARAGRAPH and owner.parent is not None else owner
            score[to.at] += 1 + t.count(",") + min(len(t) / 100, 3)
    for n in reversed(nodes[1:]):  # each after all that lies below it
        up, k = n.parent.at, n.at
        score[up] += score[k] / 2
        text[up] += text[k]
        linked[up] += linked[k]

    def net(n: Node) -> float:
        k = n.at
        if not text[k]:
            return 0.0
        return (score[k] * 1.25 + 25 if likely(n) else score[k]) * (1 - linked[k] / text[k])

    candidates = [n for n in nodes if text[n.at] and (n.name in ("article", "main", "html") or score[n.at] and (n.name in CONTAINERS or n.label))]
    best = whole(max(candidates, key=net, default=root))
    kept = [False] * size
    kept[best.at] = True
    if best.parent is not None:
        least = max(10.0, 0.2 * net(best))
        for c in best.parent.children:
            if isinstance(c, Node) and text[c.at] and not gone[c.at]:
                few_links = linked[c.at] < 0.25 * text[c.at]
                if net(c) >= least or few_links and (c.name in PROSE or score[c.at]):
                    kept[c.at] = True
    for n in nodes[1:]:
        kept[n.at] = kept[n.at] or kept[n.parent.at]
    return "\n".join(t for owner, t, _ in found if kept[owner.at])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: page_id, url, text, n_chars (code points)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in slices(batch.column(2), SLICE_BYTES):
                texts = [main_text(h) for h in part]
                n = len(part)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), batch.column(1).slice(first, n), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(tidy(run), "page_id long, url string, text string, n_chars long")
