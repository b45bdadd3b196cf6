"""Main-text extraction by composite text density.

Every DOM node gets a density: its characters per tag, adjusted for links,

    C/T * ln(C/LC * T/LT) / ln(ln(C/(C-LC) * LC + LCb/Cb * C + e))

with C, T, LC, LT the characters, tags, link characters and link tags below
the node and Cb, LCb those of the body (zero counts as one). A node's density
sum adds the densities of its children, a text run counting its length; the
body counts its own text runs only, so it is chosen where these are the page.
The node with the largest sum is the article: menus lose by their links, the
rest of the page by its few characters. A paragraph stands for the element
around it, and what lies inside an ``article`` element for that element.

The path from the body to that node gives the thresholds for articles in
several parts: another subtree is kept with it if its density is not below the
smallest density on the path and its density sum not below the smallest sum
of the path's nodes that branch.

Element lists do what density cannot: scripts, styles, forms, hidden elements
and comment sections are no text at all; elements named as page furniture
(menus, footers, sidebars, headers outside an article) are not chosen; and these
and what is marked as furniture by role, class or id (adverts, notices) is left
out inside the chosen subtree.

Text assembly: character references are decoded, white space inside a block
becomes one space, blocks are trimmed and joined in page order by a line feed.

Edge cases: a null or empty page, and one without any text, gives the empty
string; unclosed and stray tags, unclosed comments and quotes are read to the
end of the page; pages are read whole, in time linear in their length (open
elements are looked up by name, not searched for); of equal density sums the
first in page order wins; null and repeated ids are kept row by row; extra
columns are not read.
"""

from __future__ import annotations

import re
from html import unescape
from math import e, log

from pyspark.sql import DataFrame

from graphsift.llm.common import map_texts

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*)>"""
                   r"""|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)|([a-zA-Z-]+)""")
LEAST_LOG = 0.1  # a page without links has no base for the logarithm
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# Element names by their HTML category, and words that mark page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noframes".split())
BLOCK = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset
    figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol
    optgroup option p pre search section summary table tbody td tfoot th thead tr ul""".split())
NEVER = frozenset("""head script style noscript template iframe object svg canvas form button select textarea
    title noframes""".split())
NOT_CHOSEN = frozenset("nav menu footer aside dialog".split())
WHOLE = frozenset("#page html body".split())
PARAGRAPH = frozenset("address blockquote dd dt h1 h2 h3 h4 h5 h6 li p pre td th".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
             "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
SCOPE = frozenset("ul ol dl table body html article section div".split())
FURNITURE = frozenset("""ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion
    banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe
    subscription signup sidebar menu nav navbar navigation breadcrumb breadcrumbs header masthead footer
    share sharing social related recommended recommendations widget toolbar pagination pager copyright""".split())
COMMENTS = frozenset("comment comments disqus reply replies".split())
ROLES = frozenset("""navigation banner contentinfo complementary search form dialog alert alertdialog menu
    menubar toolbar""".split())


class _Page:
    """A flat DOM: node i > 0 has a parent with a smaller number."""

    def __init__(self, html: str):
        self.tag, self.parent, self.attrs = ["#page"], [-1], [""]
        self.events: list[tuple[int, str | None]] = []   # (node, text), or (node, None) at a block edge
        self._parse(html)

    def _open(self, tag: str, attrs: str, stack: _Stack) -> int:
        if tag in BLOCK and stack.blocks and self.tag[stack.nodes[stack.blocks[-1]]] == "p":
            stack.cut(stack.blocks[-1])     # a block ends an open paragraph
        ends = CLOSED_BY.get(tag, ())
        while ends:
            depth = max((stack.depth(name) for name in ends), default=0)
            if depth <= (stack.scopes[-1] if stack.scopes else 0):
                break
            name = self.tag[stack.nodes[depth]]
            stack.cut(depth)
            if tag != "tr" or name == "tr":
                break
        self.tag.append(tag)
        self.parent.append(stack.nodes[-1])
        self.attrs.append(attrs)
        return len(self.tag) - 1

    def _parse(self, html: str) -> None:
        stack, pos, end = _Stack(self.tag), 0, len(html)
        while pos < end:
            m = TOKEN.search(html, pos)
            if m is None or m.start() > pos:
                text = html[pos:m.start() if m else end]
                self.events.append((stack.nodes[-1], text))
            if m is None:
                break
            pos = m.end()
            name = m[2] or m[5]
            if not name:
                continue
            tag = name.lower()
            if m[1] or m[4]:
                self._close(tag, stack)
                continue
            node = self._open(tag, m[3] or m[6] or "", stack)
            if tag in BLOCK:
                self.events.append((stack.nodes[-1], None))
            elif tag == "br":
                self.events.append((stack.nodes[-1], " "))
            if tag in RAW:
                stop = re.compile(f"</{re.escape(tag)}", re.I).search(html, pos)
                pos = stop.start() if stop else end
            if tag not in VOID and not (m[3] or m[6] or "").rstrip().endswith("/") or tag in RAW:
                stack.push(node)

    def _close(self, tag: str, stack: _Stack) -> None:
        depth = stack.depth(tag)
        if not depth or tag not in BLOCK and stack.blocks and stack.blocks[-1] > depth:
            return       # never opened, or an inline end tag, which doesn't close blocks
        if tag in BLOCK:
            self.events.append((stack.nodes[depth], None))
        stack.cut(depth)


class _Stack:
    """Open elements, and at which depths those of each name, blocks and
    scopes are: nothing is found by walking down the stack."""

    def __init__(self, tags: list[str]):
        self.tags, self.nodes = tags, [0]
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.scopes: list[int] = []

    def depth(self, tag: str) -> int:
        """Of the innermost open element of that name; 0 if there is none."""
        found = self.at.get(tag)
        return found[-1] if found else 0

    def push(self, node: int) -> None:
        tag, depth = self.tags[node], len(self.nodes)
        self.nodes.append(node)
        self.at.setdefault(tag, []).append(depth)
        if tag in BLOCK:
            self.blocks.append(depth)
        if tag in SCOPE:
            self.scopes.append(depth)

    def cut(self, depth: int) -> None:
        """Close all elements from ``depth`` on."""
        while len(self.nodes) > depth:
            tag = self.tags[self.nodes.pop()]
            self.at[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()
            if tag in SCOPE:
                self.scopes.pop()


def _marks(attrs: str) -> tuple[set[str], str, bool]:
    """(words of class and id, role, hidden)."""
    words, role, hidden = set(), "", False
    for m in ATTRIBUTE.finditer(attrs):
        key, value = (m[1] or m[3]).lower(), (m[2] or "").strip("\"'")
        if key in ("class", "id"):
            words.update(w.lower() for w in WORDS.findall(value))
        elif key == "role":
            role = value.lower()
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            hidden = True
        elif key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            hidden = True
    return words, role, hidden


def _told_apart(page: _Page) -> tuple[list[bool], list[bool], list[bool]]:
    """Per node: lies it in an element that is no text; in one that is not
    chosen by its name; is it furniture itself, by name, role, class or id?"""
    n = len(page.tag)
    holds = [t in ("article", "main", "h1") for t in page.tag]
    for i in range(n - 1, 0, -1):
        holds[page.parent[i]] |= holds[i]
    drop, named, marked, in_article = [False] * n, [False] * n, [False] * n, [False] * n
    for i in range(1, n):
        up, tag = page.parent[i], page.tag[i]
        in_article[i] = in_article[up] or tag == "article"
        drop[i] = drop[up] or tag in NEVER
        by_name = tag in NOT_CHOSEN or tag == "header" and not in_article[i]
        named[i], marked[i] = named[up] or by_name, by_name
        if not drop[i] and page.attrs[i].strip(" /") and tag not in ("html", "body", "main"):
            words, role, hidden = _marks(page.attrs[i])
            own, comments = tag in ("article", "h1"), bool(words & COMMENTS)
            drop[i] = hidden and not holds[i] or comments and (not holds[i] or own)
            marked[i] |= not holds[i] and (bool(words & FURNITURE) or role in ROLES)
    return drop, named, marked


def _densities(page: _Page, drop: list[bool], text_len: list[int]) -> tuple[list[float], list[float]]:
    """(density, density sum) per node."""
    n = len(page.tag)
    chars, tags, link_chars, link_tags = list(text_len), [0] * n, [0] * n, [0] * n
    for i in range(n - 1, 0, -1):
        if drop[i]:
            continue
        up = page.parent[i]
        if page.tag[i] == "a":
            link_chars[i], link_tags[i] = chars[i], link_tags[i] + 1
        chars[up] += chars[i]
        tags[up] += tags[i] + 1
        link_chars[up] += link_chars[i]
        link_tags[up] += link_tags[i]
    body = next((i for i in range(n) if page.tag[i] == "body"), 0)
    ratio = link_chars[body] / max(1, chars[body])
    density, sums = [0.0] * n, [float(x) for x in text_len]
    for i in range(n - 1, -1, -1):
        if drop[i] or not chars[i]:
            continue
        c, t, lc, lt = chars[i], max(1, tags[i]), max(1, link_chars[i]), max(1, link_tags[i])
        base = log(c / max(1, c - link_chars[i]) * link_chars[i] + ratio * c + e)
        density[i] = c / t * max(0.0, log(c / lc * t / lt)) / max(log(base), LEAST_LOG)
        if i and page.tag[page.parent[i]] not in WHOLE:
            sums[page.parent[i]] += density[i]
    return density, sums


def main_text(html: str | None) -> str:
    """The article text of one page."""
    if not html:
        return ""
    page = _Page(html)
    drop, named, marked = _told_apart(page)
    n = len(page.tag)
    text_len, texts = [0] * n, []
    for node, text in page.events:
        plain = None if text is None else unescape(text)
        texts.append(plain)
        if plain and not drop[node]:
            text_len[node] += len(" ".join(plain.split()))
    density, sums = _densities(page, drop, text_len)
    live = [i for i in range(n) if not drop[i] and not named[i]]
    best = max(live, key=lambda i: (sums[i], -i))
    if sums[best] <= 0:
        return ""

    path, at = [best], best
    while page.tag[at] not in WHOLE:
        at = page.parent[at]
        path.append(at)
    above, inside = set(path), {i: [] for i in path}        # sums of the path's nodes, child by child
    for i in live:
        if page.parent[i] in above and density[i] > 0:
            inside[page.parent[i]].append(density[i])
    dense = min((density[i] for i in path if density[i] > 0), default=0.0)
    least = min([sums[best], *[sum(inside[i]) for i in path[1:] if len(inside[i]) > 1]])   # where the path branches
    parts = [i for i in live if dense > 0 and density[i] >= dense and sums[i] >= least and i not in above]

    # Per node: the outermost article element around it, else the element it stands for.
    article, home = [0] * n, list(range(n))
    for i in range(1, n):
        up = page.parent[i]
        article[i] = article[up] or (i if page.tag[i] == "article" else 0)
        if page.tag[up] not in WHOLE and (page.tag[i] in PARAGRAPH or page.tag[i] not in BLOCK):
            home[i] = home[up]
    kept = [False] * n
    for i in [best, *parts]:
        kept[article[i] or home[i]] = True
    for i in range(1, n):
        kept[i] = not drop[i] and (kept[i] or kept[page.parent[i]] and not marked[i])

    blocks, current = [], []
    for (node, _), plain in zip(page.events, texts, strict=True):
        if plain is None:
            if current:
                blocks.append(" ".join("".join(current).split()))
                current = []
        elif kept[node]:
            current.append(plain)
    if current:
        blocks.append(" ".join("".join(current).split()))
    return "\n".join(b for b in blocks if b)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html",
            keep: list[str] | None = None) -> DataFrame:
    """(id, *keep, text) per page."""
    return map_texts(pages, id_col, html_col, lambda htmls: [(main_text(h),) for h in htmls], "text string",
                     keep=keep)
