"""Main text of web pages by composite text density.

The page becomes a light tree; parts that are never the article (menus, headers and footers of the page, sidebars,
notices, adverts, forms, scripts, styles, reader comments) are not entered. Every other node gets its link-adjusted
characters a tag; the node whose children's densities have the largest sum is the core, and the article is the widest
node on its way to the body whose own density reaches the body's. An article or main element has no say in this. Class
names mark a container only if all their words do, or if its links bear them out. Time and memory grow with the page.
Defined cases: null, empty and text-free pages have an empty text; unclosed and stray tags, a page cut off anywhere and
very deep nesting are accepted; repeated rows and null keys are kept; an empty table gives no rows; extra columns are
not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, tidied, tune

START = re.compile(r"<(?=[a-zA-Z!?]|/[a-zA-Z])")
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*+)")
MARK = re.compile(r"""[>"']""")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]++)(?:\s*=\s*(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
WORDS = re.compile(r"[a-z]+")
# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset("address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
CLOSE_P = BLOCKS - frozenset("br body html td th tr tbody thead tfoot option dd dt li".split()) | {"li", "dd", "dt"}
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*+>?", re.I) for t in RAW}
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tbody", "thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
FENCES = frozenset("article aside blockquote body div fieldset figure footer form header html main nav section table ul ol dl details".split())
NEVER = frozenset("head script style noscript template nav footer aside form iframe svg canvas menu dialog button select textarea object embed noembed noframes datalist xmp".split())
ROLES = frozenset("navigation banner complementary contentinfo search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of class names and ids that mark parts beside the article, and words that say nothing beside them.
BESIDE = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar comment comments disqus cookie cookies consent notice notices popup modal newsletter subscribe subscription share sharing social related recommended widget toolbar pagination pager skip".split())
NEUTRAL = frozenset("a area bar block body bottom bottombar box btn button buttons card cards center col column container content expanded feed footer form global group head header holder icon icons inner item items js left link links list lists main nav outer overlay page panel panels post posts right row section signup site slot sticky tools top unit wrap wrapper zone".split())
#: Elements that hold running text: a class name on one of them says nothing.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 a b i em strong span br td th tr pre code blockquote li dd dt figcaption q cite time small sup sub u mark".split())
LINKED = 1 / 3
ARTICLE = ("article", "main")


class Node:
    __slots__ = ("tag", "parent", "kids", "chars", "tags", "link_chars", "links", "first", "last", "hidden", "inside", "suspect", "density")

    def __init__(self, tag, parent, first, hidden, suspect=False):
        self.tag, self.parent, self.first, self.last, self.hidden, self.suspect = tag, parent, first, first, hidden, suspect
        self.inside = tag in ARTICLE or (parent is not None and parent.inside)
        self.kids, self.chars, self.tags, self.link_chars, self.links, self.density = [], 0, 0, 0, 0, 0.0


def beside(tag: str, raw: str, inside: bool) -> bool | None:
    """Whether an element is no part of an article, or None if its links have to tell; inside: it is in an article or main.

    A container's class or id tells it if all its words do or say nothing; if only the first or the last does, the
    element's share of linked text decides.
    """
    if tag in NEVER or (tag == "header" and not inside):
        return True
    if not raw or raw.isspace() or tag in ("html", "body", *ARTICLE):
        return False
    given = {m[1].lower(): (m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(raw)}
    if "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in given.get("style", "").replace(" ", "").lower():
        return True
    if given.get("role", "").lower() in ROLES:
        return True
    if tag in PROSE:
        return False
    told = False
    for name in [*given.get("class", "").lower().split(), given.get("id", "").lower()]:
        words = WORDS.findall(name)
        if not words or {"with", "has", "no"} & set(words):
            continue
        if BESIDE & set(words) and set(words) <= BESIDE | NEUTRAL:
            return True
        if words[0] in BESIDE or words[-1] in BESIDE:
            told = None
    return told


class Tags:
    """Where tags end. A mark outside quotes ends a tag; quotes before one that is never closed are taken as plain."""

    def __init__(self, html: str):
        self.html, self.plain = html, 0

    def end(self, at: int) -> int:
        """The place after the tag that starts at `at`, or -1 if it has no end. Each character is looked at twice at most."""
        html, here = self.html, at
        while at >= self.plain:
            m = MARK.search(html, here)
            if not m:
                break
            if m[0] == ">":
                return m.end()
            here = html.find(m[0], m.end()) + 1
            if not here:
                self.plain = m.end()
        else:
            return html.find(">", at) + 1 or -1
        self.plain = len(html)
        return html.find(">", at) + 1 or -1


def tree(html: str) -> tuple[Node, list[str]]:
    """The root, and the visible text in pieces; a node's own are pieces first to last. Blocks are parted by spaces.

    Open tags are counted within the nearest element that end tags do not reach out of, so that no tag looks for one that
    is not there, however deep it stands.
    """
    root = Node("", None, 0, False)
    at, out, pos, size = root, [], 0, len(html)
    tags, opened, scopes = Tags(html), Counter(), [Counter()]

    def text(piece):
        if piece and not at.hidden:
            out.append(unescape(piece) if "&" in piece else piece)
            n = sum(map(len, out[-1].split()))
            at.chars += n
            if at.tag == "a":
                at.link_chars += n

    def closed(node):
        """Ends the open elements up to and including node."""
        nonlocal at
        while True:
            done, at = at, at.parent
            done.last = len(out)
            if done.tag in FENCES:
                scopes.pop()
            opened[done.tag] -= 1
            scopes[-1][done.tag] -= 1
            if done.tag in BLOCKS and not done.hidden:
                out.append(" ")
            if done is node:
                return

    while pos < size:
        m = START.search(html, pos)
        if not m:
            text(html[pos:])
            break
        begin = m.start()
        text(html[pos:begin])
        if html[begin + 1] in "!?":
            if html.startswith("<!--", begin):
                end = html.find("-->", begin + 4)
                pos = end + 3 if end >= 0 else size
            else:
                pos = html.find(">", begin) + 1 or size
            continue
        pos = tags.end(begin)
        if pos < 0:  # a tag that the end of the page cuts off
            break
        m = NAME.match(html, begin)
        tag, raw = m[1].lower(), html[m.end() : pos - 1]
        if html[begin + 1] == "/":
            if (opened if tag in BLOCKS else scopes[-1])[tag] > 0:
                node = at
                while node.tag != tag:
                    node = node.parent
                closed(node)
            elif tag == "p" and not at.hidden:
                out.append(" ")
            continue
        ends = (*SIBLINGS.get(tag, ()), *(("p",) if tag in CLOSE_P else ()))
        left = sum(max(scopes[-1][t], 0) for t in ends)
        if left:
            node, found = at, None
            while left:
                if node.tag in ends:
                    found, left = node, left - 1
                node = node.parent
            closed(found)
        if tag in BLOCKS and not at.hidden:
            out.append(" ")
        told = beside(tag, raw, at.inside)
        kid = Node(tag, at, len(out), at.hidden or told is True, told is None)
        if not kid.hidden:
            at.kids.append(kid)
        if tag in VOID:
            kid.last = len(out)
            continue
        if tag in RAW:
            end = RAW_END[tag].search(html, pos)
            kid.last, pos = len(out), end.end() if end else size
            continue
        opened[tag] += 1
        scopes[-1][tag] += 1
        if tag in FENCES:
            scopes.append(Counter())
        at = kid
    while at is not root:
        closed(at)
    root.last = len(out)
    return root, out


def _order(root: Node) -> list[Node]:
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += node.kids
    return out


def article(root: Node) -> tuple[Node, list[Node]]:
    """The node that holds the main text, and those within that its links put beside it."""
    nodes, left_out = _order(root), []
    for node in reversed(nodes):  # children come before their parents
        for kid in node.kids:
            if kid.suspect and kid.link_chars >= LINKED * max(kid.chars, 1):
                left_out.append(kid)
        node.kids = [k for k in node.kids if not (k.suspect and k.link_chars >= LINKED * max(k.chars, 1))]
        for kid in node.kids:
            node.chars += kid.chars
            node.tags += kid.tags + 1
            node.links += kid.links + (kid.tag == "a")
            node.link_chars += kid.chars if kid.tag == "a" else kid.link_chars
    nodes = _order(root)
    body = next((n for n in nodes if n.tag == "body"), root)
    whole = body.link_chars / max(body.chars, 1)
    for node in nodes:
        if node.chars:
            c, t, lc, lt = node.chars, max(node.tags, 1), max(node.link_chars, 1), max(node.links, 1)
            base = math.log(c / max(c - node.link_chars, 1) * node.link_chars + whole * c + math.e)
            node.density = c / t * max(math.log(c / lc * (t / lt) + 1) / base, 0.0)
    total = lambda n: sum(k.density for k in n.kids)
    core = max(nodes, key=lambda n: (total(n), n.chars, -n.first))
    path, node = [], core
    while node is not None and node is not body:
        path.append(node)
        node = node.parent
    wide = [n for n in path if n.density >= body.density and n is not root and n.tag != "html"]
    return wide[-1] if wide else core, left_out


def main_text(html: str | None) -> str:
    """The article's text: one space for white space and between blocks, trimmed."""
    if not html:
        return ""
    root, pieces = tree(html)
    node, left_out = article(root)
    for gone in left_out:
        pieces[gone.first : gone.last] = [" "] * (gone.last - gone.first)
    return " ".join("".join(pieces[node.first : node.last]).split())


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every page."""
    tune(pages.sparkSession)

    @tidied
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([main_text(h) for h in b.column(2).to_pylist()], pa.string())], ["page_id", "url", "text"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string")


def op8_html(spark, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
