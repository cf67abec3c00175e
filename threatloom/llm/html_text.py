"""Main text of web pages by composite text density.

A page becomes a tree of elements. Menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles and reader comments are known by tag, role or class name and left out, unless most of the page's
text lies in them (a form or wrapper around the whole page); headers inside an article stay. For every other node the
composite density is its characters per tag, adjusted for characters and tags inside links; the
density sum of a node adds up the densities of its children. From the body, the path to the node with
the largest sum gives the threshold (the smallest density on it); in every branch that reaches the
threshold, the subtree with the largest sum is content.

Defined results: null and empty pages, and pages without content, give an empty text; broken markup
is closed by simple rules; character references are decoded; white space in a block is one space;
blocks are joined by one line feed; the work is linear in the length of the page; repeated pages
are answered one by one; an empty table gives no rows; other columns are not read.
"""

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threatloom.llm.common import text_rows, texts_of

# Elements by their meaning.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
LEFT_OUT = frozenset(
    "aside audio button canvas dialog embed fieldset footer form head iframe input label map math menu meta nav noscript object option script select "
    "style svg template textarea title video".split()
)
LEFT_OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
LEFT_OUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu menus breadcrumb breadcrumbs "
    "sidebar sidebars aside footer foot header masthead topbar toolbar notice notices cookie cookies consent gdpr popup modal overlay newsletter subscribe "
    "subscription signup login comment comments commentlist discussion disqus respond replies reply share sharing social related recommended pagination pager skip".split()
)
# Words that may stand beside these in the name of a class and leave its meaning as it is.
BESIDE_WORDS = frozenset(
    "site page top bottom left right main global primary secondary inner outer wrap wrapper container box block area section widget bar list item items links link "
    "banner text message policy form button buttons icons header head section col column content fixed sticky mobile desktop posts articles stories thread reader user".split()
)
# Reader comments stay out even where they are most of the text.
COMMENT_WORDS = frozenset("comment comments commentlist discussion disqus respond replies reply".split())
# Elements that may be around a whole page.
AROUND = frozenset("form fieldset label".split())
# Markup inside a line: part of the element around it, no subtree to choose.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
IN_HEAD = frozenset("base link meta noscript script style template title".split())
# An open element that a start tag closes: p before any block, and rows of lists and tables.
ENDS_P = BLOCK - {"body", "html"}
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}),
}

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>""", re.DOTALL
)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WORD = re.compile(r"[a-z0-9]+")
SPACE = re.compile(r"[ \t\n\r\f\v]+")


# How an element is left out: for good, or unless it holds most of the page's text.
OUT, OUT_IF_SMALL = 2, 1


def class_words(value: str) -> set:
    """Words of the class names that mean a part beside the article: every word is such a part's or goes with one."""
    found = set()
    for name in value.split():
        words = set(WORD.findall(name))
        if words <= LEFT_OUT_WORDS | BESIDE_WORDS:
            found |= words & LEFT_OUT_WORDS
    return found


def left_out(tag: str, attributes: str, in_article=False) -> int:
    """Whether an element is no part of an article, by tag, role, class or id: 0, ``OUT`` or ``OUT_IF_SMALL``."""
    if tag in LEFT_OUT and not (in_article and tag == "header"):
        return OUT_IF_SMALL if tag in AROUND else OUT
    known = 0
    if attributes and tag not in ("html", "body", "main"):
        for m in ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if name == "hidden" or name == "aria-hidden" and value == "true":
                return OUT
            if name == "role" and value in LEFT_OUT_ROLES and tag != "article":
                known = OUT_IF_SMALL
            if name in ("class", "id"):
                words = class_words(value)
                if words & COMMENT_WORDS:
                    return OUT
                if words and tag != "article":
                    known = OUT_IF_SMALL
    return known


class Node:
    __slots__ = ("tag", "parent", "children", "chars", "tags", "link_chars", "link_tags", "out", "density", "sum", "in_article")

    def __init__(self, tag, parent, out):
        self.tag, self.parent, self.out = tag, parent, out
        self.in_article = tag == "article" or parent is not None and parent.in_article
        self.children = []  # nodes and texts in order
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.sum = 0.0


def parse(page: str) -> tuple:
    """(root, all nodes in page order) of the element tree."""
    root = Node("", None, 0)
    nodes, at, here, opened = [root], 0, root, {}
    size, last_end = len(page), page.rfind(">") + 1  # no tag ends after the last ">"
    while at < size:
        m = TOKEN.search(page, at, last_end) if at < last_end else None
        if not m:
            here.children.append(page[at:])
            break
        if m.start() > at:
            here.children.append(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            if m[0].startswith("<!--") and not m[0].endswith("-->"):
                break  # a comment that never ends
            continue
        name, closing = name.lower(), m[1] or m[4]
        if closing:
            if opened.get(name):
                while here.tag != name:
                    opened[here.tag] -= 1
                    here = here.parent
                opened[name] -= 1
                here = here.parent
            continue
        if opened.get("head") and name not in IN_HEAD:
            while opened["head"]:
                opened[here.tag] -= 1
                here = here.parent
        if name in ENDS_P and opened.get("p"):
            up = here
            while up.tag != "p" and up.tag not in ENDS_P:
                up = up.parent
            if up.tag == "p":
                while here is not up:
                    opened[here.tag] -= 1
                    here = here.parent
                opened["p"] -= 1
                here = here.parent
        if name in SIBLINGS:
            ends, fence = SIBLINGS[name]
            if any(opened.get(t) for t in ends):
                up, last = here, None
                while up.parent is not None and up.tag not in fence:
                    if up.tag in ends:
                        last = up
                    elif last is not None:
                        break
                    up = up.parent
                if last is not None:
                    while here is not last.parent:
                        opened[here.tag] -= 1
                        here = here.parent
        attributes = m[3] if m[2] else m[6]
        node = Node(name, here, left_out(name, attributes, here.in_article))
        here.children.append(node)
        nodes.append(node)
        if name in RAW:
            end = re.compile(f"</{name}[\\s/>]", re.IGNORECASE).search(page, at)
            stop = end.start() if end else size
            node.children.append(page[at:stop])
            close = page.find(">", stop) if end else -1
            at = close + 1 if close >= 0 else size
        elif name not in VOID and not attributes.rstrip().endswith("/"):
            here = node
            opened[name] = opened.get(name, 0) + 1
    settle(nodes)
    return root, nodes


def settle(nodes: list) -> None:
    """``out`` of every node from its own kind and the nodes above it.

    An element that is left out only if small stays if it holds most of the text outside those left out for
    good: over half of all and of that in ``article`` and ``main`` elements, or without such elements nine tenths.
    """
    marked = {}  # characters inside article and main elements
    for node in reversed(nodes):
        if node.out != OUT:
            node.chars += sum(len(c) - c.count(" ") - c.count("\n") for c in node.children if isinstance(c, str))
            inside = node.chars if node.tag in ("article", "main") else marked.get(id(node), 0)
            if inside:
                marked[id(node)] = inside
            if node.parent is not None:
                node.parent.chars += node.chars
                if inside:
                    marked[id(node.parent)] = marked.get(id(node.parent), 0) + inside
    total, within = nodes[0].chars, marked.get(id(nodes[0]), 0)
    for node in nodes:
        most = 2 * node.chars > total and 2 * marked.get(id(node), 0) > within if within else 10 * node.chars > 9 * total
        node.out = bool(node.parent is not None and node.parent.out or node.out == OUT or node.out and not most)
    for node in nodes:
        node.chars = 0


def weigh(nodes: list) -> None:
    """Characters and tags of each subtree, composite densities and their sums, from the leaves up."""
    for node in reversed(nodes):
        if node.out:
            continue
        chars = sum(len(c) - c.count(" ") - c.count("\n") for c in node.children if isinstance(c, str))
        node.chars += chars
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.tags + 1
        up = node.parent
        if up is not None:
            up.chars += node.chars
            up.tags += node.tags + 1
            up.link_chars += node.link_chars
            up.link_tags += node.link_tags
    body = next((n for n in nodes if n.tag == "body"), nodes[0])
    share = body.link_chars / body.chars if body.chars else 0.0
    for node in nodes:
        if not node.out and node.chars:
            c, t, lc, lt = node.chars, max(1, node.tags), node.link_chars, node.link_tags
            base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
            node.density = c / t * math.log(max(1.0, c / max(1, lc) * (t / max(1, lt)))) / base
    for node in nodes:
        if node.parent is not None and not node.out and node.tag not in INLINE:
            node.parent.sum += node.density
    for node in nodes:
        if not node.sum:
            node.sum = node.density  # a leaf stands for itself


def content(nodes: list) -> list:
    """Roots of the content subtrees, in page order.

    If the best node lies in an ``article`` or ``main`` element, the outermost of these is the content, with the
    other outermost ones that are as dense as the path to the best node. If it lies around them, those as dense as
    the path are the content where they hold over half of the text.
    """
    body = next((n for n in nodes if n.tag == "body"), nodes[0])
    within, live = {id(body)}, []
    for n in nodes:
        if n is body or id(n.parent) in within and not n.out:
            within.add(id(n))
            if n.chars and n.tag not in INLINE:
                live.append(n)
    if not live:
        return []
    best = max(live, key=lambda n: n.sum)
    threshold, marked, up = best.density, None, best
    while up is not body:
        marked = up if up.tag in ("article", "main") else marked
        up = up.parent
        threshold = min(threshold, up.density)
    roots, inside = [], set()
    for n in nodes:
        if n.parent is not None and id(n.parent) in inside:
            inside.add(id(n))
        elif id(n) in within and (n is marked or n.tag in ("article", "main") and n.chars and n.density >= threshold):
            roots.append(n)
            inside.add(id(n))
    if marked is not None or 2 * sum(n.chars for n in roots) > body.chars:
        return roots
    if best is body:
        return [body]
    below = {}  # the largest sum in each subtree
    for n in reversed(live):
        for node in (n, n.parent):
            known, own = below.get(id(node)), below.get(id(n), n)
            if node is not None and (known is None or own.sum >= known.sum):
                below[id(node)] = own if node is not n or n.sum < own.sum else n
    found, reached = set(), {id(body)}
    for n in nodes:
        if id(n) in within and (n is body or id(n.parent) in reached):
            if n.tag in INLINE:
                reached.add(id(n))
            elif n.chars and n.density >= threshold:
                reached.add(id(n))
                found.add(id(below[id(n)]))
    roots, inside = [], set()
    for n in nodes:
        if n.parent is not None and id(n.parent) in inside:
            inside.add(id(n))
        elif id(n) in found:
            roots.append(n)
            inside.add(id(n))
    return roots


def blocks_of(root: Node) -> list:
    """Texts of the blocks in a subtree, in page order."""
    out, run, stack = [], [], [root]

    def end():
        text = SPACE.sub(" ", html.unescape("".join(run))).strip(" \t\n\r\f\v\xa0") if run else ""
        if text:
            out.append(text)
        run.clear()

    while stack:
        item = stack.pop()
        if item is None:
            end()
        elif isinstance(item, str):
            run.append(item)
        elif not item.out:
            if item.tag in BLOCK:
                end()
                stack.append(None)
            elif item.tag == "br":
                run.append(" ")
            stack.extend(reversed(item.children))
    end()
    return out


def main_text(page: str) -> str:
    """The main text of one page."""
    if not page:
        return ""
    _, nodes = parse(page)
    weigh(nodes)
    return "\n".join(b for root in content(nodes) for b in blocks_of(root))


def extract_text(pages: DataFrame, id_col="page_id", html_col="html", url_col="url") -> DataFrame:
    """(id, url, text, n_chars) of each page."""

    def run(batches):
        for batch in batches:
            texts = [main_text(t.decode(errors="replace")) for t in texts_of(batch)]
            columns = [batch.column(0), batch.column(2), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "url", "text", "n_chars"])

    schema = T.StructType([T.StructField("id", pages.schema[id_col].dataType), T.StructField("url", pages.schema[url_col].dataType), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    rows = text_rows(pages, id_col, html_col, pages[url_col].alias("url"))
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
