"""Main text of web pages by composite text density.

A page is read into a tree. Each node has the characters and tags below it, and
those inside links; its density is ``C/T * log_b(C/LC' * T/LT')`` with base
``b = ln(LC/C' * C + e)`` where primes mark non-link and page-wide terms, that
is, characters per tag, lowered where text is mostly links. A node's density sum
is the sum of its children's densities. The threshold is the least density on
the path from ``body`` to the node with the largest density sum; the main content
is the nearest node that holds this node and all others whose density reaches the threshold and whose text is not mostly
links; where that lies inside an article or main element, it is that element. Between these nodes, parts that are mostly
links are left out. Its text, without blocks that are boilerplate by tag, role or name, is returned block by block. A class or id condemns a block by itself only where all
its words say so; a name that merely holds such a word (``share-price``) needs text that is mostly links as well.

Defined cases: null or empty html, and pages without text, give an empty text; unclosed or
cut tags, comments and references are read as far as they go; a page without
``body`` is its own body; repeated rows give repeated results; very long and very deep pages take time in proportion to their length;
an empty table gives an empty result; further columns stay, but for one named as the result, which it replaces.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import bounded_batches

# HTML element names and boilerplate words.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul xmp".split()
)
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Names of these say nothing: pages, headings (their ids are made from their words) and code (marked up word by word).
NAMELESS = frozenset("body html article main h1 h2 h3 h4 h5 h6 pre code span em strong b i p".split())
#: Controls of forms and media (button, select, fieldset, textarea, video, object and so on) are no boilerplate outside a form: their text stays.
SKIP = frozenset("nav footer aside form script style noscript template iframe svg dialog menu title head search".split())
SKIP_ROLE = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
#: Parts of class names and ids that tell of boilerplate.
BOILERPLATE = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertisements advertising adsbygoogle banner banners sponsor sponsored sponsors promo promos promotion menu menus nav navs navbar navigation breadcrumb breadcrumbs "
    "sidebar sidebars side footer footers foot masthead siteheader pageheader topbar cookie cookies consent gdpr notice notices alert alerts popup popups modal overlay newsletter newsletters subscribe subscription signup login "
    "share sharing social related recommended recommendations comment comments commentlist disqus replies reply respond widget widgets toolbar pager pagination skiplink copyright legal disclaimer".split()
)
#: Parts that only say which or where: a name of these and at least one of the former is boilerplate by itself.
PLACE = frozenset(
    "site page main global top bottom left right primary secondary post posts article articles entry blog user reader google js box container wrapper wrap list block area section bar slot unit panel inner outer item items link links button buttons "
    "icon icons form header head body group row column col col1 col2 sticky fixed mobile desktop thread template count title text content holder region zone small large info warning success danger error primary story stories".split()
)
#: Two parts that tell of boilerplate together.
PAIRS = frozenset("site-header page-header skip-link skip-to".split())
#: Names of reader comments, which keep their meaning where a heading says the same.
REMARKS = frozenset("comment comments commentlist disqus replies respond".split())
#: Class names that tell of a layout or a state, not of what the element is.
FLAG = re.compile(r"(?:^|[_-])(?:has|no|not|with|without|is|hide|show)[_-]|[_-](?:open|opened|closed|on|off|enabled|disabled|allowed|layout)$", re.I)
#: Elements that an opening tag closes, where they are open.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Inside these, an opening tag closes nothing that is open outside.
SCOPE = frozenset("ul ol dl table body html td th article section div main nav aside footer header form blockquote".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: The slash of an empty element, which is not the end of a value without quotes.
EMPTY = re.compile(r"""(?:^|[\s"'])/\s*$|^[^=]*/\s*$""")
PART = re.compile(r"[a-z]+|[A-Z](?:[a-z]+|[A-Z]*)|\d+")
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "noise", "named", "doubted", "anchor", "parent", "children", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, noise: bool = False):
        self.tag, self.parent, self.noise, self.children = tag, parent, noise, []
        self.named = self.doubted = False  # names that tell of boilerplate, or hold such a word
        self.anchor = ""  # an id that a heading of the same words may have given
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _parts(name: str) -> list[str]:
    return [p.lower() for p in PART.findall(name)]


def _says(name: str) -> tuple[bool, bool]:
    """Whether a class name or id tells of boilerplate by itself, and whether it holds a word that may."""
    if FLAG.search(name):
        return False, False
    if name.lower() in BOILERPLATE:
        return True, True
    parts = [p for p in _parts(name) if not p.isdigit()]
    told = any(p in BOILERPLATE for p in parts) or any("-".join(two) in PAIRS for two in zip(parts, parts[1:], strict=False))
    return told and all(p in BOILERPLATE or p in PLACE for p in parts), told


def _judge(node: Node, attrs: str) -> None:
    """What tag, role, visibility and names say of an element; attributes are read by their own names."""
    if node.tag in SKIP:
        node.noise = True
        return
    for m in ATTR.finditer(attrs) if attrs else ():
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            node.noise = True
        elif key == "role" and value.lower() in SKIP_ROLE:
            node.noise = True
        elif key in ("class", "id") and node.tag not in NAMELESS:
            for name in value.split():
                told, doubted = _says(name)
                if key == "id" and told:
                    node.anchor = " ".join(_parts(name))
                node.named, node.doubted = node.named or told, node.doubted or doubted


def parse(page: str) -> Node:
    """The page's tree; texts are ``str`` children with references decoded."""
    root = node = Node("#root", None)
    opened: Counter[str] = Counter()  # tags from the root to the node, so that what isn't open is not looked for

    def leave(top: Node) -> Node:
        up = node
        while up is not top:
            opened[up.tag] -= 1
            up = up.parent
        return top

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text:
            node.children.append(html_lib.unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:  # a closing tag: up to the element it closes, if that is open
            if not opened[tag]:
                continue
            up = node
            while up.parent is not None and up.tag != tag:
                if tag not in BLOCK and up.tag in SCOPE:
                    break
                up = up.parent
            if up.parent is not None and up.tag == tag:
                node = leave(up.parent)
            continue
        if tag in BLOCK and opened["p"]:  # closes an open paragraph
            up = node
            while up.parent is not None and up.tag not in SCOPE and up.tag != "p":
                up = up.parent
            if up.tag == "p":
                node = leave(up.parent)
        if tag in CLOSES and any(opened[x] for x in CLOSES[tag]):
            up = node
            while up.parent is not None and up.tag not in CLOSES[tag] and up.tag not in SCOPE - {"td", "th"}:
                up = up.parent
            if up.tag in CLOSES[tag]:
                node = leave(up.parent if up.tag != "td" and up.tag != "th" or tag != "tr" else (up.parent.parent or up.parent))
        new = Node(tag, node)
        _judge(new, m[3] or "")
        node.children.append(new)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            if tag in ("xmp", "textarea"):
                inside = page[at : close.start() if close else end]
                new.children.append(inside if tag == "xmp" else html_lib.unescape(inside))
            at = close.end() if close else end
        elif tag not in VOID and not EMPTY.search(m[3] or ""):
            node = new
            opened[tag] += 1
    return root


def _nodes(root: Node) -> list[Node]:
    """Parents before children."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        out.append(n)
        todo += [c for c in n.children if isinstance(c, Node)]
    return out


def densities(root: Node) -> list[Node]:
    nodes = _nodes(root)
    for n in reversed(nodes):
        for c in n.children:
            if isinstance(c, str):
                n.chars += len(SPACE.sub(" ", c.strip()))
            else:
                n.chars += c.chars
                n.tags += c.tags + 1
                n.link_chars += c.chars if c.tag == "a" else c.link_chars
                n.link_tags += c.link_tags + (c.tag == "a")
    body = next((n for n in nodes if n.tag == "body"), root)
    ratio = body.link_chars / max(body.chars, 1)
    for n in nodes:
        if n.doubted and not n.noise:
            n.noise = _condemned(n, body)
    for n in nodes:
        if n.chars and not n.noise:
            plain = max(n.chars - n.link_chars, 1)
            base = math.log(n.chars / plain * n.link_chars + ratio * n.chars + math.e)
            inside = n.chars / max(n.link_chars, 1) * max(n.tags, 1) / max(n.link_tags, 1)
            n.density = n.chars / max(n.tags, 1) * math.log(max(inside, 1.0)) / math.log(max(base, math.e)) if base > 1 else n.chars / max(n.tags, 1)
    for n in nodes:
        n.total = sum(c.density for c in n.children if isinstance(c, Node))
    return nodes


def _condemned(n: Node, body: Node) -> bool:
    """Whether an element with a name that holds a boilerplate word is boilerplate.

    A wrapper around most of the text is not, whatever its name. A name that tells by itself is enough, unless it is an id that
    a heading inside gave by the same words; any other name only condemns what is mostly links.
    """
    if 2 * (n.chars - n.link_chars) > body.chars - body.link_chars and any(isinstance(c, Node) and c.tag in BLOCK for c in n.children):
        return False
    if n.named and not (n.anchor and n.anchor not in REMARKS and _heading_says(n)):
        return True
    return 2 * n.link_chars > n.chars


def _heading_says(n: Node) -> bool:
    """Whether the first heading inside has the words of the element's id."""
    heading = next((x for x in _nodes(n) if x.tag in HEADING), None)
    return heading is not None and " ".join(_parts("".join(_texts(heading)))) == n.anchor


def _texts(top: Node) -> list[str]:
    return [c for n in _nodes(top) for c in n.children if isinstance(c, str)]


def main_node(root: Node) -> Node:
    nodes = densities(root)
    body = next((n for n in nodes if n.tag == "body"), root)
    under: set[Node] = set()  # what lies in boilerplate
    for n in nodes:  # parents first
        if n.parent is not None and (n.parent.noise or n.parent in under):
            under.add(n)
    below = [n for n in _nodes(body) if n.chars and not n.noise and n not in under]
    if not below:
        return body
    best = max(below, key=lambda n: n.total)
    threshold, up = best.density, best
    while up is not None and up is not body.parent:
        threshold, up = min(threshold, up.density) if up.chars else threshold, up.parent
    above, up = set(), best
    while up is not body:
        up = up.parent
        above.add(up)
    dense = {n for n in below if n is best or n.density >= threshold and n not in above and 2 * n.link_chars <= n.chars}
    held: dict[Node, int] = {}
    for n in reversed(nodes):
        held[n] = (n in dense) + sum(held[c] for c in n.children if isinstance(c, Node))
    inner = best
    while held[best] < len(dense):
        best = best.parent
    # An article or main element above it is the content.
    up = best
    while up is not body and up.parent is not None:
        if up.tag in ("article", "main"):
            best = up
        up = up.parent
    # Lists of links beside the parts that were put together.
    while inner is not best:
        if inner.tag in ("article", "main"):
            break
        inner = inner.parent
        if inner.tag in ("article", "main"):
            break
        for c in inner.children:
            if isinstance(c, Node) and c.tag in BLOCK and not held[c] and 2 * c.link_chars > c.chars:
                c.noise = True
    if best.tag in HEADING or best.tag == "p":
        best = best.parent or best
    return best


def blocks(top: Node) -> list[str]:
    """The subtree's text blocks in page order, without boilerplate inside it."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if run:
            text = SPACE.sub(" ", "".join(run)).strip()
            if text:
                out.append(text)
            run.clear()

    todo: list = [(top, False)]
    while todo:  # a stack, so that deep pages need no recursion
        n, leaving = todo.pop()
        if isinstance(n, str):
            run.append(n)
        elif leaving:
            flush()
        elif n is not top and (n.noise or n.tag == "header" and not (_within(n) or _has_heading(n))):
            if n.tag in BLOCK:
                flush()
        elif n.tag == "br":
            run.append(" ")
        else:
            if n.tag in BLOCK:
                flush()
                todo.append((n, True))
            todo += [(c, False) for c in reversed(n.children)]
    flush()
    return out


def _within(n: Node) -> bool:
    """Whether a header belongs to an article: it lies inside one, or in a main element."""
    up = n.parent
    while up is not None:
        if up.tag in ("article", "main"):
            return True
        up = up.parent
    return False


def _has_heading(n: Node) -> bool:
    return any(x.tag in HEADING for x in _nodes(n))


def main_text(page: str | None) -> str:
    return "\n\n".join(blocks(main_node(parse(page)))) if page else ""


@F.pandas_udf(StringType())
def _main_texts(pages: pd.Series) -> pd.Series:
    return pages.map(main_text, na_action=None)


def extract_main_text(df: DataFrame, html_col: str = "html", out: str = "text") -> DataFrame:
    """``df`` with the main text of ``html_col`` in ``out`` (which replaces a column of that name)."""
    bounded_batches(df.sparkSession)
    return df.withColumn(out, extracted(F.col(f"`{html_col}`")))


def extracted(page: Column) -> Column:
    return F.coalesce(_main_texts(F.coalesce(page, F.lit(""))), F.lit(""))
