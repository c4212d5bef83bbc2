"""HTML extraction by wrapper induction.

Each page becomes a tree of block elements. All pages of a host are aligned with simple tree matching into one
template: matched nodes whose own text never changes are constant, the others are varying slots. Pages of a host
with equal content text are one page to the template, so copies say nothing about it. Tasks fold
their pages into one small template per host, and templates of a host are folded again by the same matching,
so a host with a third of all pages gathers one row per task.

A page is then aligned with its host's template. Its content is what lies in its article (or main element;
without either, its body), without nodes whose element or class says menu, header, footer, sidebar, notice, advert,
form, comments and the like, and without constant nodes: slots that never vary while others around them do, on at least
``TEMPLATE_PAGES`` distinct pages and ``TEMPLATE_SHARE`` of the distinct pages with the varying slot around them. Headings and paragraphs of an article are never taken for template.

A class says so if all words of one of its tokens are names or shapes of such blocks ("share-box", not "elementor-widget-container").
An id says so on no heading, paragraph or inline element, and inside an article only on a div without a class. What holds an article
or main element is not dropped by its name, unless that names comments, related articles and the like beside the page's own article.
A page without article and main whose text is all in blocks so named keeps it.

Siblings with one tag and class are one repeated node of the template, and digits in class names don't count, so a
template stays as small as the host's layout is varied. It keeps every node, however rare; children are aligned among those whose
tag and class both sides have.

Defined results: null, empty and text-only pages (text: their text); a null or missing host is a host; unclosed, stray and
crossing tags are repaired as browsers do for paragraphs, lists and tables; a tag or comment cut off at
the end is dropped; drawings (svg) are left out, formulas (math) are inline text; elements deeper than ``DEEP`` stay in the text of the element there; repeated pages each
give a row; further columns are ignored; an empty table gives no rows. Whole pages are read.
"""

from __future__ import annotations

import hashlib
import html
import pickle
import re
import zlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import small_batches

TEMPLATE_PAGES = 5
TEMPLATE_SHARE = 0.5
DEEP = 60
MEMO_TEMPLATES = 2000

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*+)(?:>|\Z)", re.S)
ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike "
                   "strong sub sup time tt u var".split())
MATH = frozenset("math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mmultiscripts mprescripts none "
                 "mtable mtr mtd mlabeledtr mstyle mspace mpadded mphantom menclose merror mfenced maction mglyph semantics annotation "
                 "annotation-xml".split())
CELLS = frozenset("mtable mtr mlabeledtr mtd".split())
INLINE |= MATH - CELLS
# start tags that end a drawing left open, and what else matters to where it ends
DRAWING = re.compile(r"<(?P<end>/?)(?P<tag>svg|foreignobject|p|div|h[1-6]|ul|ol|dl|li|table|blockquote|pre|section|article|main|body)"
                     r"(?=[\s/>])(?P<attrs>[^>]*)>", re.I)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = HEADINGS | frozenset("p blockquote pre li dd dt td th figcaption".split())
# what an open element is closed by
CLOSED_BY = {"head": frozenset(["body"]), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
             "option": frozenset(["option", "optgroup"]), "tr": frozenset(["tr", "tbody", "tfoot", "thead"]),
             "td": frozenset(["td", "th", "tr", "tbody", "tfoot", "thead"]), "th": frozenset(["td", "th", "tr", "tbody", "tfoot", "thead"]),
             "p": frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 "
                            "h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())}
# where the search for an element to close ends
SCOPE = {"li": frozenset(["ul", "ol", "menu"]), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]), "tr": frozenset(["table"]),
         "td": frozenset(["table", "tr"]), "th": frozenset(["table", "tr"]), "option": frozenset(["select", "datalist"]),
         "p": frozenset(["table", "td", "th", "caption", "button", "article", "section", "div", "body"])}
DROPPED = frozenset("nav aside footer form button select dialog menu head object embed canvas audio video map".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert alertdialog dialog".split())
DROPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices "
    "alert sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments disqus reply replies respond share "
    "sharing social related recommended newsletter subscribe subscription signup login popup modal overlay toolbar pagination pager "
    "widget skip copyright disclaimer".split())
# words that come with these in a token; others ("has-sidebar", "layout-sidebar-right") say something else of the element
SHAPES = frozenset("left right top bottom box bar line list link links block area section button buttons btn icon icons item items row "
                   "slot unit inline fixed sticky floating mobile desktop posts stories articles trail form text title small large".split())
OWNERS = frozenset("site page post article entry blog global main primary secondary".split())  # "site-footer"
# blocks that hold articles other than the page's own
NEIGHBOURS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion sidebar menu nav navbar navigation "
                       "footer comment comments disqus reply replies respond related recommended".split())
NAME = re.compile(r"[a-z]+|\d+")


@lru_cache(maxsize=20_000)
def says(names: str) -> int:
    """Whether a class or id names a block that is no content: 0, 1, or 2 if it is one of ``NEIGHBOURS``."""
    found = 0
    for token in re.sub(r"([a-z])([A-Z])", r"\1 \2", names.replace(" ", "\n")).lower().split("\n"):
        words = NAME.findall(token)
        while len(words) > 1 and words[0] in OWNERS and words[-1] in DROPPED_WORDS:
            del words[0]
        if any(w in DROPPED_WORDS for w in words) and all(w in DROPPED_WORDS or w in SHAPES or w.isdigit() for w in words):
            found = max(found, 2 if any(w in NEIGHBOURS for w in words) else 1)
    return found


class Node:
    __slots__ = ("tag", "key", "names", "kids", "text", "holds")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag = tag
        got = [(n.lower(), a or b or c) for n, a, b, c in ATTR.findall(attrs)] if attrs else []
        self.names = tuple((n, v) for n, v in got)
        self.key = (tag, re.sub(r"\d+", "0", " ".join(v for n, v in got if n != "id"))) if got else (tag, "")
        self.kids: list = []  # nodes and strings in page order
        self.text = None  # digest of its own text
        self.holds = False  # an article or main element below

    def nodes(self):
        return [k for k in self.kids if isinstance(k, Node)]

    def is_main(self) -> bool:
        return self.tag == "main" or ("role", "main") in self.names

    def dropped(self, inside_article: bool, names: bool = True, wrappers: bool = False) -> bool:
        """Whether the element is no content. ``names``: by its class or id, too; ``wrappers``: not if it holds an article."""
        if self.tag in DROPPED or self.tag in RAW or (self.tag == "header" and not inside_article):
            return True
        classed = any(name == "class" for name, _ in self.names)
        for name, value in self.names:
            if name == "role":
                if value.strip().lower() in ROLES:
                    return True
            elif names and self.tag not in ("article", "main", "body", "html"):
                if name == "id" and (self.tag in PROSE or self.tag in INLINE or inside_article and (classed or self.tag != "div")):
                    continue
                found = says(" ".join(value.split()))
                if found and not (self.holds and (wrappers or found < 2)):
                    return True
        return False


def after_drawing(page: str, at: int) -> int:
    """Where the svg element whose start tag ends at ``at`` is over: behind its end tag, or before a block or the end of one around it."""
    depth, foreign = 1, 0
    for m in DRAWING.finditer(page, at):
        tag = m["tag"].lower()
        if tag == "svg":
            depth += -1 if m["end"] else not m["attrs"].endswith("/")
            if not depth:
                return m.end()
        elif tag == "foreignobject":
            foreign = max(0, foreign + (-1 if m["end"] else not m["attrs"].endswith("/")))
        elif not foreign:
            return m.start()
    return at


def parse(page: str) -> Node:
    """The tree of a page."""
    root = Node("html")
    stack = [root]
    at = 0
    find = TOKEN.search
    while True:
        m = find(page, at)
        if m is None:
            stack[-1].kids.append(page[at:])
            break
        if m.start() > at:
            stack[-1].kids.append(page[at:m.start()])
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if tag is None or (m["tag2"] and not m[0].endswith(">")):
            continue
        tag = tag.lower()
        if m["end"] or m["end2"]:
            if tag == "br":
                stack[-1].kids.append("\n")
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if tag in INLINE and stack[i].tag not in INLINE or stack[i].tag in ("table", "article", "body") and tag in ("p", "li", "div"):
                    break
            continue
        if tag == "br" or tag == "hr" or tag == "wbr":
            if tag != "wbr":
                stack[-1].kids.append("\n")
            continue
        attrs = m["attrs"] or m["attrs2"] or ""
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in VOID or tag in ("html",) or tag in MATH and attrs.endswith("/"):
            continue
        if tag == "svg":
            if not attrs.endswith("/"):
                at = after_drawing(page, at)
            continue
        for i in range(len(stack) - 1, 0, -1):
            open_ = stack[i].tag
            if tag in CLOSED_BY.get(open_, ()):
                del stack[i:]
                if open_ == "p" or tag in ("li", "option", "dt", "dd"):
                    break
                continue
            if open_ in SCOPE.get(tag, ()) or open_ in SCOPE["p"]:
                break
        if len(stack) >= DEEP:
            stack[-1].kids.append("\n")
            continue
        node = Node(tag, attrs)
        if tag == "article" or node.is_main():
            for above in stack:
                above.holds = True
        stack[-1].kids.append(node)
        stack.append(node)
    return root


def own_text(node: Node) -> str:
    return " ".join(html.unescape("".join(k for k in node.kids if isinstance(k, str))).split())


# A template node: [key, pages, digest of the text, varying, children]
def template_of(node: Node) -> list:
    kids: dict[tuple, list] = {}
    for k in node.nodes():
        t = template_of(k)
        if t[0] in kids:  # a repeated sibling
            kids[t[0]] = fold(kids[t[0]], t, same_page=True)
        else:
            kids[t[0]] = t
    return [node.key, 1, zlib.crc32(own_text(node).encode()), False, list(kids.values())]


def matched(a: list, b: list, known: dict) -> tuple[list[tuple[int, int]], int]:
    """Simple tree matching of two trees with equal roots: the pairs of their children, in order, of the greatest total weight, and the number of
    nodes that match in all. ``known`` holds what has been matched, so a pair of nodes is looked at once: time and memory are within the product
    of the trees' sizes, however deep they differ."""
    hit = known.get((id(a), id(b)))
    if hit is not None:
        return hit[:2]
    ka, kb = a[4], b[4]
    if [x[0] for x in ka] == [x[0] for x in kb]:
        pairs = [(i, i) for i in range(len(ka))]
        total = 1 + sum(matched(x, y, known)[1] for x, y in zip(ka, kb))
    else:
        in_a, in_b = {x[0] for x in ka}, {x[0] for x in kb}
        at_a, at_b = ([i for i, x in enumerate(k) if x[0] in other] for k, other in ((ka, in_b), (kb, in_a)))
        ka, kb = [ka[i] for i in at_a], [kb[j] for j in at_b]  # the others match nothing
        best = [[0] * (len(kb) + 1) for _ in range(len(ka) + 1)]
        for i, x in enumerate(ka):
            for j, y in enumerate(kb):
                w = best[i][j] + matched(x, y, known)[1] if x[0] == y[0] else 0
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], w)
        pairs, i, j = [], len(ka), len(kb)
        total = 1 + best[i][j]
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((at_a[i], at_b[j]))
        pairs.reverse()
    known[id(a), id(b)] = pairs, total, a, b  # the trees stay alive with their numbers
    return pairs, total


def match(a: list, b: list, known: dict | None = None) -> list[tuple[int, int]]:
    return matched(a, b, {} if known is None else known)[0]


def weight(a: list, b: list) -> int:
    """Nodes that two trees with equal roots can match: the root and the best of its children."""
    return matched(a, b, {})[1]


def fold(a: list, b: list, same_page: bool = False, known: dict | None = None) -> list:
    """One template of two with equal roots."""
    known = {} if known is None else known
    pairs = match(a, b, known)
    kids, i, j = [], 0, 0
    for x, y in [*pairs, (len(a[4]), len(b[4]))]:
        kids += a[4][i:x] + b[4][j:y]
        if x < len(a[4]):
            kids.append(fold(a[4][x], b[4][y], same_page, known))
        i, j = x + 1, y + 1
    if len(kids) > 1:  # nodes that came in crossed order
        merged: dict[tuple, list] = {}
        for k in kids:
            merged[k[0]] = fold(merged[k[0]], k, same_page, known) if k[0] in merged else k
        kids = list(merged.values())
    pages = max(a[1], b[1]) if same_page else a[1] + b[1]
    return [a[0], pages, a[2], a[3] or b[3] or a[2] != b[2], kids]


def content_digest(root: Node) -> bytes:
    """A digest of the text in a page's articles, or in all of it without any."""
    text, open_ = [], articles(root)[::-1]
    while open_:
        n = open_.pop()
        if isinstance(n, str):
            text.append(n)
        else:
            open_ += reversed(n.kids)
            text.append(" ")
    return hashlib.blake2b(" ".join("".join(text).split()).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _page_templates(batches):
    for batch in batches:
        seen: dict[tuple, bytes] = {}
        for host, page in zip(batch["host"].to_pylist(), batch["html"]):
            root = parse(page.as_py())
            key = host, content_digest(root)
            if key not in seen:
                seen[key] = zlib.compress(pickle.dumps(template_of(root)), 1)
        yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in seen], pa.string()), pa.array([d for _, d in seen], pa.binary()),
                                          pa.array(list(seen.values()), pa.binary())], ["host", "digest", "template"])


def _templates(batches):
    hosts: dict[str, list] = {}
    for batch in batches:
        for host, packed in zip(batch["host"].to_pylist(), batch["template"]):
            t = pickle.loads(zlib.decompress(packed.as_py()))
            hosts[host] = fold(hosts[host], t) if host in hosts else t
            if len(hosts) > MEMO_TEMPLATES:
                yield _packed(hosts)
                hosts = {}
    if hosts:
        yield _packed(hosts)


def _packed(hosts: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(hosts), pa.string()),
                                       pa.array([zlib.compress(pickle.dumps(t)) for t in hosts.values()], pa.binary())],
                                      ["host", "template"])


def _fold_host(table: pa.Table) -> pa.Table:
    whole = None
    for packed in table["template"]:
        t = pickle.loads(zlib.decompress(packed.as_py()))
        whole = t if whole is None else fold(whole, t)
    return pa.table([pa.array(table["host"].to_pylist()[:1], pa.string()), pa.array([zlib.compress(pickle.dumps(whole))], pa.binary())],
                    names=["host", "template"])


def host_templates(pages: DataFrame) -> DataFrame:
    """(host, template): one folded template for each host of ``pages`` (host, html)."""
    distinct = (pages.mapInArrow(_page_templates, "host string, digest binary, template binary")
                .groupBy("host", "digest").agg(F.min("template").alias("template")))
    return (distinct.select("host", "template").mapInArrow(_templates, "host string, template binary")
            .groupBy("host").applyInArrow(_fold_host, "host string, template binary"))


def articles(root: Node) -> list[Node]:
    """The outermost articles, else the main elements, else the root. Those in blocks named for neighbours count if there are no others."""
    for wrappers in (False, True):
        for wanted in (lambda n: n.tag == "article", Node.is_main):
            found, open_ = [], [root]
            while open_:
                n = open_.pop()
                if wanted(n):
                    found.append(n)
                elif n.tag in ("article", "main", "body", "html") or not n.dropped(False, True, wrappers):
                    open_ += reversed(n.nodes())
            if found:
                return found
    return [root]


def extract(page: str, template: list | None) -> str:
    """The text of a page's content in page order, white space as single spaces."""
    root = parse(page)
    chosen = articles(root)
    inside = chosen != [root]
    slots: dict[int, list] = {}
    around: dict[int, int] = {}  # pages of the nearest slot around it that varies
    changes: dict[int, bool] = {}

    def varies(t: list) -> bool:
        if id(t) not in changes:
            changes[id(t)] = t[3] or any(map(varies, t[4]))
        return changes[id(t)]

    def align(node: Node, t: list, pages: int) -> None:
        if node.key != t[0]:
            return
        slots[id(node)] = t
        around[id(node)] = pages
        kids = node.nodes()
        first: dict[tuple, int] = {}
        for k in kids:
            first.setdefault(k.key, len(first))
        mine = [node.key, 1, 0, False, [[x, 1, 0, False, []] for x in first]]
        known = {tuple(t[4][i][0]): t[4][i] for i, _ in match(t, mine)}
        for k in kids:
            if k.key in known:
                align(k, known[k.key], t[1] if varies(t) else pages)
    if template is not None:
        align(root, template, template[1])

    out: list[str] = []

    def constant(n: Node) -> bool:
        """Whether the slot is template: it never varies on this host though what is around it does."""
        t = slots.get(id(n))
        if t is None or t[1] < max(TEMPLATE_PAGES, TEMPLATE_SHARE * around[id(n)]) or varies(t):
            return False
        return not (inside and (n.tag in PROSE or n.tag in INLINE or n.tag in CELLS) and not n.names)

    def write(n: Node) -> None:
        for k in n.kids:
            if isinstance(k, str):
                out.append(html.unescape(k))
            elif not k.dropped(inside, names, wrappers) and not (slots_vary and constant(k)):
                gap = "" if k.tag in INLINE else " "
                out.append(gap)
                write(k)
                out.append(gap)
    for names, wrappers in ((True, False), (True, True)) if inside else ((True, False), (False, False)):
        for n in chosen:
            t = slots.get(id(n))
            slots_vary = t is not None and varies(t)
            write(n)
            out.append(" ")
        text = " ".join("".join(out).split())
        if text:
            break
    return text


def _extract(batches):
    memo: dict[bytes, list] = {}
    for batch in batches:
        text = []
        for page, packed in zip(batch["html"], batch["template"]):
            raw = packed.as_py()
            if raw is not None and raw not in memo:
                if len(memo) > MEMO_TEMPLATES:
                    memo.clear()
                memo[raw] = pickle.loads(zlib.decompress(raw))
            text.append(extract(page.as_py(), memo.get(raw)))
        yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(text, pa.string()),
                                          pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of ``pages`` (page_id, url, html)."""
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    p = small_batches(pages).select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
                                    F.coalesce("html", F.lit("")).alias("html"), host.alias("host"))
    templates = host_templates(p.select("host", "html"))
    return (p.join(templates, "host", "left").select("page_id", "url", "html", "template")
            .mapInArrow(_extract, "page_id bigint, url string, text string, n_chars bigint"))
