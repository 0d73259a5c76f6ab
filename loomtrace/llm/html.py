"""Main-text extraction: boosted trees over DOM-node features, with hierarchical decoding.

A page becomes a tree of its block elements, whose leaves are text blocks. Every node gets features: density of text
and links in its subtree, tokens of its and its ancestors' attributes, depth, and its place among its siblings. Boosted
trees give each node the probability that its subtree holds main text. Decoding picks the most likely labels of the
whole tree in which no node is kept under a dropped ancestor, so contradictory choices can't happen.

No labels come with pages, so the model learns from marked ones: a bounded sample of pages with an explicit main
element, and variants of them, rebuilt under other tags and attributes with menus, notices, forms, sidebars and
comments around and inside, whose main blocks are known by construction.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrace.llm.common import session
from loomtrace.llm.trees import Boosted, boost

#: Pages that training uses at most, of those with at most SAMPLE_CHARS characters: the smallest hashes of their ids.
SAMPLE_PAGES = 250
SAMPLE_CHARS = 200_000
VARIANTS = 4

# The HTML standard's element groups, and attribute words that sites use for parts of a page.
INLINE = frozenset("a abbr acronym area b bdi bdo big br cite code data del dfn em font i img ins kbd label map mark picture q ruby rb rp rt rtc s samp small source span strike strong sub sup time track tt u var wbr".split())
INLINE |= frozenset("maction math menclose merror mfrac mi mlabeledtr mmultiscripts mn mo mover mpadded mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template noscript svg annotation annotation-xml mphantom iframe textarea title object embed canvas audio video select option button datalist input noframes noembed xmp meta link base".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
CLOSES_SELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}, "option": {"option"}, "body": {"head"}}
#: Unseen elements that don't end a block, and those that may end themselves.
FLOATING = frozenset("select option button object svg annotation annotation-xml mphantom".split())
FOREIGN = frozenset("svg annotation annotation-xml mphantom".split())
SCOPES = frozenset("table ul ol dl div section article main aside nav body form".split())
GROUPS = {
    "main": {"article", "main"}, "nav": {"nav", "menu", "dir"}, "edge": {"footer", "header", "hgroup"}, "aside": {"aside", "dialog"}, "form": {"form", "fieldset", "legend"},
    "head": {"h1", "h2", "h3", "h4", "h5", "h6"}, "para": {"p", "blockquote", "pre"}, "list": {"ul", "ol", "dl"}, "item": {"li", "dt", "dd"}, "table": {"table", "tbody", "thead", "tfoot", "tr", "td", "th"},
}
GOOD = frozenset("article content entry main post story text body page blog news prose".split())
BAD = frozenset("ad ads advert advertisement adsbygoogle banner breadcrumb breadcrumbs byline comment comments commentlist cookie cookies consent copyright disqus dropdown footer form gdpr header hidden legal links login menu modal nav navbar navigation newsletter notice notification pagination pager popup promo promoted promotion related reply replies search share sharing shoutbox sidebar signup site social sponsor sponsored subscribe tags toolbar tooltip widget".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>|<[!?][^>]*+(?:>|\Z)|</?[A-Za-z][^>]*+\Z", re.S
)
_ATTRIBUTE = re.compile(r"(class|id|role|data-main)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPLIT = re.compile(r"[^a-z]+")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass(slots=True)
class Node:
    tag: str
    parent: int
    depth: int
    good: int = 0
    bad: int = 0
    role_main: bool = False
    marked: bool = False
    children: list[int] = field(default_factory=list)
    text: str | None = None
    link: int = 0


def _attributes(source: str) -> tuple[int, int, bool, bool]:
    good = bad = 0
    main = marked = False
    for name, *values in _ATTRIBUTE.findall(source):
        value = "".join(values)
        name = name.lower()
        marked |= name == "data-main"
        main |= name == "role" and value.lower() == "main"
        for token in _SPLIT.split(_HUMP.sub(" ", value).lower()):
            good += token in GOOD
            bad += token in BAD
    return good, bad, main, marked


class _Parser:
    """One pass over a page. Counts of open elements tell whether a tag ends any before the stack is searched, so what a
    search looks at is closed by it, and a page takes time in proportion to its length."""

    def __init__(self):
        self.nodes = [Node("#page", -1, 0)]
        self.stack: list[tuple[str, int]] = [("#page", 0)]  # open elements; inline ones share their block's node
        self.open: Counter = Counter()
        #: Open elements by tag: inline ones since each open block, and all since each open element of SCOPES.
        self.inline: list[Counter] = [Counter()]
        self.scopes: list[Counter] = [Counter()]
        self.pieces: list[str] = []
        self.linked, self.links, self.marked = 0, 0, 0  # characters inside links in this block; open links, marked elements

    def end_block(self) -> None:
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            self.pieces.clear()
            if text:
                at = self.stack[-1][1]
                self.nodes[at].children.append(len(self.nodes))
                self.nodes.append(Node("#text", at, self.nodes[at].depth + 1, text=text, link=min(self.linked, len(text)), marked=self.marked > 0))
        self.linked = 0

    def push(self, tag: str, node: int) -> None:
        self.stack.append((tag, node))
        self.open[tag] += 1
        self.scopes[-1][tag] += 1
        if tag in INLINE:
            self.inline[-1][tag] += 1
        else:
            self.inline.append(Counter())
        if tag in SCOPES:
            self.scopes.append(Counter())

    def pop_to(self, i: int) -> None:
        if any(t not in INLINE for t, _ in self.stack[i:]):
            self.end_block()
        while len(self.stack) > i:
            tag, node = self.stack.pop()
            self.open[tag] -= 1
            if tag in SCOPES:
                self.scopes.pop()
            self.scopes[-1][tag] -= 1
            if tag in INLINE:
                self.inline[-1][tag] -= 1
                self.links -= tag == "a"
            else:
                self.inline.pop()
                self.marked -= self.nodes[node].marked

    def add(self, text: str) -> None:
        text = entities.unescape(text)
        self.pieces.append(text)
        if self.links > 0:
            self.linked += len(text.strip())

    def close(self, tag: str) -> None:
        if (self.inline[-1] if tag in INLINE else self.open)[tag] > 0:
            self.pop_to(next(i for i in range(len(self.stack) - 1, 0, -1) if self.stack[i][0] == tag))
        elif tag not in INLINE:
            self.end_block()

    def close_implied(self, tag: str) -> None:
        """End what the start of `tag` ends: paragraphs, and items or cells of the same list or table."""
        ended = CLOSES_SELF.get(tag, frozenset()) | ({"p"} if tag in CLOSES_P else frozenset())
        while any(self.scopes[-1][t] > 0 for t in ended):
            self.pop_to(next(i for i in range(len(self.stack) - 1, 0, -1) if self.stack[i][0] in ended))

    def start(self, tag: str, rest: str) -> None:
        if tag in INLINE:
            if tag in ("br", "mtd", "mtr", "mlabeledtr"):
                self.pieces.append(" ")
            if tag not in VOID and not rest.endswith("/"):
                self.push(tag, self.stack[-1][1])
                self.links += tag == "a"
            return
        self.end_block()
        if tag in VOID or tag in ("html", "body"):
            return
        self.close_implied(tag)
        good, bad, main, own = _attributes(rest) if rest else (0, 0, False, False)
        parent = self.stack[-1][1]
        self.nodes[parent].children.append(len(self.nodes))
        self.push(tag, len(self.nodes))
        self.nodes.append(Node(tag, parent, self.nodes[parent].depth + 1, good, bad, main, own))
        self.marked += own


def parse(source: str) -> list[Node]:
    """The page's block elements and text blocks in document order; node 0 is the page. Unseen elements are left out."""
    p = _Parser()
    unclosed: set[str] = set()  # unseen elements without an end in the rest of the page
    at, size = 0, len(source)
    while at < size:
        m = _TOKEN.search(source, at)
        if m is None:
            p.add(source[at:])
            break
        if m.start() > at:
            p.add(source[at : m.start()])
        at = m.end()
        close, tag, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if close:
            p.close(tag)
        elif tag not in UNSEEN or tag in VOID:
            p.start(tag, rest)
        else:
            if tag not in INLINE and tag not in FLOATING:
                p.end_block()
            if rest.endswith("/") and tag in FOREIGN:
                continue
            end = None
            if tag not in unclosed:
                end = re.compile(r"</head\s*>|<body\b" if tag == "head" else rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
            if end is None:
                unclosed.add(tag)
                at = size if tag in RAW else at
            else:
                at = end.start() if end[0][1] != "/" else end.end()
    p.end_block()
    return p.nodes


_GROUP_OF = {tag: i for i, (_, tags) in enumerate(GROUPS.items()) for tag in tags}
_PUNCTUATION = re.compile(r"[.,;:!?]")
WIDTH = 24 + 2 * len(GROUPS)


def features(nodes: list[Node]) -> np.ndarray:
    """A row for each node."""
    n = len(nodes)
    chars, linked, texts, marks, elements, words = (np.zeros(n) for _ in range(6))
    for i in range(n - 1, -1, -1):
        node = nodes[i]
        if node.text is not None:
            chars[i], linked[i], texts[i] = len(node.text), node.link, 1
            marks[i], words[i] = len(_PUNCTUATION.findall(node.text)), node.text.count(" ") + 1
        else:
            elements[i] += 1
        if node.parent >= 0:
            for c in (chars, linked, texts, marks, elements, words):
                c[node.parent] += c[i]
    out = np.zeros((n, WIDTH))
    before = np.zeros(n)
    seen, total = 0.0, max(chars[0], 1.0)
    place, around = np.zeros((n, 5)), np.zeros((n, 4))
    flags = np.zeros((n, len(GROUPS)))
    groups = len(GROUPS)
    for i, node in enumerate(nodes):
        before[i] = seen
        if node.text is not None:
            seen += chars[i]
        if node.parent >= 0:
            p = node.parent
            flags[i] = flags[p]
            around[i, 0] = around[p, 0] + nodes[p].good
            around[i, 1] = around[p, 1] + nodes[p].bad
            around[i, 2] = linked[p] / max(chars[p], 1)
            around[i, 3] = np.log1p(chars[p])
            if nodes[p].tag in _GROUP_OF:
                flags[i, _GROUP_OF[nodes[p].tag]] = 1
        k = len(node.children)
        for j, c in enumerate(node.children):
            left, right = (node.children[j - 1] if j else -1), (node.children[j + 1] if j + 1 < k else -1)
            place[c] = (j, k, j / k, np.log1p(chars[left]) if left >= 0 else -1, np.log1p(chars[right]) if right >= 0 else -1)
        if node.tag in _GROUP_OF:
            out[i, 24 + groups + _GROUP_OF[node.tag]] = 1
        out[i, :5] = node.depth, node.good, node.bad, node.role_main, node.text is not None
    safe = np.maximum(chars, 1)
    out[:, 5:10] = place
    out[:, 10:14] = around
    out[:, 14], out[:, 15], out[:, 16] = np.log1p(chars), linked / safe, elements / safe
    out[:, 17], out[:, 18], out[:, 19] = marks / np.maximum(words, 1), chars / total, before / total
    out[:, 20], out[:, 21], out[:, 22], out[:, 23] = texts, chars / np.maximum(texts, 1), words / np.maximum(texts, 1), elements
    out[:, 24 : 24 + groups] = flags
    return out


def decode(nodes: list[Node], p: np.ndarray) -> np.ndarray:
    """The likeliest labels in which a kept node has no dropped ancestor: one pass up, one down."""
    p = np.clip(p, 1e-4, 1 - 1e-4)
    keep, drop = np.log(p), np.log1p(-p)
    for i in range(len(nodes) - 1, 0, -1):
        # keep[i], drop[i] now hold the best of the whole subtree
        parent = nodes[i].parent
        keep[parent] += max(keep[i], drop[i])
        drop[parent] += drop[i]
    kept = np.zeros(len(nodes), bool)
    kept[0] = True
    for i in range(1, len(nodes)):
        kept[i] = kept[nodes[i].parent] and keep[i] > drop[i]
    return kept


def marked_labels(nodes: list[Node]) -> np.ndarray:
    """Which subtrees hold a text block under a marked element."""
    out = np.array([n.text is not None and n.marked for n in nodes], float)
    for i in range(len(nodes) - 1, 0, -1):
        if out[i]:
            out[nodes[i].parent] = 1
    return out


def weak_labels(nodes: list[Node]) -> np.ndarray | None:
    """Labels of a page with an explicit main element; None without one. Parts of it that name another use are not main."""
    inside = np.zeros(len(nodes), bool)
    out = np.zeros(len(nodes))
    for i in range(1, len(nodes)):
        node = nodes[i]
        inside[i] = inside[node.parent] or node.tag in GROUPS["main"] or node.role_main
        if node.tag in ("nav", "aside", "form", "footer", "menu", "dialog") or (node.bad and node.text is None):
            inside[i] = False
        out[i] = inside[i] and node.text is not None
    if not out.any():
        return None
    for i in range(len(nodes) - 1, 0, -1):
        if out[i]:
            out[nodes[i].parent] = 1
    return out


def variant(nodes: list[Node], labels: np.ndarray, seed: int) -> str:
    """Another page with the same main blocks, marked, in another structure."""
    r = random.Random(seed)
    main = [(nodes[n.parent].tag, n.text) for n, y in zip(nodes, labels) if y and n.text is not None]
    other = [n.text for n, y in zip(nodes, labels) if not y and n.text is not None] + ["Home", "About us", "Contact"]
    any_text = [t for _, t in main] + other
    esc = entities.escape
    some = lambda k=12: esc(" ".join(r.choice(any_text).split()[:k]))
    box = lambda options, body: (lambda o: f"<{o}>{body}</{o.split()[0]}>")(r.choice(options))
    menu = lambda: "<ul>" + "".join(f'<li><a href="/{i}">{some(3)}</a></li>' for i in range(r.randint(2, 9))) + "</ul>"
    paragraphs = lambda n: "".join(f"<p>{some(40)}</p>" for _ in range(n))
    extras = {
        "menu": lambda: box(["nav", 'div class="menu"', 'div id="navigation"', 'div class="navbar top"'], menu()),
        "header": lambda: box(["header", 'div class="header"', 'div id="site-header"'], f"<h2>{some(4)}</h2><p>{some(8)}</p>"),
        "footer": lambda: box(["footer", 'div class="footer"', 'div id="footer"', 'div class="copyright legal"'], r.choice([some(15), f"<p>{some(15)}</p>", "&copy; " + some(6)])),
        "aside": lambda: box(["aside", 'div class="sidebar"', 'div id="sidebar-right"', 'section class="related"', 'div class="widget"'], f"<h3>{some(3)}</h3>" + r.choice([menu(), paragraphs(r.randint(1, 3))])),
        "ad": lambda: box(['div class="ad"', 'div class="advert"', 'aside class="sponsored"', 'div class="banner promo"', 'div id="ad-1"'], r.choice([some(25), paragraphs(1)])),
        "notice": lambda: box(['div class="cookie-notice"', 'div id="consent"', 'div class="notice"', 'div class="newsletter"', 'div role="dialog" class="popup"'], r.choice([some(20), paragraphs(1)])),
        "form": lambda: box(["form", 'form class="search"', 'form id="login"', 'form class="subscribe"'], f"<label>{some(3)}</label><input><p>{some(10)}</p>"),
        "comments": lambda: box(['section class="comments"', 'div id="comments"', 'ol class="commentlist"', 'div class="comment-list"'], f"<h3>{some(3)}</h3>" + "".join(box(['div class="comment"', 'li class="comment"', 'article class="comment"'], f"<p><b>{some(2)}</b></p>" + paragraphs(r.randint(1, 2))) for _ in range(r.randint(1, 4)))),
        "share": lambda: box(['div class="share"', 'ul class="social"', 'p class="tags"', 'div class="breadcrumbs"'], "".join(f'<a href="#">{some(2)}</a> ' for _ in range(r.randint(2, 5)))),
    }
    pick = lambda names, least=0: [extras[x]() for x in r.sample(names, r.randint(least, min(3, len(names))))]
    inside, body = pick(["ad", "share", "aside", "notice", "form"]) if r.random() < 0.4 else [], []
    for i, (tag, text) in enumerate(main):
        tag = tag if tag in ("p", "h1", "h2", "h3", "h4", "li", "blockquote", "pre", "td") else "p"
        if r.random() < 0.05:
            tag = r.choice(["h2", "h3", "blockquote", "div"])
        wrap = {"li": "ul", "td": "table"}.get(tag)
        words = esc(text)
        if r.random() < 0.15:
            head, _, tail = words.partition(" ")
            words = f'<a href="/x">{head}</a> {tail}' if "&" not in head else words
        piece = f'<{tag} data-main="1">{words}</{tag}>'
        body.append(f"<{wrap}>{piece}</{wrap}>" if wrap else piece)
        if inside and r.random() < 0.3:
            body.append(inside.pop())
    if r.random() < 0.3:
        body.append(extras["comments"]())
    core = "".join(body + inside)
    outer = r.choice(["article", "main", "article", 'div class="content"', 'div class="post-body"', 'div id="main"', 'section class="entry"', 'div class="article-text"', "div", "section", 'div role="main"'])
    core = f"<{outer}>{core}</{outer.split()[0]}>"
    if r.random() < 0.3:
        core = box(["main", 'div class="wrapper"', 'div id="page"', "div"], core + "".join(pick(["aside", "comments", "ad"])))
    top, bottom = pick(["menu", "header", "ad", "notice", "share", "form"], 1), pick(["footer", "comments", "aside", "ad", "menu", "notice", "form"], 1)
    return f"<html><body>{''.join(top)}{core}{''.join(bottom)}</body></html>"


def fit(pages: list[str], variants: int = VARIANTS, seed: int = 7) -> Boosted:
    """Learn from pages; those without an explicit main element take their longest run of paragraphs for it."""
    xs, ys = [], []
    for number, source in enumerate(pages):
        nodes = parse(source)
        labels = weak_labels(nodes)
        if labels is not None:
            xs.append(features(nodes))
            ys.append(labels)
        else:
            size: dict[int, int] = {}
            for n in nodes:
                if n.text is not None and nodes[n.parent].tag in ("p", "h1", "h2", "h3") and n.link * 3 < len(n.text):
                    home = nodes[n.parent].parent
                    size[home] = size.get(home, 0) + len(n.text)
            if not size:
                continue
            best = max(size, key=lambda k: (size[k], -k))
            labels = np.array([float(n.text is not None and nodes[n.parent].parent == best) for n in nodes])
        for v in range(variants):
            made = parse(variant(nodes, labels, seed + number * 1000 + v))
            xs.append(features(made))
            ys.append(marked_labels(made))
    if not xs:
        return Boosted(0.0)
    return boost(np.concatenate(xs), np.concatenate(ys), trees=30, depth=4, rate=0.3, least=2.0)


def page_text(source: str, model: Boosted) -> str:
    nodes = parse(source)
    kept = decode(nodes, model.predict(features(nodes)))
    return "\n".join(n.text for n, k in zip(nodes, kept) if k and n.text is not None)


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> Boosted:
    """A model from at most SAMPLE_PAGES pages, brought to the driver: 50 MB of text at the very most."""
    rows = pages.select(F.col(id_col).alias("i"), F.col(html_col).alias("html")).where(f"html is not null and length(html) <= {SAMPLE_CHARS}")
    chosen = rows.select(F.xxhash64("i").alias("h"), "i").distinct().orderBy("h", "i").limit(SAMPLE_PAGES)
    got = rows.join(F.broadcast(chosen), rows["i"].eqNullSafe(chosen["i"])).orderBy("h", "html").select("html").limit(SAMPLE_PAGES)
    return fit([r["html"] for r in got.collect()])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars): one row per row; text is empty if a page has none or is null.

    A block's character references are decoded (none is made by joining text across a tag) and its white space becomes
    single spaces; kept blocks are joined by newlines in page order. Broken markup is read as browsers do: open elements
    end with their parents, an unfinished tag at the end is dropped. Pages of any length take time in proportion to it.
    Null ids and urls are kept. Repeated rows give equal results; an empty table an empty result; other columns are
    ignored.
    """
    spark = session(pages.sparkSession)
    sent = spark.sparkContext.broadcast(train(pages, id_col, html_col))  # a few hundred tree nodes
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in batches:
            texts: list[str] = []
            trees: list[list[Node]] = []
            held = 0

            def flush() -> None:
                if trees:
                    p = model.predict(np.concatenate([features(t) for t in trees]))
                    at = 0
                    for t in trees:
                        kept = decode(t, p[at : at + len(t)])
                        at += len(t)
                        texts.append("\n".join(n.text for n, k in zip(t, kept) if k and n.text is not None))
                    trees.clear()

            for source in b.column(2).to_pylist():
                trees.append(parse(source or ""))
                held += len(trees[-1])
                if held > 20_000:
                    flush()
                    held = 0
            flush()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    kinds = rows.schema
    return rows.mapInArrow(run, f"page_id {kinds['page_id'].dataType.simpleString()}, url {kinds['url'].dataType.simpleString()}, text string, n_chars bigint")
