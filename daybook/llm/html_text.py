"""Main text of web pages by a tree-structured graphical model over their DOM.

Every block element is a node with a hidden label, content or not. Parent-child potentials
connect the labels along the tree, node potentials tie them to tag, attributes, text length
and link density. Both are smoothed frequencies from labelled pages. Sum-product messages, upward
from the leaves and downward from the root, give each node's exact marginal; text
of nodes that are content with a probability of at least one half is the page's main text.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCKS = frozenset("html body div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th thead tbody tfoot caption article section main header footer nav aside form fieldset blockquote pre figure figcaption address hr details summary dialog menu center title head".split())
#: Elements whose contents are no text of the page.
DROPPED = frozenset("script style noscript template iframe svg math canvas object video audio select option button textarea title head".split())
RAW = frozenset("script style textarea title noscript iframe".split())
VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())
#: An element of the key's kind ends where one of these begins.
ENDS = {"p": BLOCKS, "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr"}), "td": frozenset({"td", "th", "tr"}), "th": frozenset({"td", "th", "tr"})}
#: A quote opens a value only behind "="; elsewhere in a tag, or without its end, it is a character like others.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
NAMED = re.compile(r"""(?:class|id|role|aria-label|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
AGAINST = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert\w*|banner|sponsor\w*|promo\w*|nav\w*|menu|breadcrumbs?|sidebar|side|foot\w*|header|masthead|comments?|replies|reply|share|social|cookies?|consent|notice|alert|popup|modal|newsletter|subscribe|related|recommended|widget|login|search|copyright|legal|pagination|pager|tags?|toolbar|complementary|contentinfo)(?=$|[\s_-])", re.I)
FOR = re.compile(r"(?:^|[\s_-])(?:content|article\w*|post|entry|story|main|text|body|page)(?=$|[\s_-])", re.I)


@dataclass
class Node:
    tag: str
    parent: int
    names: str = ""
    chars: int = 0
    linked: int = 0
    blocks: list[tuple[int, str]] = field(default_factory=list)
    label: int = -1


def parse(page: str | None) -> list[Node]:
    """Block elements in page order, each behind its parent; their text blocks carry their place in the page."""
    nodes = [Node("root", -1)]
    if not page:
        return nodes
    open_, run, order, in_link, at, end = [0], [], 0, 0, 0, len(page)
    dropped: str | None = None
    depth = 0

    def close_block():
        nonlocal run, order
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            if text:
                node = nodes[open_[-1]]
                node.blocks.append((order, text))
                node.chars += len(text)
                order += 1
            run = []

    while at < end:
        m = TOKEN.search(page, at)
        if dropped is None and (stop := m.start() if m else end) > at:
            run.append(page[at:stop])
            if in_link:
                nodes[open_[-1]].linked += stop - at
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        closing, tag = bool(m[1]), m[2].lower()
        if dropped == "head" and not closing and tag in BLOCKS and tag not in ("head", "title"):
            dropped = None  # its end tag may be left out
        elif dropped == "option":
            if closing and tag in ("option", "optgroup", "select", "datalist"):
                dropped = None
            continue
        elif dropped is not None:
            if tag == dropped:
                depth += -1 if closing else 1
                if not depth:
                    dropped = None
            continue
        if tag in DROPPED:
            if not closing and not m[3].endswith("/"):
                if tag in BLOCKS:
                    close_block()
                if tag in RAW:
                    found = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*>?", re.I).search(page, at)
                    at = found.end() if found else end
                else:
                    dropped, depth = tag, 1
            continue
        if tag == "a":
            in_link = 0 if closing else 1
        elif tag == "br":
            run.append(" ")
        elif tag in BLOCKS:
            close_block()
            if closing:
                for k in range(len(open_) - 1, 0, -1):
                    if nodes[open_[k]].tag == tag:
                        del open_[k:]
                        break
                in_link = 0
            else:
                while len(open_) > 1 and tag in ENDS.get(nodes[open_[-1]].tag, ()):
                    open_.pop()
                if tag not in VOID:
                    names = " ".join(v.strip("\"'") for v in NAMED.findall(m[3])) if m[3] else ""
                    nodes.append(Node(tag, open_[-1], names))
                    open_.append(len(nodes) - 1)
        elif tag not in VOID and not closing and tag in ("input", "label"):
            run.append(" ")
    close_block()
    return nodes


def features(node: Node) -> tuple:
    kind = "against" if AGAINST.search(node.names) else "for" if FOR.search(node.names) else "none"
    size = sum(node.chars > x for x in (0, 25, 100, 300))
    links = 0 if not node.linked else 1 if 3 * node.linked < node.chars else 2
    return (("tag", node.tag), ("names", kind), ("size", size, links))


@dataclass
class TreeModel:
    """Log potentials: of the root's label, of (parent label, label), and of (feature, label)."""

    root: list[float]
    pair: list[list[float]]
    node: dict[tuple, tuple[float, float]]
    unknown: dict[str, tuple[float, float]]

    @classmethod
    def fit(cls, pages: list[list[Node]], smooth: float = 0.5) -> TreeModel:
        root, pair, seen, labels = [smooth, smooth], [[smooth, smooth], [smooth, smooth]], Counter(), Counter()
        for nodes in pages:
            for n in nodes:
                labels[n.label] += 1
                for f in features(n):
                    seen[f, n.label] += 1
                if n.parent < 0:
                    root[n.label] += 1
                else:
                    pair[nodes[n.parent].label][n.label] += 1
        kinds = Counter(f[0] for f in {f for f, _ in seen})
        node = {f: tuple(math.log((seen[f, y] + smooth) / (labels[y] + smooth * (kinds[f[0]] + 1))) for y in (0, 1)) for f in {f for f, _ in seen}}
        return cls([math.log(x / sum(root)) for x in root], [[math.log(x / sum(row)) for x in row] for row in pair], node, dict.fromkeys(kinds, (0.0, 0.0)))

    def marginals(self, nodes: list[Node]) -> list[float]:
        """P(content) of each node, exact: parents stand before their children, so one pass from the end
        sends all messages upward and one from the start sends them downward."""
        own = [[0.0, 0.0] for _ in nodes]
        for k, n in enumerate(nodes):
            for f in features(n):
                a, b = self.node.get(f) or self.unknown.get(f[0], (0.0, 0.0))
                own[k][0] += a
                own[k][1] += b
        p = self.pair
        up = [None] * len(nodes)
        for k in range(len(nodes) - 1, 0, -1):
            a, b = own[k]
            up[k] = (_add(p[0][0] + a, p[0][1] + b), _add(p[1][0] + a, p[1][1] + b))
            parent = own[nodes[k].parent]
            parent[0] += up[k][0]
            parent[1] += up[k][1]
        belief = [None] * len(nodes)
        belief[0] = (self.root[0] + own[0][0], self.root[1] + own[0][1])
        for k in range(1, len(nodes)):
            b = belief[nodes[k].parent]
            a0, a1 = b[0] - up[k][0], b[1] - up[k][1]  # the parent's belief without this child's message
            top = max(a0, a1)
            a0, a1 = a0 - top, a1 - top
            belief[k] = (_add(a0 + p[0][0], a1 + p[1][0]) + own[k][0], _add(a0 + p[0][1], a1 + p[1][1]) + own[k][1])
        return [1 / (1 + math.exp(min(700.0, max(-700.0, b[0] - b[1])))) for b in belief]


def _add(a: float, b: float) -> float:
    """log(exp a + exp b)"""
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def labelled_pages(count: int = 400, seed: int = 5) -> list[list[Node]]:
    """Labelled pages to learn from: random sites of the usual kinds, with data-y marking each element.

    Articles stand in article, main, section or div elements, whole or within wrappers, with headings,
    paragraphs, lists, quotations and tables; around them menus, headers, footers, sidebars, adverts,
    notices, forms and readers' comments, with or without telling class names.
    """
    rng = random.Random(seed)
    words = lambda a, b: " ".join("".join(rng.choices("abcdefghijklmnoprstuvwxyz", k=rng.randint(2, 9))) for _ in range(rng.randint(a, b)))

    def tag(name, y, inner, cls=""):
        mark = f' class="{cls}"' if cls else ""
        return f"<{name}{mark} data-y={y}>{inner}</{name}>"

    def links(y):
        return tag("ul", y, "".join(tag("li", y, f'<a href="/">{words(1, 3)}</a>') for _ in range(rng.randint(3, 9))))

    def article():
        parts = [tag(rng.choice(["h1", "h1", "h2"]), 1, words(3, 10) + ".")]
        for _ in range(rng.randint(1, 12)):
            parts.append(tag("p", 1, words(3, 90) + ". " + (f'<a href="/x">{words(1, 3)}</a> {words(8, 20)}.' if rng.random() < 0.2 else "")))
            if rng.random() < 0.1:
                parts.append(rng.choice([tag("h2", 1, words(2, 6)), tag("h3", 1, words(2, 5)), tag("ul", 1, "".join(tag("li", 1, words(3, 20)) for _ in range(3))), tag("blockquote", 1, tag("p", 1, words(10, 30) + ".")), tag("pre", 1, words(5, 30)), tag("table", 1, "".join(tag("tr", 1, tag("td", 1, words(1, 4)) * 2) for _ in range(3))), tag("div", 0, words(3, 12), rng.choice(["ad", "share", "related"]))]))
        inner = "".join(parts)
        kind = rng.random()
        if kind < 0.45:
            return tag("article", 1, inner)
        if kind < 0.6:
            return tag("main", 1, tag("article", 1, inner) if rng.random() < 0.5 else inner)
        if kind < 0.85:
            return tag("div", 1, inner, rng.choice(["content", "post", "entry-content", "article-body", "main", "story"]))
        return tag(rng.choice(["section", "div"]), 1, inner)

    def around():
        return rng.choice([
            lambda: tag("nav", 0, links(0)), lambda: tag("nav", 0, links(0)), lambda: tag("div", 0, links(0), "menu"),
            lambda: tag("div", 0, words(4, 15) + ".", rng.choice(["ad", "advert", "banner", "sponsor"])),
            lambda: tag("header", 0, tag("div", 0, words(1, 4)) + links(0)), lambda: tag("aside", 0, tag("h3", 0, words(1, 3)) + links(0)),
            lambda: tag("aside", 0, tag("p", 0, words(6, 25) + "."), rng.choice(["", "sidebar"])), lambda: tag("div", 0, tag("p", 0, words(8, 25) + "."), rng.choice(["cookie-notice", "alert", "newsletter"])),
            lambda: tag("form", 0, "<input name=q><label>" + words(1, 4) + "</label>"),
        ])()

    def below():
        comments = tag(rng.choice(["div", "section"]), 0, tag("h3", 0, "Comments") + "".join(tag("div", 0, tag("p", 0, words(3, 40) + "."), rng.choice(["comment", "reply", ""])) for _ in range(rng.randint(1, 5))), "comments")
        foot = tag("footer", 0, rng.choice([words(4, 15) + ".", tag("p", 0, words(4, 20) + "."), links(0)]), rng.choice(["", "footer"]))
        return (comments if rng.random() < 0.3 else "") + (around() if rng.random() < 0.4 else "") + (foot if rng.random() < 0.8 else "")

    pages = []
    for _ in range(count):
        middle = article()
        if rng.random() < 0.3:
            middle = tag("div", 0, middle + (around() if rng.random() < 0.5 else ""), rng.choice(["", "wrapper", "container"]))
        page = tag("html", 0, tag("body", 0, "".join(around() for _ in range(rng.randint(0, 3))) + middle + below()))
        nodes = parse(page)
        marks = re.findall(r"<(\w+)[^>]* data-y=(\d)", page)
        nodes[0].label = 0
        for n, (name, y) in zip(nodes[1:], marks, strict=True):
            assert n.tag == name
            n.label = int(y)
        pages.append(nodes)
    return pages


def main_text(page: str | None, model: TreeModel) -> str:
    nodes = parse(page)
    blocks = [b for n, p in zip(nodes, model.marginals(nodes), strict=True) if p >= 0.5 for b in n.blocks]
    return "\n".join(text for _, text in sorted(blocks))


def extract_text(pages: DataFrame, html_col: str = "html", model: TreeModel | None = None) -> DataFrame:
    """``pages`` with text and n_chars (code points) instead of ``html_col``; a null page has an empty text.

    Unclosed and stray tags are taken as browsers do it, nearly: a paragraph ends where a block
    begins; inline elements do not break blocks. Nothing is capped.
    """
    model = model or TreeModel.fit(labelled_pages())
    keep = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]

    def run(batches):
        for batch in batches:
            for s in range(0, batch.num_rows, 500):
                part = batch.slice(s, 500)
                texts = [main_text(h, model) for h in part.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in range(len(keep))], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    source = pages.select(*keep, F.col(html_col))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != html_col)
    return source.mapInArrow(run, f"{schema}{', ' if schema else ''}text string, n_chars long")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all ``pages``."""
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
