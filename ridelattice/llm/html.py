"""Main text of web pages: a tree-structured graphical model over the DOM, with sum-product marginals.

The project keeps no web pages among its records, so this operator is general: it takes ``page_id`` and ``html``.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridelattice.llm.text import packed, text_of

# HTML's phrasing elements (text flows through them), elements that are empty or whose borders say nothing,
# elements whose content is raw text, and elements whose text is never shown.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label map mark math meter output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("html head area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title".split())
HIDDEN = frozenset("script style noscript template title svg iframe object canvas audio video select option textarea button datalist".split())
#: Elements that a paragraph cannot hold end it; list items and cells end their like.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_KEEPS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr")}


class Node(NamedTuple):
    """One block element: its parent's number and what it is."""

    parent: int
    tag: str
    names: tuple[str, ...]
    stats: list[int]  # characters, of these in links, segments, sentence ends, children


class Dom(HTMLParser):
    """Block elements in page order and the text segments between their borders. Unclosed and stray tags are taken as browsers do."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes = [Node(-1, "#page", (), [0, 0, 0, 0, 0])]
        self.segments: list[tuple[int, str]] = []
        self.stack: list[tuple[str, int]] = [("#page", 0)]
        self.open: Counter[str] = Counter()
        #: Elements open inside a hidden one, which is the first, and end tags still to come.
        self.hidden: list[str] = []
        self.inside: Counter[str] = Counter()
        self.closers = Counter(re.findall(r"</([a-z]+)", html.lower()))
        self.links = self.linked = 0
        self.text: list[str] = []
        self.feed(html)
        self.close()
        self.end_segment()

    def end_segment(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            at, stats = self.stack[-1][1], self.nodes[self.stack[-1][1]].stats
            self.segments.append((at, text))
            for k, n in enumerate((len(text), min(self.linked, len(text)), 1, len(re.findall(r"[.!?](?:\s|$)", text)))):
                stats[k] += n
        self.text, self.linked = [], 0

    def pop(self, to: int) -> None:
        self.end_segment()
        self.open.subtract(tag for tag, _ in self.stack[to:])
        del self.stack[to:]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.hidden:
            if tag == self.hidden[0]:
                self.hidden.append(tag)
            elif tag not in VOID:
                self.inside[tag] += 1
            return
        if tag in HIDDEN:
            # one that nothing ends would hide the rest of the page
            if tag in RAW or self.closers[tag] > 0:
                self.hidden = [tag]
            return
        if tag == "br":
            self.text.append(" ")
        if tag == "a":
            self.links = 1
        if tag in INLINE:
            return
        self.end_segment()
        if tag in VOID:
            return
        if self.stack[-1][0] == "p":
            self.pop(len(self.stack) - 1)
        if tag in _ENDS and any(self.open[x] for x in _ENDS[tag]):
            for i in range(len(self.stack) - 1, 0, -1):
                if self.stack[i][0] in _ENDS[tag]:
                    self.pop(i)
                    break
                if self.stack[i][0] in _KEEPS.get(tag, ()):
                    break
        names = " ".join(v or "" for k, v in attrs if k in ("class", "id", "role", "aria-label", "itemprop") or k == "hidden")
        parent = self.stack[-1][1]
        self.nodes[parent].stats[4] += 1
        self.nodes.append(Node(parent, tag, tuple(dict.fromkeys(re.findall(r"[a-z]+", names.lower()))), [0, 0, 0, 0, 0]))
        self.stack.append((tag, len(self.nodes) - 1))
        self.open[tag] += 1

    def handle_endtag(self, tag: str) -> None:
        self.closers[tag] -= 1
        if self.hidden:
            if tag == self.hidden[0]:
                self.hidden.pop()
                if not self.hidden:
                    self.inside.clear()
                return
            if self.inside[tag] > 0:
                self.inside[tag] -= 1
                return
            if self.hidden[0] in RAW or not self.open[tag]:
                return
            # the end of an element around a hidden one ends that too
            self.hidden = []
            self.inside.clear()
        if tag == "a":
            self.links = 0
        if tag in INLINE or tag in VOID:
            return
        if self.open[tag] > 0:
            for i in range(len(self.stack) - 1, 0, -1):
                if self.stack[i][0] == tag:
                    self.pop(i)
                    return
        self.end_segment()

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.text.append(data)
            if self.links:
                self.linked += len(data.strip())


def features(node: Node, deep: int) -> list[str]:
    """Names of what is true of a node."""
    chars, linked, segments, ends, children = node.stats
    out = ["bias", f"tag={node.tag}", *[f"name={w}" for w in node.names], f"depth={min(deep, 6)}"]
    if segments:
        out += [f"chars={min(8, int(math.log2(chars + 1)))}", f"links={round(4 * linked / chars)}", f"ends={min(3, ends)}"]
    else:
        out.append(f"empty={min(3, children)}")
    return out


class Model(NamedTuple):
    """Log potentials: of a feature with content, and of a child's label given its parent's, by the child's tag."""

    unary: dict[str, float]
    pair: dict[tuple[str, int, int], float]


def _edge(pair: dict, tag: str, parent: int, child: int) -> float:
    return pair.get((tag, parent, child), 0.0) + pair.get(("", parent, child), 0.0)


def _log_sum(a: float, b: float) -> float:
    top = max(a, b)
    return top + math.log1p(math.exp(min(a, b) - top))


def marginals(model: Model, nodes: list[Node]) -> tuple[list[float], list[list[list[float]]]]:
    """Probability of content for each node, and of each pair of labels of a node and its parent.

    Sum-product on the tree in log space: messages go up from the leaves in reverse page order, then down from the root in
    page order; a node's number is always above its parent's. The root is never content.
    """
    n = len(nodes)
    deep = [0] * n
    own = [[0.0, 0.0] for _ in range(n)]
    for i, x in enumerate(nodes):
        if i:
            deep[i] = deep[x.parent] + 1
        own[i][1] = sum(model.unary.get(f, 0.0) for f in features(x, deep[i]))
    own[0] = [0.0, -1e9]
    edges = [None] + [[[_edge(model.pair, x.tag, p, c) for c in (0, 1)] for p in (0, 1)] for x in nodes[1:]]
    up = [list(x) for x in own]  # a node's own potential with all messages from below
    sent = [[0.0, 0.0] for _ in range(n)]
    for i in range(n - 1, 0, -1):
        e = edges[i]
        for p in (0, 1):
            sent[i][p] = _log_sum(e[p][0] + up[i][0], e[p][1] + up[i][1])
            up[nodes[i].parent][p] += sent[i][p]
    down = [[0.0, 0.0] for _ in range(n)]
    prob, joint = [0.0] * n, [[[0.0, 0.0], [0.0, 0.0]] for _ in range(n)]
    for i in range(n):
        if i:
            above = nodes[i].parent
            rest = [up[above][p] + down[above][p] - sent[i][p] for p in (0, 1)]  # the parent without this child
            e = edges[i]
            down[i] = [_log_sum(rest[0] + e[0][c], rest[1] + e[1][c]) for c in (0, 1)]
            cells = [[rest[p] + e[p][c] + up[i][c] for c in (0, 1)] for p in (0, 1)]
            top = max(max(r) for r in cells)
            mass = [[math.exp(v - top) for v in r] for r in cells]
            total = sum(map(sum, mass))
            joint[i] = [[v / total for v in r] for r in mass]
        a, b = up[i][0] + down[i][0], up[i][1] + down[i][1]
        prob[i] = 1.0 / (1.0 + math.exp(min(700.0, a - b)))
    return prob, joint


def train(pages: list[tuple[list[Node], list[int]]], rounds: int = 12, rate: float = 0.3, decay: float = 1e-3) -> Model:
    """Potentials that maximise the likelihood of labelled trees (nodes, labels), by stochastic gradients from the marginals."""
    model, rng = Model({}, {}), random.Random(7)
    for r in range(rounds):
        step = rate / (1 + 0.3 * r)
        for nodes, labels in rng.sample(pages, len(pages)):
            prob, joint = marginals(model, nodes)
            deep = [0] * len(nodes)
            for i, x in enumerate(nodes[1:], 1):
                deep[i] = deep[x.parent] + 1
                if abs(gap := labels[i] - prob[i]) > 1e-3:
                    for f in features(x, deep[i]):
                        model.unary[f] = model.unary.get(f, 0.0) * (1 - step * decay) + step * gap
                for p in (0, 1):
                    for c in (0, 1):
                        gap = (labels[x.parent] == p and labels[i] == c) - joint[i][p][c]
                        if abs(gap) > 1e-3:
                            for k in ((x.tag, p, c), ("", p, c)):
                                model.pair[k] = model.pair.get(k, 0.0) * (1 - step * decay) + step * gap
    return model


# Names under which web pages commonly wrap their parts, for the layouts of labelled pages.
_BODY = ["article", "main", "div.content", "div.post-content", "div.entry-content", "section.article-body", "div#main-content", "div.story", "div", "section"]
_CLUTTER = {
    "menu": ["nav", "div.menu", "ul.nav", "div.navbar", "nav.breadcrumb", "div#navigation", "div.breadcrumbs"],
    "header": ["header", "div.header", "header.site-header", "div#masthead", "div.topbar"],
    "footer": ["footer", "div.footer", "div#footer", "footer.site-footer", "div.copyright", "div.bottom"],
    "side": ["aside", "div.sidebar", "aside.related", "div.related-posts", "div.widget", "section.recommended", "div.tags", "div.share", "div.social"],
    "notice": ["div.cookie-notice", "div.notice", "div.consent", "div.banner", "div.newsletter", "div.popup", "div.alert", "section.subscribe", "div.cookie", "div.disclaimer"],
    "advert": ["div.ad", "div.advert", "div.ads", "aside.advertisement", "div.sponsored", "div.promo", "section.ad"],
    "form": ["form", "form.search", "div.login", "form.signup", "form.contact"],
    "comments": ["section.comments", "div#comments", "div.comment-list", "ol.comments", "div.comment", "section.reader-comments", "div.discussion", "div.replies"],
}


def _wrapped(name: str, inner: str) -> str:
    tag, mark, value = re.fullmatch(r"(\w+)([.#]?)([\w-]*)", name).groups()
    said = {"": "", ".": f' class="{value}"', "#": f' id="{value}"'}[mark]
    return f"<{tag}{said}>{inner}</{tag}>"


def labelled_page(texts: list[str], rng: random.Random) -> tuple[list[Node], list[int]]:
    """A page of a random layout, filled with the given texts, and the label of every block: 1 in the article proper."""
    said = lambda n: [rng.choice(texts) for _ in range(n)]
    esc = lambda t: t.replace("&", "&amp;").replace("<", "&lt;")
    short = lambda: " ".join(rng.choice(texts).split()[: rng.randint(1, 4)])

    def clutter(kind: str) -> str:
        links = "".join(f'<li><a href="#">{esc(short())}</a></li>' for _ in range(rng.randint(2, 8)))
        prose = "".join(f"<p>{esc(t)}</p>" for t in said(rng.randint(1, 3)))
        inner = {
            "menu": f"<ul>{links}</ul>", "header": f"<h2>{esc(short())}</h2>{rng.choice(['', f'<ul>{links}</ul>', f'<p>{esc(short())}</p>'])}",
            "footer": rng.choice([esc(short()), f"<p>{esc(short())}</p><ul>{links}</ul>", prose]), "side": rng.choice([f"<h3>{esc(short())}</h3><ul>{links}</ul>", prose, f"<ul>{links}</ul>"]),
            "notice": rng.choice([prose, esc(said(1)[0])]), "advert": rng.choice([prose, esc(said(1)[0]), f'<a href="#">{esc(said(1)[0])}</a>']),
            "form": f"<label>{esc(short())}</label><input><p>{esc(short())}</p>",
            "comments": f"<h3>{esc(short())}</h3>" * rng.randint(0, 1) + "".join(rng.choice([f'<div class="comment"><p>{esc(t)}</p></div>', f"<p>{esc(t)}</p>", f"<li>{esc(t)}</li>"]) for t in said(rng.randint(1, 5)))}[kind]
        return f'<div class="x-out">{_wrapped(rng.choice(_CLUTTER[kind]), inner)}</div>'

    def block() -> str:
        t = esc(rng.choice(texts))
        return rng.choice([f"<p>{t}</p>"] * 6 + [f"<p><b>{t}</b>", f"<h2>{esc(short())}</h2>", f"<ul><li>{t}</li><li>{esc(short())}.</li></ul>", f"<blockquote><p>{t}</p></blockquote>", f"<div><p>{t}</p></div>", f"<table><tr><td>{esc(short())}</td><td>{esc(short())}</td></tr></table>", f"<pre>{t}</pre>"])

    within = ["advert", "side", "comments", "form", "notice", "footer", "header", "menu"]
    parts = [f"<h1>{esc(short())}</h1>"] * rng.randint(0, 1) + [block() for _ in range(rng.randint(1, 12))]
    for kind in rng.sample(within, rng.choice([0, 0, 0, 1, 2])):
        parts.insert(rng.randint(1, len(parts)), clutter(kind))
    body = f'<div class="x-in">{_wrapped(rng.choice(_BODY), "".join(parts))}</div>'
    kinds = [k for k in _CLUTTER if rng.random() < 0.6]
    top, low = [k for k in kinds if k in ("menu", "header", "notice", "advert", "form")], [k for k in kinds if k not in ("menu", "header")]
    html = "".join(map(clutter, rng.sample(top, len(top)))) + body + "".join(map(clutter, rng.sample(low, len(low))))
    if rng.random() < 0.4:
        html = _wrapped(rng.choice(["div.wrapper", "div#page", "div.container", "div", "main"]), html)
    dom = Dom(f"<html><body>{html}</body></html>")
    # the markers say where the article begins and ends; they are taken out of the tree again
    label, kept, number = [0] * len(dom.nodes), [], {}
    for i, x in enumerate(dom.nodes):
        label[i] = 1 if x.names == ("x", "in") else 0 if x.names == ("x", "out") else label[x.parent] if i else 0
        if x.names in (("x", "in"), ("x", "out")):
            number[i] = number[x.parent]
            dom.nodes[x.parent].stats[4] += x.stats[4] - 1
            continue
        number[i] = len(kept)
        kept.append((x._replace(parent=number[x.parent] if i else -1), label[i]))
    return [x for x, _ in kept], [y for _, y in kept]


#: Pages whose texts fill the labelled layouts, the longest page taken for it, and how many layouts are made.
SAMPLE_PAGES, SAMPLE_CHARS, LAYOUTS = 200, 100_000, 400


def fit(pages: DataFrame, sample_pages: int = SAMPLE_PAGES, layouts: int = LAYOUTS) -> Model:
    """Model trained on labelled layouts filled with the block texts of at most ``sample_pages`` distinct pages, chosen by their hash.

    Only the training sample is bounded (in pages and in their length), not the pages that the model is applied to.
    """
    rows = packed(pages, "page_id", "html").where(F.length("html") <= SAMPLE_CHARS).select("html", F.xxhash64("page_id", "html").alias("h"))
    low = rows.select("h").distinct().orderBy("h").limit(sample_pages).agg(F.max("h")).first()[0]
    # hashes are chosen first, so that only the sample's pages leave the executors
    chosen = rows.where(F.col("h") <= F.lit(low)).dropDuplicates(["h"]).orderBy("h").collect() if low is not None else []
    texts = sorted({t for r in chosen for _, t in Dom(r["html"]).segments if len(t) < 2000}) or ["No text was found on any page."]
    rng = random.Random(5)
    return train([labelled_page(texts, rng) for _ in range(layouts)])


def main_text(model: Model, html: str) -> str:
    """Blocks of a page that are more likely content than not, in page order, one to a line."""
    dom = Dom(html)
    prob, _ = marginals(model, dom.nodes)
    return "\n".join(t for at, t in dom.segments if prob[at] > 0.5)


def page_texts(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """``page_id``, ``url`` and ``text``, the main text, of every page.

    ``pages``: rows with ``page_id``, ``url`` and ``html``; further columns are ignored, whatever their names. Without a
    ``model`` one is fitted on a bounded sample of the pages. Character references are decoded, white space inside a
    block becomes one space, blocks are joined by a line feed.

    A null or empty html has the empty text, as has a page of clutter only; unclosed and stray tags are repaired; null ids
    and urls stay null; repeated rows have equal texts; an empty table gives no rows.
    """
    model = model or fit(pages)
    rows = packed(pages, "page_id", "url", "html").select("page_id", "url", text_of(F.col("html")).alias("html"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["page_id"], b["url"], pa.array([main_text(model, h) for h in b["html"].to_pylist()], pa.string())], names=["page_id", "url", "text"])

    return rows.mapInArrow(extract, rows.select("page_id", "url", F.col("html").alias("text")).schema)
