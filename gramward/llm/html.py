"""Main text of HTML pages: gradient-boosted trees over DOM nodes, and hierarchical decoding.

Every structural node gets a probability that its subtree holds main text. Decoding then picks
the likeliest labelling in which no node is kept below a dropped one. The trees are trained
here, on pages that ``training_pages`` makes with their labels.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gramward.llm.common import slices, spread

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*)>|<[a-zA-Z/!?][^>]*\Z""", re.S
)
_ATTRIBUTE = re.compile(r"""(?i)\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_WORDS = re.compile(r"[a-z]+")
#: Elements by how they are read. Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Nothing in these is text of the page. Those of SCRIPTS take the rest where they do not end, as in a browser; of others only the tag goes.
RAW = frozenset("script style noscript template svg iframe object canvas title textarea".split())
SCRIPTS = frozenset("script style".split())
#: Their text is taken as it stands, without markup or character references.
PLAIN = frozenset("xmp listing plaintext".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big blink cite code data del dfn em font i ins kbd label mark nobr q rb rp rt rtc ruby s samp small span strike strong sub sup time tt u var "
    "math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle mpadded mphantom menclose semantics annotation".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
#: An open element of the key ends where one of the values begins.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table body article section div main aside nav".split())
#: Tags that are features of their own, of a node and of those above it.
TAGS = "nav header footer aside form article main section div p h1 h2 h3 ul ol li table td blockquote pre figure body button select fieldset dl".split()


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    tokens: frozenset[str]
    own: int = 0  # characters of text directly here
    linked: int = 0  # of these, in links
    marks: int = 0  # sentence marks
    children: list[int] = field(default_factory=list)


def flows(name: str) -> bool:
    """Elements within a line of text: inline ones, and custom ones (a hyphen in the name), which are inline unless styled."""
    return name in INLINE or "-" in name


def read(page: str | None) -> tuple[list[Node], list[tuple[int, str]]]:
    """The nodes in page order and the text pieces (node, text); node -1 marks a block's edge."""
    page = page or ""
    nodes, pieces = [Node("body", -1, 0, frozenset())], []
    stack: list[tuple[str, int]] = [("body", 0)]  # open elements with the node they belong to
    unclosed: set[str] = set()  # raw elements that have no end from here on
    at, links = 0, 0

    def text(raw: str, plain: bool = False) -> None:
        if raw and not raw.isspace():
            if "&" in raw and not plain:
                raw = html.unescape(raw)
            node = nodes[stack[-1][1]]
            size = len(raw)
            node.own += size
            node.marks += raw.count(".") + raw.count(",") + raw.count("!") + raw.count("?")
            if links:
                node.linked += size
            pieces.append((stack[-1][1], raw))
        elif raw:
            pieces.append((-1, "") if not flows(stack[-1][0]) else (stack[-1][1], " "))

    def leave(to: int) -> None:
        nonlocal links
        for name, _ in stack[to:]:
            links -= name == "a"
            if not flows(name):
                pieces.append((-1, ""))
        del stack[to:]

    size = len(page)
    while at < size:
        found = _TOKEN.search(page, at)
        if not found:
            text(page[at:])
            break
        text(page[at : found.start()])
        at = found.end()
        name = (found[2] or "").lower()
        if not name:
            continue
        if found[1]:
            if name == "br":
                pieces.append((-1, ""))
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    leave(k)
                    break
            continue
        if name in RAW or name in PLAIN:
            if name == "svg" and found[3].endswith("/"):
                continue
            end = None
            if name not in unclosed:
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            if name in PLAIN:
                pieces.append((-1, ""))
                text(page[at : end.start() if end else size], True)
                pieces.append((-1, ""))
            if end:
                at = end.end()
            elif name in SCRIPTS or name in PLAIN:
                at = size
            else:
                unclosed.add(name)
            continue
        if name in VOID:
            if name in ("br", "hr"):
                pieces.append((-1, ""))
            continue
        if name in ("html", "head", "body"):
            continue
        if name in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p":
                    leave(k)
                    break
                if stack[k][0] not in INLINE:
                    break
        if name in ENDS:
            for k in range(len(stack) - 1, 0, -1):
                if name in ENDS.get(stack[k][0], ()):
                    leave(k)
                    break
                if stack[k][0] in SCOPES:
                    break
        inline = name in INLINE
        if inline:  # a part of its block, whatever its class: no word of kept prose goes by itself
            stack.append((name, stack[-1][1]))
            links += name == "a"
            continue
        tokens = frozenset(w for a in _ATTRIBUTE.findall(found[3]) for v in a[1:] if v for w in _WORDS.findall(v.lower())) if found[3] else frozenset()
        parent = stack[-1][1]
        nodes[parent].children.append(len(nodes))
        nodes.append(Node(name, parent, nodes[parent].depth + 1, tokens))
        stack.append((name, len(nodes) - 1))
        if not flows(name):
            pieces.append((-1, ""))
    return nodes, pieces


#: In front of main text in training pages; taken for what it says there, and never a feature by itself.
MARK = "\ue000"
NUMBERS = 15


def features(nodes: list[Node], vocabulary: dict[str, int]) -> np.ndarray:
    """Of each node: sizes, densities and depth of its subtree, places among its siblings; its tag; tags and attribute tokens here or above."""
    count, tags = len(nodes), len(TAGS)
    out = np.zeros((count, NUMBERS + 2 * tags + len(vocabulary)), np.float32)
    sums = np.array([(n.own, n.linked, n.marks, 1, n.tag == "p", n.tag == "li") for n in nodes], np.float64)
    for k in range(count - 1, 0, -1):
        sums[nodes[k].parent] += sums[k]
    size, linked, marks, inside, paragraphs, items = sums.T
    page = max(size[0], 1.0)
    out[:, 0], out[:, 1], out[:, 2] = np.log1p(size), linked / np.maximum(size, 1), marks / np.maximum(size, 1)
    out[:, 3], out[:, 4], out[:, 5] = size / inside, np.log1p(inside), size / page
    out[:, 6] = [n.depth for n in nodes]
    out[:, 7] = [n.own for n in nodes]
    out[:, 8], out[:, 9] = paragraphs, items
    at = {t: k for k, t in enumerate(TAGS)}
    for k, node in enumerate(nodes):
        row = out[k]
        if node.parent >= 0:
            row[NUMBERS + tags :] = out[node.parent, NUMBERS + tags :]
        if (t := at.get(node.tag)) is not None:
            row[NUMBERS + t] = row[NUMBERS + tags + t] = 1
        for token in node.tokens:
            if (t := vocabulary.get(token)) is not None:
                row[NUMBERS + 2 * tags + t] = 1
        if node.children:
            kids = node.children
            before, whole, widest = 0.0, max(size[k], 1.0), max(size[c] for c in kids)
            for place, c in enumerate(kids):
                out[c, 10:15] = len(kids), place / len(kids), before / whole, size[c] / whole, size[c] / max(widest, 1.0)
                before += size[c]
    return out


class BoostedTrees:
    """Binary logistic boosting of depth-limited trees over quantile bins."""

    def __init__(self, trees: int = 40, depth: int = 4, rate: float = 0.3, bins: int = 32):
        self.trees, self.depth, self.rate, self.bins = trees, depth, rate, bins
        self.model: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        codes = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], axis=1)
        self.base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        score = np.full(len(y), self.base)
        width = self.bins + 1
        flat = codes + np.arange(x.shape[1]) * width
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            slope, curve = y - p, np.maximum(p * (1 - p), 1e-6)
            feature, cut, leaf = np.zeros(2**self.depth, int), np.full(2**self.depth, np.inf), np.zeros(2 ** (self.depth + 1))
            at = np.ones(len(y), int)
            for level in range(self.depth):
                first = 2**level
                for node in range(first, 2 * first):
                    rows = np.flatnonzero(at == node)
                    if len(rows) < 16:
                        continue
                    shape = x.shape[1], width
                    many = flat[rows].ravel()
                    g = np.bincount(many, np.repeat(slope[rows], x.shape[1]), shape[0] * width).reshape(shape).cumsum(1)
                    h = np.bincount(many, np.repeat(curve[rows], x.shape[1]), shape[0] * width).reshape(shape).cumsum(1)
                    whole_g, whole_h = g[0, -1], h[0, -1]
                    gain = g**2 / (h + 1) + (whole_g - g) ** 2 / (whole_h - h + 1) - whole_g**2 / (whole_h + 1)
                    gain[(h < 1) | (whole_h - h < 1)] = 0
                    f, b = np.unravel_index(gain.argmax(), shape)
                    if gain[f, b] > 1e-6 and b < len(cuts[f]):
                        feature[node], cut[node] = f, cuts[f][b]
                at = 2 * at + (x[np.arange(len(y)), feature[at]] > cut[at])
            top = 2**self.depth
            g, h = np.bincount(at - top, slope, top), np.bincount(at - top, curve, top)
            leaf[top:] = self.rate * g / (h + 1)
            score += leaf[at]
            self.model.append((feature, cut, leaf))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Log odds."""
        score, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, leaf in self.model:
            at = np.ones(len(x), int)
            for _ in range(self.depth):
                at = 2 * at + (x[rows, feature[at]] > cut[at])
            score += leaf[at]
        return score


def decode(nodes: list[Node], odds: np.ndarray) -> list[bool]:
    """The likeliest labelling in which whatever stands below a dropped node is dropped."""
    keep, drop = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
    best, none = keep.tolist(), drop.tolist()
    for k in range(len(nodes) - 1, 0, -1):
        up = nodes[k].parent
        best[up] += max(best[k], none[k])
        none[up] += none[k]
    kept = [best[0] > none[0]] * len(nodes)
    for k in range(1, len(nodes)):
        kept[k] = kept[nodes[k].parent] and best[k] > none[k]
    return kept


def main_text(nodes: list[Node], pieces: list[tuple[int, str]], kept: list[bool]) -> str:
    return " ".join("".join(text if k >= 0 and kept[k] else " " for k, text in pieces if k < 0 or kept[k]).split())


def training_pages(count: int = 400, seed: int = 7) -> Iterator[str]:
    """Pages of many layouts. Main text carries the mark U+E000, which labels it and is no feature."""
    draw = random.Random(seed)
    letters = "aeioutnshrdlcm"

    def words(low: int, high: int, main: bool = False) -> str:
        made = ["".join(draw.choice(letters) for _ in range(draw.randint(1, 11))) for _ in range(draw.randint(low, high))]
        for k in range(draw.randint(4, 14), len(made), draw.randint(6, 16)):
            made[k] += draw.choice(",.")
        return (MARK if main else "") + " ".join(made).capitalize() + draw.choice(["."] * 4 + [""])

    def attr(*names: str) -> str:
        name = draw.choice(names)
        return draw.choice([f' class="{name}"', f' id="{name}"', f' class="{name} {draw.choice(["x", "box", "block", "inner", "wide"])}"'])

    def some(make, low: int, high: int) -> str:
        return "".join(make() for _ in range(draw.randint(low, high)))

    def link() -> str:
        return f'<a href="/{draw.randint(1, 99)}">{words(1, 4)}</a>'

    def menu() -> str:
        items = "<ul>" + some(lambda: f"<li>{link()}</li>", 3, 9) + "</ul>"
        return draw.choice([f"<nav>{items}</nav>", f"<div{attr('menu', 'nav', 'navbar', 'navigation', 'breadcrumb')}>{items}</div>", f"<nav{attr('menu', 'top')}>{some(link, 2, 6)}</nav>"])

    def prose() -> str:
        return f"<p>{words(4, 60)}</p>"

    def advert() -> str:
        body = draw.choice([words(2, 18), prose(), link(), f"<p>{words(5, 30)}</p>{link()}"])
        return f"<{(t := draw.choice(['div', 'div', 'section', 'aside']))}{attr('ad', 'ads', 'advert', 'advertisement', 'banner', 'sponsored', 'promo', 'sponsor')}>{body}</{t}>"

    def notice() -> str:
        return f"<div{attr('notice', 'cookie', 'cookie-notice', 'consent', 'alert', 'popup', 'gdpr', 'disclaimer', 'newsletter', 'subscribe')}>{draw.choice([prose(), words(4, 30)])}{draw.choice(['', '<button>' + words(1, 2) + '</button>'])}</div>"

    def form() -> str:
        return f"<form{draw.choice(['', attr('search', 'login', 'signup')])}><label>{words(1, 6)}</label><input name=q>{draw.choice(['', prose(), '<select><option>' + words(1, 2) + '<option>' + words(1, 2) + '</select>'])}<button>{words(1, 2)}</button></form>"

    def side() -> str:
        body = draw.choice([f"<h3>{words(1, 4)}</h3><ul>{some(lambda: f'<li>{link()}</li>', 2, 8)}</ul>", some(prose, 1, 3), words(3, 30)])
        return draw.choice([f"<aside>{body}</aside>", f"<aside{attr('sidebar', 'widget')}>{body}</aside>", f"<div{attr('sidebar', 'side', 'widget', 'related', 'share', 'social', 'recommended', 'tags', 'author')}>{body}</div>"])

    def comments() -> str:
        one = lambda: f"<{(t := draw.choice(['div', 'li', 'article']))}{attr('comment', 'reply')}><b>{words(1, 2)}</b>{draw.choice([prose(), some(prose, 1, 3), words(3, 40)])}</{t}>"
        return f"<{(t := draw.choice(['div', 'section', 'ul']))}{attr('comments', 'comment-list', 'discussion', 'replies', 'responses')}>{draw.choice(['', '<h3>' + words(1, 3) + '</h3>'])}{some(one, 1, 6)}</{t}>"

    def header() -> str:
        return draw.choice([f"<header>{draw.choice([words(1, 8), '<h1>' + words(1, 5) + '</h1>'])}{draw.choice(['', menu()])}</header>", f"<div{attr('header', 'top', 'masthead', 'logo')}>{words(1, 8)}</div>"])

    def footer() -> str:
        body = draw.choice([f"&copy; {words(3, 30)}", f"<p>{words(3, 25)}</p>{some(link, 0, 4)}", f"<ul>{some(lambda: f'<li>{link()}</li>', 2, 6)}</ul>{words(2, 9)}"])
        return draw.choice([f"<footer>{body}</footer>", f"<footer{attr('footer', 'site')}>{body}</footer>", f"<div{attr('footer', 'copyright', 'legal', 'bottom')}>{body}</div>"])

    def block() -> str:
        kind = draw.random()
        if kind < 0.72:
            body = words(1 if draw.random() < 0.1 else 6, 90, True)
            return draw.choice([f"<p>{body}</p>", f"<p>{body}</p>", f"<p>{body}", f"<p><b>{body}<br></p>", f"<p><b>{body}</b></p>", f"<p>{body} {link()} {words(2, 20)}</p>", f"<div>{body}</div>"])
        if kind < 0.8:
            return f"<h{(n := draw.choice('234'))}>{words(1, 8, True)}</h{n}>"
        if kind < 0.86:
            return "<ul>" + some(lambda: f"<li>{words(1, 15, True)}</li>", 2, 6) + "</ul>"
        if kind < 0.9:
            return f"<blockquote>{draw.choice(['{}', '<p>{}</p>']).format(words(4, 40, True))}</blockquote>"
        if kind < 0.94:
            return "<table>" + some(lambda: f"<tr><td>{words(1, 4, True)}</td><td>{words(1, 4, True)}</td></tr>", 2, 5) + "</table>"
        return draw.choice([f"<pre>{words(4, 20, True)}</pre>", f"<figure><img src=a><figcaption>{words(2, 12, True)}</figcaption></figure>"])

    def article() -> str:
        head = draw.choice(["", "<h1>{}</h1>", "<h1>{}</h1>", "<h1>{}</h1>", "<h2>{}</h2>"]).format(words(2, 14, True))
        blocks = [block() for _ in range(draw.randint(1, 4) if draw.random() < 0.4 else draw.randint(3, 14))]
        if draw.random() < 0.3:
            blocks.insert(draw.randint(0, len(blocks)), draw.choice([advert, side, notice, form])())
        body = head + "".join(blocks) + (comments() if draw.random() < 0.1 else "")
        return draw.choice([
            f"<article>{body}</article>", f"<article>{body}</article>", f"<article{attr('post', 'article', 'entry')}>{body}</article>", f"<main>{body}</main>",
            f"<div{attr('content', 'article', 'post', 'entry', 'entry-content', 'main', 'story', 'text', 'article-body')}>{body}</div>",
            f"<main><article>{body}</article></main>", f"<section{attr('content', 'article')}>{body}</section>", f"<div>{body}</div>",
        ])

    for _ in range(count):
        above = [f() for f in draw.sample([header, menu, advert, notice, form, side], draw.randint(1, 4))]
        below = [f() for f in draw.sample([side, comments, advert, form, notice, menu], draw.randint(0, 4))]
        page = "".join(above) + article() + "".join(below) + (footer() if draw.random() < 0.85 else "")
        if draw.random() < 0.4:
            page = f"<div{draw.choice(['', attr('page', 'wrapper', 'container', 'layout')])}>{page}</div>"
        yield f"<!DOCTYPE html><html><head><title>{words(2, 9)}</title></head><body>{page}</body></html>"


@dataclass
class Extractor:
    vocabulary: dict[str, int]
    trees: BoostedTrees

    def texts(self, pages: list[str | None]) -> list[str]:
        read_pages = [read(p) for p in pages]
        if not read_pages:
            return []
        odds = self.trees.predict(np.concatenate([features(n, self.vocabulary) for n, _ in read_pages]))
        out, at = [], 0
        for nodes, pieces in read_pages:
            out.append(main_text(nodes, pieces, decode(nodes, odds[at : at + len(nodes)])))
            at += len(nodes)
        return out


@lru_cache(maxsize=1)
def trained(pages: int = 400, tokens: int = 96) -> Extractor:
    """The extractor, fitted on ``pages`` generated pages and their ``tokens`` commonest attribute tokens."""
    made = [read(p) for p in training_pages(pages)]
    counts: dict[str, int] = {}
    for nodes, _ in made:
        for node in nodes:
            for token in node.tokens:
                counts[token] = counts.get(token, 0) + 1
    kept = sorted(counts, key=lambda t: (-counts[t], t))[:tokens]
    vocabulary = {t: k for k, t in enumerate(kept)}
    labels = []
    for nodes, pieces in made:
        main = [False] * len(nodes)
        for k, text in pieces:
            if k >= 0 and MARK in text:
                main[k] = True
        for k in range(len(nodes) - 1, 0, -1):
            main[nodes[k].parent] |= main[k]
        labels += main
    x = np.concatenate([features(n, vocabulary) for n, _ in made])
    return Extractor(vocabulary, BoostedTrees().fit(x, np.array(labels, float)))


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of each row of ``pages(page_id, url, html)``.

    A null or empty html gives an empty text and 0. Whole pages are read, however long; malformed
    markup is read as far as it goes. Repeated rows give repeated results, ties between labellings drop the node; other
    columns are ignored; an empty table gives no rows. Nothing is shuffled; the fitted trees, of fixed size, go to every task.
    """
    spark = pages.sparkSession
    shared = spark.sparkContext.broadcast(trained())
    fields = [pages.schema["page_id"], pages.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            texts = shared.value.texts(batch.column(2).to_pylist())
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    return spread(pages.select("page_id", "url", "html")).mapInArrow(run, T.StructType(fields))
