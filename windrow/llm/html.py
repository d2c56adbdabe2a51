"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded so that no node contradicts its ancestors."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

#: Training bounds: pages, and the characters of one; trees of the model with their depth and bins. Any page is extracted whole.
TRAIN_PAGES, TRAIN_CHARS = 400, 200_000
TREES, DEPTH, BINS, RATE = 40, 4, 24, 0.25

#: Kinds of elements, and attribute tokens that hint at main text or at what surrounds it.
INLINE = frozenset(
    "a abbr b bdi bdo big br cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img input "
    "noscript object canvas svg g text tspan math mrow mi mo mn ms mtext msup msub msubsup mfrac msqrt mroot mover munder mstyle semantics annotation".split()
)
APART = frozenset("br noscript object canvas svg text".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template title textarea iframe".split())
FLOW = frozenset("p h1 h2 h3 h4 h5 h6".split())
GOOD_TAGS = frozenset("article main".split())
BAD_TAGS = frozenset("nav footer aside form header button select menu dialog fieldset".split())
GOOD = frozenset("article content main body post entry story text prose page".split())
BAD = frozenset(
    "nav navigation menu breadcrumb header masthead footer foot sidebar side aside widget ad ads advert advertisement sponsor promo banner cookie consent notice "
    "popup modal newsletter subscribe share social related recommend comment comments reply disqus form login search copyright legal tags meta pagination pager".split()
)
N_FEATURES = 23
KIND_OF = dict.fromkeys(FLOW, 1) | {"p": 2} | dict.fromkeys(("li", "dd", "dt"), 3) | dict.fromkeys(("td", "th", "tr", "table"), 4) | {"#text": 5}


def parse(html: str) -> list[list]:
    """Block elements and runs of text in page order: [tag, parent, end, depth, tokens, text, link characters].

    ``end`` is the number behind the subtree's last node. Tag soup is mended as browsers do where it matters: paragraphs
    end where a block begins, list items and cells where the next one does, and a stray end tag is ignored.
    """
    import re
    from html import unescape

    token = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?", re.S)
    nodes: list[list] = [["#root", -1, 0, 0, frozenset(), "", 0]]
    stack, run, links, in_link = [0], [], 0, 0

    def flush():
        nonlocal links
        text = " ".join(unescape("".join(run)).split())
        if text:
            i = len(nodes)
            nodes.append(["#text", stack[-1], i + 1, len(stack), frozenset(), text, min(links, len(text))])
        run.clear()
        links = 0

    def close(k):
        while len(stack) > k:
            nodes[stack.pop()][2] = len(nodes)

    at = 0
    n = len(html)
    while at < n:
        m = token.search(html, at)
        chunk = html[at : m.start()] if m else html[at:]
        if chunk:
            run.append(chunk)
            if in_link:
                links += len(chunk)
        if not m:
            break
        at = m.end()
        name = m.group(2)
        if not name:
            continue
        tag, ends = name.lower(), m.group(1)
        if tag in INLINE:
            if tag == "a":
                in_link = 0 if ends else 1
            elif tag in APART:
                run.append(" ")
            continue
        if tag in RAW:
            if not ends and not m.group(3).rstrip().endswith("/"):
                stop = re.compile(f"</{re.escape(tag)}", re.I).search(html, at)
                at = stop.start() if stop else n
            continue
        flush()
        in_link = 0
        if ends:
            k = next((k for k in range(len(stack) - 1, 0, -1) if nodes[stack[k]][0] == tag), None)
            if k is not None:
                close(k)
            continue
        top = nodes[stack[-1]][0]
        if top in FLOW and (tag in FLOW or tag not in VOID):
            close(len(stack) - 1)
        elif (tag in ("li", "option") and top == tag) or (tag in ("td", "th", "dt", "dd") and top in ("td", "th", "dt", "dd")) or (tag == "tr" and top in ("tr", "td", "th")):
            close(len(stack) - 1)
        if tag in VOID:
            continue
        attrs = frozenset(re.findall(r"[a-z]+", " ".join(re.findall(r"(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", m.group(3), re.I)).lower())) if m.group(3) else frozenset()
        nodes.append([tag, stack[-1], 0, len(stack), attrs, "", 0])
        stack.append(len(nodes) - 1)
    flush()
    close(0)
    return nodes


def node_features(pages: list[list[list]]) -> np.ndarray:
    """Per node of all pages: subtree text, link and element density, own and inherited attribute tokens, depth, siblings, place."""
    nodes = [x for page in pages for x in page]
    size = np.array([len(p) for p in pages])
    root = np.repeat(np.cumsum(size) - size, size)
    n = len(nodes)
    up = np.maximum(np.array([x[1] for x in nodes], np.int64), 0) + root
    end = np.array([x[2] for x in nodes], np.int64) + root
    depth = np.array([x[3] for x in nodes], float)
    own = np.array([
        (len(t), x[6], t.count(" ") + 1, t.count(".") + t.count(",") + t.count("!") + t.count("?"), 1, 0, t.count("|") + t.count("©")) if (t := x[5]) else (0, 0, 0, 0, 0, 1, 0)
        for x in nodes
    ], float)
    run = np.concatenate((np.zeros((1, own.shape[1])), np.cumsum(own, 0)))
    sub = run[end] - run[:-1]
    is_good = [x[0] in GOOD_TAGS or not GOOD.isdisjoint(x[4]) for x in nodes]
    is_bad = [x[0] in BAD_TAGS or not BAD.isdisjoint(x[4]) for x in nodes]
    in_good, in_bad, place, before, count = [0] * n, [0] * n, [0] * n, [-1] * n, [0] * n
    last = [-1] * n
    for i, p in enumerate(up.tolist()):
        in_good[i], in_bad[i] = int(is_good[i]), int(is_bad[i])
        if p != i:
            in_good[i] += in_good[p]
            in_bad[i] += in_bad[p]
            place[i], before[i], last[p] = count[p], last[p], i
            count[p] += 1
    before, count, place = np.array(before), np.array(count, float), np.array(place, float)
    tag = np.array([KIND_OF.get(x[0], 0) for x in nodes], float)
    chars, words = np.maximum(sub[:, 0], 1), np.maximum(sub[:, 2], 1)
    total = np.maximum(sub[root, 0], 1)
    log = np.log1p
    return np.stack([
        tag, tag[up], log(sub[:, 0]), sub[:, 1] / chars, sub[:, 5] / chars * 100, sub[:, 3] / words, chars / words, depth, place, count[up], place / np.maximum(count[up], 1),
        sub[:, 0] / total, sub[:, 0] / np.maximum(sub[up, 0], 1), (run[:-1, 0] - run[root, 0]) / total, log(sub[up, 0]), sub[up, 1] / np.maximum(sub[up, 0], 1),
        np.where(before >= 0, log(sub[before, 0]), 0), np.array(is_good, float), np.array(is_bad, float), np.array(in_good, float), np.array(in_bad, float), sub[:, 6], sub[:, 4],
    ], 1)


@dataclass
class Boosted:
    """Oblivious trees: each level of a tree asks one question (feature, threshold) of all its nodes."""

    base: float
    features: np.ndarray  # trees, depth
    cuts: np.ndarray
    leaves: np.ndarray  # trees, 2 ^ depth

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        bit = 1 << np.arange(self.features.shape[1])
        for f, c, leaf in zip(self.features, self.cuts, self.leaves):
            z += leaf[((x[:, f] > c) * bit).sum(1)]
        return 1 / (1 + np.exp(-z))


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Boosted:
    """Second-order boosting of the logistic loss on binned features."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], 1)
    base = float(np.log((weight @ y + 1) / (weight @ (1 - y) + 1)))
    z = np.full(len(y), base)
    feats, ths, leaves = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        g, h = weight * (y - p), weight * p * (1 - p)
        node = np.zeros(len(y), np.int64)
        tf, tc = [], []
        for d in range(DEPTH):
            best = (-1.0, 0, 0)
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                width = len(c) + 1
                key = node * width + binned[:, f]
                gs = np.bincount(key, g, (1 << d) * width).reshape(-1, width).cumsum(1)
                hs = np.bincount(key, h, (1 << d) * width).reshape(-1, width).cumsum(1)
                left, lh = gs[:, :-1], hs[:, :-1]
                gain = (left**2 / (lh + 5) + (gs[:, -1:] - left) ** 2 / (hs[:, -1:] - lh + 5)).sum(0)
                b = int(gain.argmax())
                if gain[b] > best[0]:
                    best = (float(gain[b]), f, b)
            _, f, b = best
            tf.append(f)
            tc.append(cuts[f][b] if len(cuts[f]) else np.inf)
            node |= (binned[:, f] > b).astype(np.int64) << d
        v = RATE * np.bincount(node, g, 1 << DEPTH) / (np.bincount(node, h, 1 << DEPTH) + 5)
        feats.append(tf)
        ths.append(tc)
        leaves.append(v)
        z += v[node]
    return Boosted(base, np.array(feats), np.array(ths), np.array(leaves))


def decode(nodes: list[list], p: np.ndarray) -> list[int]:
    """The text nodes to keep: the best labelling in which a kept or dropped element is so with all below it.

    An element may also be mixed, at an even chance for itself; then its children choose.
    """
    n = len(nodes)
    yes, no = np.log(np.clip(p, 1e-4, 1)), np.log(np.clip(1 - p, 1e-4, 1))
    words = np.array([max(1.0, len(x[5]) ** 0.5) if x[5] else 1.0 for x in nodes])
    yes, no = yes * words, no * words
    keep, drop = yes.tolist(), no.tolist()
    mixed = [float(np.log(0.5))] * n
    best = [0.0] * n
    for i in range(n - 1, -1, -1):
        if nodes[i][0] == "#text":
            best[i] = max(keep[i], drop[i])
        else:
            best[i] = max(keep[i], drop[i], mixed[i])
        q = nodes[i][1]
        if q >= 0:
            keep[q] += keep[i]
            drop[q] += drop[i]
            mixed[q] += best[i]
    out, i = [], 0
    while i < n:
        if nodes[i][0] == "#text":
            if keep[i] > drop[i]:
                out.append(i)
            i += 1
        elif best[i] == mixed[i] and mixed[i] > max(keep[i], drop[i]):
            i += 1
        else:
            if keep[i] >= drop[i]:
                out += [j for j in range(i, nodes[i][2]) if nodes[j][0] == "#text"]
            i = nodes[i][2]
    return out


def weak_labels(nodes: list[list]) -> np.ndarray | None:
    """1 for nodes of the main text as the page's own markup tells it, 0 for others; None for a page that does not tell.

    An article's element tells it; on pages without one, attribute tokens of main text.
    """
    says = [x[0] in GOOD_TAGS for x in nodes]
    if not any(says):
        says = [not GOOD.isdisjoint(x[4]) and BAD.isdisjoint(x[4]) for x in nodes]
    if not any(says):
        return None
    inside, y = [False] * len(nodes), np.zeros(len(nodes))
    for i, x in enumerate(nodes):
        up = inside[x[1]] if x[1] >= 0 else False
        inside[i] = (up or says[i]) and x[0] not in BAD_TAGS and (says[i] or BAD.isdisjoint(x[4]))
        y[i] = inside[i]
    return y


def by_marks(nodes: list[list]) -> np.ndarray:
    """Chances where no page of the table told its article: low below elements and attribute tokens of surroundings, high elsewhere."""
    out = np.full(len(nodes), 0.9)
    for i, x in enumerate(nodes):
        if x[0] in BAD_TAGS or not BAD.isdisjoint(x[4]) or (x[1] >= 0 and out[x[1]] < 0.5):
            out[i] = 0.01
    return out


#: Surroundings that the labelled pages are given more of, so that the model has seen each kind.
EXTRAS = (
    '<div class="sidebar"><h3>{w}</h3><ul>{links}</ul></div>', "<aside><h3>{w}</h3><p>{p}</p></aside>", '<div class="cookie-notice"><p>{p}</p><button>OK</button></div>',
    '<div class="comments"><h3>{w}</h3><div class="comment"><p>{p}</p></div><div class="comment"><p>{q}</p></div></div>', '<section id="comments"><p>{p}</p><p>{q}</p></section>',
    '<form action="/s"><label>{w}</label><input><button>{w}</button></form>', "<header><h1>{w}</h1><p>{w}</p></header>", '<div class="newsletter"><p>{p}</p><form><input></form></div>',
    '<div class="advert">{p}</div>', '<div id="related"><ul>{links}</ul></div>', '<div class="share"><a href="#">{w}</a> <a href="#">{w}</a></div>',
)


def varied(html: str, draw: np.random.Generator, prose: list[str]) -> str:
    """A labelled page with extra surroundings before, in and behind the article, and at times plainer markup."""

    def extra():
        w = " ".join(prose[draw.integers(len(prose))].split()[:3])
        links = "".join(f'<li><a href="/{i}">{" ".join(prose[draw.integers(len(prose))].split()[:4])}</a></li>' for i in range(draw.integers(3, 9)))
        p, q = (prose[draw.integers(len(prose))] for _ in range(2))
        return EXTRAS[draw.integers(len(EXTRAS))].replace("{links}", links).replace("{w}", w).replace("{p}", p).replace("{q}", q)

    for mark, after in (("<article>", False), ("</article>", True), ("</article>", False)):
        if draw.random() < 0.6:
            html = html.replace(mark, mark + extra() if after else extra() + mark, 1)
    return html


def training_table(pages: list[str], seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and weights of all nodes; half of the pages lose the marks that gave the labels."""
    draw = np.random.default_rng(seed)
    prose = [t for h in pages for x in parse(h) if len(t := x[5]) > 80] or ["none"]
    xs, ys, ws = [], [], []
    for html in pages:
        for page in (html, varied(html, draw, prose), varied(html, draw, prose)):
            nodes = parse(page)
            y = weak_labels(nodes)
            if y is None:
                continue
            if draw.random() < 0.5:
                for x in nodes:
                    if x[0] in GOOD_TAGS:
                        x[0], x[4] = "div", frozenset(["content"] if draw.random() < 0.5 else [])
                    elif x[0] in BAD_TAGS and draw.random() < 0.5:
                        x[0] = "div"
            xs.append(node_features([nodes]))
            ys.append(y)
            ws.append(np.full(len(y), 1 / len(y) ** 0.5))
    return (np.concatenate(xs), np.concatenate(ys), np.concatenate(ws)) if xs else (np.zeros((0, N_FEATURES)), np.zeros(0), np.zeros(0))


def train(pages: DataFrame, html: str = "html", id_col: str = "page_id") -> Boosted | None:
    """Fit on the TRAIN_PAGES different pages of least hash (of TRAIN_CHARS characters at most) among those whose elements tell the article, or
    if there are none, whose attribute tokens do; None without any. Pages are drawn by id and text, so neither order nor repeated ids matter."""
    raw = F.col(f"`{html}`").cast("string")
    own = pages.select(raw.alias("html"), F.xxhash64(F.lit("html"), F.col(f"`{id_col}`"), raw).alias("draw")).where(F.length("html") <= TRAIN_CHARS)
    tokens = "|".join(sorted(GOOD))
    for told in (r"(?i)<(article|main)[ >]", rf"(?i)(class|id|role)\s*=\s*[\"']?[^\"'>]*\b({tokens})\b"):
        some = own.where(F.col("html").rlike(told))
        draws = [r.draw for r in some.select("draw").distinct().orderBy("draw").limit(TRAIN_PAGES).collect()]  # hashes alone come from every task
        if draws:
            got = some.where(F.col("draw") <= draws[-1]).groupBy("draw").agg(F.min("html").alias("html")).collect()  # as many pages as draws
            x, y, w = training_table(sorted(r.html for r in got))
            if len(y) and 0 < y.mean() < 1:
                return boost(x, y, w)
    return None


def extract(pages: DataFrame, model: Boosted | None, html: str = "html", id_col: str = "page_id") -> DataFrame:
    """Add ``text`` (replacing a column of that name) to the pages' other columns: the kept blocks in page order, joined by two line ends.

    Character references are decoded and white space within a block is one space. Null and empty pages, and pages with no text
    to keep, have an empty text. Without a model (no page to learn from) elements and attribute tokens of surroundings decide.
    """
    from pyspark.sql.types import StringType, StructType

    bounded_batches(pages.sparkSession)
    src = pages.drop("text")
    at = src.columns.index(html)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out, pending, size = [], [], 0

            def settle():
                x = node_features(pending)
                p = model.probability(x) if model else np.concatenate([by_marks(nodes) for nodes in pending])
                a = 0
                for nodes in pending:
                    out.append("\n\n".join(nodes[i][5] for i in decode(nodes, p[a : a + len(nodes)])))
                    a += len(nodes)
                pending.clear()

            for h in batch.column(at):
                pending.append(parse(h.as_py() or ""))
                size += len(pending[-1])
                if size > 20_000:
                    settle()
                    size = 0
            if pending:
                settle()
            cols = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(out, pa.string())], names=[*[f for f in batch.schema.names if f != html], "text"])

    return src.mapInArrow(run, StructType([f for f in src.schema.fields if f.name != html]).add("text", StringType()))
