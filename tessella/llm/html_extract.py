"""Main text of web pages by gradient-boosted trees over DOM nodes (operator 3).

A page becomes a tree of block elements and runs of inline text. Trees boosted in
numpy on generated pages, whose labels are known, give every node a probability of
holding main text from its subtree density, attribute tokens, depth and sibling
statistics. A dynamic program over each page then takes the likeliest labelling in
which a chosen node's ancestors are all chosen, so that no decision contradicts
another.
"""

from __future__ import annotations

import functools
import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import lean

# HTML's element names by their part in layout.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br input picture source ruby rt rp".split())
RAW = set("script style textarea title noscript template iframe xmp noembed noframes select option button svg object math canvas".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "p": {"p"}, "body": {"head"}}
GROUPS = ("text", "p", "h1 h2 h3 h4 h5 h6", "ul ol li dl dt dd menu", "div", "article main", "section", "nav", "header hgroup", "footer", "aside", "form fieldset", "table tbody thead tr td th", "body", "blockquote pre figure figcaption")
BOILER = set("ad ads adv advert advertisement banner bar breadcrumb breadcrumbs byline comment comments consent cookie cookies copyright disqus footer form gdpr header hero links login masthead menu meta modal nav navbar navigation newsletter notice pagination popup promo promoted recommended related reply respond search share sharing sidebar signup social sponsor sponsored subscribe tags toolbar top widget".split())
GOOD = set("article articlebody body content entry main maincontent page post story text".split())
# possessive: a tag that doesn't end is given up after one look at what follows it
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|</?[a-zA-Z][^>]*+\Z""", re.S)
_ATTR = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
_END = {t: re.compile(f"</{t}", re.I) for t in RAW}
_GROUP = {t: i for i, g in enumerate(GROUPS) for t in g.split()}


class Page:
    """Nodes in page order: group, parent, depth, boiler, good, text (runs only), link characters."""

    __slots__ = ("group", "parent", "depth", "boiler", "good", "text", "link")

    def __init__(self, source: str):
        self.group, self.parent, self.depth, self.boiler, self.good, self.text, self.link = [], [], [], [], [], [], []
        self._node(len(GROUPS), -1, 0, 0, 0)
        stack = [("", 0)]
        run: list[str] = []
        link, in_a, head = 0, 0, 0

        def flush() -> None:
            nonlocal link
            if run:
                s = " ".join(html.unescape("".join(run)).split())
                if s and not head:
                    up = stack[-1][1]
                    self._node(0, up, self.depth[up] + 1, 0, 0, s, min(link, len(s)))
                run.clear()
            link = 0

        at, opened = 0, Counter()  # opened: how many of each tag are on the stack
        while True:
            m = _TAG.search(source, at)
            piece = source[at : m.start() if m else len(source)]
            if piece:
                run.append(piece)
                if in_a:
                    link += len(piece)
            if not m:
                break
            at = m.end()
            closing, tag, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not tag:
                continue
            tag = tag.lower()
            if tag in RAW:
                if not closing and not attrs.endswith("/"):
                    end = _END[tag].search(source, at)
                    gt = source.find(">", end.start()) if end else -1
                    at = gt + 1 if gt >= 0 else len(source)
                if tag not in ("option",):
                    run.append(" ")
                continue
            if tag in INLINE:
                if tag == "br":
                    run.append(" ")
                elif tag == "a":
                    in_a = 0 if closing else 1
                continue
            if tag == "html":
                continue
            flush()
            if closing:
                if opened[tag]:  # else nothing to close, and no need to look through the stack
                    in_a = 0
                    while True:
                        last, _ = stack.pop()
                        opened[last] -= 1
                        head -= last == "head"
                        if last == tag:
                            break
                continue
            ends = SAME.get(tag, set()) | ({"p"} if tag in CLOSES_P else set())
            while ends and stack[-1][0] in ends:
                last, _ = stack.pop()
                opened[last] -= 1
                head -= last == "head"
            if tag in VOID:
                continue
            names = set(_WORD.findall(" ".join(a or b or c for a, b, c in _ATTR.findall(attrs)).lower())) if attrs and "=" in attrs else ()
            up = stack[-1][1]
            me = self._node(_GROUP.get(tag, len(GROUPS)), up, self.depth[up] + 1, len(BOILER.intersection(names)), len(GOOD.intersection(names)))
            stack.append((tag, me))
            opened[tag] += 1
            head += tag == "head"
        flush()

    def _node(self, group: int, parent: int, depth: int, boiler: int, good: int, text: str = "", link: int = 0) -> int:
        for column, v in zip((self.group, self.parent, self.depth, self.boiler, self.good, self.text, self.link), (group, parent, depth, boiler, good, text, link), strict=True):
            column.append(v)
        return len(self.group) - 1


NAMES = ("own", "sub", "share", "linked", "density", "children", "runs", "paras", "depth", "place", "sib_at", "sibs", "sib_mean", "sib_ratio", "same", "boiler", "good", "up_boiler", "up_good", "up_bad_tag", "up_article", "stops", "mean_run", "parent_share", "parent_linked")
BAD_TAGS = {_GROUP[t] for t in ("nav", "header", "footer", "aside", "form")}


def features(p: Page) -> np.ndarray:
    n = len(p.group)
    size = np.array([len(t) for t in p.text], np.float64)
    par, group = np.array(p.parent), np.array(p.group)
    sub, link, runs, paras, kids, stops = size.copy(), np.array(p.link, np.float64), (group == 0).astype(float), (group == 1).astype(float), np.zeros(n), np.array([t.count(".") + t.count(",") for t in p.text], np.float64)
    before = np.cumsum(size) - size
    for i in range(n - 1, 0, -1):  # children follow their parents
        u = par[i]
        sub[u] += sub[i]
        link[u] += link[i]
        runs[u] += runs[i]
        paras[u] += paras[i]
        stops[u] += stops[i]
        kids[u] += 1
    up_b, up_g, bad, art = (np.zeros(n) for _ in range(4))
    at, of, same = np.zeros(n), {}, {}
    for i in range(1, n):
        u = par[i]
        up_b[i], up_g[i] = up_b[u] + (p.boiler[u] > 0), up_g[u] + (p.good[u] > 0)
        bad[i], art[i] = bad[u] + (p.group[u] in BAD_TAGS), art[u] + (p.group[u] == 5)
        at[i] = of.get(u, 0)
        of[u] = at[i] + 1
        same[u, p.group[i]] = same.get((u, p.group[i]), 0) + 1
    u = np.maximum(par, 0)
    sibs, total = np.maximum(kids[u], 1), max(1.0, sub[0])
    mean = sub[u] / sibs
    alike = np.array([same.get((par[i], p.group[i]), 1) for i in range(n)], np.float64)
    cols = (np.log1p(size), np.log1p(sub), sub / total, link / np.maximum(sub, 1), np.log1p(sub / (runs + kids + 1)), kids, runs, paras, np.array(p.depth, float), before / total, at, sibs, np.log1p(mean), sub / (mean + 1), alike, np.array(p.boiler, float), np.array(p.good, float), up_b, up_g, bad, art, stops / (sub + 1), np.log1p(sub / np.maximum(runs, 1)), sub[u] / total, link[u] / np.maximum(sub[u], 1))
    return np.column_stack([*cols, *(group == g for g in range(len(GROUPS)))]).astype(np.float32)


class Boosted:
    """Logistic boosting of depth-limited trees on binned features."""

    def __init__(self, trees: int = 40, depth: int = 4, rate: float = 0.3, bins: int = 32, least: float = 1.0):
        self.trees_n, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        qs = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.cuts = [np.unique(np.quantile(x[:, f], qs)) for f in range(x.shape[1])]
        b = self._bin(x)
        n, nf = b.shape
        rate = y.mean()
        self.start = float(np.log(rate / (1 - rate)))
        score, self.trees = np.full(n, self.start), []
        for _ in range(self.trees_n):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            feat, cut = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, self.bins)
            node = np.zeros(n, np.int64)
            for level in range(self.depth):
                width, first = 2**level, 2**level - 1
                idx = ((node - first)[:, None] * nf + np.arange(nf)) * self.bins + b
                hg = np.bincount(idx.ravel(), np.repeat(g, nf), width * nf * self.bins).reshape(width, nf, self.bins).cumsum(2)
                hh = np.bincount(idx.ravel(), np.repeat(h, nf), width * nf * self.bins).reshape(width, nf, self.bins).cumsum(2)
                tg, th = hg[:, :1, -1:], hh[:, :1, -1:]
                gain = hg**2 / (hh + 1) + (tg - hg) ** 2 / (th - hh + 1) - tg**2 / (th + 1)
                gain[(hh < self.least) | (th - hh < self.least)] = 0
                flat = gain.reshape(width, -1)
                best = flat.argmax(1)
                ok = flat[np.arange(width), best] > 1e-6
                feat[first : first + width] = np.where(ok, best // self.bins, 0)
                cut[first : first + width] = np.where(ok, best % self.bins, self.bins)
                node = 2 * node + 1 + (b[np.arange(n), feat[node]] > cut[node])
            leaf = node - (2**self.depth - 1)
            value = self.rate * np.bincount(leaf, g, 2**self.depth) / (np.bincount(leaf, h, 2**self.depth) + 1)
            self.trees.append((feat, cut, value))
            score += value[leaf]
        return self

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(self.cuts)])

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        b, rows = self._bin(x), np.arange(len(x))
        out = np.full(len(x), self.start)
        for feat, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[rows, feat[node]] > cut[node])
            out += value[node - (2**self.depth - 1)]
        return out


def decode(parent: list[int], odds: np.ndarray) -> np.ndarray:
    """The likeliest labels in which a chosen node's parent is chosen too."""
    n = len(parent)
    gain = odds.copy()  # of choosing a node with the best of its subtree; not choosing it gives 0
    for i in range(n - 1, 0, -1):
        if gain[i] > 0:
            gain[parent[i]] += gain[i]
    keep = np.zeros(n, bool)
    keep[0] = True
    for i in range(1, n):
        keep[i] = keep[parent[i]] and gain[i] > 0
    return keep


MARK = "\ue000"


@functools.lru_cache(1)
def _lexicon() -> list[str]:
    r = np.random.default_rng(11)
    letters = np.array(list("aeinorstlhd"))
    return ["".join(letters[r.integers(0, 11, k)]) + end for k, end in zip(r.integers(2, 9, 3000), r.choice(["", ".", ","], 3000, p=[0.87, 0.08, 0.05]), strict=True)]


def sample_page(r: np.random.Generator) -> str:
    """A generated page; every run of main text holds MARK."""
    lexicon = _lexicon()

    def prose(a: int, b: int, main: bool = False) -> str:
        n = int(r.integers(a, b + 1))
        return (MARK if main else "") + " ".join(map(lexicon.__getitem__, r.integers(0, len(lexicon), n).tolist()))

    pick = lambda *x: x[int(r.integers(len(x)))]

    def link_list(a: int, b: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/x">{prose(1, 3)}</a></li>' for _ in range(int(r.integers(a, b)))) + "</ul>"

    def ad() -> str:
        return f'<{(t := pick("div", "div", "aside", "section"))} class="{pick("ad", "ads", "advert", "promo", "sponsored", "banner ad-slot", "widget promo")}">{pick("", "<p>")}{prose(2, 40)}</{t}>'

    def para() -> str:
        k, long = r.random(), r.random() < 0.7
        body = prose(1, 12, True) if not long else prose(12, 160, True)
        if k < 0.7:
            return f"<p>{body}</p>"
        if k < 0.78:
            return f"<p><b>{body}<br>"
        if k < 0.84:
            return f"<h2>{prose(1, 8, True)}</h2>"
        if k < 0.88:
            return f"<blockquote>{body}</blockquote>"
        if k < 0.93:
            return "<ul>" + "".join(f"<li>{prose(2, 20, True)}</li>" for _ in range(int(r.integers(2, 6)))) + "</ul>"
        if k < 0.96:
            return f"<pre>{body}</pre>"
        return "<table><tr>" + "".join(f"<td>{prose(1, 8, True)}</td>" for _ in range(4)) + "</tr></table>"

    def inner() -> str:
        return pick(ad(), f'<div class="{pick("share", "social", "related", "newsletter")}">{link_list(2, 5)}{prose(2, 8)}</div>', f'<form class="subscribe">{prose(3, 12)}<input type="text"></form>', f'<aside><p>{prose(5, 30)}</p></aside>', f'<nav class="breadcrumb"><a href="/">{prose(1, 2)}</a></nav>', f'<div class="notice">{prose(3, 20)}</div>')

    parts = []
    for _ in range(int(r.integers(0, 14))):
        parts.append(para())
        if r.random() < 0.06:
            parts.append(inner())
    title = pick(f"<h1>{prose(2, 12, True)}</h1>", f"<header><h1>{prose(2, 12, True)}</h1></header>") if r.random() < 0.85 or not parts else ""
    tag, attr = [("article", ""), ("main", ""), ("div", ' class="content"'), ("div", ' id="main-content"'), ("div", ' class="post entry"'), ("section", ' class="article-body"'), ("div", ""), ("article", ' class="post"')][int(r.integers(8))]
    main = f"<{tag}{attr}>{title}{''.join(parts)}</{tag}>"
    head = [pick(f"<nav>{link_list(3, 9)}</nav>", f'<div id="menu">{link_list(3, 9)}</div>', f'<ul class="navbar">{link_list(2, 7)[4:]}', "")]
    if r.random() < 0.4:
        head.insert(int(r.integers(2)), pick(f"<header><p>{prose(1, 8)}</p>{link_list(1, 4)}</header>", f'<div class="header masthead">{prose(1, 10)}</div>'))
    for _ in range(int(r.integers(0, 3))):
        head.append(pick(ad(), ad(), f'<div class="{pick("cookie-notice", "consent", "notice", "gdpr popup")}"><p>{prose(5, 40)}</p></div>'))
    tail = []
    if r.random() < 0.4:
        c = "".join(f'<div class="comment"><p>{prose(3, 60)}</p></div>' for _ in range(int(r.integers(1, 7))))
        tail.append(pick(f'<section id="comments"><h2>{prose(1, 3)}</h2>{c}</section>', f'<div class="comments">{c}</div>', f'<ol class="comment-list"><li>{prose(5, 50)}</li></ol>'))
    if r.random() < 0.4:
        side = pick(f'<aside class="sidebar">{link_list(2, 8)}<p>{prose(3, 40)}</p></aside>', f'<div id="sidebar"><h3>{prose(1, 3)}</h3>{link_list(2, 8)}</div>', f"<aside><p>{prose(5, 60)}</p></aside>")
        (head if r.random() < 0.5 else tail).append(side)
    if r.random() < 0.25:
        tail.append(f'<form action="/s"><p>{prose(2, 15)}</p><label>{prose(1, 3)}</label></form>')
    tail.append(pick(f"<footer>{prose(2, 25)}</footer>", f'<div class="footer"><p>{prose(2, 25)}</p>{link_list(1, 5)}</div>', f"<footer><p>{prose(2, 15)}</p>{link_list(1, 4)}</footer>", ""))
    body = "".join(head) + main + "".join(tail)
    for _ in range(int(r.integers(0, 3))):
        body = f"<div>{body}</div>" if r.random() < 0.5 else f'<div class="{pick("wrapper", "page", "container", "site")}">{body}</div>'
    page = f"<html><head><title>{prose(2, 8)}</title></head><body>{body}</body></html>"
    return page if r.random() < 0.85 else page[: int(len(page) * r.uniform(0.3, 1))]


@functools.lru_cache(2)
def main_text_model(pages: int = 900, seed: int = 3) -> Boosted:
    """Fitted on generated pages; their number is fixed and no table is read."""
    r = np.random.default_rng(seed)
    x, y = [], []
    for _ in range(pages):
        p = Page(sample_page(r))
        main = np.array([MARK in t for t in p.text], float)
        for i in range(len(p.parent) - 1, 0, -1):
            main[p.parent[i]] = max(main[p.parent[i]], main[i])
        x.append(features(p)[1:])
        y.append(main[1:])
    return Boosted().fit(np.concatenate(x), np.concatenate(y))


def main_texts(sources: list[str], model: Boosted) -> list[str]:
    pages = [Page(s) for s in sources]
    odds = model.log_odds(np.concatenate([features(p) for p in pages]))
    out, at = [], 0
    for p in pages:
        keep = decode(p.parent, odds[at : at + len(p.parent)])
        at += len(p.parent)
        out.append(" ".join(t for t, k in zip(p.text, keep, strict=True) if t and k))
    return out


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: Boosted | None = None) -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points).

    A null html counts as empty; a page without main text has the empty text. Cut
    tags, comments and entities at the end of a truncated page are tolerated. White
    space is Unicode's. Rows are independent: repeated rows give equal rows, an
    empty table none, other columns are not read.
    """
    model = model or main_text_model()

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sources, texts, some, held = b["html"].to_pylist(), [], [], 0
            for s in sources:
                some.append(s)
                held += len(s)
                if held > 1 << 21:
                    texts += main_texts(some, model)
                    some, held = [], 0
            if some:
                texts += main_texts(some, model)
            yield pa.RecordBatch.from_arrays([b["page_id"], b["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    d = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    return d.mapInArrow(run, "page_id long, url string, text string, n_chars long")
