"""Main text of web pages by belief propagation over the DOM tree.

Every block element is a binary variable (content or not). Its features give a unary potential, each parent-child edge a
potential for the pair of states. Sum-product messages pass upward and downward once, which on a tree gives the exact
marginals. Weights are trained in numpy by the likelihood gradient (observed minus expected features) on labelled pages.
Text runs of elements with a content marginal of at least one half are joined in page order.

Labelled pages come from html_pages.labelled_pages(): layouts with every kind of boilerplate, with and without the
semantic elements, so that names, places, links and text shape all carry weight.

Edge cases: null, empty and broken pages give an empty text or what can be read; scripts, styles, comments and templates
never count, elements that readers do not see are one kind of boilerplate; long and deep pages cost time in proportion; repeated rows give repeated results; an empty table
gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from .common import map_batches
from .html_tree import Page, read

TAGS = ("article", "main", "section", "nav", "header", "footer", "aside", "div", "p", "h1", "h2", "h3", "ul", "ol", "li", "table", "td", "tr", "blockquote", "pre", "form", "button", "label", "figure", "figcaption", "body", "html", "#root", "dialog", "details")
_TAG = {t: i for i, t in enumerate(TAGS)}
#: Words in class, id or role, by what they say about an element.
WORDS = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs crumbs tabs pager pagination toc skip links topbar toolbar sitemap",
    "edge": "header masthead footer foot colophon copyright legal banner contentinfo top bottom site logo brand",
    "side": "sidebar side aside rail widget widgets complementary secondary column related recommended recommendations popular trending more tags teaser teasers",
    "advert": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted dfp adsense commercial partner",
    "notice": "cookie cookies consent gdpr notice notices alert alertdialog warning popup modal overlay dialog banner toast disclaimer paywall message",
    "form": "form forms login signup signin register newsletter subscribe subscription search searchbox searchform contact captcha",
    "comment": "comment comments reply replies respond discussion disqus thread feedback reaction reactions commentlist reviews",
    "share": "share sharing social follow like likes print email toolbox buttons meta byline author",
    "body": "article content contents main post posts entry story text body page maintext articlebody copy prose paragraph lead",
    "hidden": "hidden none sr-only visually-hidden screen-reader-text invisible collapsed",
}
_WORD = {w: i for i, words in enumerate(WORDS.values()) for w in words.split()}
SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
FEATURES = len(TAGS) + 1 + 2 * len(WORDS) + 12


def features(page: Page) -> np.ndarray:
    """One row of features per node: tag, words of its own and of its nearest ancestors, text and link measures."""
    n = len(page.parent)
    out = np.zeros((n, FEATURES))
    own, linked, stops, runs = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    for node, text, is_link in page.runs:
        own[node] += len(text)
        linked[node] += len(text) * is_link
        stops[node] += text.count(".") + text.count(",")
        runs[node] += 1
    total, total_linked, size = own.copy(), linked.copy(), np.ones(n)
    parent = page.parent
    for i in range(n - 1, 0, -1):
        p = parent[i]
        total[p] += total[i]
        total_linked[p] += total_linked[i]
        size[p] += size[i]
    base = len(TAGS) + 1
    depth = np.zeros(n)
    for i in range(n):
        out[i, _TAG.get(page.tag[i], len(TAGS))] = 1
        for word in SPLIT.split(page.marks[i]) if page.marks[i] else ():
            if word in _WORD:
                out[i, base + _WORD[word]] = 1
        if i:
            depth[i] = depth[parent[i]] + 1
            above = base + len(WORDS)
            out[i, above : above + len(WORDS)] = np.maximum(out[parent[i], base : base + len(WORDS)], 0.7 * out[parent[i], above : above + len(WORDS)])
    rest = out[:, base + 2 * len(WORDS) :]
    rest[:, 0] = 1
    rest[:, 1] = np.log1p(own) / 6
    rest[:, 2] = np.log1p(total) / 6
    rest[:, 3] = linked / np.maximum(own, 1)
    rest[:, 4] = total_linked / np.maximum(total, 1)
    rest[:, 5] = np.minimum(1, 20 * stops / np.maximum(own, 20))
    rest[:, 6] = own > 200
    rest[:, 7] = (own > 0) & (own < 40)
    rest[:, 8] = np.minimum(depth, 12) / 12
    rest[:, 9] = own == 0
    rest[:, 10] = np.minimum(1, runs / 5)
    rest[:, 11] = total / max(total[0], 1)
    return out


def levels_of(parent: np.ndarray) -> list[np.ndarray]:
    """Node numbers by depth; parents come before their children in the numbering."""
    depth = np.zeros(len(parent), dtype=np.int64)
    for i, p in enumerate(parent.tolist()):
        if p >= 0:
            depth[i] = depth[p] + 1
    order = np.argsort(depth, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    return np.logaddexp.reduce(x, axis=axis)


def sum_product(unary: np.ndarray, pair: np.ndarray, parent: np.ndarray, levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Exact marginals of a forest: (nodes x 2) log-marginals of the nodes and (nodes x 2 x 2) of (parent, child) edges.

    unary: log-potentials (nodes x 2), pair: log-potentials (2 x 2) of parent state and child state.
    """
    below, up = unary.copy(), np.zeros_like(unary)
    for level in levels[:0:-1]:
        up[level] = _lse(pair[None] + below[level][:, None, :], axis=2)
        np.add.at(below, parent[level], up[level])
    down = np.zeros_like(unary)
    for level in levels[1:]:
        p = parent[level]
        rest = below[p] + down[p] - up[level]
        down[level] = _lse(rest[:, :, None] + pair[None], axis=1)
    node = below + down
    node -= _lse(node, axis=1)[:, None]
    edge = np.full((len(unary), 2, 2), -np.inf)
    for level in levels[1:]:
        p = parent[level]
        rest = below[p] + down[p] - up[level]
        e = rest[:, :, None] + pair[None] + below[level][:, None, :]
        edge[level] = e - _lse(e.reshape(len(e), 4), axis=1)[:, None, None]
    return node, edge


@dataclass
class Forest:
    """Several pages as one forest."""

    parent: np.ndarray
    levels: list[np.ndarray]
    x: np.ndarray
    starts: np.ndarray

    @staticmethod
    def of(pages: list[Page]) -> Forest:
        starts = np.cumsum([0, *[len(p.parent) for p in pages]])
        parent = np.concatenate([np.where(np.array(p.parent) < 0, -1, np.array(p.parent) + s) for p, s in zip(pages, starts, strict=False)])
        return Forest(parent, levels_of(parent), np.concatenate([features(p) for p in pages]), starts)


@dataclass
class Model:
    weights: np.ndarray
    pair: np.ndarray

    def marginals(self, forest: Forest) -> np.ndarray:
        score = forest.x @ self.weights
        node, _ = sum_product(np.column_stack([np.zeros(len(score)), score]), self.pair, forest.parent, forest.levels)
        return np.exp(node[:, 1])

    @staticmethod
    def train(pages: list[Page], labels: list[list[int]], epochs: int = 300, rate: float = 0.1, decay: float = 2e-4) -> Model:
        forest, y = Forest.of(pages), np.concatenate([np.array(v) for v in labels])
        model = Model(np.zeros(FEATURES), np.zeros((2, 2)))
        child = np.flatnonzero(forest.parent >= 0)
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[forest.parent[child]], y[child]), 1)
        moments = [(np.zeros(FEATURES), np.zeros(FEATURES)), (np.zeros((2, 2)), np.zeros((2, 2)))]
        for t in range(1, epochs + 1):
            score = forest.x @ model.weights
            node, edge = sum_product(np.column_stack([np.zeros(len(score)), score]), model.pair, forest.parent, forest.levels)
            grads = (forest.x.T @ (y - np.exp(node[:, 1])) / len(y), (seen - np.exp(edge[child]).sum(axis=0)) / len(y))
            for p, g, (m, v) in zip((model.weights, model.pair), grads, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p += rate * ((m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8) - decay * p)
        return model


def texts_of(pages: list[Page], model: Model) -> list[str]:
    if not pages:
        return []
    forest = Forest.of(pages)
    chosen = model.marginals(forest) >= 0.5
    return [" ".join(text for node, text, _ in p.runs if chosen[s + node]) for p, s in zip(pages, forest.starts, strict=False)]


def fit() -> Model:
    from .html_pages import labelled_pages

    pages, labels = labelled_pages()
    return Model.train(pages, labels)


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text of every page; text is empty where no element is content."""
    model = pages.sparkSession.sparkContext.broadcast(fit())

    def run(rows: dict[str, list]) -> dict[str, list]:
        out = []
        for at in range(0, len(rows["html"]), 32):
            out += texts_of([read(h) for h in rows["html"][at : at + 32]], model.value)
        return {"page_id": rows["page_id"], "url": rows["url"], "text": out}

    return map_batches(pages.select("page_id", "url", "html"), run, "page_id long, url string, text string")
