"""Language identification with a byte convolutional network, trained in numpy.

Bytes (A-Z lower-cased) of fixed-length windows are embedded, filters of several widths run over them, each filter's
largest response is kept and a softmax layer gives the languages. A whole text is cut into overlapping windows, so that
every byte run of the widest filter lies in some window; the windows' logits are averaged.

Scoring evaluates the same convolution through tables: embedding and filter weights of two neighbouring bytes are
multiplied out beforehand, so a position costs two look-ups.

Edge cases: null texts and texts without a letter are `und` with score 0; short texts are one padded window; without
labelled rows everything is `und`; repeated rows give repeated results; an empty table gives an empty table; extra
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, id_crc32, map_batches, one_text_each, removed, stored, whole_rows

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 8
EMBED = 6

#: Labelled documents learned from (the smallest by a hash of the id), and windows of all of them together: documents are
#: taken whole, in that order, up to this many.
LABELLED = 4_000
TRAINING_WINDOWS = 24_000
EPOCHS = 8

LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"


def windows(data: bytes) -> np.ndarray:
    """All windows of data as rows of bytes, overlapping by the widest filter less one; the last one is padded with 0."""
    step = WINDOW - max(WIDTHS) + 1
    n = max(1, -(-(len(data) - max(WIDTHS) + 1) // step))
    padded = np.zeros((n - 1) * step + WINDOW, dtype=np.uint8)
    padded[: len(data)] = np.frombuffer(data, dtype=np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::step]


@dataclass
class Network:
    names: list[str]
    embed: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @staticmethod
    def fresh(names: list[str], seed: int = 3) -> Network:
        rng = np.random.default_rng(seed)
        filters = [rng.normal(0, (2 / (w * EMBED)) ** 0.5, (w * EMBED, FILTERS)) for w in WIDTHS]
        kept = FILTERS * len(WIDTHS)
        return Network(names, rng.normal(0, 0.5, (256, EMBED)), filters, np.zeros(kept), rng.normal(0, kept**-0.5, (kept, len(names))), np.zeros(len(names)))

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, *self.filters, self.bias, self.out, self.out_bias]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Cross-entropy of windows x with classes y, and its gradients in the order of parameters()."""
        n = len(x)
        z = self.embed[x]
        pooled, where = [], []
        for w, f in zip(WIDTHS, self.filters, strict=True):
            patches = np.lib.stride_tricks.sliding_window_view(z, (w, EMBED), axis=(1, 2)).reshape(n, WINDOW - w + 1, w * EMBED)
            response = patches @ f
            where.append(response.argmax(axis=1))
            pooled.append(response.max(axis=1))
        before = np.concatenate(pooled, axis=1) + self.bias
        hidden = np.maximum(before, 0)
        logits = hidden @ self.out + self.out_bias
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        loss = float(-np.log(np.maximum(p[np.arange(n), y], 1e-12)).mean())
        d = p
        d[np.arange(n), y] -= 1
        d /= n
        d_hidden = (d @ self.out.T) * (before > 0)
        d_embed, d_filters = np.zeros_like(self.embed), []
        rows = np.arange(n)[:, None]
        for k, (w, f) in enumerate(zip(WIDTHS, self.filters, strict=True)):
            g = d_hidden[:, k * FILTERS : (k + 1) * FILTERS]
            at = where[k][:, :, None] + np.arange(w)  # window, filter, offset
            at_bytes = x[rows[:, :, None], at]
            d_filters.append(np.einsum("nf,nfwe->wef", g, self.embed[at_bytes]).reshape(w * EMBED, FILTERS))
            np.add.at(d_embed, at_bytes, np.einsum("nf,wef->nfwe", g, f.reshape(w, EMBED, FILTERS)))
        return loss, [d_embed, *d_filters, d_hidden.sum(axis=0), hidden.T @ d, d.sum(axis=0)]

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, batch: int = 64, rate: float = 5e-3, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        first, second, t = [np.zeros_like(p) for p in self.parameters()], [np.zeros_like(p) for p in self.parameters()], 0
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                own = order[at : at + batch]
                _, grads = self.gradients(x[own], y[own])
                t += 1
                for p, g, m, v in zip(self.parameters(), grads, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= rate * (1 - epoch / epochs) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Responses of all filters to bytes (0, 1) and to bytes (2, 3) of a patch, by byte pair."""
        one = []
        for offset in range(4):
            parts = [self.embed @ f[offset * EMBED : (offset + 1) * EMBED] if offset < w else np.zeros((256, FILTERS)) for w, f in zip(WIDTHS, self.filters, strict=True)]
            one.append(np.concatenate(parts, axis=1))
        pair = [(a[:, None, :] + b[None, :, :]).reshape(65536, -1).astype(np.float32) for a, b in (one[:2], one[2:])]
        return pair[0] + self.bias.astype(np.float32), pair[1]

    def logits(self, x: np.ndarray, tables: tuple[np.ndarray, np.ndarray], step: int = 64) -> np.ndarray:
        """Logits of windows x. A filter narrower than the widest also runs over the last positions, as in training."""
        low, high = tables
        out = np.empty((len(x), len(self.names)))
        for at in range(0, len(x), step):
            part = x[at : at + step].astype(np.int32)
            pairs = (part[:, :-1] << 8) | part[:, 1:]
            response = np.take(low, pairs[:, :-2], axis=0)
            response += np.take(high, pairs[:, 2:], axis=0)
            best = response.max(axis=1)
            for w in range(2, 4):  # positions that only narrower filters reach
                k = WIDTHS.index(w)
                own = slice(k * FILTERS, (k + 1) * FILTERS)
                for p in range(WINDOW - 3, WINDOW - w + 1):
                    tail = low[pairs[:, p], own] if w == 2 else low[pairs[:, p], own] + high[part[:, p + 2] << 8, own]
                    best[:, own] = np.maximum(best[:, own], tail)
            out[at : at + step] = np.maximum(best, 0) @ self.out + self.out_bias
        return out


def training_windows(docs: DataFrame, limit: int, most: int) -> tuple[np.ndarray, list[str]]:
    """All windows of at most `limit` labelled documents that are not held out, taken whole until they have `most` windows.

    A document that has more windows by itself is not among the labelled rows learned from.
    """
    rows = docs.where((id_crc32("doc_id") % 5 != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    chosen = rows.select("doc_id", "lang").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "lang").limit(limit)

    def run(part: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"lang": [], "windows": []}
        for lang, text in zip(part["lang"], part["text"], strict=True):
            if LETTER.search(text):
                out["lang"].append(lang)
                out["windows"].append(windows(text.encode().translate(LOWER)).tobytes())
        return out

    sample = stored(one_text_each(rows.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"]), "doc_id", "lang"))
    size = F.greatest(F.lit(1), F.ceil((F.octet_length("text") - max(WIDTHS) + 1) / (WINDOW - max(WIDTHS) + 1)))
    order = F.xxhash64("doc_id"), "doc_id", "lang"
    sizes = sample.select(F.struct("doc_id", "lang"), size).orderBy(*order).collect()
    taken = docs.sparkSession.createDataFrame(whole_rows([((r[0][0], r[0][1]), r[1]) for r in sizes], most), "doc_id long, lang string")
    learned = sample.join(F.broadcast(taken), ["doc_id", "lang"])
    got = map_batches(learned.select("lang", "text"), run, "lang string, windows binary").collect()
    removed(sample)
    each = sorted((r["lang"], bytes(r["windows"][at : at + WINDOW])) for r in got for at in range(0, len(r["windows"]), WINDOW))
    x = np.frombuffer(b"".join(w for _, w in each), dtype=np.uint8).reshape(-1, WINDOW)
    return x, [lang for lang, _ in each]


def fit(docs: DataFrame, limit: int = LABELLED, most: int = TRAINING_WINDOWS) -> Network | None:
    x, langs = training_windows(docs, limit, most)
    if not langs:
        return None
    names = sorted(set(langs))
    network = Network.fresh(names)
    network.train(x, np.array([names.index(v) for v in langs]))
    return network


def predict(texts: list[str | None], network: Network | None, tables: tuple[np.ndarray, np.ndarray] | None) -> tuple[list[str], list[float]]:
    langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if network is None:
        return langs, scores
    for i, text in enumerate(texts):
        if text is None or not LETTER.search(text):
            continue
        data, total, n = text.encode().translate(LOWER), np.zeros(len(network.names)), 0
        step = (WINDOW - max(WIDTHS) + 1) * 4096
        for at in range(0, max(1, len(data) - max(WIDTHS) + 1), step):  # a long text goes in pieces
            part = network.logits(windows(data[at : at + step + max(WIDTHS) - 1]), tables)
            total, n = total + part.sum(axis=0), n + len(part)
        mean = total / n
        p = np.exp(mean - mean.max())
        best = int(p.argmax())
        langs[i], scores[i] = network.names[best], float(p[best] / p.sum())
    return langs, scores


def identify(docs: DataFrame, limit: int = LABELLED) -> DataFrame:
    """doc_id, lang_pred, score of every document; learns from the documents' own lang column, held-out ids left out."""
    network = fit(docs, limit)
    shared = docs.sparkSession.sparkContext.broadcast((network, network.tables() if network else None))

    def run(rows: dict[str, list]) -> dict[str, list]:
        langs, scores = predict(rows["text"], *shared.value)
        return {"doc_id": rows["doc_id"], "lang_pred": langs, "score": scores}

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, lang_pred string, score double")
