"""Quality classifier: attention-based multiple-instance learning in numpy.

A document is a bag of passages (runs of PASSAGE bytes, all of the text). A passage is encoded by its frequencies of
neighbouring byte classes and by its share of different byte runs, through a learned dense layer. Gated attention
a = softmax(w . (tanh(V h) * sigmoid(U h))) weighs the passages, and the weighted sum of their encodings is scored.
Only document labels are learned from; the attention finds the passages that matter.

Edge cases: null and empty texts are one empty passage; a label repeated for an id counts once; without labelled rows
the score is 0.5; repeated rows give repeated results; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_crc32, labelled, map_batches, one_text_each, removed, stored, whole_rows

PASSAGE = 1024
RUN = 8
HIDDEN = 16
GATES = 8

#: Labelled documents learned from (the smallest by a hash of the id).
LABELLED = 3_000
#: Passages of all of them together, at about 1 KB each: labelled documents are taken whole, in that order, up to this many.
TRAINING_PASSAGES = 64_000
EPOCHS = 150


def _classes() -> np.ndarray:
    """16 byte classes: 0 space, 1 line end, 2-4 small letters, 5 capitals, 6 digits, 7-12 punctuation, 13-14 UTF-8, 15 other."""
    out = np.full(256, 15, dtype=np.uint8)
    groups = [b" ", b"\n\r", b"aeiou", b"bcdfghjklm", b"npqrstvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".!?", b",;:", b"|", b"#*$%&<>", b"\"'()[]{}", b"-_+=/\\@~^`"]
    for k, group in enumerate(groups):
        out[list(group)] = k
    out[128:192], out[192:] = 13, 14
    return out


CLASS = _classes()
WIDTH = 256 + 2


def passages(text: str | None) -> np.ndarray:
    """Features (passages x WIDTH, float32) of a whole text."""
    data = np.frombuffer((text or "").encode(), dtype=np.uint8)
    n = max(1, -(-len(data) // PASSAGE))
    out = np.zeros((n, WIDTH), dtype=np.float32)
    if len(data) > 1:
        c = CLASS[data].astype(np.int64)
        of = np.arange(len(data) - 1) // PASSAGE
        counts = np.bincount(of * 256 + c[:-1] * 16 + c[1:], minlength=n * 256).reshape(n, 256)
        out[:, :256] = np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))
    if len(data) >= RUN:
        runs = np.lib.stride_tricks.sliding_window_view(data, RUN)
        key = np.ascontiguousarray(runs).view(np.uint64).ravel()
        for i in range(n):
            own = key[i * PASSAGE : (i + 1) * PASSAGE]
            if len(own):
                out[i, 256] = 1 - len(np.unique(own)) / len(own)
    out[:, 257] = 1.0
    out[-1, 257] = (len(data) - (n - 1) * PASSAGE) / PASSAGE
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray
    v: np.ndarray
    u: np.ndarray
    w: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @staticmethod
    def fresh(mean: np.ndarray, scale: np.ndarray, seed: int = 11) -> Model:
        r = np.random.default_rng(seed)
        return Model(mean, scale, r.normal(0, WIDTH**-0.5, (WIDTH, HIDDEN)), np.zeros(HIDDEN), r.normal(0, HIDDEN**-0.5, (HIDDEN, GATES)), r.normal(0, HIDDEN**-0.5, (HIDDEN, GATES)), r.normal(0, 0.1, GATES), r.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1))

    def parameters(self) -> list[np.ndarray]:
        return [self.dense, self.dense_bias, self.v, self.u, self.w, self.out, self.out_bias]

    def forward(self, x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        """x: passages of all bags one after another, starts: where each bag begins."""
        s = (x - self.mean) / self.scale
        h = np.tanh(s @ self.dense + self.dense_bias)
        t, g = np.tanh(h @ self.v), _sigmoid(h @ self.u)
        e = (t * g) @ self.w
        bag = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(x))))
        a = np.exp(e - np.maximum.reduceat(e, starts)[bag])
        a /= np.add.reduceat(a, starts)[bag]
        z = np.add.reduceat(a[:, None] * h, starts)
        return {"s": s, "h": h, "t": t, "g": g, "bag": bag, "a": a, "z": z, "p": _sigmoid(z @ self.out + self.out_bias)}

    def gradients(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        f = self.forward(x, starts)
        h, t, g, a, bag = f["h"], f["t"], f["g"], f["a"], f["bag"]
        d = (f["p"] - y) * weight / weight.sum()
        d_z = d[:, None] * self.out
        d_h = a[:, None] * d_z[bag]
        d_a = (h * d_z[bag]).sum(axis=1)
        d_e = a * (d_a - np.add.reduceat(a * d_a, starts)[bag])
        d_t, d_g = d_e[:, None] * self.w * g * (1 - t * t), d_e[:, None] * self.w * t * g * (1 - g)
        d_h += d_t @ self.v.T + d_g @ self.u.T
        d_s = d_h * (1 - h * h)
        return [f["s"].T @ d_s, d_s.sum(axis=0), h.T @ d_t, h.T @ d_g, (t * g).T @ d_e, f["z"].T @ d, np.array([d.sum()])]

    def train(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.02, decay: float = 1e-3) -> None:
        share = np.clip(y.mean(), 0.02, 0.98)
        weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))
        first, second = [np.zeros_like(p) for p in self.parameters()], [np.zeros_like(p) for p in self.parameters()]
        for t in range(1, epochs + 1):
            for p, g, m, v in zip(self.parameters(), self.gradients(x, starts, y, weight), first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * ((m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8) + decay * p)


def fit(docs: DataFrame, labels: DataFrame, limit: int = LABELLED, most: int = TRAINING_PASSAGES) -> Model | None:
    """The model from at most `limit` labelled documents that are not held out, taken whole until they have `most` passages.

    A document that has more passages by itself is not among the labelled rows learned from. None without such rows.
    """
    chosen = labelled(labels, "quality", limit, id_crc32("doc_id") % 3 != 1)
    sample = stored(one_text_each(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "doc_id", "y"))
    size = F.greatest(F.lit(1), F.ceil(F.octet_length(F.coalesce("text", F.lit(""))) / PASSAGE))
    sizes = sample.select("doc_id", size.alias("size")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    taken = whole_rows(sizes, most)

    def run(rows: dict[str, list]) -> dict[str, list]:
        return {"doc_id": rows["doc_id"], "y": rows["y"], "bag": [passages(t).tobytes() for t in rows["text"]]}

    learned = sample.where(F.col("doc_id").isin(taken)).select("doc_id", "text", "y")
    got = map_batches(learned, run, "doc_id long, y int, bag binary").orderBy("doc_id").collect()
    removed(sample)
    if not got:
        return None
    bags = [np.frombuffer(r["bag"], dtype=np.float32).reshape(-1, WIDTH) for r in got]
    x = np.concatenate(bags)
    starts = np.cumsum([0, *[len(b) for b in bags[:-1]]])
    model = Model.fresh(x.mean(axis=0), np.maximum(x.std(axis=0), 0.02))
    model.train(x, starts, np.array([float(r["y"]) for r in got]))
    return model


def score(texts: list[str | None], model: Model | None) -> list[float]:
    if model is None or not texts:
        return [0.5] * len(texts)
    bags = [passages(t) for t in texts]
    return model.forward(np.concatenate(bags), np.cumsum([0, *[len(b) for b in bags[:-1]]]))["p"].tolist()


def quality(docs: DataFrame, labels: DataFrame, limit: int = LABELLED) -> DataFrame:
    """doc_id, score (0 to 1, higher: better) of every document."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, limit))

    def run(rows: dict[str, list]) -> dict[str, list]:
        return {"doc_id": rows["doc_id"], "score": score(rows["text"], model.value)}

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, score double")
