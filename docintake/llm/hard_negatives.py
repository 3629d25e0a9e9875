"""Hard-negative mining by a secondary-sort shuffle.

For each anchor the rows of its own label that score highest are its positives; a positive's negatives are rows of other
labels whose score lies in a window below the positive's. Scores are integer inner products of quantised vectors.

A pair's anchor, descending score, kind and id are packed into one key of bytes whose order is the order wanted.
repartitionAndSortWithinPartitions brings the keys of an anchor together in that order, and an iterator walks them: a
positive opens its window, a negative goes to the open windows that hold it, a full window closes. It keeps the open
windows of one anchor, never the anchor's rows.

Two such shuffles answer a block of anchors. The first ranks the rows of the anchors' labels; its first few are the positives.
The second has these and the negatives. Before each, a task keeps of its own rows only what can still be among the first
few of a list of positives or of a window (a combiner: what it leaves out is beaten by enough rows of the same task), so
what is shuffled is a few keys for each anchor and task, whatever the number of rows, and no label, however frequent,
meets in one task. Anchors are the stated query set; in blocks of about BLOCK they go to all rows, one after another.

Edge cases: rows with a null id, label or vector, or with a null or non-finite component take no part. Shorter vectors
count as padded with zeros. Ties are ordered by id; rows of one id that score alike for an anchor count once, and an
anchor never meets a row of its own id; anchors of one id that differ in label or vector are answered each by itself. A window is empty where the positive's score is below
zero. Scores are exact as long as they fit into 64 bits. Columns other than the three are not read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, removed, stored

#: Anchors of one block; a block and its windows are broadcast (256 bytes and 5 windows of 16 bytes an anchor at 64 dimensions).
BLOCK = 65_536
#: Pairs scored at once in a task.
AT_ONCE = 2_000_000
#: anchor number, descending score, kind (positives first), id; each unsigned and big-endian, so that bytes sort as the values do.
KEY = struct.Struct(">QQBQ")
HALF, POSITIVE, NEGATIVE = 1 << 63, 0, 1
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


@dataclass(frozen=True)
class Window:
    """Negatives with low * positive <= 100 * negative <= high * positive, of which the first `negatives` are kept."""

    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95

    def __post_init__(self) -> None:
        if not 0 <= self.low <= self.high <= 100:
            raise ValueError("a window lies between 0 and 100 per cent of the positive's score")

    def bounds(self, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest score inside, for scores of positives; parts of a hundred by themselves, so that nothing overflows."""
        whole, part = score // 100, score % 100
        return self.low * whole - (-self.low * part) // 100, self.high * whole + self.high * part // 100


def pack(anchor: int, score: int, kind: int, vec_id: int) -> bytes:
    return KEY.pack(anchor, HALF - 1 - score, kind, vec_id + HALF)


def unpack(key: bytes) -> tuple[int, int, int, int]:
    anchor, score, kind, vec_id = KEY.unpack(key)
    return anchor, HALF - 1 - score, kind, vec_id - HALF


def quantised(vectors: Iterable, scale: float) -> np.ndarray:
    """Rows of floor(scale * x), shorter ones padded with zeros."""
    rows = [np.asarray(v, dtype=np.float64) for v in vectors]
    out = np.zeros((len(rows), max([0, *map(len, rows)])))
    for i, v in enumerate(rows):
        out[i, : len(v)] = np.floor(scale * v)
    return out


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of a with all rows of b; in floating point where no partial sum can lose a bit."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    bound = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(width, 1)
    if bound < 1 << 24:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if bound < 1 << 53:
        return (a @ b.T).astype(np.int64)
    whole = lambda x: np.array([[int(c) for c in row] for row in x], dtype=object).reshape(x.shape)
    return np.clip(whole(a) @ whole(b).T, -HALF, HALF - 1).astype(np.int64) if width else np.zeros((len(a), len(b)), np.int64)


class Anchors:
    """One block: numbers, ids, labels, quantised vectors, and for the second round the windows."""

    def __init__(self, ids: Iterable[int], labels: Iterable[int], vectors: np.ndarray):
        self.ids, self.labels, self.vectors = np.array(ids, np.int64), np.array(labels, np.int64), vectors
        self.low = self.high = None

    def open(self, positives: dict[int, list[int]], window: Window) -> None:
        """Windows of the positives' scores; those that there are not hold nothing."""
        found = np.full((len(self.ids), window.positives), -1, np.int64)
        for number, each in positives.items():
            found[number, : len(each)] = np.maximum(each, -1)
        self.low, self.high = window.bounds(found)
        self.low[found < 0], self.high[found < 0] = 1, 0


class Best:
    """For each line of a table the first `most` (score, id) seen, best first."""

    def __init__(self, lines: int, most: int):
        self.score, self.id = np.zeros((lines, most), np.int64), np.zeros((lines, most), np.int64)
        self.held = np.zeros((lines, most), bool)

    def add(self, at: int, score: np.ndarray, ids: np.ndarray, fits: np.ndarray) -> None:
        """Lines at, at + 1, ...: the columns of `score` that fit; ids ascend from left to right, each once."""
        most = self.score.shape[1]
        lines = slice(at, at + len(score))
        if fits.shape[1] > most:
            order = np.where(fits, score, np.iinfo(np.int64).min)
            least = np.partition(order, -most, axis=1)[:, -most, None]
            above = fits & (order > least)
            level = fits & (order == least)
            fits = above | (level & (np.cumsum(level, axis=1) <= most - above.sum(axis=1, keepdims=True)))
        line, column = np.nonzero(fits)
        if not len(line):
            return
        old_line, old_column = np.nonzero(self.held[lines])
        line = np.concatenate([old_line, line])
        s = np.concatenate([self.score[lines][old_line, old_column], score[line[len(old_line) :], column]])
        i = np.concatenate([self.id[lines][old_line, old_column], ids[column]])
        order = np.lexsort((i, -s, line))
        line, s, i = line[order], s[order], i[order]
        again = np.zeros(len(line), bool)
        again[1:] = (line[1:] == line[:-1]) & (s[1:] == s[:-1]) & (i[1:] == i[:-1])
        line, s, i = line[~again], s[~again], i[~again]
        rank = np.arange(len(line)) - np.searchsorted(line, line)
        line, s, i, rank = (x[rank < most] for x in (line, s, i, rank))
        for table, values in ((self.score, s), (self.id, i), (self.held, True)):
            table[lines][line, rank] = values

    def entries(self) -> Iterator[tuple[int, int, int]]:
        for line, k in zip(*np.nonzero(self.held), strict=True):
            yield int(line), int(self.score[line, k]), int(self.id[line, k])


def batches(found: Iterator[pa.RecordBatch], scale: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, vectors), ids ascending; a batch in which ids repeat comes as several, with each id once in each."""
    for batch in found:
        ids, labels = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
        vectors = quantised(batch.column(2).to_numpy(zero_copy_only=False), scale)
        order = np.argsort(ids, kind="stable")
        while len(order):
            first = np.ones(len(order), bool)
            first[1:] = ids[order[1:]] != ids[order[:-1]]
            now = order[first]
            yield ids[now], labels[now], vectors[now]
            order = order[~first]
            if len(order):  # exact repetitions add nothing
                known = {(ids[k], labels[k], vectors[k].tobytes()) for k in now.tolist()}
                order = order[[(ids[k], labels[k], vectors[k].tobytes()) not in known for k in order.tolist()]]


def positives_of(found: Iterator[pa.RecordBatch], anchors: Anchors, window: Window, scale: float) -> Iterator[bytes]:
    """Keys of what can be a positive among the rows of one task."""
    best = Best(len(anchors.ids), window.positives)
    for ids, labels, vectors in batches(found, scale):
        step = max(1, AT_ONCE // len(ids))
        for at in range(0, len(anchors.ids), step):
            part = slice(at, at + step)
            fits = (anchors.labels[part, None] == labels) & (anchors.ids[part, None] != ids)
            best.add(at, scores(anchors.vectors[part], vectors), ids, fits)
    for line, score, vec_id in best.entries():
        yield pack(line, score, POSITIVE, vec_id)


def negatives_of(found: Iterator[pa.RecordBatch], anchors: Anchors, window: Window, scale: float) -> Iterator[bytes]:
    """Keys of what can be a negative of some window among the rows of one task, each once."""
    best = [Best(len(anchors.ids), window.negatives) for _ in range(window.positives)]
    for ids, labels, vectors in batches(found, scale):
        step = max(1, AT_ONCE // len(ids))
        for at in range(0, len(anchors.ids), step):
            part = slice(at, at + step)
            score = scores(anchors.vectors[part], vectors)
            other = (anchors.labels[part, None] != labels) & (anchors.ids[part, None] != ids)
            for k, held in enumerate(best):
                held.add(at, score, ids, other & (score >= anchors.low[part, k, None]) & (score <= anchors.high[part, k, None]))
    for line, score, vec_id in sorted({e for held in best for e in held.entries()}):
        yield pack(line, score, NEGATIVE, vec_id)


def emit(keys: Iterable[bytes], window: Window) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(anchor number, positive, rank, negative, positive score, negative score) from keys in order; a repeated key counts once."""
    now, last, windows = None, None, []
    for key in keys:
        if key == last:
            continue
        last = key
        anchor, score, kind, vec_id = unpack(key)
        if anchor != now:
            now, windows, opened = anchor, [], 0
        if kind == POSITIVE:
            if opened < window.positives:
                opened += 1
                windows.append([vec_id, score, 0])
            continue
        for w in windows:
            if window.low * w[1] <= 100 * score <= window.high * w[1]:
                w[2] += 1
                yield anchor, w[0], w[2], vec_id, w[1], score
        windows = [w for w in windows if w[2] < window.negatives and 100 * score >= window.low * w[1]]


def first_positives(keys: Iterable[bytes], window: Window) -> Iterator[bytes]:
    now, last, taken = None, None, 0
    for key in keys:
        if key == last:
            continue
        last = key
        if key[:8] != now:
            now, taken = key[:8], 0
        if taken < window.positives:
            taken += 1
            yield key


def mine(rows: DataFrame, is_anchor: str, window: Window = Window(), scale: float = 256, block: int = BLOCK) -> DataFrame:
    """RESULT for rows(vec_id, label, embedding); `is_anchor` is a condition on vec_id in SQL."""
    spark = rows.sparkSession
    bound_batches(spark)
    rows = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding"))
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & sound)
    asked = rows.where(is_anchor).distinct()
    blocks = max(1, ceil(asked.count() / block))
    number = F.pmod(F.xxhash64("vec_id", "label", "embedding"), F.lit(blocks))
    found = [_block(rows, asked.where(number == k), window, scale) for k in range(blocks)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _block(rows: DataFrame, asked: DataFrame, window: Window, scale: float) -> DataFrame:
    spark = rows.sparkSession
    own = sorted(map(tuple, asked.select("vec_id", "label", "embedding").collect()))
    ids, labels, vectors = zip(*own, strict=True) if own else ((), (), ())
    anchors = Anchors(ids, labels, quantised(vectors, scale))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def keyed(which) -> object:
        sent = spark.sparkContext.broadcast(anchors)

        def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys = list(which(found, sent.value, window, scale))
            for at in range(0, len(keys), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + 10_000], pa.binary())], names=["key"])

        return rows.mapInArrow(run, "key binary")

    def in_order(keys: DataFrame, walk) -> object:
        pairs = keys.rdd.map(lambda r: (bytes(r[0]), None))
        dealt = pairs.repartitionAndSortWithinPartitions(tasks, lambda key: int.from_bytes(key[:8], "big") % tasks)
        return dealt.mapPartitions(lambda part: walk((k for k, _ in part), window))

    positives = stored(spark.createDataFrame(in_order(keyed(positives_of), first_positives).map(lambda k: (bytearray(k),)), "key binary"))
    tops: dict[int, list[int]] = {}
    for row in positives.collect():
        anchor, score, _, _ = unpack(bytes(row[0]))
        tops.setdefault(anchor, []).append(score)
    anchors.open(tops, window)
    both = positives.unionByName(keyed(negatives_of))
    numbered = spark.sparkContext.broadcast(anchors.ids)
    mined = in_order(both, emit).map(lambda r: (int(numbered.value[r[0]]), *r[1:]))
    out = stored(spark.createDataFrame(mined, RESULT))
    removed(positives)
    return out
