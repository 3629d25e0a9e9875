"""Benchmark decontamination by winnowing.

Every run of `window` words that a document shares with a benchmark item is found: both sides are fingerprinted by the
smallest k-gram hash of each run of window - k + 1 k-grams (rightmost on ties), so any shared run of `window` words has a
common fingerprint at the same place. Common fingerprints are joined and each hit is extended to the windows around it;
those that an item holds too, by hash and then by the words themselves, mark their words. Neighbouring windows share
their words, so a hit grows to the whole shared run, and repeated words cost no more than others: each window of a
document is looked up once, however often it occurs. An item of fewer words is one window of its own length, found by
the hash of all document runs of that length and verified the same way. Different windows whose hashes are equal are
told apart by their words.

The benchmark is a stated query set: it is put to workers in blocks of about BLOCK_BYTES text, one reading pass of the
documents per block, so that a larger benchmark costs passes, not memory. What a pass writes are hits, never texts;
documents are not shuffled, but for rows that are left out together with those that a Bloom filter takes for one.

Edge cases: null texts have no words; items without words match nothing; repeated rows of an item count once (by
item_id), a null item_id counts as the id ''; documents keep all their rows; an empty benchmark leaves all documents
clean; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, add_columns, map_batches, stored, text_key
from .sieve import dropped

WINDOW = 10
GRAM = 5

#: Text of the items that workers hold at a time; items are put to blocks by a hash of their id and text.
BLOCK_BYTES = 32 << 20

#: Bytes of words after A-Z is lower-cased: digits, a-z and everything beyond ASCII.
WORD_BYTE = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])

_ONE, _BASE, _INVERSE = np.uint64(1), 0x9E3779B97F4A7C15 | 1, pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64)
_powers = {"up": np.ones(1, dtype=np.uint64), "down": np.ones(1, dtype=np.uint64)}


def _power(which: str, base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n - 1) modulo 2^64, kept between calls up to the longest text met."""
    if len(_powers[which]) < n:
        grown = np.full(max(n, 2 * len(_powers[which])), base, dtype=np.uint64)
        grown[0] = 1
        _powers[which] = np.cumprod(grown, dtype=np.uint64)
    return _powers[which][:n]


def _spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each span, from prefix sums modulo 2^64."""
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * _power("up", _BASE, len(values)), dtype=np.uint64, out=sums[1:])
    h = (sums[ends] - sums[starts]) * _power("down", _INVERSE, len(values) + 1)[starts]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


@dataclass
class Words:
    """The words of one text: lower-cased bytes, where each word starts and ends, and a hash of each."""

    data: bytes
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray

    def __getitem__(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]]

    def __len__(self) -> int:
        return len(self.starts)

    def grams(self, k: int) -> np.ndarray:
        """Hash of every run of k words."""
        n = len(self) - k + 1
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        at = np.arange(n)
        return _spans_hash(self.hashes, at, at + k)

    def winnowed(self, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, positions) of the k-grams kept; shorter texts keep the smallest of what they have."""
        grams = self.grams(k)
        if not len(grams):
            return grams, np.zeros(0, dtype=np.int64)
        wide = min(window - k + 1, len(grams))
        runs = np.lib.stride_tricks.sliding_window_view(grams, wide)[:, ::-1]
        places = np.unique(np.arange(len(runs)) + wide - 1 - runs.argmin(axis=1))
        return grams[places], places


def words_of(text: str | None) -> Words:
    data = (text or "").encode().translate(LOWER)
    raw = np.frombuffer(data, dtype=np.uint8)
    edge = np.diff(WORD_BYTE[raw].astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return Words(data, starts, ends, _spans_hash(raw.astype(np.uint64) + _ONE, starts, ends))


@dataclass
class Index:
    """Fingerprints and windows of one block of items; items of equal words are one entry with several ids."""

    gram: int
    window: int
    entries: list[list[bytes]]
    ids: list[list[str]]
    fingerprints: np.ndarray
    #: Sorted hashes of all windows, an occurrence (entry, place) of each, and the entries that hold it, from `first` on.
    windows: np.ndarray
    entry: np.ndarray
    place: np.ndarray
    first: np.ndarray
    owners: np.ndarray
    #: For hashes that different windows share, by number: (an occurrence, the entries that hold it) of each of them.
    shared: dict[int, list[tuple[int, int, list[int]]]]
    short: dict[int, tuple[np.ndarray, dict[int, list[int]]]]

    def hits(self, w: Words) -> tuple[list[tuple[int, int]], set[str]]:
        """Word spans [start, end) of w inside occurrences of windows, and the ids of the items they come from."""
        spans, found = [], []
        if len(self.windows) and len(w) >= self.window:
            hashes, places = w.winnowed(self.gram, self.window)
            met = places[_member(hashes, self.fingerprints)]
            if len(met):
                near = np.zeros(len(w) + 1, dtype=np.int64)
                np.add.at(near, np.maximum(met - (self.window - self.gram), 0), 1)
                np.add.at(near, met + 1, -1)
                starts = np.flatnonzero(near.cumsum()[: len(w) - self.window + 1] > 0)
                grams = w.grams(self.window)[starts]
                starts, grams = (x[_member(grams, self.windows)] for x in (starts, grams))
                for s, k in zip(starts.tolist(), np.searchsorted(self.windows, grams).tolist(), strict=True):
                    own = [w[i] for i in range(s, s + self.window)]
                    for which, (entry, q) in enumerate([x[:2] for x in self.shared[k]] if k in self.shared else [(self.entry[k], self.place[k])]):
                        if own == self.entries[entry][q : q + self.window]:
                            spans.append((s, s + self.window))
                            found.append((k, which))
                            break
        items = {int(e) for k, which in set(found) for e in (self.shared[k][which][2] if k in self.shared else self.owners[self.first[k] : self.first[k + 1]])}
        for n, (keys, entries) in self.short.items():
            grams = w.grams(n)
            for p in np.flatnonzero(_member(grams, keys)).tolist():
                for e in entries[int(grams[p])]:
                    if all(w[p + j] == x for j, x in enumerate(self.entries[e])):
                        spans.append((p, p + n))
                        items.add(e)
        return spans, {i for e in items for i in self.ids[e]}


def build_index(items: list[tuple[str, str | None]], gram: int = GRAM, window: int = WINDOW) -> Index:
    texts: dict[bytes, tuple[Words, set[str]]] = {}
    for item_id, text in items:
        w = words_of(text)
        if len(w):
            texts.setdefault(b" ".join(w[i] for i in range(len(w))), (w, set()))[1].add(item_id)
    entries, short = [w for w, _ in texts.values()], {}
    marks, hashes, entry, place = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for number, w in enumerate(entries):
        if len(w) < window:
            short.setdefault(len(w), {}).setdefault(int(w.grams(len(w))[0]), []).append(number)
        else:
            marks.append(w.winnowed(gram, window)[0])
            hashes.append(w.grams(window))
            entry.append(np.full(len(hashes[-1]), number))
            place.append(np.arange(len(hashes[-1])))
    h, e, at = (np.concatenate(x) for x in (hashes, entry, place))
    order = np.lexsort((at, e, h))
    h, e, at = h[order], e[order], at[order]
    known: dict[tuple[int, int], bytes] = {}
    once = np.append(True, (h[1:] != h[:-1]) | (e[1:] != e[:-1]))[: len(h)]
    for i in np.flatnonzero(~once).tolist():  # a repeated window of an entry, unless its words differ
        own = (int(h[i]), int(e[i]))
        if own not in known:
            first_place = int(at[i - 1])
            known[own] = [entries[e[i]][j] for j in range(first_place, first_place + window)]
        once[i] = known[own] != [entries[e[i]][j] for j in range(at[i], at[i] + window)]
    h, e, at = h[once], e[once], at[once]
    windows, first = np.unique(h, return_index=True)
    ends, words = np.append(first, len(h)), [[w[i] for i in range(len(w))] for w in entries]
    return Index(
        gram, window, words, [sorted(ids) for _, ids in texts.values()],
        np.unique(np.concatenate(marks)), windows, e[first], at[first], ends, e, _told_apart(words, e, at, ends, window),
        {n: (np.array(sorted(x), dtype=np.uint64), x) for n, x in short.items()},
    )


def _told_apart(words: list[list[bytes]], entry: np.ndarray, place: np.ndarray, ends: np.ndarray, window: int) -> dict[int, list[tuple[int, int, list[int]]]]:
    """The windows of hashes that stand for several different ones."""
    out = {}
    for k in np.flatnonzero(np.diff(ends) > 1).tolist():
        apart: dict[tuple[bytes, ...], tuple[int, int, list[int]]] = {}
        for i in range(ends[k], ends[k + 1]):
            e, q = int(entry[i]), int(place[i])
            apart.setdefault(tuple(words[e][q : q + window]), (e, q, []))[2].append(e)
        if len(apart) > 1:
            out[k] = list(apart.values())
    return out


def _member(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(keys) or not len(values):
        return np.zeros(len(values), dtype=bool)
    at = np.searchsorted(keys, values)
    return keys[np.minimum(at, len(keys) - 1)] == values


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


HITS = "n_words long, starts array<long>, ends array<long>, items array<string>"


def contamination(docs: DataFrame, benchmark: DataFrame, gram: int = GRAM, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, starts, ends (merged hit spans in words), items (ids as text, sorted)."""
    indexes = _indexes(benchmark, gram, window, block_bytes)
    if len(indexes) == 1:
        return _searched(docs.select("doc_id", "text"), indexes[0], "doc_id")
    keyed = docs.select("doc_id", "text", text_key().alias("own"))
    hits = _hits(keyed, indexes)
    whole = hits.groupBy("doc_id", "own").agg(F.flatten(F.collect_list(F.arrays_zip("starts", "ends"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    def merge(rows: dict[str, list]) -> dict[str, list]:
        spans = [merged([(s["starts"], s["ends"]) for s in own or ()]) for own in rows["spans"]]
        return {"doc_id": rows["doc_id"], "n_words": rows["n_words"], "starts": [[a for a, _ in x] for x in spans], "ends": [[b for _, b in x] for x in spans], "items": [i or [] for i in rows["items"]]}

    counted = map_batches(keyed, lambda rows: {"__id": rows["doc_id"], "__own": rows["own"], "n_words": [len(words_of(t)) for t in rows["text"]]}, "__id long, __own long, n_words long")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("own") == F.col("__own"))
    joined = counted.join(whole, same, "left").select(F.col("__id").alias("doc_id"), "n_words", "spans", "items")
    return map_batches(joined, merge, f"doc_id long, {HITS}")


def clean(docs: DataFrame, benchmark: DataFrame, gram: int = GRAM, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs that share no window with any item, with their columns."""
    indexes = _indexes(benchmark, gram, window, block_bytes)
    if len(indexes) > 1:
        return dropped(docs, _hits(docs.select("doc_id", "text", text_key().alias("own")), indexes).select("doc_id", "own").distinct())
    index = docs.sparkSession.sparkContext.broadcast(indexes[0]())

    def run(rows: dict[str, list]) -> dict[str, list]:
        return {"__clean": [not index.value.hits(words_of(t))[0] for t in rows["text"]]}

    return add_columns(docs, run, ["text"], "__clean boolean").where("__clean").drop("__clean")


def _indexes(benchmark: DataFrame, gram: int, window: int, block_bytes: int) -> list[Callable[[], Index]]:
    """One block of items at least; each index is made when it is asked for."""
    named = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    size = named.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64)).first()[0] or 0
    count = max(1, -(-size // block_bytes))
    # by id and text: items of one id may be many
    blocks = [named.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k) if count > 1 else named for k in range(count)]
    return [lambda items=items: build_index([(r[0], r[1]) for r in items.collect()], gram, window) for items in blocks]


def _hits(keyed: DataFrame, indexes: list[Callable[[], Index]]) -> DataFrame:
    """(doc_id, own, n_words, starts, ends, items) of rows that a block hits, a row for each; block after block is written."""
    out = [stored(_searched(keyed, index, "doc_id", "own").where(F.size("starts") > 0)) for index in indexes]
    return reduce(DataFrame.unionByName, out)


def _searched(docs: DataFrame, make: Callable[[], Index], *keys: str) -> DataFrame:
    """The keys and HITS of every row of docs(text, keys) by one index."""
    index = docs.sparkSession.sparkContext.broadcast(make())

    def run(rows: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {**{k: rows[k] for k in keys}, "n_words": [], "starts": [], "ends": [], "items": []}
        for text in rows["text"]:
            w = words_of(text)
            spans, ids = index.value.hits(w)
            spans = merged(spans)
            out["n_words"].append(len(w))
            out["starts"].append([a for a, _ in spans])
            out["ends"].append([b for _, b in spans])
            out["items"].append(sorted(ids))
        return out

    return map_batches(docs, run, f"{', '.join(f'{k} long' for k in keys)}, {HITS}")


def items_digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
