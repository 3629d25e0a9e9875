"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier 1: a minimal perfect hash over the vocabulary resolves a whole pre-token that is itself a vocabulary entry.
Tier 2: any other pre-token is merged with a heap of candidate pairs over a doubly linked list of its bytes.
Each distinct pre-token of a worker is resolved once and remembered in a bounded table.

Edge cases: null and empty texts encode to no ids; bytes outside the vocabulary cannot occur, since all 256 single
bytes are in it (checked when the ranks are read); one very long pre-token costs O(n log n).
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import regex
import xxhash
from pyspark.sql import DataFrame

from .common import map_batches

#: Distinct pre-tokens in each of the two generations that a worker remembers (about 0.2 KB each).
REMEMBERED = 350_000


class PerfectHash:
    """Minimal perfect hash of byte strings by hash and displace: bucket -> displacement, n slots for n keys.

    Large buckets search a seed that sends all their keys to free slots; a bucket of one key takes any free slot,
    written as the negative seed -1 - slot.
    """

    def __init__(self, keys: list[bytes], per_bucket: int = 4):
        n = len(keys)
        self.n, self.buckets = n, max(1, n // per_bucket)
        hashes = np.array([xxhash.xxh64_intdigest(k) for k in keys], dtype=np.uint64)
        of = (hashes % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(of, kind="stable")
        cuts = np.searchsorted(of[order], np.arange(self.buckets + 1))
        self.seeds = [0] * self.buckets
        self.slots = [-1] * n
        taken = np.zeros(n, dtype=bool)
        for b in np.argsort(-(cuts[1:] - cuts[:-1]), kind="stable").tolist():
            members = order[cuts[b] : cuts[b + 1]].tolist()
            if len(members) <= 1:
                break
            seed, places = self._free_seed(hashes[members], taken)
            taken[places] = True
            self.seeds[b] = seed
            for i, p in zip(members, places.tolist(), strict=True):
                self.slots[p] = i
        free = (p for p, i in enumerate(self.slots) if i < 0)
        for b in np.flatnonzero(cuts[1:] - cuts[:-1] == 1).tolist():
            self.seeds[b] = -1 - (p := next(free))
            self.slots[p] = int(order[cuts[b]])
        self.keys = [keys[i] for i in self.slots]

    def _free_seed(self, hashes: np.ndarray, taken: np.ndarray, step: int = 64) -> tuple[int, np.ndarray]:
        """The least seed that sends all hashes to different free slots, tried `step` seeds at a time."""
        for at in range(0, 1 << 40, step):
            seeds = np.arange(at, at + step, dtype=np.uint64)
            x = hashes[:, None] ^ (seeds * np.uint64(0x9E3779B97F4A7C15))[None, :]
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            places = ((x >> np.uint64(17)) % np.uint64(self.n)).astype(np.int64)
            fine = ~taken[places].any(axis=0)
            if fine.any():
                for k in np.flatnonzero(fine).tolist():
                    if len(set(places[:, k].tolist())) == len(hashes):
                        return at + k, places[:, k]
        raise RuntimeError("no seed found")

    def _place(self, h: int, seed: int) -> int:
        if seed < 0:
            return -1 - seed
        x = (h ^ (seed * 0x9E3779B97F4A7C15)) & 0xFFFFFFFFFFFFFFFF
        x = ((x ^ (x >> 31)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
        return (x >> 17) % self.n

    def find(self, key: bytes) -> int:
        """The number of key in the list it was built from, or -1."""
        if not self.n:
            return -1
        h = xxhash.xxh64_intdigest(key)
        p = self._place(h, self.seeds[h % self.buckets])
        return self.slots[p] if self.keys[p] == key else -1


class Remembered(dict):
    """pre-token -> its decimal ids, comma-joined; resolved on first sight.

    When it is full it becomes the older generation; words met again move back, the others go with the next turn.
    """

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec, self.older = codec, {}

    def __missing__(self, token: str) -> str:
        ids = self.older.get(token)
        if ids is None:
            ids = ",".join(map(str, self.codec.encode_word(token.encode())))
        if len(token) <= 64:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[token] = ids
        return ids


class Codec:
    """Encoder and decoder of one rank file; codec() keeps one per worker process."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        if any(bytes([b]) not in self.ranks for b in range(256)):
            raise ValueError("the rank file lacks single bytes")
        self.words = list(self.ranks)
        self.ids = list(self.ranks.values())
        self.known = PerfectHash(self.words)
        self.bytes_of = {str(rank): word for word, rank in self.ranks.items()}
        self.split = regex.compile(pattern).findall
        self.seen = Remembered(self)

    def merge(self, word: bytes) -> list[int]:
        """Tier 2: repeatedly joins the pair of lowest rank, leftmost first."""
        ranks = self.ranks
        n = len(word)
        parts: list[bytes | None] = [word[i : i + 1] for i in range(n)]
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            first = parts[i]
            if first is None or (j := right[i]) >= n or len(first) + len(parts[j]) != size:
                continue  # one of the two has changed since
            joined = first + parts[j]
            parts[i], parts[j] = joined, None
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                if (r := ranks.get(joined + parts[k])) is not None:
                    heapq.heappush(heap, (r, i, size + len(parts[k])))
            if (k := left[i]) >= 0 and (r := ranks.get(parts[k] + joined)) is not None:
                heapq.heappush(heap, (r, k, size + len(parts[k])))
        return [ranks[p] for p in parts if p is not None]

    def encode_word(self, word: bytes) -> list[int]:
        at = self.known.find(word)
        return [self.ids[at]] if at >= 0 else self.merge(word)

    def encode(self, text: str) -> str:
        """Decimal ids of text, joined by commas."""
        seen = self.seen
        return ",".join([seen[t] for t in self.split(text)])

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.split(","))) if ids else b""


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids array<int>: the ids of every text by the rank file at `path` (readable on every worker)."""

    def run(rows: dict[str, list]) -> dict[str, list]:
        c = codec(path, pattern)
        coded = [c.encode(t or "") for t in rows["text"]]
        return {"doc_id": rows["doc_id"], "ids": [[int(i) for i in x.split(",")] if x else [] for x in coded]}

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, ids array<int>")


def decode(coded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, text: the inverse of encode(); bytes that are not UTF-8 become replacement characters, null ids null."""

    def run(rows: dict[str, list]) -> dict[str, list]:
        c = codec(path, pattern)
        texts = [None if x is None else c.decode(",".join(map(str, x))).decode("utf-8", "replace") for x in rows["ids"]]
        return {"doc_id": rows["doc_id"], "text": texts}

    return map_batches(coded.select("doc_id", "ids"), run, "doc_id long, text string")


def encode_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes, decodes the ids again and digests both sides.

    Same Codec as encode() and decode(), in one pass, so that the ids of a corpus need not be stored for the digests.
    """

    def run(rows: dict[str, list]) -> dict[str, list]:
        c = codec(path, pattern)
        out: dict[str, list] = {"doc_id": rows["doc_id"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for text in rows["text"]:
            ids = c.encode(text or "")
            out["n_tokens"].append(ids.count(",") + 1 if ids else 0)
            out["ids_sha256"].append(hashlib.sha256(ids.encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(c.decode(ids)).hexdigest())
        return out

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
