"""Fill-in-middle transformation: two cuts of a text found by a Fenwick tree over fixed blocks of it.

A text is taken as UTF-8 bytes in blocks of BLOCK bytes. Two Fenwick trees hold how many units and how many code points
begin in each block. A cut after k units descends the tree of units by halving steps to the block in which unit k begins, then
looks in that block alone; the tree of code points turns the place into a number of characters. What a unit is, is a
parameter: a code point, or a match of a pattern (a word, say; what stands between two matches goes with the first).

Edge cases: a null text counts as empty; an empty text, one that holds a sentinel, and one that the draw leaves out is
returned as it is (form `plain`, no cuts). A null id is drawn as the empty id. Rows are worked out each by itself:
repeated rows give repeated results, columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

#: Bytes of one block.
BLOCK = 4096


@dataclass(frozen=True)
class Sentinels:
    """Three different marks, each in one pair of angle brackets: so none can arise where a mark meets the text."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self) -> None:
        marks = {self.prefix, self.suffix, self.middle}
        if len(marks) < 3 or not all(regex.fullmatch("<[^<>]+>", m) for m in marks):
            raise ValueError("sentinels must be three different texts of the form <...>")


@dataclass(frozen=True)
class Draw:
    """Which texts are transformed: of 100, the first `rate`; of those, `spm_rate` of 100 with the suffix first."""

    seed: str = "1"
    rate: int = 90
    spm_rate: int = 20


class Fenwick:
    """Sums of blocks, built in one pass."""

    def __init__(self, counts: Sequence[int]):
        self.n = len(counts)
        self.tree = [0, *counts]
        for i in range(1, self.n + 1):
            up = i + (i & -i)
            if up <= self.n:
                self.tree[up] += self.tree[i]

    def descend(self, k: int) -> tuple[int, int]:
        """(block, units before it): the last block before which at most k units begin; the number of blocks if k is all of them."""
        at, step = 0, 1 << self.n.bit_length()
        before = 0
        while step:
            if (to := at + step) <= self.n and before + self.tree[to] <= k:
                at, before = to, before + self.tree[to]
            step >>= 1
        return at, before

    def before(self, block: int) -> int:
        """Sum of all blocks before `block`."""
        total = 0
        while block:
            total += self.tree[block]
            block &= block - 1
        return total


class Blocks:
    """A text in blocks, with the places where code points and units begin."""

    def __init__(self, text: str, unit: regex.Pattern | None = None, block: int = BLOCK):
        self.data, self.block = text.encode(), block
        self.begins = (np.frombuffer(self.data, np.uint8) & 0xC0) != 0x80
        self.points = Fenwick(self._per_block(self.begins))
        if unit is None:
            self.starts, self.units = self.begins, self.points
        else:
            self.starts = np.zeros(len(self.data), bool)
            offsets = np.flatnonzero(self.begins)
            self.starts[offsets[[m.start() for m in unit.finditer(text) if m.end() > m.start()]]] = True
            self.units = Fenwick(self._per_block(self.starts))
        self.n = self.units.before(self.units.n)

    def _per_block(self, marks: np.ndarray) -> list[int]:
        return np.add.reduceat(marks, np.arange(0, len(marks), self.block), dtype=np.int64).tolist() if len(marks) else []

    def cut(self, k: int) -> int:
        """Byte at which unit k (from 0) begins: what comes before holds k units. The end, if there are only k."""
        if k >= self.n:
            return len(self.data)
        if k <= 0:
            return 0  # what comes before the first unit goes with it
        block, before = self.units.descend(k)
        at = block * self.block
        return at + int(np.flatnonzero(self.starts[at : at + self.block])[k - before])

    def characters(self, to: int) -> int:
        """Code points before byte `to`."""
        block = to // self.block
        return self.points.before(block) + int(np.count_nonzero(self.begins[block * self.block : to]))


def draws(doc_id: int | None, seed: str) -> tuple[int, int, int, int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))


def split(text: str, doc_id: int | None, draw: Draw, marks: Sentinels, unit: regex.Pattern | None, block: int = BLOCK) -> tuple[int, str, bytes, int | None, int | None]:
    """(units, form, output, characters of prefix, of middle)."""
    blocks = Blocks(text, unit, block)
    h1, h2, h3, h4 = draws(doc_id, draw.seed)
    data = blocks.data
    if not data or h3 % 100 >= draw.rate or any(m in text for m in (marks.prefix, marks.suffix, marks.middle)):
        return blocks.n, "plain", data, None, None
    low, high = sorted((h1 % (blocks.n + 1), h2 % (blocks.n + 1)))
    a, b = blocks.cut(low), blocks.cut(high)
    before = marks.prefix.encode() + data[:a]
    after = marks.suffix.encode() + data[b:]
    form, order = ("spm", (after, before)) if h4 % 100 < draw.spm_rate else ("psm", (before, after))
    first = blocks.characters(a)
    return blocks.n, form, b"".join((*order, marks.middle.encode(), data[a:b])), first, blocks.characters(b) - first


def transform(docs: DataFrame, draw: Draw = Draw(), marks: Sentinels = Sentinels(), unit: str | None = None) -> DataFrame:
    """doc_id, n, form, output, prefix_chars, middle_chars for each row of docs(doc_id, text); n counts units.

    `unit` is a pattern whose matches are the units; without one, code points are.
    """
    find = regex.compile(unit) if unit else None

    def run(rows: dict[str, list]) -> dict[str, list]:
        made = [split(t or "", i, draw, marks, find) for i, t in zip(rows["doc_id"], rows["text"], strict=True)]
        n, form, output, first, middle = zip(*made, strict=True) if made else ((),) * 5
        return {"doc_id": rows["doc_id"], "n": n, "form": form, "output": [o.decode() for o in output], "prefix_chars": first, "middle_chars": middle}

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, n long, form string, output string, prefix_chars long, middle_chars long")


def restore(made: DataFrame, marks: Sentinels = Sentinels(), column: str = "restored") -> DataFrame:
    """made(output, form, ...) with the text that transform() was given in `column`; built-in functions only.

    Each sentinel occurs once in an output that is not plain. A null output or form, or another form, gives null.
    """
    p, s, m = marks.prefix, marks.suffix, marks.middle
    head = F.substring_index("output", m, 1)
    middle = F.substr("output", F.length(head) + len(m) + 1)
    psm = F.concat(F.substr(F.substring_index(head, s, 1), F.lit(len(p) + 1)), middle, F.substring_index(head, s, -1))
    spm = F.concat(F.substring_index(head, p, -1), middle, F.substr(F.substring_index(head, p, 1), F.lit(len(s) + 1)))
    form = F.col("form")
    return made.withColumn(column, F.when(form == "plain", F.col("output")).when(form == "psm", psm).when(form == "spm", spm))
