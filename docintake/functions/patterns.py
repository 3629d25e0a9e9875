"""What a user's regular expression asks of a matcher: whether it can be read, and whether it always ends soon.

A backtracking matcher takes long where a text can be matched in many ways. A pattern becomes an automaton whose
states are its atoms, and the automaton is searched for ambiguity: two ways round one loop with the same text
(exponential), or two loops that share out a text between them (polynomial). Whatever may repeat a varying number of
times counts as a loop, `?` and `{1,50}` included, since a row of these is as slow as a loop. A search also tries
every place to begin at, which is one more loop over any text.
"""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Callable, Iterable
from functools import cache

import regex

_ATOM = regex.compile(r"\\[pP]\{[^}]*\}|\\x[0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|.", regex.DOTALL)
_REPEAT = regex.compile(r"(?:([*+?])|\{(\d+)(?:(,)(\d*))?\}|\{,(\d+)\})([?+]?)")
#: Characters that classes are tried on: ASCII and some letters, digits, marks and spaces beyond it.
_PROBES = [chr(c) for c in range(128)] + list("éßΩжع日한٣²½ \u2028€😀")
_ASSERTIONS = ("^", "$", r"\b", r"\B", r"\A", r"\Z", r"\z")
#: Larger automata and searches count as unsafe.
MOST_STATES, MOST_STEPS = 800, 100_000
#: A bounded repeat of more than this counts as endless where a search begins with it.
LONG = 200
#: An exact number of times beyond this is a path of as many atoms.
COPIES = 8


def is_valid(pattern: str) -> bool:
    try:
        regex.compile(pattern)
    except regex.error:
        return False
    return True


def java_reads(pattern: str) -> bool:
    from pyspark.sql import SparkSession

    try:
        SparkSession.getActiveSession()._jvm.java.util.regex.Pattern.compile(pattern)
    except Exception:  # noqa: BLE001 - whatever Java refuses goes to the helper
        return False
    return True


def _chars(atom: str) -> frozenset[str]:
    """The probes that one atom matches."""
    one = regex.compile(atom, regex.IGNORECASE)
    return frozenset(c for c in _PROBES if one.fullmatch(c))


class _Unreadable(Exception):
    """The pattern uses something that the test does not follow."""


class _Reader:
    """Reads a pattern as nested tuples: atom (chars), seq (parts), alt (parts), rep (part, least, most)."""

    def __init__(self, pattern: str):
        self.pattern, self.at = pattern, 0

    def whole(self) -> tuple:
        tree = self.alternatives()
        if self.at < len(self.pattern):
            raise _Unreadable
        return tree

    def alternatives(self) -> tuple:
        parts = [self.sequence()]
        while self.pattern.startswith("|", self.at):
            self.at += 1
            parts.append(self.sequence())
        return ("alt", parts) if len(parts) > 1 else parts[0]

    def sequence(self) -> tuple:
        parts = []
        while self.at < len(self.pattern) and self.pattern[self.at] not in "|)":
            parts.append(self.repeated(self.item()))
        return ("seq", parts)

    def item(self) -> tuple:
        if self.pattern[self.at] == "(":
            self.at += 3 if self.pattern.startswith("(?:", self.at) else 1
            inside = self.alternatives()
            if not self.pattern.startswith(")", self.at):
                raise _Unreadable
            self.at += 1
            return inside
        m = _ATOM.match(self.pattern, self.at)
        self.at = m.end()
        return ("seq", []) if m[0] in _ASSERTIONS else ("atom", _chars(m[0]))

    def repeated(self, part: tuple) -> tuple:
        while m := _REPEAT.match(self.pattern, self.at):
            self.at = m.end()
            if m[1]:
                least, most = {"*": (0, None), "+": (1, None), "?": (0, 1)}[m[1]]
            elif m[5]:
                least, most = 0, int(m[5])
            else:
                least = int(m[2])
                most = least if not m[3] else int(m[4]) if m[4] else None
            part = ("rep", part, least, most)
        return part


class _Automaton:
    """States are atoms; `follow` counts in how many ways one comes right after another."""

    def __init__(self, loops: Callable[[int, int | None], bool]):
        self.chars: list[frozenset[str]] = []
        self.follow: list[Counter[int]] = []
        self.loops = loops

    def build(self, tree: tuple) -> tuple[list[int], list[int], bool]:
        """(states it can begin with, states it can end with, whether it may be empty)."""
        kind = tree[0]
        if kind == "atom":
            if len(self.chars) >= MOST_STATES:
                raise _Unreadable
            self.chars.append(tree[1])
            self.follow.append(Counter())
            return [len(self.chars) - 1], [len(self.chars) - 1], False
        if kind == "seq":
            made: tuple[list[int], list[int], bool] = ([], [], True)
            for part in tree[1]:
                made = self.chained(made, self.build(part))
            return made
        if kind == "alt":
            each = [self.build(part) for part in tree[1]]
            return [x for e in each for x in e[0]], [x for e in each for x in e[1]], any(e[2] for e in each)
        _, part, least, most = tree
        if most == 0:
            return [], [], True
        if least == most and (part[0] == "atom" or least == 1):
            return self.build(("seq", [part] * min(least, COPIES)))
        first, last, empty = self.build(part)
        if self.loops(least, most):
            self.link(last, first)
        return first, last, empty or least == 0

    def chained(self, a: tuple, b: tuple) -> tuple[list[int], list[int], bool]:
        self.link(a[1], b[0])
        return a[0] + (b[0] if a[2] else []), b[1] + (a[1] if b[2] else []), a[2] and b[2]

    def link(self, ends: Iterable[int], begins: Iterable[int]) -> None:
        begins = list(begins)
        for x in ends:
            self.follow[x].update(begins)

    def reached(self, start: tuple[int, ...], within: list[set[int] | None], backwards: bool = False) -> set[tuple[int, ...]]:
        """Tuples of states that one text leads to from `start`, each state inside its set (None: anywhere)."""
        near = self.before if backwards else self.follow
        seen, queue = {start}, deque([start])
        while queue:
            now = queue.popleft()
            common = frozenset.intersection(*(self.chars[s] for s in now)) if backwards else None
            if backwards and not common:
                continue
            partial: list[tuple[tuple[int, ...], frozenset[str] | None]] = [((), None)]
            for s, inside in zip(now, within, strict=True):
                steps = [t for t in near[s] if inside is None or t in inside]
                partial = [((*done, t), self.chars[t] if both is None else both & self.chars[t]) for done, both in partial for t in steps if backwards or both is None or both & self.chars[t]]
            for to, _ in partial:
                if to not in seen:
                    seen.add(to)
                    queue.append(to)
                    if len(seen) > MOST_STEPS:
                        raise _Unreadable
        return seen

    def ambiguous(self) -> bool:
        n = len(self.chars)
        self.before: list[Counter[int]] = [Counter() for _ in range(n)]
        for x in range(n):
            for y in self.follow[x]:
                self.before[y][x] += 1
        after = []
        for x in range(n):
            seen, queue = set(), [x]
            while queue:
                for y in self.follow[queue.pop()]:
                    if y not in seen:
                        seen.add(y)
                        queue.append(y)
            after.append(seen)
        looped = [x for x in range(n) if x in after[x]]
        rounds = {x: {y for y in after[x] if x in after[y]} for x in looped}
        for p in looped:
            if any(k > 1 and y in rounds[p] for y, k in self.follow[p].items()):
                return True
            there = self.reached((p, p), [rounds[p]] * 2)
            if any(a != b for a, b in there) and any(a != b for a, b in there & self.reached((p, p), [rounds[p]] * 2, backwards=True)):
                return True
        return any(q != p and q in after[p] and (p, q, q) in self.reached((p, p, q), [rounds[p], None, rounds[q]]) for p in looped for q in looped)


@cache
def is_safe(pattern: str) -> bool:
    """Whether a backtracking matcher that begins at one place takes time in proportion to the text, for all we know.

    Back-references, look-around and inline flags other than a leading (?i) are not followed and count as unsafe.
    """
    body = pattern.removeprefix("(?i)")
    if regex.search(r"\\[1-9gkKGX]|\(\?(?!:)|\[\[|&&|--|\|\|\]|~~", body):
        return False
    try:
        whole = _Automaton(lambda least, most: True)
        whole.build(_Reader(body).whole())
        return not whole.ambiguous()
    except (_Unreadable, regex.error, RecursionError):
        return False


@cache
def is_linear(pattern: str) -> bool:
    """Whether a search for a safe pattern takes time in proportion to the text wherever it has to begin anew; else it
    may take the square of it."""
    body = pattern.removeprefix("(?i)")
    try:
        tree = _Reader(body).whole()
        anywhere = _Automaton(lambda least, most: most is None or most > LONG)
        begins = anywhere.build(("rep", ("atom", frozenset(_PROBES)), 0, None))
        anywhere.chained(begins, anywhere.build(_tried_everywhere(body, tree)))
        return not anywhere.ambiguous()
    except (_Unreadable, regex.error, RecursionError):
        return False


def _tried_everywhere(body: str, tree: tuple) -> tuple:
    """The tree without a leading run that a search begins once only: see from_run_start(); a run of word characters after
    a word boundary is such a run as well."""
    if tree[0] != "seq":
        return tree
    at = next((i for i, part in enumerate(tree[1]) if part != ("seq", [])), len(tree[1]))
    if at == len(tree[1]) or tree[1][at][0] != "rep" or tree[1][at][1][0] != "atom":
        return tree
    _, atom, least, _ = tree[1][at]
    if from_run_start(body) == body and not (body.startswith(r"\b") and at == 1 and atom[1] <= _chars(r"\w")):
        return tree
    return ("seq", ([atom] if least else []) + tree[1][at + 1 :])


def from_run_start(pattern: str) -> str:
    """An equal search that begins only where its leading run begins, if the pattern starts with a run of one atom.

    A match that begins inside of a run can begin at the start of the run as well, as the run takes what comes before.
    """
    m = _ATOM.match(pattern)
    if not m or m[0] in (*_ASSERTIONS, "(", ")", "|") or "|" in pattern:
        return pattern
    times = _REPEAT.match(pattern, m.end())
    endless = times and not times[6] and (times[1] in ("*", "+") or times[3] and not times[4])
    return f"(?<!{m[0]}){pattern}" if endless else pattern
