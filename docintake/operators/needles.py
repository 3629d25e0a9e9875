"""Thousands of templates: every text is read once for all needles, not once for each.

The needles of all text conditions form one Aho-Corasick automaton for each of the two haystacks; a pass over a text gives
the conditions that it meets. Pattern conditions are compiled as in signals.py. A template is found through the
conditions met: each is counted for the groups it is in, and a group all of whose conditions are met makes its template match.
So the work on a document depends on its length and on what it meets, and the plan on neither templates nor needles.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Condition, Template
from .signals import INLINE, SHORT, condition, normal_form

#: Characters of needles in one automaton (some 100 bytes each in a worker); more go in several, each with a pass of its own.
MOST_CHARACTERS = 2_000_000


def match_many(docs: DataFrame, templates: list[Template]) -> DataFrame:
    """Adds `matches`, array<struct<template_id, confidence>> of the templates that match, in template order.

    docs come from haystacks(). decide() says the same of these as of match_templates(), which lists the others with 0.
    """
    distinct = list(dict.fromkeys(c for t in templates for g in t.groups for c in g))
    number = {c: k for k, c in enumerate(distinct)}
    whole: dict[str, list[int]] = defaultdict(list)
    typed: dict[str, list[int]] = defaultdict(list)
    patterns: list[Condition] = []
    for c in distinct:
        if c.mode == "regex":
            patterns.append(c)
        elif raw := c.value.casefold().strip():
            needle = normal_form(c.value)
            (typed[raw] if len(needle) < SHORT else whole[needle]).append(number[c])
    met = [_found(docs, "normalised", part) for part in _parts(whole)] + [_found(docs, "lowered", part) for part in _parts(typed)]
    for at in range(0, len(patterns), INLINE):
        docs = docs.withColumn(f"__p{at // INLINE}", F.array(*[F.when(condition(c), F.lit(number[c])) for c in patterns[at : at + INLINE]]))
        met.append(F.array_compact(f"__p{at // INLINE}"))
    none = F.array().cast("array<struct<template_id:bigint,confidence:double>>")
    if not met:
        return docs.withColumn("matches", none)
    ids = _templates(docs, templates, number)(F.concat(*met))
    out = docs.withColumn("matches", F.transform(ids, lambda i: F.struct(i.alias("template_id"), F.lit(1.0).alias("confidence"))))
    return out.drop(*[f"__p{k}" for k in range(-(-len(patterns) // INLINE))])


def _parts(needles: dict[str, list[int]]) -> Iterator[dict[str, list[int]]]:
    part: dict[str, list[int]] = {}
    size = 0
    for needle, ids in needles.items():
        if part and size + len(needle) > MOST_CHARACTERS:
            yield part
            part, size = {}, 0
        part[needle] = ids
        size += len(needle)
    if part:
        yield part


def _found(docs: DataFrame, haystack: str, needles: dict[str, list[int]]) -> Column:
    """array<int>: the numbers of the conditions whose needle is in the haystack."""
    shared = docs.sparkSession.sparkContext.broadcast(needles)

    @F.pandas_udf("array<int>")
    def met(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for needle, ids in shared.value.items():
            automaton.add_word(needle, tuple(ids))
        automaton.make_automaton()
        for texts in batches:
            yield texts.map(lambda text: [i for ids in {ids for _, ids in automaton.iter(text)} for i in ids])

    return met(F.col(haystack))


def _templates(docs: DataFrame, templates: list[Template], number: dict[Condition, int]):
    """A function array<int> of conditions met -> array<long> of templates that match, in template order."""
    groups: dict[int, list[int]] = defaultdict(list)
    sizes, owner = [], []
    for place, t in enumerate(templates):
        for own in t.groups:
            wanted = {number[c] for c in own}
            for c in wanted:
                groups[c].append(len(sizes))
            sizes.append(len(wanted))
            owner.append(place)
    shared = docs.sparkSession.sparkContext.broadcast((dict(groups), sizes, owner, [t.template_id for t in templates]))

    @F.pandas_udf("array<long>")
    def matching(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of, needed, at, ids = shared.value

        def one(met) -> list[int]:
            left: dict[int, int] = {}
            hit = set()
            for c in met:
                for g in of[c]:
                    left[g] = left.get(g, needed[g]) - 1
                    if not left[g]:
                        hit.add(at[g])
            return [ids[k] for k in sorted(hit)]

        for rows in batches:
            yield rows.map(one)

    return matching
