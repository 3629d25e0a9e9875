"""Template matching: AND/OR signals over the text, compiled to one boolean expression per template."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Condition, Template
from ..functions import patterns, slow
from ..functions.text import normalize_text

#: Fixed limit: length of a pattern.
PATTERN_LENGTH = 512
#: Shorter normalised needles are looked for as they were typed.
SHORT = 3
#: Longer texts go to a matcher with a deadline where a pattern may take the square of their length.
SQUARED = 10_000
#: Conditions beyond this number are evaluated once each as columns of their own, so that no expression grows too large.
INLINE = 200


def signal_groups(signals_json: Column) -> Column:
    """C3 over a table: array<array<struct<mode, value>>> of JSON configurations, as config.parse_groups() reads one."""
    none = "array<variant>"
    items = F.coalesce(F.try_variant_get(F.try_parse_json(signals_json), "$", none), F.array().cast(none))
    kind, get = F.schema_of_variant, F.try_variant_get
    signal = lambda mode, value: F.struct(mode.alias("mode"), value.alias("value"))

    def text(c: Column, path: str, default: str) -> Column:
        """What is there as text; nothing, an empty text, zero and false give the default."""
        found = get(c, path, "string")
        plain = F.when(kind(get(c, path, "variant")) == "BOOLEAN", F.when(found == "true", "True")).otherwise(F.when(kind(get(c, path, "variant")) == "STRING", found).otherwise(F.nullif(found, F.lit("0"))))
        return F.coalesce(F.nullif(plain, F.lit("")), F.lit(default))

    def group(item: Column) -> Column:
        inside = F.filter(get(item, "$", none), lambda c: kind(c).startswith("OBJECT"))
        return F.transform(inside, lambda c: signal(text(c, "$.mode", "texto"), text(c, "$.value", "")))

    flat = F.transform(items, lambda x: F.array(signal(F.lit("texto"), get(x, "$", "string"))))
    nested = F.transform(F.filter(items, lambda x: kind(x).startswith("ARRAY")), group)
    return F.when(F.forall(items, lambda x: kind(x) == "STRING"), flat).otherwise(nested)


def haystacks(docs: DataFrame, text: str = "full_text") -> DataFrame:
    """Adds `lowered` (small letters) and `normalised` (C1) of the text; null is ''."""
    whole = F.coalesce(text, F.lit(""))
    return docs.withColumns({"lowered": F.lower(whole), "normalised": normalize_text(whole)})


def normal_form(value: str) -> str:
    import unicodedata

    plain = "".join(c for c in unicodedata.normalize("NFKD", value) if not unicodedata.combining(c)).lower()
    return " ".join(re.sub(r"[^\w\s]", " ", plain).split())


def condition(c: Condition) -> Column:
    """One condition on the columns of haystacks()."""
    if c.mode == "regex":
        return _regex(c.value)
    needle, typed = normal_form(c.value), c.value.casefold().strip()
    if not typed:
        return F.lit(False)
    if len(needle) < SHORT:
        return F.col("lowered").contains(typed)
    return F.col("normalised").contains(needle)


def _regex(pattern: str) -> Column:
    if not pattern or len(pattern) > PATTERN_LENGTH or not patterns.is_valid(pattern):
        return F.lit(False)
    quick, text = "(?iUd)" + patterns.from_run_start(pattern), F.col("lowered")
    if not patterns.is_safe(pattern) or not patterns.java_reads(quick):
        return slow.search_with_deadline(text, pattern)
    if patterns.is_linear(pattern):
        return text.rlike(quick)
    long = F.length(text) > SQUARED
    return F.when(long, slow.search_with_deadline(F.when(long, text), pattern)).otherwise(text.rlike(quick))


def all_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(False)


def any_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts) if parts else F.lit(False)


def template_matches(t: Template) -> Column:
    """Any group whose conditions all hold; no groups and empty groups do not match."""
    return any_of([all_of([condition(c) for c in group]) for group in t.groups])


def match_templates(docs: DataFrame, templates: list[Template]) -> DataFrame:
    """Adds `matches`, array<struct<template_id, confidence>> in template order; docs come from haystacks().

    Each distinct condition is evaluated once when there are many, and the templates combine the results.
    """
    distinct = list(dict.fromkeys(c for t in templates for g in t.groups for c in g))
    if len(distinct) <= INLINE:
        verdicts = {c: condition(c) for c in distinct}
    else:
        for at in range(0, len(distinct), INLINE):
            docs = docs.withColumn(f"__c{at // INLINE}", F.array(*[condition(c) for c in distinct[at : at + INLINE]]))
        verdicts = {c: F.col(f"__c{i // INLINE}")[i % INLINE] for i, c in enumerate(distinct)}
    rows = [
        F.struct(
            F.lit(t.template_id).cast("long").alias("template_id"),
            F.when(any_of([all_of([verdicts[c] for c in g]) for g in t.groups]), 1.0).otherwise(0.0).alias("confidence"),
        )
        for t in templates
    ]
    none = F.array().cast("array<struct<template_id:bigint,confidence:double>>")
    out = docs.withColumn("matches", F.array(*rows) if rows else none)
    return out.drop(*[f"__c{i}" for i in range(-(-len(distinct) // INLINE))])


def exploded(docs: DataFrame, key: str = "document_id") -> DataFrame:
    """One row per document and template, best first, in template order among equals (rank from 1)."""
    ranked = F.array_sort("matches", lambda a, b: F.when(a["confidence"] > b["confidence"], -1).when(a["confidence"] < b["confidence"], 1).otherwise(0))
    rows = docs.select(key, F.posexplode(ranked).alias("pos", "m"))
    return rows.select(key, (F.col("pos") + 1).cast("long").alias("rank"), "m.template_id", "m.confidence")


def decide(docs: DataFrame, threshold: float = 0.5, gap: float = 0.1) -> DataFrame:
    """Adds `decision` (matched, ambiguous, quarantine), `template_id` and `confidence` from `matches`."""
    ranked = F.array_sort("matches", lambda a, b: F.when(a["confidence"] > b["confidence"], -1).when(a["confidence"] < b["confidence"], 1).otherwise(0))
    best, second = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
    hit = F.coalesce((best["confidence"] > 0) & (best["confidence"] >= threshold), F.lit(False))
    close = F.coalesce((second["confidence"] >= threshold) & (best["confidence"] - second["confidence"] < gap), F.lit(False))
    decision = F.when(~hit, "quarantine").when(close, "ambiguous").otherwise("matched")
    out = docs.withColumn("decision", decision)
    matched = F.col("decision") == "matched"
    return out.withColumns({"template_id": F.when(matched, best["template_id"]), "confidence": F.when(matched, best["confidence"])})


def ambiguous_candidates(docs: DataFrame, threshold: float = 0.5, key: str = "document_id") -> DataFrame:
    """The templates that reach the threshold for ambiguous documents.

    Documents are chosen within what is exploded: a filter on the decision, or one that Spark infers from a plain explode,
    would be moved below the matching and evaluate all of it once more for every time that the decision refers to it.
    """
    hits = F.when(F.col("decision") == "ambiguous", F.filter("matches", lambda m: m["confidence"] >= threshold))
    return docs.select(key, F.explode_outer(hits).alias("m")).where("m is not null").select(key, "m.template_id")


def evaluate_groups(docs: DataFrame, t: Template, key: str = "document_id") -> DataFrame:
    """One row per document, group and condition with `matched`, the same expressions as in C7."""
    rows = [
        F.struct(F.lit(g).alias("group_no"), F.lit(i).alias("condition_no"), F.lit(c.mode).alias("mode"), F.lit(c.value).alias("value"), condition(c).alias("matched"))
        for g, group in enumerate(t.groups)
        for i, c in enumerate(group)
    ]
    return docs.select(key, F.explode(F.array(*rows)).alias("r")).select(key, F.lit(t.template_id).cast("long").alias("template_id"), "r.*")


def group_report(evaluated: DataFrame, key: str = "document_id") -> DataFrame:
    """Per document the groups that hold, and whether the template matches."""
    groups = evaluated.groupBy(key, "template_id", "group_no").agg(F.bool_and("matched").alias("holds"))
    return groups.groupBy(key, "template_id").agg(F.count_if("holds").alias("groups_held"), F.bool_or("holds").alias("matched"))

