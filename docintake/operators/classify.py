"""What follows a match: outside decisions, forced templates, routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def apply_decisions(docs: DataFrame, decisions: DataFrame, template_ids: DataFrame) -> DataFrame:
    """C11: docs(document_id, decision, template_id, confidence) after decisions(document_id, template_id?, confidence).

    Decisions count for ambiguous documents, and for unmatched ones as a fallback. An unknown or missing template sends
    the document to quarantine; its confidence is kept where the document was ambiguous.
    """
    d = decisions.select("document_id", F.col("template_id").alias("d_template"), F.col("confidence").alias("d_confidence"), F.lit(True).alias("decided"))
    known = template_ids.select(F.col("template_id").alias("d_template"), F.lit(True).alias("is_known")).distinct()
    joined = docs.join(d.join(known, "d_template", "left"), "document_id", "left")
    open_ = F.col("decision").isin("ambiguous", "quarantine") & F.coalesce("decided", F.lit(False))
    taken = open_ & F.coalesce("is_known", F.lit(False))
    refused_tie = open_ & ~taken & (F.col("decision") == "ambiguous")
    return joined.select(
        "document_id",
        F.when(taken, "matched").when(open_ | (F.col("decision") == "ambiguous"), "quarantine").otherwise(F.col("decision")).alias("decision"),
        F.when(taken, F.col("d_template")).when(open_, F.lit(None)).otherwise(F.col("template_id")).alias("template_id"),
        F.when(taken | refused_tie, F.col("d_confidence")).otherwise(F.col("confidence")).alias("confidence"),
    )


def paid_calls(docs: DataFrame, fallback: bool, any_template: bool) -> DataFrame:
    """Docs with `tie_call`, `fallback_call` and `fields_call`: the calls that a model would be paid for.

    docs: decision, forced, missing_required (count).
    """
    tie = (F.col("decision") == "ambiguous") & ~F.col("forced")
    second = (F.col("decision") == "quarantine") & ~F.col("forced") & F.lit(fallback and any_template)
    return docs.withColumns({"tie_call": tie, "fallback_call": second & ~tie, "fields_call": F.col("missing_required") > 0})


def forced_template(docs: DataFrame, forced: DataFrame, template_ids: DataFrame) -> DataFrame:
    """A forced template replaces the match, without confidence; an unknown one is an error."""
    known = template_ids.select(F.col("template_id").alias("f_template"), F.lit(True).alias("is_known")).distinct()
    f = forced.select("document_id", F.col("template_id").alias("f_template")).join(known, "f_template", "left")
    j = docs.join(f, "document_id", "left")
    has = F.col("f_template").isNotNull()
    return j.select(
        "document_id",
        F.when(has & F.col("is_known"), "matched").when(has, "error").otherwise(F.col("decision")).alias("decision"),
        F.when(has & F.col("is_known"), F.col("f_template")).when(~has, F.col("template_id")).alias("template_id"),
        F.when(~has, F.col("confidence")).alias("confidence"),
    )


def classify_once(docs: DataFrame, results: DataFrame) -> DataFrame:
    """C14: the documents without a result."""
    return docs.join(results.select("document_id"), "document_id", "left_anti")


def route(template_id: Column, score: Column, invalid_required: Column, threshold: float = 0.8) -> Column:
    """struct(state, step)"""
    review = invalid_required | (score < threshold)
    state = F.when(template_id.isNull(), "quarentena").when(review, "em_revisao").otherwise("processando")
    return F.struct(state.alias("state"), F.lit("classificado").alias("step"))
