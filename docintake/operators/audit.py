"""Audit log: undo plans, reopened documents, orphans, a document's history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed mark of rows that a split wrote, not an automation.
SPLIT_MARK = "split_to_files:"


def undo_plan(audit: DataFrame, manifest: DataFrame, run_id: str | None = None, document_id: int | None = None) -> DataFrame:
    """Done rows of a run or document with `operation` and the `new_status` they get.

    A copy is deleted; a move goes back if its destination is there, else the source is restored by hash. manifest(path).
    """
    rows = audit.where("status = 'done'")
    if run_id is not None:
        rows = rows.where(F.col("run_id") == run_id)
    if document_id is not None:
        rows = rows.where(F.col("document_id") == document_id)
    there = manifest.select(F.col("path").alias("dest_path"), F.lit(True).alias("there")).distinct()
    j = rows.join(there, "dest_path", "left").withColumn("there", F.coalesce("there", F.lit(False)))
    copy = F.col("action") == "copy"
    operation = (
        F.when(copy, "delete_copy")
        .when(F.col("source_path").isNull(), "error")
        .when(F.col("there"), "move_back")
        .when(F.col("content_hash").isNotNull(), "restore")
        .otherwise("error")
    )
    j = j.withColumn("operation", operation)
    new = F.when(F.col("operation").isin("delete_copy", "move_back"), "undone").when(F.col("operation") == "restore", "undone_from_cas").otherwise(F.col("status"))
    return j.withColumn("new_status", new).drop("there")


def reopen(audit: DataFrame, docs: DataFrame, run_id: str) -> DataFrame:
    """The finished documents of a run, back to processando / classificado."""
    ids = audit.where((F.col("run_id") == run_id) & (F.col("status") == "done")).select("document_id").distinct()
    found = docs.where("state = 'concluido'").join(ids, "document_id", "left_semi")
    return found.withColumns({"state": F.lit("processando"), "step": F.lit("classificado")})


def reconcile_orphans(audit: DataFrame, manifest: DataFrame) -> DataFrame:
    """Intent rows become done if their destination holds the expected content, else orphaned."""
    there = manifest.select(F.col("path").alias("dest_path"), F.col("hash").alias("content_hash"), F.lit(True).alias("there")).distinct()
    j = audit.where("status = 'intent'").join(there, ["dest_path", "content_hash"], "left")
    return j.withColumn("status", F.when(F.col("there"), "done").otherwise("orphaned")).drop("there")


def without_splits(audit: DataFrame) -> DataFrame:
    return audit.where(F.col("details").isNull() | ~F.startswith("details", F.lit(SPLIT_MARK)))


def can_undo(audit: DataFrame) -> DataFrame:
    """U4: per document whether any row is done, and the number of rows shown."""
    return without_splits(audit).groupBy("document_id").agg(F.count("*").alias("entries"), F.bool_or(F.col("status") == "done").alias("can_undo"))


def document_audit(audit: DataFrame, document_id: int) -> DataFrame:
    """U4: the history of one document, newest first."""
    return without_splits(audit.where(F.col("document_id") == document_id)).orderBy(F.desc("created_at"), F.desc("audit_id"))
