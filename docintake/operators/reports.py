"""Lists, counts and details for people."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import STATES
from ..functions.validate import confidence_band

#: Fixed texts shown for a document without a better reason.
NO_ERROR_TEXT = "Falha sem detalhe registrado."
QUARANTINE_TEXT = "Nenhum template correspondeu."


def list_documents(docs: DataFrame, originals: DataFrame, folders: DataFrame, limit: int = 100, offset: int = 0, before: int | None = None) -> DataFrame:
    """Q1: one page, newest id first; the page is cut before the joins.

    `before` is the last id of the page before: a page then costs the same wherever it is, and nothing but the page comes
    to one place. `offset` skips rows and gathers all that it skips.
    """
    rows = docs if before is None else docs.where(F.col("document_id") < before)
    page = rows.orderBy(F.desc("document_id")).offset(offset).limit(limit) if offset else rows.orderBy(F.desc("document_id")).limit(limit)
    o = originals.select("origin_id", F.col("filename").alias("original_filename"), "folder_id")
    f = folders.select("folder_id", F.col("path").alias("folder"))
    return page.join(o, "origin_id", "left").join(f, "folder_id", "left").orderBy(F.desc("document_id"))


def state_counts(docs: DataFrame) -> DataFrame:
    """Q2: state, n for all six states, zero where there is none, and a row `total`."""
    counts = docs.groupBy("state").agg(F.count("*").alias("n")).where(F.col("state").isin(*STATES))
    names = docs.sparkSession.createDataFrame([(s,) for s in STATES], "state string")
    full = names.join(counts, "state", "left").select("state", F.coalesce("n", F.lit(0)).alias("n"))
    return full.unionByName(full.agg(F.lit("total").alias("state"), F.sum("n").alias("n")))


def attention(docs: DataFrame, jobs: DataFrame, results: DataFrame, filled: DataFrame) -> DataFrame:
    """Q3: document_id, bucket, reason, score, fields (array in field order) of documents that wait for a person.

    Jobs of failed documents and fields of those in review are gathered, of no others. An empty error is none.
    """
    waiting = docs.where(F.col("state").isin("falha", "quarentena", "em_revisao"))
    failed = waiting.where("state = 'falha'").select("content_hash")
    in_review = waiting.where("state = 'em_revisao'").select("document_id")
    errors = jobs.withColumnRenamed("hash", "content_hash").join(failed, "content_hash", "left_semi")
    last = errors.groupBy("content_hash").agg(F.max_by(F.struct("last_error"), F.struct("updated_at", "job_id")).alias("job"))
    fields = filled.join(in_review, "document_id", "left_semi").groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("field_no", "name", "raw", "valid"))).alias("fields"))
    review = in_review.join(results.select("document_id", "score"), "document_id", "left").join(fields, "document_id", "left")
    error = F.coalesce(F.nullif("job.last_error", F.lit("")), F.lit(NO_ERROR_TEXT))
    reason = F.when(F.col("state") == "falha", error).when(F.col("state") == "quarentena", QUARANTINE_TEXT)
    return waiting.join(last, "content_hash", "left").join(review, "document_id", "left").select("document_id", F.col("state").alias("bucket"), reason.alias("reason"), "score", "fields")


def search_documents(docs: DataFrame, status: str | None, q: str) -> DataFrame:
    """Q4: docs(filename, folder) of a state whose file or folder name holds q, whatever its case."""
    out = docs.where(F.col("state") == status) if status else docs
    needle = q.strip().lower()
    return out.where(F.lower(F.concat(F.coalesce("filename", F.lit("")), F.coalesce("folder", F.lit("")))).contains(needle)) if needle else out


def document_detail(docs: DataFrame, results: DataFrame, templates: DataFrame, filled: DataFrame) -> DataFrame:
    """Q5: each document with `classification` (template name, scores, band, fields in order), null if unclassified."""
    fields = filled.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("field_no", "name", "raw", "normalized", "valid"))).alias("fields"))
    r = results.join(templates.select("template_id", F.col("name").alias("template_name")), "template_id", "left").join(fields, "document_id", "left")
    nested = r.select("document_id", F.struct("template_id", "template_name", "confidence", "score", confidence_band(F.col("score")).alias("band"), "fields").alias("classification"))
    return docs.join(nested, "document_id", "left")


def block_family(docs: DataFrame, originals: DataFrame) -> DataFrame:
    """Q6: per original its file, number of documents, and their least and greatest id."""
    family = docs.groupBy("origin_id").agg(F.count("*").alias("documents"), F.min("document_id").alias("first_id"), F.max("document_id").alias("last_id"))
    return originals.select("origin_id", "filename").join(family, "origin_id", "left").withColumn("documents", F.coalesce("documents", F.lit(0)))
