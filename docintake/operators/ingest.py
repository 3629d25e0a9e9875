"""From files to documents: duplicate gate, folders, blocks, routes, quiet files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.naming import sanitize_component
from ..functions.text import file_name, is_supported_ext, stem, strip
from ..sources.files import blob_type


def _first_of_hash(files: DataFrame) -> DataFrame:
    """hash, first arrival: a map-side minimum, so one hash shared by most files does not fill one task."""
    return files.groupBy("hash").agg(F.min("arrival").alias("first_arrival"))


def ingest_gate(files: DataFrame, registry: DataFrame) -> DataFrame:
    """files(path, hash, arrival) with status ingested, duplicate or ignored. The first arrival of a new hash is ingested."""
    wanted = is_supported_ext(F.col("path"))
    first = _first_of_hash(files.where(wanted))
    known = registry.select("hash").distinct().withColumn("known", F.lit(True))
    seen = first.join(known, "hash", "left")
    status = F.when(~wanted, "ignored").when(F.col("known") | (F.col("arrival") != F.col("first_arrival")), "duplicate").otherwise("ingested")
    return files.join(seen, "hash", "left").withColumn("status", F.when(~wanted, "ignored").otherwise(status)).drop("known", "first_arrival")


def duplicate_hits(files: DataFrame, registry: DataFrame) -> DataFrame:
    """Hash, filename of the first arrival, later arrivals; a hash of the registry counts all of its files."""
    seen = files.where(is_supported_ext(F.col("path"))).groupBy("hash").agg(F.min_by(file_name(F.col("path")), "arrival").alias("filename"), F.count("*").alias("n"))
    known = registry.select("hash").distinct().withColumn("known", F.lit(1))
    return seen.join(known, "hash", "left").select("hash", "filename", (F.col("n") - 1 + F.coalesce("known", F.lit(0))).alias("duplicate_hits"))


def scan_outcome(files: DataFrame, registry: DataFrame, jobs: DataFrame) -> DataFrame:
    """Files with outcome enqueued, duplicate or skipped: known hash, hash queued or repeated in the scan, extension."""
    wanted = is_supported_ext(F.col("path"))
    first = _first_of_hash(files.where(wanted))
    known = registry.select("hash").distinct().withColumn("known", F.lit(True))
    queued = jobs.where("step = 'ingest'").select("hash").distinct().withColumn("queued", F.lit(True))
    seen = first.join(known, "hash", "left").join(queued, "hash", "left")
    outcome = (
        F.when(~wanted, "skipped")
        .when(F.col("known"), "duplicate")
        .when(F.col("queued") | (F.col("arrival") != F.col("first_arrival")), "skipped")
        .otherwise("enqueued")
    )
    return files.join(seen, "hash", "left").withColumn("outcome", outcome).drop("known", "queued", "first_arrival")


def scan_totals(outcomes: DataFrame) -> DataFrame:
    """One row with the number of enqueued files and of skipped duplicates."""
    return outcomes.agg(F.count_if(F.col("outcome") == "enqueued").alias("enqueued"), F.count_if(F.col("outcome") == "duplicate").alias("skipped_duplicates"))


def folder_of(files: DataFrame, folders: DataFrame) -> DataFrame:
    """I4: the first folder (by folder_id) that contains each file by whole path components, null if none.

    Every ancestor of a path becomes a row, so that the containment is an equality join of any size; files of equal
    ancestors share the look-up, since ancestors are joined once each.
    """
    parts = F.split(F.regexp_replace("path", "/[^/]*$", ""), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    parents = files.select(F.regexp_replace("path", "/[^/]*$", "").alias("parent"), F.explode(above).alias("ancestor")).distinct()
    found = parents.join(folders.select(F.col("path").alias("ancestor"), "folder_id"), "ancestor").groupBy("parent").agg(F.min("folder_id").alias("folder_id"))
    return files.withColumn("parent", F.regexp_replace("path", "/[^/]*$", "")).join(found, "parent", "left").drop("parent")


def block_ranges(files: DataFrame) -> DataFrame:
    """One row per block of files(file_id, page_count, pages_per_block): block, first_page, last_page."""
    count, n = F.coalesce("page_count", F.lit(0)), F.coalesce("pages_per_block", F.lit(0))
    size = F.when(n > 0, n).otherwise(F.greatest(count, F.lit(1)))
    starts = F.sequence(F.lit(1).cast("long"), F.greatest(count, F.lit(1)).cast("long"), size.cast("long"))
    rows = files.where(count > 0).select("*", size.alias("__size"), F.posexplode(starts).alias("block", "first_page"))
    return rows.withColumn("last_page", F.least(F.col("first_page") + F.col("__size") - 1, F.col("page_count"))).drop("__size")


def assign_blocks(pages: DataFrame, n: int | None) -> DataFrame:
    """document_id, block, first_page, last_page, text and content_hash of blocks of n pages (all pages if n is 0 or null)."""
    block = F.floor((F.col("page_number") - 1) / n).cast("long") if n else F.lit(0).cast("long")
    ordered = F.sort_array(F.collect_list(F.struct("page_number", F.coalesce("text", F.lit("")).alias("text"))))
    out = pages.withColumn("block", block).groupBy("document_id", "block").agg(F.min("page_number").alias("first_page"), F.max("page_number").alias("last_page"), ordered.alias("pages"))
    text = F.array_join(F.transform("pages", lambda p: p["text"]), "\n")
    return out.select("document_id", "block", "first_page", "last_page", text.alias("text"), F.sha2(text.cast("binary"), 256).alias("content_hash"))


def block_filename(name: Column, first: Column, last: Column) -> Column:
    """{stem}_p{a}.pdf or {stem}_p{a}-{b}.pdf"""
    pages = F.when(first == last, first.cast("string")).otherwise(F.concat_ws("-", first.cast("string"), last.cast("string")))
    return sanitize_component(F.concat(stem(name), F.lit("_p"), pages, F.lit(".pdf")))


def blocks_to_documents(blocks: DataFrame, documents: DataFrame) -> DataFrame:
    """I8: new documents of blocks(content_hash, origin_id, block): one per hash not there yet, from its first origin and block."""
    first = blocks.groupBy("content_hash").agg(F.min(F.struct("origin_id", "block")).alias("at"))
    new = first.join(documents.select("content_hash").distinct(), "content_hash", "left_anti")
    return new.select("content_hash", "at.origin_id", "at.block", F.lit("processando").alias("state"), F.lit("aguardando_extracao").alias("step"))


def block_counts(blocks: DataFrame) -> DataFrame:
    """I8: blocks per origin, those that made no document included."""
    return blocks.groupBy("origin_id").agg(F.count("*").alias("block_count"))


def duplicates_total(registry: DataFrame) -> DataFrame:
    """I10"""
    return registry.agg(F.coalesce(F.sum("duplicate_hits"), F.lit(0)).alias("total"))


def stable_files(observations: DataFrame, window_s: float = 4.0, piece: str = "hour") -> DataFrame:
    """Path, size, since, seen of files whose (size, mtime) did not change for window_s seconds up to the last look.

    observations(path, size, mtime, ts); a row with null size says that the file has gone. The looks at a path are
    summed up for each `piece` of time and the pieces put together, so that a path looked at often is no single task.
    """
    at = joined_looks(look_pieces(observations.withColumn("piece", F.date_trunc(piece, F.col("ts").cast("timestamp")))))
    quiet = F.col("seen").cast("timestamp").cast("double") - F.col("since").cast("timestamp").cast("double") >= window_s
    return at.where(F.col("size").isNotNull() & quiet)


def look_pieces(looks: DataFrame, *also: str) -> DataFrame:
    """path, piece (and what goes with them): the first and last state of a piece of time, when it last changed, began and ended."""
    by = Window.partitionBy("path", "piece").orderBy("ts")
    same = F.col("size").eqNullSafe(F.lag("size").over(by)) & F.col("mtime").eqNullSafe(F.lag("mtime").over(by))
    marked = looks.withColumn("change", F.when((F.row_number().over(by) > 1) & ~same, F.col("ts")))
    state = F.struct("size", "mtime")
    return marked.groupBy("path", "piece", *also).agg(
        F.min_by(state, "ts").alias("first"), F.max_by(state, "ts").alias("last"), F.max("change").alias("change"), F.min("ts").alias("begin"), F.max("ts").alias("seen")
    )


def joined_looks(pieces: DataFrame) -> DataFrame:
    """path, size, since, seen: the last state of each path, since when it holds, and when it was last looked at."""

    def follow(acc: Column, x: Column) -> Column:
        goes_on = x["change"].isNull() & F.coalesce(acc["last"] == x["first"], F.lit(False))
        return F.struct(x["last"].alias("last"), F.when(goes_on, acc["since"]).otherwise(F.coalesce(x["change"], x["begin"])).alias("since"), x["seen"].alias("seen"))

    kinds = dict(pieces.dtypes)
    start = F.struct(F.lit(None).cast(kinds["last"]).alias("last"), F.lit(None).cast(kinds["begin"]).alias("since"), F.lit(None).cast(kinds["seen"]).alias("seen"))
    ordered = F.sort_array(F.collect_list(F.struct("piece", "first", "last", "change", "begin", "seen")))
    return pieces.groupBy("path").agg(F.aggregate(ordered, start, follow).alias("at")).select("path", "at.last.size", "at.since", "at.seen")


def text_route(pages: DataFrame, min_chars: int = 16) -> DataFrame:
    """native_text where pages hold min_chars characters on average, else vision."""
    total, n = F.sum(F.length(strip(F.coalesce("text", F.lit(""))))), F.count("*")
    return pages.groupBy("document_id").agg(n.alias("page_count"), total.alias("chars"), F.when(total >= min_chars * n, "native_text").otherwise("vision").alias("route"))


def route_by_type(content: Column, native: Column) -> Column:
    """Images go to vision, PDFs by their text, anything else is an error."""
    kind = blob_type(content)
    return F.when(kind.isin("jpeg", "png"), "vision").when((kind == "pdf") & native, "native_text").when(kind == "pdf", "vision").otherwise("error")


def document_text(pages: DataFrame) -> DataFrame:
    """Page texts in page order, joined by line ends."""
    ordered = F.sort_array(F.collect_list(F.struct("page_number", F.coalesce("text", F.lit("")).alias("text"))))
    return pages.groupBy("document_id").agg(F.array_join(F.transform(ordered, lambda p: p["text"]), "\n").alias("full_text"))


def usage_ledger(answers: DataFrame) -> DataFrame:
    """One row for each paid call of answers(document_id, step, usage struct<input_tokens, output_tokens>).

    What was answered without a call has no usage and leaves no row; a call without a token count counts 0.
    """
    paid = answers.where(F.col("usage").isNotNull() & F.col("step").isin("extract", "classify"))
    return paid.select("document_id", "step", *[F.coalesce(f"usage.{n}", F.lit(0)).alias(to) for n, to in (("input_tokens", "prompt_tokens"), ("output_tokens", "completion_tokens"))])


def usage_totals(calls: DataFrame) -> DataFrame:
    """Tokens per document and step of the ledger of paid calls."""
    return calls.groupBy("document_id", "step").agg(F.count("*").alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"))
