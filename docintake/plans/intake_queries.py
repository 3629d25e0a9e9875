"""Queries of sources and ingestion: S, I and X."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import ingest
from ..sources import files as src
from .registry import query

#: The supported extension test in DuckDB.
EXT = r"lower(regexp_extract(path, '^(?:.*/)?[^/]+(\.[^./]+)$', 1)) IN ('.pdf', '.jpg', '.jpeg', '.png')"


def hashed(t):
    return t.files.withColumn("hash", src.content_hash(F.col("content"))).drop("content")


def registry(t):
    return hashed(t).where("arrival % 3 = 0").select("hash").distinct()


H = "h AS (SELECT arrival, path, size, sha256(content) AS hash FROM {files}), r AS (SELECT DISTINCT hash FROM h WHERE arrival % 3 = 0)"


@query("s1_scan_files", f"SELECT regexp_extract(path, '[^/]*$') AS name, octet_length(encode(content)) AS size, sha256(content) AS hash FROM {{files}} WHERE {EXT} AND content IS NOT NULL")
def s1(t):
    """The documents as files in a folder, listed and read back."""
    where = src.shared_folder(t.spark, "files")
    src.put_files(t.files, where)
    return src.scan_files(t.spark, where).select(text.file_name(F.col("path")).alias("name"), "size", src.content_hash(F.col("content")).alias("hash"))


@query("s2_supported_files", f"SELECT arrival, path, {EXT} AS supported FROM {{files}}")
def s2(t):
    return t.files.select("arrival", "path", text.is_supported_ext(F.col("path")).alias("supported"))


@query("s3_active_folders", "SELECT count(*) AS total, count_if(active) AS active FROM {folders}")
def s3(t):
    return t.folders.agg(F.count("*").alias("total"), F.count_if("active").alias("active"))


@query("s4_content_hash", "SELECT arrival, sha256(content) AS hash FROM {files}")
def s4(t):
    return hashed(t).select("arrival", "hash")


@query(
    "s5_blob_type",
    r"""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'jpeg' WHEN 2 THEN 'png' END AS kind FROM {documents}""",
)
def s5(t):
    magic = F.when(F.col("doc_id") % 4 == 0, F.unhex(F.lit("255044462D"))).when(F.col("doc_id") % 4 == 1, F.unhex(F.lit("FFD8"))).when(F.col("doc_id") % 4 == 2, F.unhex(F.lit("89504E470D0A1A0A"))).otherwise(F.unhex(F.lit("00")))
    content = F.concat(magic, F.col("text").cast("binary"))
    return t.documents.select("doc_id", src.blob_type(content).alias("kind"))


@query(
    "s7_read_pairs",
    """SELECT j.document_id, CASE WHEN j.document_id % 29 = 0 THEN '' ELSE concat_ws(';', 'Número_Pedido=ignored', CASE WHEN numero IS NOT NULL THEN 'numero  PEDIDO=' || numero END, 'VALOR total=' || valor, 'Data  Emissão=' || emissao, 'CNPJ=' || cnpj, CASE WHEN urgente IS NOT NULL THEN 'Urgente=' || urgente END) END AS pairs
       FROM {order_json} j JOIN {order_raw} r ON j.document_id = r.document_id""",
)
def s7(t):
    pairs = F.transform(src.read_pairs(F.col("fields_json")), lambda p: F.concat_ws("=", p["key"], p["value"]))
    return t.order_json.select("document_id", F.array_join(pairs, ";").alias("pairs"))


@query(
    "i1_ingest_gate",
    f"""WITH {H}, m AS (SELECT hash, min(arrival) AS first_arrival FROM h WHERE {EXT} GROUP BY hash)
       SELECT arrival, path, CASE WHEN NOT {EXT} THEN 'ignored' WHEN h.hash IN (SELECT hash FROM r) OR arrival <> first_arrival THEN 'duplicate' ELSE 'ingested' END AS status
       FROM h LEFT JOIN m ON h.hash = m.hash""",
)
def i1(t):
    return ingest.ingest_gate(hashed(t), registry(t)).select("arrival", "path", "status")


@query(
    "i2_duplicate_hits",
    f"""WITH {H} SELECT hash, regexp_extract(arg_min(path, arrival), '[^/]*$') AS filename, count(*) - 1 + CASE WHEN hash IN (SELECT hash FROM r) THEN 1 ELSE 0 END AS duplicate_hits
       FROM h WHERE {EXT} GROUP BY hash""",
)
def i2(t):
    return ingest.duplicate_hits(hashed(t), registry(t))


@query(
    "i3_scan_outcome",
    f"""WITH {H}, q AS (SELECT DISTINCT hash FROM h WHERE arrival % 7 = 1), m AS (SELECT hash, min(arrival) AS first_arrival FROM h WHERE {EXT} GROUP BY hash)
       SELECT arrival, CASE WHEN NOT {EXT} THEN 'skipped' WHEN h.hash IN (SELECT hash FROM r) THEN 'duplicate' WHEN h.hash IN (SELECT hash FROM q) OR arrival <> first_arrival THEN 'skipped' ELSE 'enqueued' END AS outcome
       FROM h LEFT JOIN m ON h.hash = m.hash""",
)
def i3(t):
    h = hashed(t)
    jobs = h.where("arrival % 7 = 1").select("hash", F.lit("ingest").alias("step"))
    return ingest.scan_outcome(h, registry(t), jobs).select("arrival", "outcome")


@query(
    "i3_scan_totals",
    f"""WITH {H}, q AS (SELECT DISTINCT hash FROM h WHERE arrival % 7 = 1), m AS (SELECT hash, min(arrival) AS first_arrival FROM h WHERE {EXT} GROUP BY hash)
       SELECT count_if(h.hash NOT IN (SELECT hash FROM r) AND h.hash NOT IN (SELECT hash FROM q) AND arrival = first_arrival) AS enqueued, count_if(h.hash IN (SELECT hash FROM r)) AS skipped_duplicates
       FROM h JOIN m ON h.hash = m.hash WHERE {EXT}""",
)
def i3_totals(t):
    h = hashed(t)
    jobs = h.where("arrival % 7 = 1").select("hash", F.lit("ingest").alias("step"))
    return ingest.scan_totals(ingest.scan_outcome(h, registry(t), jobs))


@query(
    "i4_folder_of",
    "SELECT f.arrival, min(d.folder_id) AS folder_id FROM {files} f LEFT JOIN {folders} d ON d.active AND (f.path = d.path OR starts_with(f.path, d.path || '/')) GROUP BY f.arrival",
)
def i4(t):
    return ingest.folder_of(t.files.select("arrival", "path"), src.active_folders(t.folders)).select("arrival", "folder_id")


@query(
    "i5_block_ranges",
    """WITH f AS (SELECT conv_id AS file_id, count(*) AS page_count, CASE WHEN conv_id % 4 = 0 THEN NULL ELSE conv_id % 4 - 1 END AS n FROM {conversations} GROUP BY conv_id),
       s AS (SELECT file_id, page_count, CASE WHEN coalesce(n, 0) > 0 THEN n ELSE page_count END AS size FROM f)
       SELECT file_id, b AS block, b * size + 1 AS first_page, least((b + 1) * size, page_count) AS last_page FROM s, unnest(range(0, CAST(ceil(page_count / size) AS BIGINT))) AS u(b)""",
)
def i5(t):
    f = t.conversations.groupBy(F.col("conv_id").alias("file_id")).agg(F.count("*").alias("page_count"))
    f = f.withColumn("pages_per_block", F.when(F.col("file_id") % 4 != 0, F.col("file_id") % 4 - 1))
    return ingest.block_ranges(f).select("file_id", "block", "first_page", "last_page")


BLOCKS = """b AS (SELECT document_id, CAST(floor((page_number - 1) / 2) AS BIGINT) AS block, min(page_number) AS first_page, max(page_number) AS last_page,
       sha256(string_agg(coalesce(text, ''), chr(10) ORDER BY page_number)) AS content_hash FROM {page_texts} GROUP BY 1, 2)"""


@query("i6_assign_blocks", f"WITH {BLOCKS} SELECT * FROM b")
def i6(t):
    return ingest.assign_blocks(t.page_texts, 2).drop("text")


@query(
    "i7_block_filename",
    f"WITH {BLOCKS} SELECT document_id, block, 'scan_' || document_id || '_p' || CASE WHEN first_page = last_page THEN CAST(first_page AS VARCHAR) ELSE first_page || '-' || last_page END || '.pdf' AS name FROM b",
)
def i7(t):
    b = ingest.assign_blocks(t.page_texts, 2)
    name = F.concat(F.lit("scan_"), F.col("document_id").cast("string"), F.lit(".pdf"))
    return b.select("document_id", "block", ingest.block_filename(name, F.col("first_page"), F.col("last_page")).alias("name"))


@query(
    "i8_blocks_to_documents",
    """WITH b AS (SELECT sha256(text) AS content_hash, doc_id % 40 AS origin_id, doc_id AS block FROM {documents}), known AS (SELECT DISTINCT content_hash FROM b WHERE block % 6 = 0)
       SELECT content_hash, origin_id, block, 'processando' AS state, 'aguardando_extracao' AS step FROM b WHERE content_hash NOT IN (SELECT content_hash FROM known)
       QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY origin_id, block) = 1""",
)
def i8(t):
    b = t.documents.select(F.sha2("text", 256).alias("content_hash"), (F.col("doc_id") % 40).alias("origin_id"), F.col("doc_id").alias("block"))
    return ingest.blocks_to_documents(b, b.where("block % 6 = 0").select("content_hash"))


@query("i8_block_counts", "SELECT doc_id % 40 AS origin_id, count(*) AS block_count FROM {documents} GROUP BY 1")
def i8_counts(t):
    return ingest.block_counts(t.documents.select((F.col("doc_id") % 40).alias("origin_id")))


@query("i10_duplicates_total", "SELECT CAST(coalesce(sum(duplicate_hits), 0) AS BIGINT) AS total FROM {originals}")
def i10(t):
    return ingest.duplicates_total(t.originals)


@query(
    "i11_stable_files",
    """WITH m AS (SELECT path, size, mtime, ts, CASE WHEN row_number() OVER w = 1 OR (size IS NOT DISTINCT FROM lag(size) OVER w AND mtime IS NOT DISTINCT FROM lag(mtime) OVER w) THEN 0 ELSE 1 END AS changed
         FROM {observations} WINDOW w AS (PARTITION BY path ORDER BY ts)),
       g AS (SELECT *, sum(changed) OVER (PARTITION BY path ORDER BY ts ROWS UNBOUNDED PRECEDING) AS island FROM m),
       i AS (SELECT path, island, min(size) AS size, min(ts) AS since, max(ts) AS seen FROM g GROUP BY path, island QUALIFY row_number() OVER (PARTITION BY path ORDER BY island DESC) = 1)
       SELECT path, size, epoch_us(since) AS since_us, epoch_us(seen) AS seen_us FROM i WHERE epoch_us(seen) - epoch_us(since) >= 3600000000""",
)
def i11(t):
    out = ingest.stable_files(t.observations, 3600)
    return out.select("path", "size", F.unix_micros(F.col("since").cast("timestamp")).alias("since_us"), F.unix_micros(F.col("seen").cast("timestamp")).alias("seen_us"))


@query(
    "x1_text_route",
    r"""SELECT document_id, count(*) AS page_count, CAST(sum(length(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g'))) AS BIGINT) AS chars,
       CASE WHEN sum(length(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g'))) >= 400 * count(*) THEN 'native_text' ELSE 'vision' END AS route FROM {page_texts} GROUP BY 1""",
)
def x1(t):
    return ingest.text_route(t.page_texts, 400)


@query("x2_route_by_type", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN CASE WHEN n_chars >= 1000 THEN 'native_text' ELSE 'vision' END WHEN 1 THEN 'vision' ELSE 'error' END AS route FROM {documents}")
def x2(t):
    magic = F.when(F.col("doc_id") % 3 == 0, F.unhex(F.lit("255044462D"))).when(F.col("doc_id") % 3 == 1, F.unhex(F.lit("FFD8FF"))).otherwise(F.lit(b""))
    content = F.concat(magic, F.col("text").cast("binary"))
    return t.documents.select("doc_id", ingest.route_by_type(content, F.col("n_chars") >= 1000).alias("route"))


@query("x3_document_text", "SELECT document_id, sha256(string_agg(coalesce(text, ''), chr(10) ORDER BY page_number)) AS text_hash FROM {page_texts} GROUP BY 1")
def x3(t):
    return ingest.document_text(t.page_texts).select("document_id", F.sha2("full_text", 256).alias("text_hash"))


@query("x4_usage_rows", "SELECT document_id, step, prompt_tokens, CASE WHEN document_id % 4 = 0 THEN 0 ELSE completion_tokens END AS completion_tokens FROM {usage} WHERE (document_id + completion_tokens) % 3 > 0")
def x4_rows(t):
    called = (F.col("document_id") + F.col("completion_tokens")) % 3 > 0
    usage = F.struct(F.col("prompt_tokens").alias("input_tokens"), F.when(F.col("document_id") % 4 != 0, F.col("completion_tokens")).alias("output_tokens"))
    return ingest.usage_ledger(t.usage.select("document_id", "step", F.when(called, usage).alias("usage")))


@query("x4_usage_ledger", "SELECT document_id, step, count(*) AS calls, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens FROM {usage} GROUP BY 1, 2")
def x4(t):
    return ingest.usage_totals(t.usage)


@query(
    "w1_ingest",
    f"""WITH {H}, m AS (SELECT hash, min(arrival) AS first_arrival FROM h WHERE {EXT} GROUP BY hash),
       i AS (SELECT h.* FROM h JOIN m ON h.hash = m.hash AND arrival = first_arrival WHERE {EXT} AND h.hash NOT IN (SELECT hash FROM r)),
       d AS (SELECT i.arrival, i.hash, min(f.folder_id) AS folder_id FROM i LEFT JOIN {{folders}} f ON f.active AND starts_with(i.path, f.path || '/') GROUP BY 1, 2)
       SELECT folder_id, count(*) AS originals, min(arrival) AS first_arrival FROM d GROUP BY 1""",
)
def w1(t):
    """Workload 1: scan, hash, gate, folder; originals per watched folder."""
    # contents are read and hashed once; the gate, the registry and the folders work on paths and hashes
    files = src.staged(hashed(t).drop("size"))
    known = files.where("arrival % 3 = 0").select("hash").distinct()
    gated = src.staged(ingest.ingest_gate(files, known).where("status = 'ingested'").select("arrival", "path"))
    return ingest.folder_of(gated, src.active_folders(t.folders)).groupBy("folder_id").agg(F.count("*").alias("originals"), F.min("arrival").alias("first_arrival"))
