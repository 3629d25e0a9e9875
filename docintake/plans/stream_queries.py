"""Queries that run a stream over a given table to its end."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..config import STATES
from ..functions.text import file_name
from ..sources.files import put_files, shared_folder, staged_table, write_stage
from ..streaming import ops
from .classify_queries import HITS, TEMPLATES
from .inputs import INPUTS
from .intake_queries import EXT
from .registry import query
from .report_queries import REPLAYED

#: Buckets of keys in the tables of a stream over one small file.
FEW = 2
STATE_OF = {"signup": "processando", "view": "em_revisao", "click": "quarentena", "purchase": "concluido"}


def _folder(t) -> str:
    return shared_folder(t.spark, "stream")


def _events(t):
    # a pattern, so that the table may be one file or a folder of files
    rows = ops.table_stream(t.spark, f"{t.sf_dir}/events*.parquet", t.events.schema)
    state = F.lit("falha")
    for event, name in STATE_OF.items():
        state = F.when(F.col("event_type") == event, name).otherwise(state)
    return rows.withColumn("state", state)


@query("t6_live_counts", f"WITH s AS (SELECT to_state AS state FROM {{state_log}}) SELECT state, count(*) AS n FROM s GROUP BY 1")
def t6(t):
    name = f"live_{uuid.uuid4().hex}"
    run = ops.live_counts(_events(t)).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", _folder(t)).trigger(availableNow=True).start()
    run.awaitTermination()
    return t.spark.table(name).where(F.col("state").isin(*STATES))


def _gated(t):
    where = _folder(t)
    files = _events(t).select(F.concat(F.lit("/in/"), F.col("event_id").cast("string"), F.lit(".pdf")).alias("path"), F.sha2(F.col("user_id").cast("string"), 256).alias("hash"), F.col("event_id").alias("arrival"))
    ops.gate_stream(files, f"{where}/registry", f"{where}/checkpoint").awaitTermination()
    return t.spark.read.parquet(f"{where}/registry")


@query(
    "t2_streaming_gate",
    "SELECT CASE WHEN status = 1 THEN 'ingested' ELSE 'duplicate' END AS status, count(*) AS n FROM (SELECT row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS status FROM {events}) GROUP BY 1",
)
def t2(t):
    return _gated(t).groupBy("status").agg(F.count("*").alias("n"))


@query("t2_registry_hits", "SELECT sha256(CAST(user_id AS VARCHAR)) AS hash, CAST(min(event_id) AS VARCHAR) || '.pdf' AS filename, count(*) - 1 AS duplicate_hits FROM {events} GROUP BY user_id")
def t2_hits(t):
    return ops.registry_hits(_gated(t))


def _input(t, name: str, table: str):
    """An input that needs one given table, over the stream of that table's files."""
    rows = ops.table_stream(t.spark, f"{t.sf_dir}/{table}*.parquet", getattr(t, table).schema)
    return t.spark.sql(INPUTS[name], **{table: rows})


@query("s8_write_stage", "SELECT document_id, CASE WHEN state = 'em_revisao' THEN 'first' ELSE 'second' END AS run FROM {docs}")
def s8(t):
    where = f"{_folder(t)}/stage"
    write_stage(t.docs.where("state = 'em_revisao'").select("document_id", F.lit("first").alias("run")), where, "document_id")
    write_stage(t.docs.select("document_id", F.lit("second").alias("run")), where, "document_id")
    return staged_table(t.spark, where)


@query("t1_file_stream", f"SELECT regexp_extract(path, '[^/]*$') AS name, octet_length(encode(content)) AS size, sha256(content) AS hash FROM {{files}} WHERE {EXT} AND content IS NOT NULL")
def t1(t):
    """The documents as files in a folder that a stream watches."""
    where = _folder(t)
    put_files(t.files, f"{where}/in")
    rows = ops.listed_stream(t.spark, f"{where}/in", f"{where}/listings").select(file_name(F.col("path")).alias("name"), "size", F.sha2("content", 256).alias("hash"))
    ops.land_batches(rows, "append", f"{where}/rows", f"{where}/checkpoint").awaitTermination()
    return t.spark.read.parquet(f"{where}/rows").drop("batch")


@query(
    "t3_quiet_files",
    """WITH m AS (SELECT path, size, mtime, ts, CASE WHEN row_number() OVER w = 1 OR (size IS NOT DISTINCT FROM lag(size) OVER w AND mtime IS NOT DISTINCT FROM lag(mtime) OVER w) THEN 0 ELSE 1 END AS changed
         FROM {observations} WINDOW w AS (PARTITION BY path ORDER BY ts)),
       g AS (SELECT *, sum(changed) OVER (PARTITION BY path ORDER BY ts ROWS UNBOUNDED PRECEDING) AS island FROM m),
       i AS (SELECT path, island, min(size) AS size, min(ts) AS since FROM g GROUP BY path, island QUALIFY row_number() OVER (PARTITION BY path ORDER BY island DESC) = 1)
       SELECT path, size, epoch_us(since) AS since_us FROM i WHERE size IS NOT NULL AND epoch_us(since) + 7200000000 < (SELECT max(epoch_us(ts)) FROM {observations})""",
)
def t3(t):
    seen = _input(t, "observations", "events").withColumn("ts", F.col("ts").cast("timestamp"))
    where = _folder(t)
    ops.quiet_files(seen, where, f"{where}/checkpoint", FEW).awaitTermination()
    return ops.quiet(ops.latest(t.spark, where, "path"), 7200).select("path", "size", F.unix_micros("since").alias("since_us"))


@query("t4_live_states", REPLAYED)
def t4(t):
    where = _folder(t)
    ops.live_states(_input(t, "state_log", "events").withColumn("ts", F.col("ts").cast("timestamp")), where, f"{where}/checkpoint", buckets=FEW).awaitTermination()
    return ops.latest(t.spark, where, "document_id")


@query("l2_replay_more", REPLAYED)
def l2_more(t):
    """The log in three parts, each of which holds requests of all times."""
    where = _folder(t)
    for k in range(3):
        out = ops.replay_more(t.state_log.where(F.col("id") % 3 == (k + 1) % 3), k, where, buckets=FEW)
    return out


@query("t5_classify_stream", f"WITH {HITS} SELECT document_id, decision, template_id, CASE WHEN decision = 'matched' THEN 1.0 END AS confidence FROM d")
def t5(t):
    where = _folder(t)
    ops.classify_stream(_input(t, "texts", "documents"), TEMPLATES, f"{where}/results", f"{where}/checkpoint").awaitTermination()
    return staged_table(t.spark, f"{where}/results")
