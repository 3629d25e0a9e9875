"""Streaming forms: file streams, the duplicate gate, quiet files, live states and counts.

What a stream must remember lives in Parquet tables that are partitioned by what a batch looks up: by hash prefix, by
key, by piece of time. A batch reads the partitions it touches, and writes under its own number or replaces whole partitions
from rows it can read again, so that a batch that runs again changes nothing. No state store grows with the stream.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..config import Template
from ..functions.text import file_name, is_supported_ext
from ..operators.ingest import ingest_gate, joined_looks, look_pieces
from ..operators.lifecycle import joined_replays, replay_pieces
from ..operators.signals import decide, haystacks, match_templates
from ..sources.files import BUCKETS, GLOB, LISTED, bucket_of, existing, listed, not_staged, own_uri, put_once, replace_partitions, with_content

REGISTRY = "path string, hash string, arrival long, status string, prefix string, batch long"
#: Hexadecimal digits of a hash that name its partition of the registry.
DIGITS = 2
#: A batch that touches more parts than this lists none in its filters: it is a backfill that reads most of them.
MOST_PARTS = 2_000
#: Files in one batch of a file stream: what the driver holds for a batch (statuses, splits) stays bounded.
FILES = 100_000
#: Names in one file of a listing, and such files in one batch.
NAMES_EACH, LISTS = 2_000, 100
#: Settings for batches of many small files: some 500 of them in a task instead of 32, and listed by few tasks, not 10,000.
SMALL_FILES = {"spark.sql.files.openCostInBytes": 256 << 10, "spark.sql.sources.parallelPartitionDiscovery.parallelism": 96}


@contextmanager
def lowered(spark: SparkSession, settings: dict[str, int]) -> Iterator[None]:
    """Settings of the session at these values at most; afterwards they are as before."""
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, most in settings.items():
            if before[k] is None or not before[k].isdigit() or int(before[k]) > most:
                spark.conf.set(k, str(most))
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def file_stream(spark: SparkSession, root: str, most: int = FILES) -> DataFrame:
    """New supported files below root as path, content, size, modified; others are not opened, as in scan_files().

    A batch holds `most` files at most; no file is left out, the rest come in further batches. A file source goes by the
    settings of this session while it runs, so a stream of many small files runs within lowered(spark, SMALL_FILES).
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", GLOB).option("maxFilesPerTrigger", most).load(root)
    return files.where(is_supported_ext(F.col("path"))).select("path", "content", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def listed_stream(spark: SparkSession, root: str, listings: str, most: int = LISTS) -> DataFrame:
    """T1 for any number of files: what file_stream() gives, of the files that are below root when it is called.

    New files are listed by tasks and written to the table at `listings`, which remembers all that ever came; the stream
    runs over the files of that table, `most` in a batch, and its tasks read what they name. So the driver, whose file
    source holds every path that it has seen, holds one in NAMES_EACH. A store that only Spark reaches goes by file_stream().
    """
    uri = own_uri(spark, root)
    if uri is None:
        return file_stream(spark, root)
    found, known = listed(spark, uri), existing(spark, listings, LISTED)
    new = found if known is None else found.join(known.select("name"), "name", "left_anti")
    n = new.count()
    if n or known is None:
        new.repartition(-(-n // NAMES_EACH) or 1, "name").write.mode("append").parquet(listings)
    rows = spark.readStream.schema(LISTED).option("maxFilesPerTrigger", most).parquet(listings)
    return with_content(rows, uri)


def table_stream(spark: SparkSession, path: str, schema: StructType, files: int = 4) -> DataFrame:
    """A table of Parquet files as a stream of its files, so many in a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def _run(rows: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def known_hashes(spark: SparkSession, registry_path: str, prefixes: list[str], before: int) -> DataFrame:
    """Hashes that batches before `before` have ingested, from the partitions of the prefixes alone."""
    known = existing(spark, registry_path, REGISTRY)
    if known is None:
        return spark.createDataFrame([], "hash string")
    return known.where(F.col("prefix").isin(prefixes) & (F.col("batch") < before) & (F.col("status") == "ingested")).select("hash")


def gate_stream(files: DataFrame, registry_path: str, checkpoint: str, digits: int = DIGITS) -> StreamingQuery:
    """files(path, hash, arrival) through the gate; the registry of all hashes ever seen lives in Parquet and never forgets.

    It is partitioned by the first `digits` of the hash and by batch. A batch reads the prefixes it holds itself.
    """

    def batch(rows: DataFrame, number: int) -> None:
        rows = rows.withColumn("prefix", F.substring("hash", 1, digits))
        prefixes = sorted(r[0] for r in rows.select("prefix").distinct().collect() if r[0] is not None)
        gated = ingest_gate(rows, known_hashes(rows.sparkSession, registry_path, prefixes, number))
        replace_partitions(gated.select("path", "hash", "arrival", "status", "prefix", F.lit(number).cast("long").alias("batch")), registry_path, "prefix", "batch")

    return _run(files, batch, checkpoint)


def registry_hits(registry: DataFrame) -> DataFrame:
    """Hash, filename of its first arrival, and how often it came again."""
    first = F.min_by(file_name(F.col("path")), F.when(F.col("status") == "ingested", F.struct("batch", "arrival")))
    return registry.where("status <> 'ignored'").groupBy("hash").agg(first.alias("filename"), F.count_if(F.col("status") == "duplicate").alias("duplicate_hits"))


Summed, Joined = Callable[..., DataFrame], Callable[[DataFrame], DataFrame]


def fold_batch(new: DataFrame, number: int, key: str, piece: str, summed: Summed, joined: Joined, path: str, part: str = "day", buckets: int = BUCKETS) -> None:
    """One batch of rows with a time `ts`, folded by key in order of time however late they come.

    The batch lands its rows by `part` of time and by bucket of the key, sums up anew the pieces in the parts that it
    touches (`summed`, one row for each key and `piece`) from all rows landed there, and puts together (`joined`) the
    pieces of the keys that it touches. Below path: `rows`, `pieces`, and `results` by batch; see latest(). What it
    reads is the parts it touches and the summaries of its buckets, however many batches came before. A batch that runs
    again under its number changes nothing.
    """
    spark, places = new.sparkSession, {"part": StringType(), "bucket": LongType()}
    cut = lambda unit: F.date_trunc(unit, F.col("ts").cast("timestamp"))
    name = F.coalesce(F.date_format(cut(part), "yyyy-MM-dd-HH"), F.lit("0000"))
    schema = StructType([*new.schema.fields, *[StructField(n, k) for n, k in places.items()], StructField("batch", LongType())])
    replace_partitions(new.withColumns({"part": name, "bucket": bucket_of(key, buckets).cast("long"), "batch": F.lit(number).cast("long")}), f"{path}/rows", *places, "batch")
    landed = existing(spark, f"{path}/rows", schema)
    if landed is None:
        return  # nothing has come yet
    landed = landed.where(F.col("batch") <= number)
    own = landed.where(F.col("batch") == number)
    mine = sorted(map(tuple, own.select(*places).distinct().limit(MOST_PARTS + 1).collect()))
    few = len(mine) <= MOST_PARTS
    here = F.col("bucket").isin(sorted({b for _, b in mine})) if few else F.lit(True)
    touched = here & F.col("part").isin(sorted({p for p, _ in mine})) if few else F.lit(True)
    sums = summed(landed.where(touched).withColumn("piece", cut(piece)), *places)
    replace_partitions(sums, f"{path}/pieces", *places)
    kinds = StructType([*[f for f in sums.schema.fields if f.name not in places], *[StructField(n, k) for n, k in places.items()]])
    keys = own.select(F.col(key).alias("__key")).distinct()
    known = spark.read.schema(kinds).parquet(f"{path}/pieces").where(here)
    joined(known.join(keys, F.col(key).eqNullSafe(F.col("__key")), "left_semi")).write.mode("overwrite").parquet(f"{path}/results/batch={number}")


def by_pieces(rows: DataFrame, key: str, piece: str, summed: Summed, joined: Joined, path: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """fold_batch() for every batch of a stream."""
    return _run(rows, lambda new, number: fold_batch(new, number, key, piece, summed, joined, path, buckets=buckets), checkpoint)


def latest(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The last result of each key of by_pieces()."""
    found = spark.read.parquet(f"{path}/results")
    others = [c for c in found.columns if c not in (key, "batch")]
    return found.groupBy(key).agg(F.max_by(F.struct(*others), "batch").alias("__last")).select(key, "__last.*")


def quiet_files(observations: DataFrame, path: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """observations(path, size, mtime, ts) -> for each path its last (size, mtime), since when it holds, and the last look.

    quiet() tells which of latest() are quiet at the time that the looks have reached.
    """
    return by_pieces(observations, "path", "hour", look_pieces, joined_looks, path, checkpoint, buckets)


def quiet(files: DataFrame, window_s: float = 4.0) -> DataFrame:
    """Path, size, since of files that are there and have not changed for window_s seconds up to the last look at any file."""
    now = files.agg(F.unix_micros(F.max("seen").cast("timestamp"))).first()[0]
    past = F.unix_micros(F.col("since").cast("timestamp")) + int(window_s * 1_000_000) < F.lit(now).cast("long")
    return files.where(F.col("size").isNotNull() & past).select("path", "size", "since")


def live_states(log: DataFrame, path: str, checkpoint: str, initial: str = "recebido", buckets: int = BUCKETS) -> StreamingQuery:
    """T4: log(document_id, ts, id, to_state, step) -> the state of each document after every batch that touches it.

    What is kept of a day of a document is where the day leads from each state; a request that comes late folds its own
    day anew.
    """
    return by_pieces(log, "document_id", "day", partial(replay_pieces, initial=initial), partial(joined_replays, initial=initial), path, checkpoint, buckets)


def replay_more(new: DataFrame, number: int, path: str, initial: str = "recebido", buckets: int = BUCKETS) -> DataFrame:
    """L2 from snapshots: the states of all documents after a further part of the log; number counts the parts.

    Only days that have new requests are replayed, those of other days stand in the summaries below path.
    """
    fold_batch(new, number, "document_id", "day", partial(replay_pieces, initial=initial), partial(joined_replays, initial=initial), path, buckets=buckets)
    return latest(new.sparkSession, path, "document_id")


def classify_stream(texts: DataFrame, templates: list[Template], table_path: str, checkpoint: str) -> StreamingQuery:
    """T5: texts(document_id, full_text) classified as they come; each document is written once, whatever runs again.

    Documents that another batch has written are left out before they are classified.
    """

    def batch(rows: DataFrame, number: int) -> None:
        new = not_staged(rows, table_path, "document_id", number)
        decided = decide(match_templates(haystacks(new), templates)).select("document_id", "decision", "template_id", "confidence")
        put_once(decided, table_path, "document_id", number)

    return _run(texts, batch, checkpoint)


def land_batches(rows: DataFrame, mode: str, table_path: str, checkpoint: str) -> StreamingQuery:
    """Every batch of a stream under its own number, so that one that runs again replaces what it wrote."""
    run = rows.writeStream.outputMode(mode).foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{table_path}/batch={number}"))
    return run.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live_counts(docs: DataFrame) -> DataFrame:
    """Documents per state, kept up to date."""
    return docs.groupBy("state").agg(F.count("*").alias("n"))
