"""Files, registries and tables as inputs, and the sink that writes each key once."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce
from typing import TYPE_CHECKING

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import EXTENSIONS, file_name, is_supported_ext

if TYPE_CHECKING:
    from pyarrow.fs import FileSystem

#: Partitions by key of a table that grows batch by batch.
BUCKETS = 16
#: Supported extensions in any case, for a listing; the list itself is in functions.text.
GLOB = "*.{" + ",".join("".join(f"[{c}{c.upper()}]" for c in e[1:]) for e in EXTENSIONS) + "}"
#: Folders, and paths, that a task remembers to have made.
FOLDERS, PATHS = 10_000, 100_000
#: Files and bytes that one task reads at most on average, where that makes more tasks than there are cores.
FILES_EACH, BYTES_EACH = 5_000, 128 << 20
#: Rows and bytes of contents in one batch between a task and its worker, folders that one task lists on average.
ROWS_AT_ONCE, BYTES_AT_ONCE, FOLDERS_EACH = 1_000, 4 << 20, 100
LISTED = "name string, size long, modified timestamp"
PAIR = "array<struct<key:string,value:string,confidence:double>>"


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder in the place that the session names for checkpoints, else (tests, a notebook) next to the warehouse."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}-{kind}s"
    return f"{base.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: a narrow result that several steps read is worked out once."""
    where = shared_folder(df.sparkSession, "stage")
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


def own_uri(spark: SparkSession, root: str) -> str | None:
    """root as a URI that tasks can list and read by themselves; None for a pattern and for a store that only Spark reaches."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    if any(c in uri for c in "*?[]{}"):
        return None
    try:
        opened(uri)
    except (OSError, ValueError):
        return None
    return uri


def opened(uri: str) -> tuple[FileSystem, str]:
    """The store of a URI, or of a local path, and the place in it."""
    from pyarrow.fs import FileSystem, LocalFileSystem

    if uri.startswith("file:") or "://" not in uri:
        return LocalFileSystem(), "/" + uri.removeprefix("file:").strip("/")
    store, base = FileSystem.from_uri(uri)
    return store, base.rstrip("/")


def listed(spark: SparkSession, uri: str) -> DataFrame:
    """name (from uri on), size, modified of all supported files below uri, staged; a folder that is not there has none.

    Folders are listed by tasks, level by level, and what they hold stays in tables, so the driver knows of no file. One
    task lists one folder as a whole.
    """
    kinds = pa.schema([("name", pa.string()), ("folder", pa.bool_()), ("size", pa.int64()), ("modified", pa.timestamp("us", "UTC"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSelector, FileType

        store, base = opened(uri)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                found = [x for x in store.get_file_info(FileSelector(base + folder, allow_not_found=True)) if x.type in (FileType.File, FileType.Directory)]
                for at in range(0, len(found), ROWS_AT_ONCE):
                    part = found[at : at + ROWS_AT_ONCE]
                    columns = [f"{folder}/{x.base_name}" for x in part], [x.type == FileType.Directory for x in part], [x.size for x in part], [(x.mtime_ns or 0) // 1000 for x in part]
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=k.type) for c, k in zip(columns, kinds, strict=True)], schema=kinds)

    level, files, cores = spark.createDataFrame([("",)], "name string"), [], spark.sparkContext.defaultParallelism
    folders = 1
    while folders:
        tasks = min(folders, max(cores, folders // FOLDERS_EACH))
        here = staged(level.repartition(tasks, "name").mapInArrow(run, "name string, folder boolean, size long, modified timestamp").where(F.col("folder") | is_supported_ext(F.col("name"))))
        files.append(here.where("not folder").drop("folder"))
        level = here.where("folder").select("name")
        folders = level.count()
    return reduce(DataFrame.union, files)


def with_content(found: DataFrame, uri: str) -> DataFrame:
    """path, content, size, modified of files that listed() found, read by the tasks that hold their names."""
    target = pa.schema([("path", pa.string()), ("content", pa.binary()), ("size", pa.int64()), ("modified", pa.timestamp("us", "UTC"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = opened(uri)
        shown = f"file:{base}" if uri.startswith("file:") else uri.rstrip("/")
        for batch in batches:
            names, first, held, contents = batch.column(0).to_pylist(), 0, 0, []
            for i, name in enumerate(names):
                with store.open_input_file(base + name) as file:
                    contents.append(file.read())
                held += len(contents[-1])
                if held >= BYTES_AT_ONCE or len(contents) == ROWS_AT_ONCE or i + 1 == len(names):
                    n = i + 1 - first
                    paths = pa.array([shown + x for x in names[first : i + 1]], type=pa.string())
                    yield pa.RecordBatch.from_arrays([paths, pa.array(contents, type=pa.binary()), *(batch.column(c).slice(first, n) for c in (1, 2))], schema=target)
                    first, held, contents = i + 1, 0, []

    return found.select("name", "size", F.col("modified").cast("timestamp").alias("modified")).mapInArrow(run, "path string, content binary, size long, modified timestamp")


def scan_files(spark: SparkSession, root: str) -> DataFrame:
    """Path, content, size, modified of all supported files below root, whatever the case of their extension.

    Files are chosen by name while they are listed, so that others are never opened. Tasks list and read them, so the
    driver holds nothing that grows with them; a store that only Spark reaches, or a pattern, goes by Spark's own source,
    whose listing the driver holds and which passes over names that begin with a dot or an underscore.
    """
    uri = own_uri(spark, root)
    if uri is not None:
        found = listed(spark, uri)
        n, size = found.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
        tasks = max(min(n, spark.sparkContext.defaultParallelism), n // FILES_EACH, size // BYTES_EACH, 1)
        return with_content(found.repartition(tasks, "name"), uri)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", GLOB).load(root)
    return files.where(is_supported_ext(F.col("path"))).select("path", "content", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def supported_files(files: DataFrame) -> DataFrame:
    """files(path, ...) with a supported extension, and their name."""
    return files.where(is_supported_ext(F.col("path"))).withColumn("name", file_name(F.col("path")))


def active_folders(folders: DataFrame) -> DataFrame:
    """S3"""
    return folders.where("active")


def spread(df: DataFrame, scan: DataFrame, key: str) -> DataFrame:
    """df over all cores by key where scan, the table it comes from, has fewer splits than there are cores.

    A table with enough splits is left as it is, so that a large one is never shuffled for this. `scan` must be a plain
    read: its splits are counted from the file listing, without a job.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if scan.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def content_hash(content: Column) -> Column:
    """SHA-256 in hex of bytes, or of the UTF-8 of a text."""
    return F.sha2(content.cast("binary"), 256)


def blob_type(content: Column) -> Column:
    """Pdf, jpeg or png by the first bytes; null for anything else."""
    def starts(magic: str) -> Column:
        return F.startswith(content, F.unhex(F.lit(magic)))

    return F.when(starts("255044462D"), "pdf").when(starts("FFD8"), "jpeg").when(starts("89504E470D0A1A0A"), "png")


def read_pairs(fields_json: Column) -> Column:
    """The key-value pairs of a JSON list; what cannot be read is an empty list, a missing value is ''."""
    pairs = F.coalesce(F.from_json(fields_json, PAIR), F.array().cast(PAIR))
    return F.transform(
        F.filter(pairs, lambda p: p["key"].isNotNull()),
        lambda p: F.struct(p["key"].alias("key"), F.coalesce(p["value"], F.lit("")).alias("value"), p["confidence"].alias("confidence")),
    )


def existing(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame | None:
    """The Parquet table at path, or None where there is none yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def bucket_of(key: str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


def replace_partitions(df: DataFrame, path: str, *partitions: str) -> None:
    """Writes df by its partitions; those that it has replace what was there, so that a batch can run again."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def not_staged(df: DataFrame, path: str, key: str, batch: int | None = None) -> DataFrame:
    """The rows of df whose key no other batch has written to the table at path; only the buckets of these keys are read."""
    there = existing(df.sparkSession, path, f"{key} {dict(df.dtypes)[key]}, bucket int, batch long")
    if there is None:
        return df
    buckets = [r[0] for r in df.select(bucket_of(key).alias("bucket")).distinct().collect()]
    there = there.where(F.col("bucket").isin(buckets))
    return df.join(there.where(F.col("batch") != batch) if batch is not None else there, key, "left_anti")


def put_once(new: DataFrame, path: str, key: str, batch: int | None = None) -> None:
    """Writes rows that are not in the table yet; of rows with one key the one with the least hash of its columns counts."""
    others = F.struct(*[c for c in new.columns if c != key])
    one = new.groupBy(key).agg(F.min_by(others, F.xxhash64(F.to_json(others))).alias("__row")).select(key, "__row.*").select(*new.columns)
    marked = one.withColumns({"bucket": bucket_of(key), "batch": F.lit(-1 if batch is None else batch).cast("long")})
    if batch is None:
        marked.write.mode("append").partitionBy("bucket", "batch").parquet(path)
    else:
        replace_partitions(marked, path, "bucket", "batch")


def write_stage(df: DataFrame, path: str, key: str, batch: int | None = None) -> None:
    """Appends the rows whose key is not in the table at path yet, so that a second run adds nothing.

    The table is partitioned by a hash of the key and by batch: a run reads the keys of its own buckets only, and a
    numbered batch that runs again replaces what it wrote. staged_table() reads the table.
    """
    put_once(not_staged(df, path, key, batch), path, key, batch)


def staged_table(spark: SparkSession, path: str) -> DataFrame:
    """What write_stage() wrote, without its partitions."""
    return spark.read.parquet(path).drop("bucket", "batch")


def put_files(files: DataFrame, root: str) -> None:
    """Writes each row of files(path, content) with a content as a file of its own below root.

    Each task writes below a folder of its own, and begins another one when a path comes again, so that rows with one path
    are as many files.
    """

    def write(rows: Iterator[Row]) -> None:
        from pyspark import TaskContext

        (store, base), task = opened(root), TaskContext.get().partitionId()
        part, made, there = 0, set(), set()
        for row in rows:
            name = row.path.lstrip("/")
            if name in there or len(there) == PATHS:
                part, there = part + 1, set()
            there.add(name)
            where = f"{base}/{task}-{part}/{name}"
            folder = where.rsplit("/", 1)[0]
            if folder not in made:
                store.create_dir(folder, recursive=True)
                made = made if len(made) < FOLDERS else set()
                made.add(folder)
            with store.open_output_stream(where) as out:
                out.write(bytes(row.content))

    files.select("path", F.col("content").cast("binary").alias("content")).where("path is not null and content is not null").foreachPartition(write)
