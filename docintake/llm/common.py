"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Hashable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of one Arrow batch between the JVM and a Python worker, so that long texts do not pile up: a task holds a batch
#: several times, as vectors that grow by doubling, as the message that is sent, and in the worker.
BATCH_BYTES = 4 << 20

#: Rows that one call of a batch function sees.
ROWS_PER_CALL = 256

#: Maps A-Z to a-z and leaves every other byte (UTF-8 parts included) alone.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Caps the bytes of an Arrow batch in this session unless a smaller cap is set."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if now is None or not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def map_batches(
    df: DataFrame, fn: Callable[[dict[str, list]], dict[str, Sequence]], schema: str, setup: Callable[[], None] | None = None
) -> DataFrame:
    """Runs fn over column lists of at most ROWS_PER_CALL rows inside mapInArrow.

    fn gets {column: list of values} and returns {column: sequence} in the order of schema; the number of rows
    may differ. Partitioning is kept and nothing is shuffled.
    """
    bound_batches(df.sparkSession)
    target = to_arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if setup:
            setup()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_PER_CALL):
                part = batch.slice(at, ROWS_PER_CALL)
                out = fn({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)


def add_columns(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, Sequence]], reads: list[str], schema: str) -> DataFrame:
    """df with the columns of schema, which fn makes from the columns `reads`; all other columns pass through untouched."""
    bound_batches(df.sparkSession)
    target = to_arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_PER_CALL):
                part = batch.slice(at, ROWS_PER_CALL)
                out = fn({n: part.column(n).to_pylist() for n in reads})
                new = [pa.array(out[f.name], type=f.type) for f in target]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*part.schema.names, *target.names])

    full = StructType([*df.schema.fields, *StructType.fromDDL(schema).fields])
    return df.mapInArrow(run, full)


def text_key() -> F.Column:
    """Hash of the text, null as empty; with doc_id it names a row among rows of one id."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def to_arrow(schema: str) -> pa.Schema:
    kinds = {
        "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "string": pa.string(),
        "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()),
        "array<float>": pa.list_(pa.float32()), "array<string>": pa.list_(pa.string()),
    }
    return pa.schema([(n, kinds[k]) for n, k in (part.strip().split(" ") for part in schema.split(","))])


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; only where that is unset, one next to the warehouse."""
    named = spark.sparkContext._jsc.sc().getCheckpointDir()
    if named.isDefined():
        return named.get()
    return spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-checkpoints"


def stored(df: DataFrame) -> DataFrame:
    """Cuts lineage: df written as Parquet in the shared folder and read back, so that lost executors cost no rerun of df.

    `stored_at` of the result names its folder, for removed().
    """
    where = f"{shared_folder(df.sparkSession).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(where)
    out = df.sparkSession.read.schema(df.schema).parquet(where)
    out.stored_at = where
    return out


def removed(df: DataFrame) -> None:
    """Deletes what stored() wrote for df; nothing may read df afterwards."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: A key counts as hot if it holds over one in HOT_SHARE of all rows, so that there are fewer than HOT_SHARE hot keys.
HOT_SHARE = 1000


def join_hot(rows: DataFrame, facts: DataFrame, key: str, total: int, count: str) -> DataFrame:
    """rows joined with facts (one row for each key, `count` of them the rows it has), no task getting a hot key.

    Facts of hot keys, fewer than HOT_SHARE by arithmetic, are broadcast; the other keys meet by a shuffle in which no
    key holds more than one in HOT_SHARE of the `total` rows. `count` is not in the result; null keys meet nothing.
    """
    heavy = F.col(count) * HOT_SHARE > total
    hot, rest = facts.where(heavy).drop(count), facts.where(~heavy).drop(count)
    few = [r[0] for r in hot.select(key).limit(HOT_SHARE).collect()]
    if not few:
        return rows.join(rest, key)
    is_hot = F.col(key).isin(few)
    return rows.where(is_hot).join(F.broadcast(hot), key).unionByName(rows.where(~is_hot).join(rest, key))


def id_crc32(column: str) -> F.Column:
    """crc32 of an id written as decimal text; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def labelled(labels: DataFrame, value: str, limit: int | None, where: F.Column | None = None) -> DataFrame:
    """At most `limit` labelled ids (the smallest by a hash of the id; None: all of them) with their label as `y`.

    Repeated label rows of one id count once, with the larger label; null ids and null labels do not count.
    """
    rows = labels.select("doc_id", F.col(value).cast("int").alias("y")).where("doc_id is not null and y is not null")
    if where is not None:
        rows = rows.where(where)
    each = rows.groupBy("doc_id").agg(F.max("y").alias("y"))
    return each if limit is None else each.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def one_text_each(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, text): of rows with equal keys the text with the least hash, whatever the partitioning."""
    return rows.groupBy(*keys).agg(F.min_by("text", text_key()).alias("text"))


def whole_rows(sizes: Iterable[tuple[Hashable, int]], most: int) -> list[Hashable]:
    """The first keys, in the order given, whose sizes add up to `most` at most; one that is larger by itself is passed over."""
    taken, total = [], 0
    for key, size in sizes:
        if size > most:
            continue
        if total + size > most:
            break
        taken.append(key)
        total += size
    return taken
