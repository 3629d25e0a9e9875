"""Sharding along a Hilbert curve over metadata dimensions.

Each dimension is quantised into 2^bits equal-depth bins of its whole values (null below all else), the bins of a row
become its index on the Hilbert curve, rows are sorted by that index and the order is cut into runs. Neighbours on the curve are neighbours in every dimension, so each run covers
narrow ranges of all of them and readers can skip files by any of them.

Law `rows`: run sizes differ by one at most. Ranks come from range partitions with a row count each (one number per
partition goes to the driver), never from one sorted task; the sort key ends in a hash, so one hot value still spreads.

Edge cases: null and empty texts have no bytes; rows that are equal in all columns keep separate slots; an empty table
gives an empty table; fewer rows than shards leave the rest of the shards empty; extra columns are ignored.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

def hilbert_index(bins: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert curve index of integer points (rows x dimensions), each coordinate below 2^bits (Skilling's transform)."""
    x = bins.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(high, q - 1, swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where((x[dims - 1] & q) != 0, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def value_limits(rows: DataFrame, name: str, bits: int) -> list:
    """Limits of equal-depth bins of a column, from the counts of all its values.

    Values are counted map-side and dealt by range; one count per partition and the limits go to the driver. A value is
    a limit if the rows up to it reach another 2^-bits of all rows.
    """
    counts = rows.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("value")).agg(F.count("*").alias("n"))
    dealt = stored(counts.repartitionByRange("value").withColumn("part", F.spark_partition_id()))
    sizes = sorted((r["part"], r["n"]) for r in dealt.groupBy("part").agg(F.sum("n").alias("n")).collect())
    total = sum(n for _, n in sizes)
    if not total:
        return []
    before = rows.sparkSession.createDataFrame(list(zip([p for p, _ in sizes], accumulate([n for _, n in sizes], initial=0), strict=False)), "part int, before long")
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("part").orderBy("value"))
    placed = dealt.join(F.broadcast(before), "part").withColumn("upto", upto)
    ends = placed.where(f"upto * {1 << bits} div {total} > (upto - n) * {1 << bits} div {total} and upto < {total}")
    return [r["value"] for r in ends.orderBy("upto").select("value").collect()]


def quantised(rows: DataFrame, dims: list[str], bits: int) -> list[Column]:
    """Bin columns (0 .. 2^bits - 1): how many limits lie below the value; limits are 2^bits values, whatever the rows."""

    def bin_of(d: str) -> Column:
        limits = value_limits(rows, d, bits)
        below = F.size(F.filter(F.array(*[F.lit(x) for x in limits]), lambda x: x < F.col(d))) if limits else F.lit(0)
        return F.when(F.col(d).isNull(), 0).otherwise(below).cast("int")

    return [bin_of(d) for d in dims]


def ranked(df: DataFrame, keys: list[Column]) -> tuple[DataFrame, int]:
    """(df with `rank`, 0 .. rows - 1 in the order of keys, row count); keys must be fine enough to spread over range partitions."""
    spread = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    spread = stored(spread.withColumn("__at", F.monotonically_increasing_id()))
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted((r["p"], r["n"]) for r in spread.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    offsets = list(accumulate([n for _, n in sizes], initial=0))
    starts = df.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(sizes, offsets, strict=False)] or [(0, 0)], "__p long, __before long")
    out = spread.withColumn("__p", part).withColumn("__place", place).join(F.broadcast(starts), "__p")
    return out.withColumn("rank", F.col("__before") + F.col("__place")).drop("__at", "__p", "__place", "__before"), offsets[-1]


def hilbert_shards(docs: DataFrame, dims: list[str], shards: int = 24, bits: int = 5) -> DataFrame:
    """doc_id, size, text_crc32, curve, shard, slot: `shards` runs of the curve order whose row counts differ by one at most."""
    if bits * len(dims) > 62:
        raise ValueError("bits times dimensions must fit a long")
    text = F.coalesce("text", F.lit("")).cast("binary")
    # texts are read once; all else works on sizes and dimensions
    narrow = stored(docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), *[F.col(d).alias(f"__d{i}") for i, d in enumerate(dims)]))
    bins = quantised(narrow, [f"__d{i}" for i in range(len(dims))], bits)

    @F.pandas_udf("long")
    def curve(*parts: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.column_stack([p.to_numpy() for p in parts]), bits))

    order = [F.col("curve"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.col("text_crc32"), F.col("size")]
    out, total = ranked(narrow.select("doc_id", "size", "text_crc32", curve(*bins).alias("curve")), order)
    # shard s takes the ranks from ceil(s * total / shards) on: at most one row apart
    shard = F.expr(f"cast(rank * {shards}L div {max(total, 1)}L as int)")
    first = F.expr(f"({total}L * shard + {shards - 1}) div {shards}")
    return out.withColumn("shard", shard).withColumn("slot", F.col("rank") - first).drop("rank")


def write_shards(docs: DataFrame, placed: DataFrame, path: str) -> None:
    """Writes docs as path/shard=N/, each shard in curve order, from the placement of hilbert_shards()."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    key = ["doc_id", "text_crc32"]
    rows = docs.withColumn("text_crc32", F.crc32(text))
    # repeated rows of one id and text are told apart by a running number, so that a join keeps the row count
    rows = rows.withColumn("__copy", F.row_number().over(Window.partitionBy(*key).orderBy("text_crc32")))
    spots = placed.select(*key, "shard", "slot", F.row_number().over(Window.partitionBy(*key).orderBy("slot")).alias("__copy"))
    on = rows["doc_id"].eqNullSafe(spots["doc_id"]) & (rows["text_crc32"] == spots["text_crc32"]) & (rows["__copy"] == spots["__copy"])
    out = rows.join(spots, on).select(*[rows[c] for c in docs.columns], spots["shard"], spots["slot"])
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").drop("slot").write.partitionBy("shard").parquet(path)
