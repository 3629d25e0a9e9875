"""Leaving rows out of a table of texts without moving the texts.

The rows to leave out are known by (doc_id, text_key). Their keys go into a Bloom filter, whose size is checked; rows
that miss it stay where they are. Kept rows that hit it by chance are found among the keys alone and put into a second
filter, which all of these hit: they, about one row in 250, are shuffled with their texts for an exact anti-join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, text_key

#: Bits of a filter for each key and bits set by each; about one in 250 other keys hits by chance.
BITS_EACH = 12
PROBES = 8

#: Bits of one block of a filter; all bits of a key lie in one block, so blocks are made in parallel.
BLOCK_BITS = 1 << 16

#: Bytes of a filter that may be broadcast; more keys than fit are anti-joined by a shuffle of the rows.
MOST_BYTES = 128 << 20


def _places(keys: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """(block of each key, its bits within the block) from the 64 bits of the key."""
    k = keys.astype(np.int64).view(np.uint64)
    block = (k >> np.uint64(32)) % np.uint64(blocks)
    step = ((k * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) | np.uint64(1)
    at = (k & np.uint64(0xFFFFFFFF))[:, None] + step[:, None] * np.arange(PROBES, dtype=np.uint64)
    return block.astype(np.int64), (at % np.uint64(BLOCK_BITS)).astype(np.int64)


class Filter:
    """A Bloom filter over long keys, made by Spark block by block and broadcast."""

    def __init__(self, keys: DataFrame, count: int) -> None:
        """keys(h long), `count` of them."""
        self.blocks = blocks = -(-max(count, 1) * BITS_EACH // BLOCK_BITS)

        def fill(rows: pd.DataFrame) -> pd.DataFrame:
            bits = np.zeros(BLOCK_BITS, dtype=bool)
            bits[_places(rows["h"].to_numpy(), blocks)[1].ravel()] = True
            return pd.DataFrame({"block": rows["block"].iloc[:1], "bits": [np.packbits(bits).tobytes()]})

        block = F.expr(f"cast(shiftrightunsigned(h, 32) % {blocks} as long)")
        made = keys.select("h", block.alias("block")).groupBy("block").applyInPandas(fill, "block long, bits binary").collect()
        whole = np.zeros((blocks, BLOCK_BITS // 8), dtype=np.uint8)
        for r in made:
            whole[r["block"]] = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
        self.bits = keys.sparkSession.sparkContext.broadcast(whole)

    def hit(self):
        """A function of a long column: whether the filter may hold it."""
        blocks, bits = self.blocks, self.bits

        @F.pandas_udf("boolean")
        def test(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            whole = bits.value
            for keys in batches:
                block, at = _places(keys.to_numpy(), blocks)
                byte = whole[block[:, None], at >> 3]
                yield pd.Series((byte >> (7 - (at & 7)).astype(np.uint8) & 1).all(axis=1))

        return test


def without(docs: DataFrame, keys: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """The rows of docs whose key stays, one of each; keys(doc_id, text_key, stays) holds one row for every row of docs.

    Rows with equal id and text are one key, of which one row stays at most. Columns of docs are kept.
    """
    hashed = stored(keys.groupBy("doc_id", "text_key").agg(F.max("stays").alias("stays"), F.count("*").alias("copies")).withColumn("h", F.xxhash64("doc_id", "text_key")))
    moved = hashed.where("not stays or copies > 1")
    count = moved.count()
    if not count:
        return docs
    keyed = docs.withColumn("__own", text_key()).withColumn("__h", F.xxhash64("doc_id", "__own"))
    if count * BITS_EACH // 8 > most_bytes:
        untouched, looked_at = None, keyed
    else:
        first = Filter(moved.select("h"), count).hit()
        doubtful = stored(hashed.where("stays").where(first("h")).select("h"))
        second = Filter(doubtful, doubtful.count()).hit()
        untouched, looked_at = keyed.where(~first("__h")), keyed.where(first("__h")).where(second("__h"))
    leaves = moved.where("not stays").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"))
    kept = looked_at.join(leaves, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__key")), "left_anti")
    one = kept.dropDuplicates(["doc_id", "__own"])
    return (one if untouched is None else untouched.unionByName(one)).drop("__own", "__h")


def dropped(docs: DataFrame, keys: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """The rows of docs whose key is not in keys(doc_id, own), each of them; only rows that a filter takes for one are shuffled."""
    hashed = stored(keys.withColumn("h", F.xxhash64("doc_id", "own")))
    count = hashed.count()
    if not count:
        return docs
    keyed = docs.withColumn("__own", text_key()).withColumn("__h", F.xxhash64("doc_id", "__own"))
    leaves = hashed.select(F.col("doc_id").alias("__id"), F.col("own").alias("__key"))
    leave = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__key"))
    if count * BITS_EACH // 8 > most_bytes:
        return keyed.join(leaves, leave, "left_anti").drop("__own", "__h")
    hit = Filter(hashed.select("h"), count).hit()
    return keyed.where(~hit("__h")).unionByName(keyed.where(hit("__h")).join(leaves, leave, "left_anti")).drop("__own", "__h")
