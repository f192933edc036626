"""Sharding by jump consistent hashing: a key and a number of shards decide the shard, and no table is kept.

The jump walk draws from a generator seeded by the key where the key would move next as shards are added, and stops
before the number of shards.  With one more shard a key stays, or moves into the new one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Groups of rows that are numbered apart, over all shards; and the copies of one row that are numbered together.
GROUPS = 1 << 16
COPIES = 4096
OVERHEAD = 16  # bytes of a row besides its text


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each unsigned 64-bit key, from 0."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    keys = keys.astype(np.uint64)
    bucket, following = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    live = np.arange(len(keys))
    with np.errstate(over="ignore"):
        while len(live):
            bucket[live] = following[live]
            keys[live] = keys[live] * np.uint64(2862933555777941757) + np.uint64(1)
            draw = ((keys[live] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
            following[live] = ((bucket[live] + 1) * (float(1 << 31) / draw)).astype(np.int64)
            live = live[following[live] < shards]
    return bucket


def stable_key(key: Column) -> Column:
    """A key of any type as 64 bits, a long.  Half of an MD5, so that other engines can work it out as well; null
    counts as the text ``null``."""
    text = F.md5(F.coalesce(key.cast("string"), F.lit("null")).cast("binary"))
    high, low = F.conv(F.substring(text, 1, 8), 16, 10), F.conv(F.substring(text, 9, 8), 16, 10)
    return F.shiftleft(high.cast("long"), 32).bitwiseOR(low.cast("long"))


def shard_of(key: Column, shards: int) -> Column:
    """The shard of a key."""

    @F.pandas_udf("int")
    def walk(k: pd.Series) -> pd.Series:
        return pd.Series(jump(k.to_numpy(np.int64).view(np.uint64), shards).astype(np.int32))

    return walk(stable_key(key))


def assign_shards(docs: DataFrame, shards: int, key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, size (UTF-8 bytes of the text plus 16), text_crc32, law
    (``key``), shard, slot (0, 1, ... without gaps in each shard), grown_shard (with one more shard).

    Rows of one key share a shard, whatever their texts; a null key is a key.  A null text has size 16 and the
    checksum of an empty one.  Within a shard slots go by part, which key, size and checksum decide, and in it by those;
    repeated rows get slots of their own.  Other columns are not read.

    No task numbers a whole shard, nor all texts of one key: repeated rows are counted before they are moved, and go on in
    chunks; rows are numbered in parts of shards, and a table of ``GROUPS`` sizes (or one per shard) gives where each part starts.
    """
    parts = max(1, GROUPS // shards)
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select(
        F.col(key).alias("key"),
        (F.octet_length(text) + OVERHEAD).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    counted = rows.groupBy("key", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies"))
    placed = counted.select(
        "*",
        shard_of(F.col("key"), shards).alias("shard"),
        shard_of(F.col("key"), shards + 1).alias("grown_shard"),
        F.xxhash64("key", "size", "text_crc32").alias("hash"),
        F.explode(F.expr(f"sequence(0, (copies - 1) div {COPIES})")).alias("chunk"),
    ).select(
        "key", "size", "text_crc32", "shard", "grown_shard", "chunk",
        F.expr(f"cast((pmod(hash, {parts}) + chunk) % {parts} as int)").alias("part"),
        F.least(F.lit(COPIES), F.expr(f"copies - chunk * {COPIES}")).alias("here"),
    )
    sizes = placed.groupBy("shard", "part").agg(F.sum("here").alias("rows"))  # at most max(GROUPS, shards) rows
    before = F.sum("rows").over(W.partitionBy("shard").orderBy("part")) - F.col("rows")
    offsets = sizes.select(F.col("shard").alias("s"), F.col("part").alias("p"), before.alias("before"))
    in_part = W.partitionBy("shard", "part").orderBy("key", "size", "text_crc32", "chunk")
    numbered = placed.withColumn("within", F.sum("here").over(in_part.rowsBetween(W.unboundedPreceding, -1)))
    return (
        numbered.join(F.broadcast(offsets), (F.col("shard") == F.col("s")) & (F.col("part") == F.col("p")))
        .select("*", F.explode(F.expr("sequence(0, here - 1)")).alias("copy"))
        .select(
            F.col("key").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard",
            (F.col("before") + F.coalesce("within", F.lit(0)) + F.col("copy")).cast("bigint").alias("slot"), "grown_shard",
        )
    )
