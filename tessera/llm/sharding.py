"""Sharding by jump consistent hashing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import groups_for


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Jump consistent hash (Lamping and Veach 2014) of many 64-bit keys at once."""
    key = keys.astype(np.int64).view(np.uint64).copy()
    bucket = np.zeros(len(key), np.int64)
    ahead = np.zeros(len(key), np.int64)
    open_ = np.arange(len(key))
    while len(open_):
        bucket[open_] = ahead[open_]
        key[open_] = key[open_] * np.uint64(2862933555777941757) + np.uint64(1)
        step = float(1 << 31) / ((key[open_] >> np.uint64(33)).astype(np.float64) + 1.0)
        ahead[open_] = np.minimum((bucket[open_] + 1) * step, 2.0**62).astype(np.int64)
        open_ = open_[ahead[open_] < shards]
    return bucket


def shard_of(key: Column, shards: int) -> Column:
    """The shard, 0 to shards - 1, of a 64-bit key column: no ring, no table, and appending a shard moves
    only the rows that the new shard takes."""

    def f(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(), shards).astype(np.int32))

    return F.pandas_udf(f, "int")(key)


def assign_shards(docs: DataFrame, shards: int = 24, rows_per_chunk: int = 50_000) -> DataFrame:
    """Put every document in one of `shards` shards by a key law: doc_id and the number of shards decide.

    Returns doc_id, size (UTF-8 bytes of the text and 8, a null text has none), text_crc32, law, shard,
    slot (gapless from 0 within a shard) and grown_shard (the shard if one more is appended). A null
    doc_id hashes as a key of its own. Copies of a text are told apart by doc_id, so a large group of
    copies spreads over all shards. Slots need no shard in one task: a shard is cut into chunks by a hash of
    id and text, so that rows of one id or none spread over them; the chunks are counted (map-side combined), and each row's slot is its chunk's start and its number in it.
    """
    key = F.xxhash64(F.coalesce("doc_id", F.lit(-1)))
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8).alias("size"),
        crc.alias("text_crc32"),
    )
    chunks = groups_for(docs.count(), shards * rows_per_chunk, 16)
    chunk_of = lambda c: F.pmod(F.hash(F.coalesce("doc_id", F.lit(-1)), c, F.lit(7)), F.lit(chunks))
    rows = rows.select("*", shard_of(key, shards).alias("shard"), shard_of(key, shards + 1).alias("grown_shard"), chunk_of(F.col("text_crc32")).alias("_chunk"))
    counted = docs.select(shard_of(key, shards).alias("shard"), chunk_of(crc).alias("_chunk")).groupBy("shard", "_chunk").count()
    before = Window.partitionBy("shard").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select("shard", "_chunk", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("shard", "_chunk").orderBy("doc_id", "size", "text_crc32")
    numbered = rows.withColumn("_n", F.row_number().over(inside))
    return numbered.join(starts, ["shard", "_chunk"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_start") + F.col("_n") - 1).alias("slot"), "grown_shard"
    )
