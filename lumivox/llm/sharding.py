"""Sharding: jump consistent hashing maps stable keys to shards without a ring table."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumivox.llm.common import id_and_text, table

#: Fixed values of jump consistent hashing: the generator's multiplier and 2^31.
MULTIPLIER = 2862933555777941757
JUMP = float(1 << 31)
SHARDS = 40
#: Rows of one shard that one task numbers.
RUN_ROWS = 100_000


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key: all keys jump together until past the end."""
    if shards < 1:
        raise ValueError("shards must be positive")
    key = keys.astype(np.uint64).copy()
    shard = np.zeros(len(key), np.int64)
    ahead = np.zeros(len(key), np.int64)
    left = np.arange(len(key))
    while len(left):
        shard[left] = ahead[left]
        key[left] = key[left] * np.uint64(MULTIPLIER) + np.uint64(1)
        step = (key[left] >> np.uint64(33)).astype(np.float64) + 1.0
        ahead[left] = ((shard[left] + 1) * (JUMP / step)).astype(np.int64)
        left = left[ahead[left] < shards]
    return shard


def shard_of(key: Column, shards: int) -> Column:
    """Jump hash of a long column; the key is mixed first, as ids are often in sequence."""

    @F.pandas_udf("int")
    def jump(mixed: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(mixed.to_numpy(np.int64).view(np.uint64), shards).astype(np.int32))

    return jump(F.xxhash64(key))


def assign_shards(docs: DataFrame, shards: int = SHARDS, run_rows: int = RUN_ROWS) -> DataFrame:
    """Shard, and place within the shard, of every document, under the law ``key``.

    Returns doc_id, size (UTF-8 bytes of the text and 16), text_crc32, law, shard,
    slot (from 0, without gaps, in each shard), grown_shard (with one shard more:
    the same, or the new one). Null texts have 16 bytes and crc32 0; null ids
    share one shard; repeated rows each get a slot; no rows give no rows.

    A shard's rows are numbered in runs of about ``run_rows`` keyed by a hash of
    the id, size and crc32, so many null or equal ids with other texts are spread as
    well; only the runs' counts are summed up in order, so no shard meets in one task.
    Rows that are alike in all three are neighbours, in any order.
    """
    base = id_and_text(docs)
    rows = base.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        shard_of(F.col("doc_id"), shards).alias("shard"),
        shard_of(F.col("doc_id"), shards + 1).alias("grown_shard"),
    )
    runs = max(1, -(-base.select("doc_id").count() // (shards * run_rows)))
    rows = rows.withColumn("run", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(runs)))
    sizes = rows.groupBy("shard", "run").count()
    before = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", "run", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "run").orderBy("doc_id", "size", "text_crc32")
    numbered = rows.withColumn("n", F.row_number().over(within).cast("long") - 1).join(offsets, ["shard", "run"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("offset") + F.col("n")).alias("slot"), "grown_shard")


def op4_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"))
