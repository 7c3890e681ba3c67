"""Sharding by jump consistent hashing.

A stable key decides its shard by a few steps of a linear congruential generator, with no ring or
table: going from n to n + 1 shards moves one key in n + 1, all of them into the new shard.

Defined cases: null text has no bytes; rows with the same doc_id, null included, share a shard
whatever their texts; an empty table gives an empty one; extra columns are not read by the query
and are carried by add_shard(), which refuses to overwrite a column.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.llm.common import cut, documents, two_level_sum

SHARDS = 40


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key; vectorised, O(log shards) steps."""
    state, out = keys.astype(np.int64).view(np.uint64).copy(), np.zeros(len(keys), dtype=np.int64)
    live, jump = np.arange(len(keys)), np.zeros(len(keys), dtype=np.int64)
    while len(live):
        out[live] = jump
        state[live] = state[live] * np.uint64(2862933555777941757) + np.uint64(1)
        draw = (state[live] >> np.uint64(33)).astype(np.float64) + 1.0
        jump = ((out[live] + 1) * (float(1 << 31) / draw)).astype(np.int64)
        on = jump < shards
        live, jump = live[on], jump[on]
    return out


def shard_of(key: Column, shards: int) -> Column:
    """Shard of a stable key column of any type, as an Arrow-batched column expression."""

    @F.pandas_udf("int")
    def jump(k: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(k.to_numpy(), shards).astype(np.int32))

    return jump(F.xxhash64(key))


def add_shard(df: DataFrame, key: str, shards: int, out: str = "shard") -> DataFrame:
    if out in df.columns:
        raise ValueError(f"the input has a column {out}")
    return df.withColumn(out, shard_of(F.col(key), shards))


def write_shards(df: DataFrame, path: str, key: str = "doc_id", shards: int = SHARDS, out: str = "shard") -> None:
    """One folder per shard, each row in the folder its key decides."""
    add_shard(df, key, shards, out).write.partitionBy(out).parquet(path)


def number_slots(df: DataFrame, order: list[str]) -> DataFrame:
    """df (with column shard) with slot: 0, 1, 2, ... without gaps in each shard.

    No task holds a whole shard: rows are numbered in about sqrt(rows per shard) buckets.
    """
    buckets = max(16, math.isqrt(df.count() // SHARDS + 1))
    df = df.withColumn("__bucket_no", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    return two_level_sum(df, ["shard"], "__bucket_no", order, F.lit(1), "slot").drop("__bucket_no")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))).alias("text_crc32"),
    )
    key = F.col("doc_id")
    docs = cut(docs.withColumns({"shard": shard_of(key, SHARDS), "grown_shard": shard_of(key, SHARDS + 1)}))
    out = number_slots(docs, ["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
