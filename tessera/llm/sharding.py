"""Sharding by jump consistent hashing (Lamping and Veach, 2014).

A stable 64-bit key and the number of shards decide a row's shard; there is no
ring table. Going from n to n + 1 shards moves about 1/(n + 1) of the rows, all
of them into the new shard.

Edge cases: a null key hashes like any other value; rows that repeat a key share
its shard and get different slots; a null text has size 1 and crc 0; texts of any
length are measured whole; an empty
table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import dense_slots, table


def jump_hash(keys: np.ndarray, n_shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key, all keys advancing together."""
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    state = keys.astype(np.uint64)
    shard = np.full(len(state), -1, np.int64)
    jump = np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    while len(live):
        shard[live] = jump[live]
        with np.errstate(over="ignore"):
            state[live] = state[live] * np.uint64(2862933555777941757) + np.uint64(1)
        scale = (state[live] >> np.uint64(33)).astype(np.float64) + 1.0
        jump[live] = ((shard[live] + 1) * (2147483648.0 / scale)).astype(np.int64)
        live = live[jump[live] < n_shards]
    return shard.astype(np.int32)


def shard_column(key: Column, n_shards: int) -> Column:
    """Shard of ``xxhash64(key)`` among ``n_shards``."""

    @F.pandas_udf("int")
    def place(h: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(h.to_numpy(np.int64).view(np.uint64), n_shards))

    return place(F.xxhash64(key))


def assign_shards(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """One row per document: its size, checksum, shard, slot in the shard, and
    the shard it would have with one shard more."""
    text = F.coalesce(F.col("text"), F.lit(""))
    placed = docs.select(
        F.col("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
    ).select(
        "doc_id", "size", "text_crc32",
        F.lit("key").alias("law"),
        shard_column(F.col("doc_id"), n_shards).alias("shard"),
        shard_column(F.col("doc_id"), n_shards + 1).alias("grown_shard"),
    )
    slotted = dense_slots(placed, "shard", ["doc_id", "text_crc32", "size"])
    return slotted.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op7_sharding(spark, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"), 8)


QUERIES = {"op7_sharding": op7_sharding}
SQL: dict[str, str] = {}
