"""Sharding by jump consistent hashing.

A key's shard depends on the key and the number of shards only; with one more
shard a key either stays or moves to the new shard, and 1/(n+1) of the keys
move.  No ring table is kept.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .textscan import mix

#: Slot ranges for each shard: rows of a shard are numbered in so many pieces side by side.
PIECES = 64


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Jump consistent hash of unsigned 64-bit keys, all rows at once (about log(shards) steps)."""
    key = keys.astype(np.uint64).copy()
    at = np.zeros(len(key), np.int64)
    nxt = np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    while len(live):
        at[live] = nxt[live]
        k = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        key[live] = k
        nxt[live] = ((at[live] + 1) * (float(1 << 31) / ((k >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
        live = live[nxt[live] < shards]
    return at


def shard_of(key: Column, shards: int) -> Column:
    """Shard of an integer key column; a null key counts as the key 0."""

    @F.pandas_udf("int")
    def place(s: pd.Series) -> pd.Series:
        keys = s.fillna(0).astype("int64").to_numpy().view(np.uint64)
        return pd.Series(jump_hash(mix(keys + np.uint64(0x9E3779B97F4A7C15)), shards).astype(np.int32))

    return place(key.cast("bigint"))


def assign_shards(docs: DataFrame, shards: int = 8) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row.

    law is ``key``: doc_id and shard count alone decide.  size is the UTF-8
    length of the text (null: none) plus 1; slot numbers a shard's rows from 0
    without gaps; grown_shard is the shard with one shard more.  Null ids share
    a shard, repeated rows get slots of their own, an empty table gives no row.
    Slots are numbered in PIECES pieces a shard and shifted by the counts of
    the pieces before, so that no shard passes through one task.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.octet_length(text).cast("bigint") + 1).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    rows = rows.select(
        "*",
        F.lit("key").alias("law"),
        shard_of(F.col("doc_id"), shards).alias("shard"),
        shard_of(F.col("doc_id"), shards + 1).alias("grown_shard"),
    ).withColumn("piece", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(PIECES)).cast("int"))
    rows = materialize(rows, "shards")
    counts = rows.groupBy("shard", "piece").agg(F.count("*").alias("n"))  # shards x PIECES rows
    before = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inner = Window.partitionBy("shard", "piece").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.withColumn("place", F.row_number().over(inner))
        .join(F.broadcast(starts), ["shard", "piece"])
        .select("doc_id", "size", "text_crc32", "law", "shard", (F.col("start") + F.col("place") - 1).cast("bigint").alias("slot"), "grown_shard")
    )
