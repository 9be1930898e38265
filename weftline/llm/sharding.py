"""Sharding by jump consistent hashing (Lamping and Veach, 2014).

The shard of a row depends only on its key and the number of shards; appending a shard moves rows
into the new shard and nowhere else.  No ring table is kept.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import saved

#: Rows of one shard that a single task numbers: slots are dealt in groups by a hash of the key.
SLOT_GROUPS = 1024
#: Largest run of equal rows that one task unrolls at once.
RUN = 65_536


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key, vectorised; only keys that still jump stay in the loop."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    state = keys.astype(np.uint64)
    bucket = np.zeros(len(state), dtype=np.int64)
    moving = np.arange(len(state))
    after = np.zeros(len(state), dtype=np.int64)
    while len(moving):
        bucket[moving] = after
        state[moving] = state[moving] * np.uint64(2862933555777941757) + np.uint64(1)
        draw = (state[moving] >> np.uint64(33)).astype(np.float64) + 1.0
        after = ((bucket[moving] + 1) * (float(1 << 31) / draw)).astype(np.int64)
        stays = after < shards
        moving, after = moving[stays], after[stays]
    return bucket.astype(np.int32)


def shard_of(key: Column, shards: int) -> Column:
    """Shard (int) of a 64-bit key column."""

    @F.pandas_udf("int")
    def jump(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.to_numpy(dtype=np.int64).view(np.uint64), shards))

    return jump(F.coalesce(key, F.lit(0)))


def assign_shards(df: DataFrame, key: str = "doc_id", shards: int = 40) -> DataFrame:
    """``df`` with shard and grown_shard (the shard if there were one more).

    Keys are mixed by a 64-bit hash first; a null key has a hash like any other.  Rows with one
    key share a shard.  Nothing is shuffled.
    """
    mixed = F.xxhash64(F.col(f"`{key}`"))
    return df.withColumns({"shard": shard_of(mixed, shards), "grown_shard": shard_of(mixed, shards + 1)})


def shard_slots(df: DataFrame, order: list[str], groups: int = SLOT_GROUPS) -> DataFrame:
    """The rows of ``df`` (shard and ``order`` columns) with slot: gapless from 0 in every shard.

    Equal rows are first counted, so a hot key is one row in the shuffle.  Each shard is dealt
    into ``groups`` by a hash of the order columns; slots ascend by group, then by the order
    columns.  A task numbers one group at a time; where groups start comes from a table of at most
    shards x groups counts.
    """
    columns = ["shard", *order]
    distinct = (
        df.groupBy(*columns)
        .agg(F.count(F.lit(1)).alias("__copies"))
        .withColumn("__group", F.pmod(F.xxhash64(*order), F.lit(groups)))
    )
    distinct = saved(distinct, "shard-rows")
    in_shard = Window.partitionBy("shard").orderBy("__group").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        distinct.groupBy("shard", "__group")
        .agg(F.sum("__copies").alias("__rows"))
        .select("shard", "__group", F.coalesce(F.sum("__rows").over(in_shard), F.lit(0)).alias("__base"))
    )
    in_group = (
        Window.partitionBy("shard", "__group").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = (
        distinct.withColumn("__before", F.coalesce(F.sum("__copies").over(in_group), F.lit(0)))
        .join(starts, ["shard", "__group"])
        .withColumn("__first", F.col("__base") + F.col("__before"))
    )
    # Equal rows are unrolled again: first in runs, then one by one.
    runs = placed.withColumn(
        "__run", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__copies") - 1, F.lit(RUN).cast("long")))
    )
    last = F.least(F.col("__copies"), F.col("__run") + RUN) - 1
    return runs.withColumn("__at", F.explode(F.sequence(F.col("__run"), last))).select(
        *columns, (F.col("__first") + F.col("__at")).alias("slot")
    )


def query(documents: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    placed = shard_slots(
        assign_shards(rows, "doc_id", 40), ["doc_id", "text_crc32", "size", "grown_shard"]
    )
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
