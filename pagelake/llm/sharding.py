"""Sharding by jump consistent hashing (operator 10).

The shard follows from the key and the number of shards alone; with one more
shard a key either stays or moves into the new one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.llm.common import Tables, number_rows


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each uint64 key: jumps ahead until the next one leaves the range."""
    key = keys.astype(np.uint64)
    key = (key ^ (key >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)  # spreads close keys
    key = (key ^ (key >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    key = key ^ (key >> np.uint64(31))
    now, ahead = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    while len(live):
        now[live] = ahead[live]
        key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        ahead[live] = ((now[live] + 1) * (2.0**31 / ((key[live] >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
        live = live[ahead[live] < shards]
    return now


def assign_shards(df: DataFrame, key: str, shards: int, *, out: str = "shard") -> DataFrame:
    """Add ``out``, the shard 0 to ``shards - 1`` of a long key (null counts as 0)."""

    @F.pandas_udf("int")
    def place(k: pd.Series) -> pd.Series:
        return pd.Series(jump(k.to_numpy(dtype=np.int64), shards).astype(np.int32))

    return df.withColumn(out, place(F.coalesce(F.col(key).cast("long"), F.lit(0))))


def shard_documents(docs: DataFrame, shards: int = 8, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard, slot and checks of every row: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    Equal ids share a shard, whatever their texts. Slots count from 0 in each
    shard by (id, size, crc), nulls first; equal rows take neighbouring slots.
    A null text has size 1 and the crc of nothing. Texts are read once, not shuffled.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    tables = Tables(docs.sparkSession, "shards")
    rows = tables.write(rows, "sizes")  # texts are read once
    rows = assign_shards(assign_shards(rows, "doc_id", shards), "doc_id", shards + 1, out="grown_shard")
    rows = rows.withColumn("one", F.lit(1).cast("long"))
    placed = number_rows(rows, ["doc_id", "size", "text_crc32"], by=["shard"], sums={"slot": "one"}, name="slots", tables=tables)
    tables.drop("sizes")
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
