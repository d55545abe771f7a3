"""Shards by jump consistent hashing, with gapless slots inside each shard."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

#: Rows that one task numbers: a shard is cut into as many runs as that takes.
RUN_ROWS = 200_000
_STEP = np.uint64(2862933555777941757)


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Lamping and Veach's jump consistent hash of unsigned 64-bit keys into 0..shards-1."""
    key = keys.astype(np.uint64, copy=True)
    at = np.full(len(key), -1, np.int64)
    ahead = np.zeros(len(key), np.int64)
    while True:
        on = np.flatnonzero(ahead < shards)
        if not len(on):
            return at
        at[on] = ahead[on]
        key[on] = key[on] * _STEP + np.uint64(1)
        ahead[on] = ((at[on] + 1) * (2.0**31 / ((key[on] >> np.uint64(33)) + np.uint64(1)))).astype(np.int64)


def shard(docs: DataFrame, shards: int = 40) -> DataFrame:
    """(doc_id, text, ...) -> doc_id, size, text_crc32, law, shard, slot, grown_shard, one row for each input row.

    The law is `key`: doc_id and the number of shards decide, and one more shard takes rows only into
    itself. size is the text's UTF-8 bytes plus 16; a null text counts as empty (CRC 0). Rows without
    doc_id share one key. Slots follow a hash of the row, then doc_id, CRC and size; equal rows take
    their slots in any order. A shard is numbered in runs of about RUN_ROWS rows, whose offsets come
    from counts, so no task has to hold a shard.
    """

    @F.pandas_udf("shard int, grown_shard int")
    def jump(key: pd.Series) -> pd.DataFrame:
        k = key.to_numpy(np.int64).view(np.uint64)
        return pd.DataFrame({"shard": jump_hash(k, shards), "grown_shard": jump_hash(k, shards + 1)}, dtype="int32")

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    ).withColumn("to", jump(F.xxhash64("doc_id")))
    rows = written(rows.select("doc_id", "size", "text_crc32", "to.*"), "shards")
    runs = max(1, -(-rows.count() // (shards * RUN_ROWS)))
    rows = rows.withColumn("run", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(runs)).cast("int"))
    counts = rows.groupBy("shard", "run").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy("shard").orderBy("run")) - F.col("n")
    own = W.partitionBy("shard", "run").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.withColumn("at", F.row_number().over(own) - 1)
        .join(counts.select("shard", "run", before.alias("before")), ["shard", "run"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
            (F.col("before") + F.col("at")).cast("long").alias("slot"), "grown_shard",
        )
    )
