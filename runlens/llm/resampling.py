"""Importance resampling towards a target: hashed n-gram weights by an integer word dictionary, Gumbel top-k draws.

Within each slice of documents distinct words get ids, a run of words is a tuple of ids in one integer,
each distinct tuple's bytes are put together and hashed once, and the buckets go back to all its places.
Ids and tuples never leave their slice, so no word is shuffled and no dictionary grows with the corpus;
what Spark adds up are counts of a fixed number of buckets.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh, written
from .words import offsets_and_bytes, slices, words

#: Buckets that features are hashed into, words of the longest feature, words of a document that may be drawn.
BUCKETS = 10_000
LONGEST = 2
LEAST_WORDS = 20
#: Longer features are hashed one by one.
_SHORT = 64


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1).astype(np.uint32)
    return c


_TABLE = _crc_table()


def crc32(column: pa.Array) -> np.ndarray:
    """The unsigned CRC-32 of each string's bytes, one byte of all strings at a time."""
    at, data = offsets_and_bytes(column)
    sizes = np.diff(at)
    out = np.zeros(len(column), np.uint32)
    order = np.argsort(-np.minimum(sizes, _SHORT + 1), kind="stable")
    long = int((sizes > _SHORT).sum())
    for i in order[:long]:
        out[i] = zlib.crc32(data[at[i] : at[i + 1]])
    order = order[long:]
    begin, left, crc = at[order], sizes[order], np.full(len(order), 0xFFFFFFFF, np.uint32)
    for j in range(int(left[0]) if len(left) else 0):
        n = int(np.searchsorted(-left, -j, "left"))  # those with more than j bytes come first
        c = crc[:n]
        crc[:n] = _TABLE[(c ^ data[begin[:n] + j]) & 255] ^ (c >> np.uint32(8))
    out[order] = ~crc
    return out


def feature_buckets(texts: pa.Array, buckets: int = BUCKETS, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all features, text by text, and the number of features of each text."""
    flat, sizes = words(texts)
    coded = flat.dictionary_encode()
    names, ids = coded.dictionary.cast(pa.binary()), coded.indices.to_numpy().astype(np.int64)
    home = np.repeat(np.arange(len(sizes)), sizes)
    found, of = [], []
    tuples, parts = ids, [np.arange(len(names))]  # the tuple of the run that begins at each word; words of each distinct tuple
    for n in range(1, longest + 1):
        if n > 1:
            ahead = np.flatnonzero(home[n - 1 :] == home[: len(home) - n + 1]) if len(home) >= n else np.zeros(0, np.int64)
            pairs = pa.array(tuples[ahead] * len(names) + ids[ahead + n - 1]).dictionary_encode()
            distinct = pairs.dictionary.to_numpy()
            parts = [p[distinct // len(names)] for p in parts] + [distinct % len(names)]
            tuples = np.full(len(ids), 0, np.int64)
            tuples[ahead] = pairs.indices.to_numpy()
        else:
            ahead = np.arange(len(ids))
        columns = [names.take(pa.array(p)) for p in parts]
        spelled = columns[0] if n == 1 else pc.binary_join_element_wise(*columns, b" ")
        found.append((crc32(spelled) % buckets)[tuples[ahead]])
        of.append(home[ahead])
    home = np.concatenate(of)
    order = np.argsort(home, kind="stable")
    return np.concatenate(found)[order].astype(np.int32), np.bincount(home, minlength=len(sizes))


def _hashed(rows: DataFrame, buckets: int, longest: int) -> DataFrame:
    """(doc, text) -> doc, buckets: one entry for each feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found, sizes = feature_buckets(batch["text"], buckets, longest)
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch["doc"], pa.ListArray.from_arrays(ends, pa.array(found))], ["doc", "buckets"])

    return rows.mapInArrow(run, "doc long, buckets array<int>")


def bucket_counts(hashed: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(buckets) -> bucket, n: features of all rows in each bucket that has any; a task adds up its rows first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(batch["buckets"].flatten().to_numpy(), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    return hashed.select("buckets").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def _gains(raw: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """A thousand times the log ratio of each bucket's shares, with one added to every count, rounded down: `buckets` numbers."""
    both = raw.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t"))
    both = both.unionByName(target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    every = raw.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"), *(F.lit(0).cast("long").alias(c) for c in "st"))
    counts = both.unionByName(every).groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).orderBy("bucket").collect()
    totals = [sum(r[c] for r in counts) for c in "st"]
    s, t = (np.array([r[c] for r in counts], np.float64) for c in "st")
    return np.floor(1000 * np.log((t + 1) * (totals[0] + buckets) / ((s + 1) * (totals[1] + buckets)))).astype(np.int64)


def ranked(rows: DataFrame, score: str, doc: str, keep: str, percent: int) -> DataFrame:
    """(doc, score, keep, ...) -> the same and rank: 1, 2, ... for the floor of `percent` of the rows with keep, highest scores first, ties to smaller docs; else null.

    Rows are dealt by ranges of (score, doc) and numbered where they lie; the ranges' sizes, one number for
    each, give the offsets. Rows equal in both are told apart by their place in the written table.
    """
    n, place, part, before = fresh(rows, "n", "place", "part", "before")
    rows = written(rows.withColumn(place, F.monotonically_increasing_id()), "scored")
    order = [F.col(score).desc(), F.col(doc).asc_nulls_last(), F.col(place)]
    lying = written(rows.where(keep).orderBy(*order).withColumn(place, F.monotonically_increasing_id()), "ordered")
    # what comes before the first row of a partition; as many rows as partitions
    sizes = lying.groupBy(F.shiftright(place, 33).alias(part)).agg(F.count(F.lit(1)).alias(n))
    sizes = sizes.select(part, F.coalesce(F.sum(n).over(W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(before), F.sum(n).over(W.partitionBy()).alias(n))
    at = F.col(before) + F.col(place).bitwiseAND(F.lit((1 << 33) - 1)) + 1
    named = lying.join(F.broadcast(sizes), F.shiftright(place, 33) == F.col(part))
    rank = F.when(at <= F.floor(percent * F.col(n) / 100), at.cast("long"))
    out = [c for c in rows.columns if c != place]
    return named.select(*out, rank.alias("rank")).unionByName(rows.where(~F.col(keep)).select(*out, F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, seed: int = 7, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """(doc_id, text), (text) -> doc_id, n_features, weight, score, rank, all long: a row for each document.

    Weight is the mean gain of a document's features, score the weight with Gumbel noise from the hash of
    seed and doc_id, and the highest scores among documents of LEAST_WORDS words or more are drawn. A null
    text has no words; no features weigh 0; rows without doc_id share one noise; equal rows are documents
    of their own, ranked in any order; an empty target leaves the gains to the documents alone. No other
    column is read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text"))
    hashed = written(_hashed(rows, buckets, longest), "hashed")
    wanted = _hashed(target.select(F.lit(0).cast("long").alias("doc"), F.col("text").cast("string").alias("text")), buckets, longest)
    gains = _gains(bucket_counts(hashed, buckets), bucket_counts(wanted, buckets), buckets)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch["buckets"]
            sums = np.concatenate([[0], np.cumsum(gains[column.flatten().to_numpy()])])
            ends = column.offsets.to_numpy() - column.offsets[0].as_py()
            n = np.diff(ends).astype(np.int64)
            weight = np.diff(sums[ends]) // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([batch["doc"], pa.array(n), pa.array(weight)], ["doc_id", "n_features", "weight"])

    found = hashed.mapInArrow(weigh, "doc_id long, n_features long, weight long")
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    # a text of w words has w features of one word, w - 1 of two, and so on
    long_enough = F.col("n_features") >= sum(max(LEAST_WORDS - k, 0) for k in range(longest))
    scored = found.withColumn("score", (F.col("weight") + noise).cast("long")).withColumn("eligible", long_enough)
    return ranked(scored, "score", "doc_id", "eligible", percent).select("doc_id", "n_features", "weight", "score", "rank")
