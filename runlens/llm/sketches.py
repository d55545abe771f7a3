"""Bottom-k sketches of shingle hashes: mergeable fingerprints of documents.

A shingle is a window of SHINGLE bytes of the UTF-8 text (a shorter text is one shingle). A sketch
holds the K smallest distinct hashes, ascending; the sketch of a union is the K smallest of both, so
parts can be sketched apart if they overlap by SHINGLE-1 bytes.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parallel

K = 64
SHINGLE = 16
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_FULL = float(2**64)


def window_hashes(data: bytes) -> np.ndarray:
    """Mixed 64-bit hashes of all byte windows, in order."""
    n = len(data) - SHINGLE + 1
    if n < 1:
        return np.array([xxhash.xxh64_intdigest(data)] if data else [], np.uint64)
    words = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    h = words[:n] * _A
    h ^= h >> np.uint64(29)
    h += words[8 : 8 + n]
    for by, times in ((30, _B), (27, _C)):
        h ^= h >> np.uint64(by)
        h *= times
    h ^= h >> np.uint64(31)
    return h


def bottom(h: np.ndarray, k: int = K) -> np.ndarray:
    """The k smallest distinct values, ascending."""
    if len(h) > 16 * k:
        low = np.unique(h[h < np.uint64(int(_FULL * 4 * k / len(h)))])
        if len(low) >= k:
            return low[:k]
    return np.unique(h)[:k]


def encode(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype("<u8").tobytes()).decode()


def decode(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<u8")


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.unique(np.concatenate([a, b]))[:k]


def distinct(sketch: np.ndarray, k: int = K) -> float:
    """Distinct shingles: exact below k, else (k-1) over the k-th smallest as a share of the range."""
    return float(len(sketch)) if len(sketch) < k else (k - 1) * _FULL / float(sketch[-1])


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated |A and B| / |A or B|: the share of the union's sketch that both have; 1 for two empty sets."""
    union = merge(a, b, k)
    return float(np.isin(union, a).__and__(np.isin(union, b)).mean()) if len(union) else 1.0


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated |A and B| / |A|; 1 if A is empty."""
    if not len(a):
        return 1.0
    return min(1.0, resemblance(a, b, k) * distinct(merge(a, b, k), k) / distinct(a, k))


class _Part:
    """A document with its code points, hashes and sketch."""

    def __init__(self, doc_id: int | None, text: str | None) -> None:
        self.doc_id, self.text = doc_id, text or ""
        self.data = self.text.encode("utf-8", "replace")
        self.hashes = window_hashes(self.data)
        self.sketch = bottom(self.hashes)

    def edited(self, after: _Part) -> tuple[bytes, np.ndarray]:
        """Its text with the last quarter replaced by the start of the next document's; that text's sketch."""
        cut = len(self.text) // 4
        if not cut:
            return self.data, self.sketch
        head = self.text[: len(self.text) - cut].encode("utf-8", "replace")
        new = head + after.text[:cut].encode("utf-8", "replace")
        whole = len(head) - SHINGLE + 1
        if whole < 1 or len(new) < SHINGLE:
            return new, bottom(window_hashes(new))
        rest = new[whole:]
        fresh = window_hashes(rest) if len(rest) >= SHINGLE else np.empty(0, np.uint64)
        return new, bottom(np.concatenate([self.hashes[:whole], fresh]))


def in_order(docs: DataFrame) -> DataFrame:
    """doc_id, text, guest: documents dealt by ascending doc_id and sorted, each partition ending with a guest,
    the first document of the partition after it (after the last: of the first).

    Cut points are quantiles of doc_id, one for each partition; they and the partitions' first ids are
    all that the driver sees. Rows without doc_id come first; rows with the same one are ordered by text hash.
    """
    spark = docs.sparkSession
    parts = max(parallel(spark), docs.rdd.getNumPartitions())  # as many as the input has splits, or more
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), key.alias("key"))
    cuts = rows.agg(F.percentile_approx("key", [i / parts for i in range(1, parts)] or [0.5], max(10_000, 10 * parts))).first()[0]
    cuts = np.array(sorted(set(cuts or [])), np.int64)

    @F.pandas_udf("int")
    def part_of(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, k.to_numpy(np.int64), "right").astype("int32"))

    dealt = rows.withColumn("part", part_of("key"))
    firsts = sorted((r[0], r[1]) for r in dealt.groupBy("part").agg(F.min("key")).collect())
    to = [(first, firsts[i - 1][0]) for i, (_, first) in enumerate(firsts)]
    guests = F.broadcast(spark.createDataFrame(to, "key long, before int"))
    return (
        dealt.join(guests, "key", "left")
        .select(
            "doc_id", "text", "key",
            F.explode(F.when(F.col("before").isNull(), F.array(F.struct("part", F.lit(0).alias("guest"))))
                      .otherwise(F.array(F.struct("part", F.lit(0).alias("guest")), F.struct(F.col("before").alias("part"), F.lit(1).alias("guest"))))).alias("at"),
        )
        .select("doc_id", "text", "key", "at.*")
        .repartitionById(len(cuts) + 1, F.col("part"))
        .sortWithinPartitions("guest", "key", F.xxhash64("text"))
        .select("doc_id", "text", "guest")
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text, ...) -> doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    contained_edited (how much of the text is in its edited one, estimated), distinct_shingles (estimated).

    One row for each input row. A null text counts as empty and has an empty fingerprint; two empty
    fingerprints have likeness 1, an empty and another one 0. The next document is the one with the next
    doc_id (see in_order); for the last it is the first, for a single document itself.
    """
    schema = (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string,"
        " edited_fingerprint string, near_edited double, near_next double, contained_edited double, distinct_shingles double"
    )

    def row(x: _Part, after: _Part) -> tuple:
        new, sketch = x.edited(after)
        return (
            x.doc_id, len(x.text), hashlib.sha256(new).hexdigest(), encode(x.sketch), encode(sketch),
            resemblance(x.sketch, sketch), resemblance(x.sketch, after.sketch), containment(x.sketch, sketch), distinct(x.sketch),
        )

    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.float64()] * 4]
    names = [x.split()[0] for x in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, over = None, False
        for b in batches:
            out = []
            for doc_id, text, guest in zip(*b.columns, strict=True):
                if over:
                    break
                x = _Part(doc_id.as_py(), text.as_py())
                if last is not None:
                    out.append(row(last, x))
                last, over = x, bool(guest.as_py())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)

    return in_order(docs).mapInArrow(run, schema)
