"""Operators over texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Bytes of a wanted text's head that windows of the searched texts are joined by.
HEAD = 24
#: Wanted texts of a key up to which each of its messages is held against all of them.
FEW = 1000


def _head(raw: Column, at: Column, size: Column | int) -> Column:
    return F.xxhash64(F.substring(raw, at, F.lit(size) if isinstance(size, int) else size))


def _sizes(wanted: DataFrame, text: str, head: int) -> list[int]:
    """The head sizes that occur: `head`, and those of shorter wanted texts; at most `head` numbers."""
    found = wanted.select(F.least(F.octet_length(text), F.lit(head)).alias("n")).where("n > 0").distinct().collect()
    return sorted(r.n for r in found)


def _windows(rows: DataFrame, keep: Sequence[str], text: str, sizes: Sequence[int]) -> DataFrame:
    """keep, _h: the hashes of all windows of these sizes of each text."""
    raw = rows.select(*keep, F.col(text).cast("binary").alias("_raw")).where(F.octet_length("_raw") > 0)
    at = raw.select(*keep, "_raw", F.explode(F.sequence(F.lit(1), F.octet_length("_raw"))).alias("_at"))
    left = F.octet_length("_raw") - F.col("_at") + 1
    hashes = F.array(*(F.when(left >= n, F.xxhash64(F.lit(n), _head(F.col("_raw"), F.col("_at"), n))) for n in sizes))
    return at.select(*keep, hashes[0].alias("_h") if len(sizes) == 1 else F.explode(hashes).alias("_h")).where("_h is not null")


def _keyed(wanted: DataFrame, text: str, head: int) -> DataFrame:
    n = F.least(F.octet_length(text), F.lit(head))
    return wanted.where(F.octet_length(text) > 0).withColumn("_h", F.xxhash64(n, _head(F.col(text).cast("binary"), F.lit(1), n)))


def leaks(docs: DataFrame, canaries: DataFrame, doc: str, text: str, item: str, canary: str, head: int = HEAD) -> DataFrame:
    """(item, doc) where a canary stands in a text as it is, once for each pair.

    Not all pairs are compared: a canary is found by its first `head` bytes, or all if it is shorter, which
    join with windows of that size of the texts, and is then held against the text in full. Empty and null
    ones leak nowhere.
    """
    wanted = canaries.select(F.col(item).alias("_item"), F.col(canary).alias("_canary"))
    sizes = _sizes(wanted, "_canary", head)
    if not sizes:
        return docs.select(doc).join(canaries.select(item)).where("false").select(item, doc)
    wanted = _keyed(wanted, "_canary", head)
    hit = _windows(docs, [doc], text, sizes).join(wanted.select("_h").distinct(), "_h", "left_semi").distinct()
    near = hit.join(wanted, "_h").join(docs.select(doc, text), doc)
    return near.where(F.col(text).contains(F.col("_canary"))).select(F.col("_item").alias(item), doc).distinct()


def last_seen(messages: DataFrame, wanted: DataFrame, key: str, text: str, time: str, said: str, head: int = HEAD) -> DataFrame:
    """key, said, last: for each wanted text of a key the time of that key's last message that has it; no row without one.

    Messages meet the wanted texts of their key as one list, so they are shuffled once and only what they have
    becomes rows. Keys with more than FEW wanted texts are searched by the windows of their messages instead,
    which costs rows by the byte but no pairs.
    """
    named = wanted.where(F.octet_length(said) > 0).select(key, said)
    sizes = named.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    lists = named.join(sizes.where(F.col("_n") <= FEW), key).groupBy(key).agg(F.collect_list(said).alias("_wanted"))
    has = F.filter("_wanted", lambda w: F.col(text).contains(w))
    found = messages.select(key, time, text).hint("merge").join(lists, key).select(key, time, F.explode(has).alias(said)).groupBy(key, said).agg(F.max(time).alias("last"))
    many = named.join(sizes.where(F.col("_n") > FEW), key).select(key, said)
    heads = _sizes(many, said, head)
    if not heads:
        return found
    many = _keyed(many, said, head)
    asked = messages.join(many.select(key).distinct(), key, "left_semi")
    hit = _windows(asked, [key, time], text, heads).join(many.select(key, "_h").distinct(), [key, "_h"], "left_semi").distinct()
    near = hit.join(many, [key, "_h"]).join(messages.select(key, time, text), [key, time])
    return found.unionByName(near.where(F.col(text).contains(F.col(said))).groupBy(key, said).agg(F.max(time).alias("last")))


def top_words(docs: DataFrame, group: str, words: Column, n: int, least: int = 1) -> DataFrame:
    """group, word, n: the most frequent words of each group, ties by word."""
    counts = docs.select(group, F.explode(words).alias("word")).groupBy(group, "word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    rank = F.row_number().over(W.partitionBy(group).orderBy(F.desc("n"), "word"))
    return counts.withColumn("_r", rank).where(F.col("_r") <= n).drop("_r")
