"""Writers and training-row shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import gated_score


def write_json(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def flat_trace_lines(spans: DataFrame, ids: tuple[str, str, str], name: str, start_ms: str, end_ms: str, failed: Column, attributes: Column) -> DataFrame:
    """value: each span as a flat trace line of JSON."""
    iso = lambda c: F.date_format(F.timestamp_millis(c), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    trace, span, parent = ids
    line = F.struct(
        F.col(trace).alias("trace_id"), F.col(span).alias("span_id"), F.coalesce(F.col(parent), F.lit("")).alias("parent_span_id"), F.col(name).alias("name"),
        iso(F.col(start_ms)).alias("start_time"), iso(F.col(end_ms)).alias("end_time"), F.struct(F.when(failed, "ERROR").otherwise("OK").alias("code")).alias("status"), attributes.alias("attributes"),
    )
    return spans.select(F.to_json(line).alias("value"))


def trainable(rollouts: DataFrame, splits: tuple[str, ...] = ("search", "train")) -> DataFrame:
    """Completed, positively scored, ungated lines of the splits that may be learned from; `score` is the gated one."""
    scored = rollouts.withColumn("score", gated_score(F.col("reward"), F.col("gated")))
    return scored.where((F.col("status") == "completed") & (F.col("score") > 0) & F.col("split").isin(*splits))


def sft_rows(rollouts: DataFrame) -> DataFrame:
    return trainable(rollouts).select(F.concat("messages", F.array(F.struct(F.lit("assistant").alias("role"), F.col("completion").alias("content")))).alias("messages"))


def grpo_rows(rollouts: DataFrame) -> DataFrame:
    """instance, completions with their scores and advantages, best first; gated ones take part with 0, ungraded ones do not."""
    scored = rollouts.withColumn("score", gated_score(F.col("reward"), F.col("gated"))).where("score is not null and status = 'completed'")
    by = scored.groupBy("instance").agg(F.avg("score").alias("m"), F.stddev_pop("score").alias("sd"), F.collect_list(F.struct("score", "completion")).alias("c"))
    advantage = lambda x: F.struct(x["score"].alias("score"), x["completion"].alias("completion"), F.coalesce(F.try_divide(x["score"] - F.col("m"), F.col("sd")), F.lit(0.0)).alias("advantage"))
    return by.where(F.size("c") > 1).select("instance", F.transform(F.reverse(F.array_sort("c")), advantage).alias("completions"))


def dpo_rows(preferences: DataFrame, texts: DataFrame, key: str, prompt: str, completion: str) -> DataFrame:
    """prompt, chosen, rejected from (chosen, rejected) keys; a pair without both texts is left out."""
    good = texts.select(F.col(key).alias("chosen"), F.col(prompt).alias("prompt"), F.col(completion).alias("chosen_text"))
    bad = texts.select(F.col(key).alias("rejected"), F.col(completion).alias("rejected_text"))
    return preferences.join(good, "chosen").join(bad, "rejected").select("prompt", F.col("chosen_text").alias("chosen"), F.col("rejected_text").alias("rejected"))


def manifest(df: DataFrame, by: str) -> DataFrame:
    """by, rows, digest: an order-free digest of the rows, to tell two exports apart."""
    row = F.xxhash64(F.to_json(F.struct(*df.columns)))
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("rows"), F.hex(F.bit_xor(row)).alias("digest"))
