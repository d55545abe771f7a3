"""Scans: lazy, with fixed schemas; a malformed line is an error unless a reader says otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scores import first_number
from ..functions.text import epoch_millis
from . import schemas


def json_lines(spark: SparkSession, path: str, schema: str, skip_malformed: bool = False) -> DataFrame:
    """JSON lines of one schema. By default the first malformed line fails the scan."""
    mode = "DROPMALFORMED" if skip_malformed else "FAILFAST"
    return spark.read.schema(schema).option("mode", mode).option("recursiveFileLookup", True).json(path)


def run_records(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path, schemas.RUN_RECORDS)


def outcomes(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path, schemas.OUTCOMES)


def rollouts(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path, schemas.ROLLOUTS)


def lines(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """file, block, at, value: the lines of text files, which Spark splits; block is the byte where a split begins.

    at grows along a split, so (file, block, at) orders a file's lines whatever tasks read them. It holds where
    lines() is read directly, before any shuffle.
    """
    reader = spark.read.option("recursiveFileLookup", True)
    reader = reader.option("pathGlobFilter", pattern) if pattern else reader
    return reader.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")


def numbered(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """file, line (from 0, blank ones counted), value: one more scan counts the lines of each split."""
    own = W.partitionBy("file").orderBy("block")
    rows = lines(spark, path, pattern)
    splits = rows.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))  # a row for each split
    splits = splits.withColumn("before", F.sum("n").over(own) - F.col("n")).drop("n")
    return rows.join(splits, ["file", "block"]).select("file", (F.col("before") + F.col("at") - F.col("first")).cast("int").alias("line"), "value")


def parsed_lines(spark: SparkSession, path: str, schema: str, pattern: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(file, block, at, r, has) of JSON lines of a schema with the keys each has, and (file, line, value) of those that are none; blank lines count as neither."""
    good = lambda df: df.where("trim(value) <> ''").withColumn("_keys", F.json_object_keys("value"))
    row = F.from_json("value", schema, {"mode": "PERMISSIVE"})
    read = good(lines(spark, path, pattern)).where(F.col("_keys").isNotNull())
    bad = good(numbered(spark, path, pattern)).where(F.col("_keys").isNull())
    return read.select("file", "block", "at", row.alias("r"), F.col("_keys").alias("has")), bad.select("file", "line", "value")


def log_store(spark: SparkSession, path: str, schema: str, key: str, source: bool = False) -> DataFrame:
    """An append-only JSON log of rows and patches as its latest rows, one for each key; with `source`, also the file that wrote to each row last.

    A later line patches an earlier one: of each column the last line that has it counts, an explicit null too.
    Files go by name, with a rolled file before the active one; lines by place in the file, which several tasks
    may read. A line that is no JSON object, or one without key, is an error that names its file and split.
    """
    rows = lines(spark, path).where("trim(value) <> ''")
    row, has = F.from_json("value", schema, {"mode": "FAILFAST"}), F.json_object_keys("value")
    where = F.concat(F.col("file"), F.lit(", split from byte "), F.col("block").cast("string"), F.lit(": "), F.substring("value", 1, 80))
    checked = F.when(has.isNull(), F.raise_error(F.concat(F.lit("no JSON object in "), where)).cast("string")).otherwise(F.col("value"))
    rows = rows.withColumn("value", checked)
    parsed = rows.select(F.struct("file", "block", "at").alias("place"), row.alias("r"), has.alias("has"), where.alias("where"))
    fields = parsed.schema["r"].dataType.fieldNames()
    named = F.coalesce(F.col(f"r.{key}").cast("string"), F.raise_error(F.concat(F.lit(f"no {key} in "), F.col("where"))).cast("string"))
    last = [F.max_by(F.col(f"r.{c}"), F.when(F.array_contains("has", c), F.col("place"))).alias(c) for c in fields if c != key]
    last += [F.max("place")["file"].alias("source")] if source else []
    out = parsed.groupBy(named.cast(parsed.schema["r"].dataType[key].dataType).alias(key)).agg(*last)
    return out.select(*fields, *(["source"] if source else []))


def flat_spans(spark: SparkSession, path: str) -> DataFrame:
    """Flat trace lines with times in milliseconds; a line without trace or span id is left out."""
    rows = json_lines(spark, path, schemas.FLAT_SPANS)
    return project_spans(rows)


def project_spans(rows: DataFrame) -> DataFrame:
    """The read model of flat spans: ids, times, status, and what prioritised attributes tell."""
    attribute = lambda *keys: F.coalesce(*(F.try_element_at("attributes", F.lit(k)) for k in keys))
    start, end = epoch_millis(F.col("start_time")), epoch_millis(F.col("end_time"))
    return rows.where("trace_id <> '' and span_id <> ''").select(
        "trace_id", "span_id", F.nullif("parent_span_id", F.lit("")).alias("parent_span_id"), "name",
        F.coalesce(attribute("span.kind", "openinference.span.kind"), "kind").alias("kind"),
        start.alias("start_ms"), end.alias("end_ms"), F.greatest(end - start, F.lit(0)).alias("duration_ms"),
        (F.upper(F.coalesce("status.code", F.lit(""))).contains("ERROR") | (F.col("status.code") == "2")).alias("failed"), F.col("status.message").alias("message"),
        attribute("gen_ai.request.model", "llm.model_name", "model").alias("model"), attribute("gen_ai.tool.name", "tool.name", "tool_name").alias("tool"),
        attribute("gen_ai.agent.name", "agent.name").alias("agent"),
        first_number(F.col("attributes"), ["gen_ai.usage.input_tokens", "llm.token_count.prompt"]).alias("input_tokens"),
        first_number(F.col("attributes"), ["gen_ai.usage.output_tokens", "llm.token_count.completion"]).alias("output_tokens"),
        first_number(F.col("attributes"), ["gen_ai.usage.cost", "llm.cost.total"]).alias("cost_usd"),
    )


def flatten_export(rows: DataFrame) -> DataFrame:
    """Nested trace exports (resourceSpans, scopeSpans, spans) as flat spans."""
    def pairs(attributes: Column) -> Column:
        value = lambda v: F.coalesce(v["stringValue"], v["intValue"], v["doubleValue"].cast("string"), v["boolValue"].cast("string"))
        return F.map_from_entries(F.transform(F.coalesce(attributes, F.array().cast("array<struct<key:string,value:struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean>>>")), lambda a: F.struct(a["key"], value(a["value"]))))

    spans = rows.select(F.inline("resourceSpans")).select("resource", F.inline("scopeSpans")).select("resource", F.inline("spans"))
    return spans.select(
        F.col("traceId").alias("trace_id"), F.col("spanId").alias("span_id"), F.coalesce("parentSpanId", F.lit("")).alias("parent_span_id"), "name",
        F.lit(None).cast("string").alias("kind"), F.col("startTimeUnixNano").alias("start_time"), F.col("endTimeUnixNano").alias("end_time"), "status",
        F.struct(pairs(F.col("resource.attributes")).alias("attributes")).alias("resource"), pairs(F.col("attributes")).alias("attributes"),
    )


def runs_of_traces(spans: DataFrame) -> DataFrame:
    """One run record for each trace of projected spans: counts, tokens, cost with provenance, terminal outcome."""
    known, llm = F.count("cost_usd"), F.count_if(F.col("model").isNotNull())
    kind = F.when(known == 0, "uncaptured").when(known < llm, "estimated").otherwise("observed")
    root = F.min_by("failed", F.struct(F.col("parent_span_id").isNotNull(), "start_ms"))
    return spans.groupBy(F.col("trace_id").alias("runId")).agg(
        F.count(F.lit(1)).alias("spans"), F.count_if("failed").alias("errors"), F.count("tool").alias("tool_calls"), llm.alias("llm_calls"),
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("cost_usd").alias("costUsd"), kind.alias("cost_kind"),
        F.mode("model", deterministic=True).alias("model"), (F.max("end_ms") - F.min("start_ms")).alias("wallMs"),
        F.when(root, "failed").otherwise("succeeded").alias("terminalOutcome"),
    )


def feedback_table(ratings: DataFrame, scale: tuple[float, float] | None = None) -> DataFrame:
    """(runId, rater, rating number or boolean) -> runId, score (mean), by_rater: ratings within the scale as 0..1; runs without a finite rating vanish."""
    x = F.col("rating").cast("double")
    if scale:
        x = (x - scale[0]) / (scale[1] - scale[0])
    rows = ratings.select("runId", "rater", x.alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    by = rows.groupBy("runId", "rater").agg(F.avg("x").alias("x"))
    return by.groupBy("runId").agg(F.avg("x").alias("score"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("rater", "x")))).alias("by_rater"))


def qrels(spark: SparkSession, path: str) -> DataFrame:
    """query, doc, grade of relevance files with three or four columns."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where("trim(value) <> ''").select(parts.alias("p"))
    four = F.size("p") == 4
    return rows.select(F.col("p")[0].alias("query"), F.when(four, F.get("p", F.lit(2))).otherwise(F.get("p", F.lit(1))).alias("doc"), F.when(four, F.get("p", F.lit(3))).otherwise(F.get("p", F.lit(2))).cast("int").alias("grade"))


def transcript(spark: SparkSession, path: str) -> DataFrame:
    """file, line, type, role, text, input and output tokens of coding-agent transcripts in JSON lines; the two common dialects."""
    at = lambda *ps: F.coalesce(*(F.get_json_object("value", p) for p in ps))
    rows = numbered(spark, path)
    return rows.where("trim(value) <> ''").select(
        "file", "line", at("$.type").alias("type"), at("$.message.role", "$.role", "$.item.role").alias("role"),
        at("$.message.content", "$.item.text", "$.content", "$.text").alias("text"),
        at("$.message.usage.input_tokens", "$.usage.input_tokens").cast("double").alias("input_tokens"),
        at("$.message.usage.output_tokens", "$.usage.output_tokens").cast("double").alias("output_tokens"),
    )


def rejects(rows: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows with `reasons`): named row constraints; null does not pass."""
    failed = F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in checks.items())), lambda x: x.isNotNull())
    named = rows.withColumn("reasons", failed)
    return named.where(F.size("reasons") == 0).drop("reasons"), named.where(F.size("reasons") > 0)


def scorecard(log: DataFrame, scenario: str, profile: str, time: str, values: list[str]) -> DataFrame:
    """scenario, profile, timeline: entries in order of time."""
    entry = F.struct(F.col(time).alias("at"), *values)
    return log.groupBy(scenario, profile).agg(F.array_sort(F.collect_list(entry)).alias("timeline"))


def ledger_conflicts(log: DataFrame, key: str, payload: Column) -> DataFrame:
    """Ids of a log that were written again with another content; equal repeats are none."""
    by = log.groupBy(key).agg(F.countDistinct(F.sha2(payload, 256)).alias("versions"), F.count(F.lit(1)).alias("n"))
    return by.where("versions > 1")


def hash_chain(log: DataFrame, order: str, digest: str, previous: str) -> DataFrame:
    """Entries whose link to the one before does not hold."""
    before = F.lag(digest).over(W.orderBy(order))
    return log.withColumn("_b", before).where(~F.col(previous).eqNullSafe(F.col("_b"))).drop("_b")
