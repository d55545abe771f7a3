"""Readers, sinks and streams on small files."""

import json

import pytest
from pyspark.sql import functions as F

from runlens.sources import readers as R
from runlens.sources import schemas
from runlens.sources import sinks as K
from runlens.streaming import streams


def test_later_lines_patch_earlier_ones(spark, tmp_path):
    (tmp_path / "runs.1.ndjson").write_text('{"runId":"a","status":"running","layer":"x"}\n{"runId":"b","status":"done"}\n')
    (tmp_path / "runs.2.ndjson").write_text('{"runId":"a","status":"done"}\n\n{"runId":"a","layer":null}\n')
    got = R.log_store(spark, str(tmp_path), schemas.RUNS, "runId").select("runId", "status", "layer").orderBy("runId").collect()
    assert [tuple(r) for r in got] == [("a", "done", None), ("b", "done", None)]


def test_a_file_is_read_by_several_tasks(spark, tmp_path):
    n = 6000
    with (tmp_path / "runs.1.ndjson").open("w") as f:
        for i in range(n):
            f.write(json.dumps({"runId": f"r{i % 1500}", "status": f"s{i}", **({"layer": f"l{i}"} if i < 1500 else {})}) + "\n")
    (tmp_path / "runs.2.ndjson").write_text('{"runId":"r7","layer":null}\n')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        assert R.lines(spark, str(tmp_path)).rdd.getNumPartitions() > 5
        got = {r.runId: (r.status, r.layer, r.source.rsplit("/", 1)[1]) for r in R.log_store(spark, str(tmp_path), schemas.RUNS, "runId", source=True).collect()}
        assert got == {f"r{i}": (f"s{i + 4500}", None if i == 7 else f"l{i}", "runs.2.ndjson" if i == 7 else "runs.1.ndjson") for i in range(1500)}
        numbered = R.numbered(spark, str(tmp_path), "*.1.ndjson").collect()
        assert sorted((r.line, json.loads(r.value)["status"]) for r in numbered) == [(i, f"s{i}") for i in range(n)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_malformed_lines_are_named(spark, tmp_path):
    (tmp_path / "a.ndjson").write_text('{"runId":"a"}\n\nnot json\n[1]\n{"status":"x"}\n{"runId":"b","status":5}\n')
    good, bad = R.parsed_lines(spark, str(tmp_path), schemas.RUNS)
    assert sorted((r.line, r.value) for r in bad.collect()) == [(2, "not json"), (3, "[1]")] and good.count() == 3
    with pytest.raises(Exception, match="no JSON object in .*a.ndjson, split from byte 0: not json"):
        R.log_store(spark, str(tmp_path), schemas.RUNS, "runId").collect()
    (tmp_path / "a.ndjson").write_text('{"status":"x"}\n')
    with pytest.raises(Exception, match="no runId in"):
        R.log_store(spark, str(tmp_path), schemas.RUNS, "runId").collect()


def test_nested_export_becomes_runs(spark, tmp_path):
    attribute = lambda k, v: {"key": k, "value": {"stringValue": v}}
    spans = [
        {"traceId": "t", "spanId": "1", "name": "root", "startTimeUnixNano": "1700000000000000000", "endTimeUnixNano": "1700000002000000000", "status": {"code": "OK"}, "attributes": []},
        {"traceId": "t", "spanId": "2", "parentSpanId": "1", "name": "llm", "startTimeUnixNano": "1700000000500000000", "endTimeUnixNano": "1700000001000000000", "status": {"code": "STATUS_CODE_ERROR"}, "attributes": [attribute("model", "m-1"), attribute("gen_ai.usage.input_tokens", "12")]},
    ]
    (tmp_path / "e.json").write_text(json.dumps({"resourceSpans": [{"resource": {"attributes": []}, "scopeSpans": [{"spans": spans}]}]}))
    flat = R.project_spans(R.flatten_export(R.json_lines(spark, str(tmp_path), schemas.EXPORT)))
    run = R.runs_of_traces(flat).first()
    assert (run.runId, run.spans, run.errors, run.wallMs, run.input_tokens, run.cost_kind, run.terminalOutcome) == ("t", 2, 1, 2000, 12.0, "uncaptured", "succeeded")


def test_ratings_vanish_without_a_finite_one(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 3.0), ("b", "x", None), ("c", "x", float("nan"))], "runId string, rater string, rating double")
    got = R.feedback_table(df, (1.0, 5.0)).collect()
    assert [(r.runId, r.score, r.by_rater) for r in got] == [("a", 0.25, {"x": 0.0, "y": 0.5})]


def test_relevance_files_of_both_widths(spark, tmp_path):
    (tmp_path / "q.txt").write_text("q1 0 d1 2\nq2 d2 1\n\n")
    assert sorted(tuple(r) for r in R.qrels(spark, str(tmp_path)).collect()) == [("q1", "d1", 2), ("q2", "d2", 1)]


def test_rejects_carry_reasons_and_null_does_not_pass(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (None, -1)], "a int, b int")
    good, bad = R.rejects(df, {"a": F.col("a").isNotNull(), "b": F.col("b") > 0})
    assert good.count() == 1 and sorted(r.reasons for r in bad.collect()) == [["a", "b"], ["b"]]


def test_gated_rows_do_not_train(spark):
    df = spark.createDataFrame([("i", "train", "completed", 1.0, False, "good"), ("i", "train", "completed", 1.0, True, "gamed"), ("i", "train", "completed", None, False, "ungraded")], "instance string, split string, status string, reward double, gated boolean, completion string")
    assert [r.completion for r in K.trainable(df).collect()] == ["good"]
    group = K.grpo_rows(df).first().completions
    assert [(c.completion, c.advantage) for c in group] == [("good", 1.0), ("gamed", -1.0)]


def test_conflicting_rewrites_are_found(spark):
    df = spark.createDataFrame([("a", "1"), ("a", "1"), ("b", "1"), ("b", "2")], "id string, p string")
    assert [r.id for r in R.ledger_conflicts(df, "id", F.col("p")).collect()] == ["b"]


def run(df, spark, mode, name):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return [tuple(r) for r in spark.table(name).collect()]


def test_streams_equal_batches(spark, tmp_path):
    rows = [("u", i, a) for i, a in enumerate(["x", "x", None, "x", "x", "y"])]
    spark.createDataFrame(rows, "lane string, at long, action string").coalesce(1).write.parquet(str(tmp_path / "s"))
    source = streams.file_stream(spark, str(tmp_path / "s"), "lane string, at long, action string")
    assert run(streams.repeated_actions(source, "lane", "at", "action", idle_ms=None), spark, "append", "alerts") == [("u", 3, "x", 3)]
    guard = streams.budget_guard(source, "lane", F.col("at"), 10.0)
    assert run(guard, spark, "complete", "guard") == [("u", 15, 10.0, True)]
    wealth = run(streams.wealth_stream(source, "lane", "at", F.lit(1.0), idle_ms=None), spark, "update", "wealth")
    assert [r[:2] for r in wealth] == [("u", 6)] and wealth[0][2] > 1


def test_gate_stream_restarts_with_its_state(spark, tmp_path):
    import random

    from runlens.operators.statistics import Gate

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng, sides, scores = random.Random(3), [], {}
    for lane, gain in (("up", 0.85), ("even", 0.0), ("short", 0.3)):
        for i in range(60 if lane != "short" else 4):
            a = rng.uniform(0.3, 0.6)
            scores[lane, i] = a, a + gain * rng.random() + rng.uniform(-0.1, 0.1)
            sides += [(rng.randrange(3), lane, i, after, scores[lane, i][after]) for after in (0, 1)]
    schema = "lane string, pair long, after int, score double"
    want, waiting = {}, {}
    (tmp_path / "in").mkdir()
    source = streams.file_stream(spark, str(tmp_path / "in"), schema)
    for batch in range(3):
        part = [s for s in sides if s[0] == batch]
        for _, lane, i, after, score in sorted(part, key=lambda s: s[1:4]):
            gate = want.setdefault(lane, Gate(50, least=5))
            other = waiting.pop((lane, i), None)
            if other is None:
                waiting[lane, i] = score
            else:
                gate.add(score - other if after else other - score)
        spark.createDataFrame([s[1:] for s in part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = streams.gate_stream(source, "lane", "pair", F.col("after") == 1, F.col("score"), 50, wait_ms=None, least=5)
        # every batch is a query of its own, which starts from the checkpoint of the one before
        q = out.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).foreachBatch(lambda df, n: df.write.mode("append").parquet(str(tmp_path / "out"))).trigger(availableNow=True).start()
        assert q.awaitTermination(180)
        got = {}
        for r in spark.read.parquet(str(tmp_path / "out")).collect():
            if r.n >= got.get(r.lane, (0,))[0]:
                got[r.lane] = (r.n, round(r.wealth, 9), r.decision)
        assert got == {k: (g.process.n, round(g.process.wealth, 9), g.decision) for k, g in want.items()}
    assert {k: g.decision for k, g in want.items()} == {"up": "promote", "even": "undecided-at-maxN", "short": "continue"}
