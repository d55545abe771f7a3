"""Empty, single-row, tie and null cases of operators and functions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from runlens.functions import distributions as D
from runlens.functions import moments, scores, text
from runlens.operators import aggregates as A
from runlens.operators import evaluation as E
from runlens.operators import joins as J
from runlens.operators import ordered as O
from runlens.operators import records as R
from runlens.operators import statistics as S
from runlens.operators import texts as X
from runlens.operators import trees


def rows(df):
    return [tuple(r) for r in df.collect()]


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_wilson_of_no_trials_is_everything(spark):
    low, high = scores.wilson(F.lit(0), F.lit(0))
    assert tuple(one(spark, a=low, b=high)) == (0.0, 1.0)


@pytest.mark.parametrize("n,c,k,want", [(5, 0, 2, 0.0), (5, 5, 2, 1.0), (5, 4, 2, 1.0), (4, 1, 2, 0.5), (10, 3, 5, 1 - math.comb(7, 5) / math.comb(10, 5))])
def test_pass_at_k(spark, n, c, k, want):
    assert one(spark, x=scores.pass_at_k(F.lit(n), F.lit(c), k)).x == pytest.approx(want)


def test_leaderboard_ties_unknown_cost_and_empty(spark):
    runs = spark.createDataFrame([("b", True, 1.0), ("a", True, None), ("c", True, 1.0)], "c string, ok boolean, cost double")
    got = {r.candidate: (r["rank"], r.mean_cost) for r in A.leaderboard(runs, "c", F.col("ok"), F.col("cost")).collect()}
    assert got == {"b": (1, 1.0), "c": (2, 1.0), "a": (3, None)}
    assert rows(A.leaderboard(runs.limit(0), "c", F.col("ok"), F.col("cost"))) == []


def test_histogram_of_a_constant_and_of_nothing(spark):
    df = spark.createDataFrame([(2.0,), (2.0,), (None,)], "v double")
    assert rows(A.histogram(df, F.col("v"))) == [(0, 2.0, 2.0, 2)]
    assert rows(A.histogram(df.where("v > 5"), F.col("v"))) == []


@pytest.mark.parametrize("a,b,want", [([1, 1], [2, 2], 1.0), ([1, 2], [3, 3], 0.0), ([1, 2, 3], [2, 4, 6], 1.0), ([1, 2, 3], [3, 2, 1], -1.0)])
def test_pearson_guards(spark, a, b, want):
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b, strict=True)], "a double, b double")
    assert df.agg(moments.pearson(F.col("a"), F.col("b")).alias("r")).first().r == pytest.approx(want)


def test_pearson_of_one_pair_is_nan(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 1.0)], "a double, b double")
    assert math.isnan(df.agg(moments.pearson(F.col("a"), F.col("b")).alias("r")).first().r)


def test_as_of_takes_the_latest_not_after(spark):
    left = spark.createDataFrame([(1, 10), (1, 5), (2, 9)], "k int, t int")
    right = spark.createDataFrame([(1, 5, "a"), (1, 8, "b"), (1, 11, "c"), (3, 1, "d")], "k int, u int, v string")
    got = {(r.k, r.t): r.v for r in J.latest_as_of(left, right, "k", "t", "u", ["v"]).collect()}
    assert got == {(1, 10): "b", (1, 5): "a", (2, 9): None}


def test_pairing_keeps_unmatched_sides(spark):
    df = spark.createDataFrame([("x", 1, 1, 5.0), ("y", 1, 1, 6.0), ("y", 1, 2, 7.0), ("x", 2, 1, 8.0)], "arm string, k int, o int, v double")
    got = sorted(rows(J.pair_arms(df, "arm", ("x", "y"), ["k"], ["o"], "v")))
    assert got == [(1, 1, 5.0, 6.0, "both"), (1, 2, None, 7.0, "after"), (2, 1, 8.0, None, "before")]


def test_frontier_keeps_equal_points(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0), (2, 1.0, 1.0), (3, 2.0, 1.0), (4, 2.0, 2.0)], "id int, cost double, q double")
    assert sorted(r.id for r in O.pareto_frontier(df, "cost", "q").collect()) == [1, 2, 4]


def test_touching_spans_are_apart_and_overlaps_count(spark):
    df = spark.createDataFrame([("a", 0, 10, 1), ("a", 10, 20, 2), ("a", 15, 30, 3)], "l string, s int, e int, k int")
    assert [r.island for r in O.pack_intervals(df, "l", "s", "e", "k").orderBy("k").collect()] == [1, 2, 2]
    ts = df.select("l", F.timestamp_seconds("s").alias("s"), F.timestamp_seconds("e").alias("e"))
    assert rows(O.max_concurrency(ts, "l", F.col("s"), F.col("e"))) == [("a", 2, 30.0, 30.0)]


def test_orphans_are_left_out_of_a_trajectory(spark):
    df = spark.createDataFrame([("r", "a", None, 1), ("r", "c", "a", 3), ("r", "b", "a", 2), ("r", "x", "gone", 4), ("r", "y", "y", 5)], "run string, s string, p string, o int")
    assert sorted(rows(trees.trajectory(df, "run", "s", "p", ["o"]))) == [("r", "a", 0, 0), ("r", "b", 1, 1), ("r", "c", 1, 2)]


def test_trajectory_depth_reads_every_turn(spark, tmp_path):
    from runlens.plans import QUERIES

    spark.createDataFrame([(1, i) for i in range(300)], "conv_id long, turn long").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.turn: r.depth for r in QUERIES["trajectory_depth"](spark, str(tmp_path)).collect()}
    assert got == {i: i.bit_length() for i in range(300)}


def test_guard_on_the_same_span_does_not_count(spark):
    df = spark.createDataFrame([("r", 1, True, True)], "run string, o int, p boolean, q boolean")
    rules = {"r1": ("precedes", F.col("p"), F.col("q"))}
    assert rows(O.contract(df, "run", ["o"], rules)) == [("r", "r1", False)]


def test_adjusted_p_values_with_ties(spark):
    df = spark.createDataFrame([("f", 1, 0.01), ("f", 2, 0.04), ("f", 3, 0.04), ("f", 4, 1.0)], "f string, k int, p double")
    got = {r.k: (r.bh, r.holm, r.bonferroni) for r in O.adjusted_p(df, "f", "p", "k").collect()}
    assert got[1] == pytest.approx((0.04, 0.04, 0.04)) and got[2][0] == got[3][0] == pytest.approx(0.16 / 3)
    assert got[4] == (1.0, 1.0, 1.0)


def test_distribution_functions_against_identities():
    assert D.normal_cdf(1.959963984540054) == pytest.approx(0.975, abs=1e-12)
    assert D.normal_quantile(0.975) == pytest.approx(1.959963984540054, abs=1e-9)
    assert D.student_t_cdf(1.0, 1) == pytest.approx(0.75)
    assert D.student_t_cdf(2.0, 2) == pytest.approx(0.5 + 2 / (2 * math.sqrt(2 + 4)))
    assert D.incomplete_beta(2, 3, 0.4) == pytest.approx(sum(math.comb(4, i) * 0.4**i * 0.6 ** (4 - i) for i in (2, 3, 4)))
    assert D.binomial_two_sided(0, 0) == 1 and D.binomial_two_sided(1, 6) == pytest.approx(2 * 7 / 64)
    low, high = D.clopper_pearson(0, 10)
    assert low == 0 and high == pytest.approx(1 - 0.025 ** (1 / 10))


def test_exact_rank_test_against_enumeration():
    import itertools

    n, m = 3, 4
    us = [sum(sum(b < a for b in range(n + m) if b not in pick) for a in pick) for pick in itertools.combinations(range(n + m), n)]
    for u in range(n * m + 1):
        low = min(u, n * m - u)
        assert D.mann_whitney_exact(u, n, m) == pytest.approx(min(1, 2 * sum(x <= low for x in us) / len(us)))


def test_signed_ranks_against_enumeration(spark):
    import itertools

    for ranks in ([2, 4, 6], [3, 3, 6, 8], [5, 5, 5, 5, 10]):
        sums = [sum(r for r, up in zip(ranks, signs, strict=True) if up) for signs in itertools.product([0, 1], repeat=len(ranks))]
        for s in set(sums):
            far = abs(s - sum(ranks) / 2)
            assert D.signed_rank_exact(ranks, far) == pytest.approx(sum(abs(x - sum(ranks) / 2) >= far for x in sums) / len(sums))
    df = spark.createDataFrame([("a", 0.0, 1.0), ("a", 0.0, 2.0), ("a", 0.0, 3.0), ("b", 1.0, 1.0), *(("c", 0.0, float(i)) for i in range(1, 31))], "g string, x double, y double")
    got = {r.g: (r.n, r.w, r.p) for r in S.wilcoxon(df, "g", F.col("x"), F.col("y")).collect()}
    assert got["a"] == (3, 6.0, pytest.approx(0.25)) and got["b"] == (0, 0.0, 1.0) and got["c"][:2] == (30, 465.0) and got["c"][2] < 1e-5


def test_power_against_published_values(spark):
    got = one(spark, a=D.required_n(F.lit(0.5)), b=D.required_n(F.lit(0.5), paired=True), c=D.required_n(F.lit(0.0)), d=D.mcnemar_n(F.lit(0.2), F.lit(0.2)), e=D.mcnemar_power(F.lit(0.3), F.lit(0.1), F.lit(100)), f=D.paired_mde(F.lit(0)))
    assert (got.a, got.b, got.c, got.d, got.f) == (63.0, 32.0, math.inf, math.inf, math.inf) and got.e == pytest.approx(0.8975, abs=1e-3)


def test_scorecard_verdicts(spark):
    runs = [("s", "p", "c1", 1, x) for x in (0.1, 0.2, 0.15, 0.12)] + [("s", "p", "c2", 2, x) for x in (0.8, 0.9, 0.85, 0.82)] + [("t", "p", "c1", 1, 0.5), ("t", "p", "c2", 2, 0.52), ("u", "p", "c2", 2, 0.5), ("u", "p", "c2", 2, None)]
    entries = R.record_runs(spark.createDataFrame(runs, "s string, p string, c string, at int, x double"), "s", "p", "c", "at", F.col("x"))
    got = {r.s: (r.verdict, r.p) for r in R.scorecard_diff(entries, "s", "p", "c", "at").collect()}
    assert got["s"][0] == "improved" and got["s"][1] < 1e-4 and got["t"] == ("flat", None) and got["u"] == ("new", None)


def test_baselines_and_periods(spark):
    rows_in = [("a", i < 5, 1.0 + i / 100, True) for i in range(10)] + [("b", i < 5, float(10**i), True) for i in range(10)] + [("c", i < 5, (2.0 if i < 5 else 1.0) + i / 1000, True) for i in range(10)] + [("d", False, 1.0, True)]
    df = spark.createDataFrame(rows_in, "m string, cand boolean, v double, up boolean")
    got = {r.m: r.verdict for r in R.against_baseline(df, "m", F.col("cand"), F.col("v"), F.col("up")).collect()}
    assert got == {"a": "regressed", "b": "unstable", "c": "improved", "d": "insufficient"}
    out = {r.metric: r.verdict for r in R.prior_period(df.where("m = 'c'"), F.col("cand"), {"up": (F.col("v"), True), "down": (F.col("v"), False), "none": (F.lit(None), True)}).collect()}
    assert out == {"up": "improved", "down": "regressed"}


def test_classes_of_failures_in_order(spark):
    runs = spark.createDataFrame([("ok", "completed", None, None, None), ("named", "failed", False, "pii_leak", None), ("late", "aborted", False, "unknown", "hit the Deadline"), ("stuck", "failed", False, None, None), ("idle", "failed", False, None, None), ("dry", "failed", False, None, None), ("odd", "failed", None, None, None), ("scope", "failed", False, None, None)], "runId string, status string, pass boolean, failureClass string, notes string")
    spans = [("stuck", f"s{i}", i, "tool", "grep", "error", None, None, None, None, None) for i in range(3)] + [("idle", "g", 1, "agent", None, None, None, None, None, None, 4), ("dry", "r", 1, "retrieval", None, None, None, None, None, None, None), ("odd", "f", 1, "judge", None, None, None, "format", 0.4, None, None)]
    spans = spark.createDataFrame(spans, "runId string, spanId string, ord int, kind string, toolName string, status string, exitCode int, dimension string, score double, bestHit double, toolsAvailable int")
    events = spark.createDataFrame([("scope", "e1", 1, "custom", '{"kind": "integration_manifest_resolved", "missing": [{"status": "ready", "missingScopes": ["read"]}]}'), ("scope", "e0", 2, "budget_breach", "{}")], "runId string, eventId string, ord int, kind string, payload string")
    got = {r.runId: (r.failure_class, r.trigger) for r in R.classify_failures(runs, spans, events).collect()}
    assert got == {"ok": ("success", None), "named": ("pii_leak", None), "late": ("timeout", None), "stuck": ("tool_recovery_failure", "s2"), "idle": ("tool_selection_error", None), "dry": ("bad_retrieval", "r"), "odd": ("format_drift", "f"), "scope": ("missing_integration_scope", "e1")}


def test_wealth_decides_for_a_clear_winner_only():
    good, even = S.Wealth(), S.Wealth()
    for i in range(200):
        good.add(1.0)
        even.add(float(i % 2))
    assert good.decided and even.decided is None and good.n == 200


def test_wealth_of_a_hand_computed_series():
    w = S.Wealth()
    assert w.add(1.0) == 1.0 and w.squares == pytest.approx((1 - 0.75) ** 2)
    bet = min(0.5, 0.25 / ((0.25 + 0.0625) / 2 + 0.0625))
    assert w.add(1.0) == pytest.approx(1 + bet * 0.5)
    with pytest.raises(ValueError):
        w.add(1.5)


def test_series_states(spark):
    series = {"flat": [0.5] * 5, "up": [0.1, 0.5, 0.2, 0.3, 0.4, 0.9], "down": [0.9, 0.7, 0.5, 0.2], "noisy": [0.1, 0.9, 0.2, 0.8, 0.3], "few": [0.1, 0.2], "zero": [0.0, 0.0, 0.0, 0.0, 0.0]}
    df = spark.createDataFrame([(k, i, v) for k, vs in series.items() for i, v in enumerate(vs)], "l string, i int, v double")
    got = {r.l: (r.state, r.tail_run) for r in O.series_convergence(df, "l", ["i"], "v").collect()}
    assert got == {"flat": ("stabilized", 0), "up": ("drifting-up", 3), "down": ("drifting-down", -3), "noisy": ("noisy", -1), "few": ("insufficient-data", 0), "zero": ("stabilized", 0)}


def test_stuck_loops_take_the_densest_stretch_of_serial_calls(spark):
    calls = [("r", "t", "x", i, s, e) for i, (s, e) in enumerate([(0, 1), (30_000, 31_000), (60_000, 61_000), (110_000, 111_000), (115_000, 116_000), (119_000, 119_500), (130_000, 131_000)])]
    calls += [("r", "u", "x", 20 + i, s, e) for i, (s, e) in enumerate([(0, 50), (10, 60), (20, 70)])]  # overlapping
    calls += [("r", "v", k, 30 + i, i * 10, i * 10 + 5) for i, k in enumerate("ababab")] + [("r", "w", "x", 40 + i, i, None) for i in range(5)]
    df = spark.createDataFrame(calls, "run string, track string, tool string, o int, s long, e long")
    find = lambda **k: sorted((r.track, r.tool, r["first"], r["last"], r.calls) for r in O.stuck_loops(df, ["run", "track"], F.col("s"), F.col("e"), "o", ["tool"], **k).collect())
    assert find() == [("t", "x", 110_000, 130_000, 4)] or find() == [("t", "x", 60_000, 119_000, 4)]
    assert find(between=1)[-2:] == [("v", "a", 0, 40, 3), ("v", "b", 10, 50, 3)]


def test_waste_of_failed_unused_and_empty_results(spark):
    runs = spark.createDataFrame([(1,), (2,)], "run int")
    calls = spark.createDataFrame([(1, 1, False, "the whole answer"), (1, 2, True, "the whole answer"), (1, 3, False, ""), (1, 4, False, None), (1, 5, False, "ab"), (1, 9, False, "the whole answer")], "run int, at int, bad boolean, result string")
    said = spark.createDataFrame([(1, 6, "so the whole answer is: ab"), (2, 7, "ab")], "run int, time int, text string")
    got = sorted(rows(J.tool_waste(runs, calls, said, "run", "at", "time", F.col("bad"), "result", "text")))
    assert got == [(1, 6, 2, pytest.approx(2 / 6)), (2, 0, 0, 0.0)]


def test_headroom_and_tight_budgets(spark):
    df = spark.createDataFrame([("a", "pass"), ("a", "unknown"), ("b", "fail"), ("c", "unknown")], "t string, o string")
    got = {r.t: (r.n, r.n_known, r.headroom) for r in E.headroom(df, "t", F.col("o")).collect()}
    assert got == {"a": (2, 1, "saturated"), "b": (1, 1, "gap"), "c": (1, 0, "unknown")}
    seen = spark.createDataFrame([("x", 0.0), ("x", 1.0), ("y", 0.3)], "c string, s double")
    cells = spark.createDataFrame([("x",), ("y",), ("z",)], "c string")
    share = lambda budget: {r.c: (r.n, r.share) for r in E.curriculum(seen, cells, ["c"], F.col("s"), budget).collect()}
    assert share(2) == {"x": (2, 1), "y": (1, 1), "z": (0, 1)}
    w = {"x": math.sqrt(0.55) + 1 / math.sqrt(2), "y": math.sqrt(0.05) + 1, "z": math.sqrt(0.05) + 1}
    assert share(103) == {k: (n, 1 + math.floor(100 * w[k] / sum(w.values()) + 0.5)) for k, n in (("x", 2), ("y", 1), ("z", 0))}


def test_reward_hacking_verdicts(spark):
    up = [("a", i, 0.1 + 0.04 * i, 0.5) for i in range(20)] + [("b", i, 0.5, 0.5) for i in range(20)] + [("c", i, 0.5, 0.5) for i in range(3)]
    df = spark.createDataFrame(up, "l string, i int, p double, t double")
    got = {r.l: (r.n, r.verdict, r.divergence) for r in E.reward_hacking(df, "l", ["i"], "p", "t").collect()}
    assert got == {"a": (20, "gaming", 1.0), "b": (20, "clean", 0.0), "c": (3, "insufficient_evidence", None)}


def test_truncation_fills_the_budget(spark):
    for said in ("a" * 500, "é" * 300, "aé\U0001f600" * 90, "short"):
        out = one(spark, x=text.truncate(F.lit(said), 200)).x
        size = len(said.encode())
        if size <= 200:
            assert out == said
        else:
            note = f"\n[truncated: original {size} bytes]"
            assert out.endswith(note) and said.startswith(out.removesuffix(note)) and 200 - 8 <= len(out.encode()) <= 200


def test_leaks_of_short_long_and_empty_canaries(spark):
    docs = spark.createDataFrame([(1, "say the very secret sentence of thirty letters aloud"), (2, "xx ab yy"), (3, None), (4, "")], "d int, t string")
    canaries = spark.createDataFrame([(1, "the very secret sentence of thirty letters"), (2, "ab"), (3, ""), (4, None)], "i int, c string")
    assert sorted(rows(X.leaks(docs, canaries, "d", "t", "i", "c"))) == [(1, 1), (2, 2)]


def test_signatures_and_redaction(spark):
    said = F.lit("at /usr/lib/x.py took 12ms  or 1.5gb for 550e8400-e29b-41d4-a716-446655440000")
    assert one(spark, x=text.error_signature(said)).x == "at <path> took #ms or #gb for <id>"
    blank = one(spark, a=text.error_signature(F.lit(None).cast("string"), F.lit("fetch")), b=text.error_signature(F.lit(" ")), c=text.error_signature(F.lit("5m or 2h or 7x")))
    assert tuple(blank) == ("(fetch — no message)", "(error — no message)", "#m or #h or 7x")
    rows_in = spark.createDataFrame([("a@b.co and A@B.co from 1.2.3.4",), ("ssn 123-45-6789, key sk-abcdefghijkl, Bearer abcdefghij.klm",), ("call 555-123-4567",), (None,)], "t string")
    got = text.redact(rows_in, "t", "x").collect()
    assert got[0].x == "[redacted:email] and [redacted:email] from [redacted:ipv4]" and (got[0].email, got[0].ipv4, got[0].ssn) == (2, 1, 0)
    assert got[1].x == "ssn [redacted:ssn], key [redacted:sk-key], [redacted:bearer]" and got[2].x == "call [redacted:phone-us]" and got[3].x is None


def test_log_functions(spark):
    log = F.lit("== 3 failed, 17 passed in 2s ==")
    assert tuple(one(spark, x=text.test_counts(log)).x) == (17, 3)
    diff = F.lit("--- a\n+++ b\n+x\n+y\n-z\n c")
    assert tuple(one(spark, x=text.patch_stats(diff)).x) == (1, 2, 1)
    assert one(spark, x=text.epoch_millis(F.lit("1700000000000000000"))).x == one(spark, x=text.epoch_millis(F.lit("1700000000"))).x == 1700000000000


def test_adjusted_p_values_order_distinct_values_only(spark):
    rng = random.Random(4)
    tests = [(f, i, rng.choice([0.0, 0.01, 0.02, 0.2, 0.9, 1.0])) for f in "ab" for i in range(40)] + [("b", 99, None)]
    df = O.adjusted_p(spark.createDataFrame(tests, "f string, k int, p double"), "f", "p", "k")
    assert "currentrow$(), unboundedfollowing" not in df._jdf.queryExecution().executedPlan().toString().lower()
    got = {(r.f, r.k): (r.bh, r.holm, r.bonferroni) for r in df.collect()}
    assert len(got) == len(tests)
    for f in "ab":
        mine = sorted(((p, k) for g, k, p in tests if g == f), key=lambda x: (x[0] is not None, x))
        m = len(mine)
        for i, (p, k) in enumerate(mine):
            later = [q * m / (j + 1) for j, (q, _) in enumerate(mine) if j >= i and q is not None]
            before = [q * (m - j) for j, (q, _) in enumerate(mine) if j <= i and q is not None]
            assert got[f, k] == pytest.approx((min([1.0, *later]), min(1.0, max(before, default=1.0)), 1.0 if p is None else min(1.0, p * m)))


def test_elo_pools_pass_through_tasks_without_groups(spark):
    rng = random.Random(5)
    matches = [(pool, i, *rng.sample("vwxyz", 2), rng.choice([0.0, 0.5, 1.0])) for pool in [*range(30), None] for i in range(7)]
    df = spark.createDataFrame(matches, "pool long, o int, a string, b string, s double").repartition(3)
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, "5")  # pools go on in the next batch
    try:
        out = S.elo(df, "pool", ["o"], "a", "b", F.col("s"))
        assert "FlatMapGroups" not in out._jdf.queryExecution().executedPlan().toString()
        got = {(r.pool, r.player): r.rating for r in out.collect()}
    finally:
        spark.conf.set(size, before)
    want: dict = {}
    for pool, _, a, b, s in sorted(matches, key=lambda m: (str(m[0]), m[1])):
        ra, rb = want.get((pool, a), 1000.0), want.get((pool, b), 1000.0)
        step = 32 * (s - 1 / (1 + 10 ** ((rb - ra) / 400)))
        want[pool, a], want[pool, b] = ra + step, rb - step
    assert got == pytest.approx(want)


@pytest.mark.parametrize("few", [3, 1000])
def test_last_messages_make_rows_of_what_they_have_only(spark, monkeypatch, few):
    monkeypatch.setattr(X, "FEW", few, raising=False)
    rng = random.Random(6)
    said = ["ab", "b", "the whole answer", "the whole answer of more than a head", "no", "\u00e9t\u00e9", ""]
    wanted = [(k, w) for k in range(6) for w in rng.sample(said, 1 + k)]
    told = [(k, t, rng.choice(["", "x"]).join(rng.choices(said + ["z "], k=3))) for k in range(7) for t in range(5)] + [(0, 9, None)]
    out = X.last_seen(spark.createDataFrame(told, "k int, t int, text string"), spark.createDataFrame(wanted, "k int, said string"), "k", "text", "t", "said")
    if few == 1000:
        assert "xxhash64" not in out._jdf.queryExecution().executedPlan().toString()  # no windows
    want = {(k, w): max(ts) for k, w in wanted if w and (ts := [t for key, t, text in told if key == k and text and w in text])}
    assert {(r.k, r.said): r["last"] for r in out.collect()} == want and len(want) > 5
