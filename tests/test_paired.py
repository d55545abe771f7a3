"""Intervals of paired differences, counter-based random numbers, the Poisson bootstrap, decisions, exact quantiles by sketches."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from runlens.functions.random import poisson_one, uniform
from runlens.operators import paired as P
from runlens.operators import quantiles as Q

Z2 = 1.959963984540054**2


def by(df, key):
    return {r[key]: r for r in df.collect()}


def test_intervals_agree_with_the_exact_test_and_closed_forms(spark):
    rows = [(f"{b}-{c}", b, c, 40) for b in range(0, 21) for c in range(0, 21 - b)] + [("all", 40, 0, 40), ("none", 0, 0, 7), ("lost", 0, 40, 40)]
    df = spark.createDataFrame(rows, "g string, b int, c int, n int")
    exact, score = P.exact_interval(F.col("b"), F.col("c"), F.col("n")), P.score_interval(F.col("b"), F.col("c"), F.col("n"))
    got = by(df.select("g", "b", "c", "n", exact[0].alias("el"), exact[1].alias("eh"), score[0].alias("sl"), score[1].alias("sh")), "g")
    for r in got.values():
        m, k = r.b + r.c, min(r.b, r.c)
        p = min(1.0, 2 * sum(math.comb(m, i) for i in range(k + 1)) / 2**m)
        assert (r.el > 0 or r.eh < 0) == (p < 0.05), r
        assert -1 <= r.sl <= (r.b - r.c) / r.n <= r.sh <= 1 and -1 <= r.el <= (r.b - r.c) / r.n <= r.eh <= 1
        back = got.get(f"{r.c}-{r.b}") if r.n == 40 else None
        assert back is None or (abs(back.sl + r.sh) < 1e-9 and abs(back.el + r.eh) < 1e-9)
    assert abs(got["none"].sh - Z2 / (7 + Z2)) < 1e-9 and (got["none"].el, got["none"].eh) == (0, 0)
    assert got["all"].sh == 1 and got["all"].eh == 1 and got["lost"].sl == -1 and abs(got["all"].sl - (40 - Z2) / (40 + Z2)) < 1e-9


def test_scales_of_two_point_outcomes(spark):
    rows = [("unit", 0, 1), ("unit", 1, 1), ("points", 0, 100), ("points", 100, 0), ("mixed", 0, 100), ("mixed", 1, 0), ("part", 0.5, 1), ("neg", -1, 0), ("nan", float("nan"), 1), ("zero", 0, 0)]
    df = spark.createDataFrame([(g, float(x), float(y)) for g, x, y in rows], "g string, x double, y double")
    got = {r.g: r.scale for r in P.paired_risk(df, "g", F.col("x"), F.col("y")).collect()}
    assert got == {"unit": 1.0, "points": 100.0, "mixed": None, "part": None, "neg": None, "nan": None, "zero": None}
    assert P.paired_risk(df.where("false"), "g", F.col("x"), F.col("y")).count() == 0


def test_numbers_depend_on_key_and_counter_alone(spark):
    keys = spark.range(20_000).select((F.col("id") * 12_345_678_901 - 7).alias("k"))
    u = lambda df: {(r.k, r.c): r.u for r in df.select("k", F.explode(F.array(F.lit(0), F.lit(5))).alias("c")).select("k", "c", uniform(F.col("k"), F.col("c")).alias("u")).collect()}
    a = u(keys.repartition(7))
    assert a == u(keys.coalesce(1)) and len(set(a.values())) > 39_900
    x = np.array([a[k, 0] for k, c in a if c == 0]), np.array([a[k, 5] for k, c in a if c == 0])
    assert all(0 < v.min() and v.max() < 1 and abs(v.mean() - 0.5) < 0.01 and np.abs(np.histogram(v, 20, (0, 1))[0] - 1000).max() < 150 for v in x)
    assert abs(np.corrcoef(x[0], x[1])[0, 1]) < 0.03 and abs(np.corrcoef(x[0][1:], x[0][:-1])[0, 1]) < 0.03
    w = np.array([r.w for r in keys.select(poisson_one(uniform(F.col("k"), F.lit(3), seed=9)).alias("w")).collect()])
    assert abs(w.mean() - 1) < 0.03 and abs(w.var() - 1) < 0.05 and abs((w == 0).mean() - math.exp(-1)) < 0.015


def test_poisson_bootstrap_is_near_theory_and_ignores_partitions(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(10, 4, 3000)
    df = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate(v)] + [("one", 1, 5.0), ("none", 1, None), ("flat", 1, 2.0), ("flat", 2, 2.0)], "g string, k long, v double")
    got = by(P.poisson_bootstrap(df.repartition(5), "g", F.col("k"), F.col("v"), resamples=400), "g")
    again = by(P.poisson_bootstrap(df.coalesce(1), "g", F.col("k"), F.col("v"), resamples=400), "g")
    half = 1.96 * v.std() / math.sqrt(len(v))
    assert abs(got["a"].low - (v.mean() - half)) < 0.2 * half and abs(got["a"].high - (v.mean() + half)) < 0.2 * half
    assert all(abs(got[g].low - again[g].low) < 1e-9 for g in got) and "none" not in got
    assert (got["one"].low, got["one"].high, got["flat"].low, got["flat"].high) == (5, 5, 2, 2)


def test_promotions_need_evidence(spark):
    rows = []
    rows += [("better", i, 0.2 + i % 5 / 10, 0.5 + i % 7 / 10) for i in range(40)] + [("tied", i, i / 10, i / 10) for i in range(40)] + [("shifted", i, i / 100, i / 100 + 0.25) for i in range(40)]
    rows += [("few", i, 0.1, 0.2 + i / 10) for i in range(5)] + [("six", i, 0.1, 0.2 + i / 10) for i in range(6)] + [("seven", i, 0.1, 0.2 + i / 10 if i else 0.0) for i in range(7)]
    rows += [("wins", i, 0.0, 1.0 if i < 9 else 0.0) for i in range(30)] + [("some", i, 0.0, 1.0 if i < 4 else 0.0) for i in range(30)] + [("same", i, i % 2, i % 2) for i in range(30)]
    df = spark.createDataFrame([(g, i, float(x), float(y)) for g, i, x, y in rows], "g string, k long, x double, y double")
    got = by(P.decide(df, "g", F.col("k"), F.col("x"), F.col("y")), "g")
    assert {g for g, r in got.items() if r.promote} == {"better", "six", "wins"}
    assert got["shifted"].indeterminate is False or not got["shifted"].promote
    assert got["tied"].indeterminate and not got["few"].sufficient and got["six"].method == "exact-sign" and abs(got["six"].p - 1 / 64) < 1e-9
    assert got["some"].vetoed and abs(got["some"].p - 0.125) < 1e-9 and got["same"].vetoed and got["same"].low < 0 < got["same"].high
    easier = by(P.decide(df, "g", F.col("k"), F.col("x"), F.col("y"), threshold=-0.2), "g")
    assert easier["same"].promote and easier["some"].promote and not easier["tied"].promote


@pytest.mark.parametrize(("few", "error"), [(10_000, 0.005), (10, 0.005), (10, 1e-7)])
def test_quantiles_are_exact(spark, monkeypatch, few, error):
    """Brackets that miss, as with an error far too small, are widened."""
    monkeypatch.setattr(Q, "FEW", few)
    monkeypatch.setattr(Q, "ERROR", error)
    rng = np.random.default_rng(1)
    values = {"smooth": rng.normal(0, 1, 6000), "ties": rng.integers(0, 4, 3000) * 1.5, "one": np.array([7.0]), "two": np.array([1.0, 2.0]), "flat": np.full(500, 3.0)}
    rows = [(g, float(x)) for g, v in values.items() for x in v] + [("smooth", None), ("smooth", float("nan")), ("gone", None)]
    shares = [0, 0.05, 0.25, 0.5, 0.9, 1]
    got = by(Q.exact_quantiles(spark.createDataFrame(rows, "g string, v double").repartition(6), "g", "v", shares), "g")
    assert set(got) == set(values)
    for g, v in values.items():
        assert got[g].n == len(v) and np.allclose(got[g].q, np.quantile(v, shares), rtol=0, atol=1e-12)


def test_labels_and_verdicts(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.5,), (9.0,), (None,)], "x double")
    label = Q.bucket_label(F.col("x"), F.array(F.lit(2.0), F.lit(2.75)))
    assert [r[0] for r in df.select(label).collect()] == ["[-inf,2)", "[2,2.75)", "[2,2.75)", "[2.75,+inf)", None]
    rows = [(i % 2 == 0, float(i % 50), None if i % 2 else "a") for i in range(400)] + [(True, None, None)]
    features = Q.fidelity(spark.createDataFrame(rows, "sim boolean, x double, c string"), F.col("sim"), ["x"], ["c"])
    got = by(features, "feature")
    assert got["x"].divergence < 0.01 and got["c"].divergence is None and (got["c"].n_sim, got["c"].n_prod) == (200, 0)
    assert tuple(Q.fidelity_verdict(features).first())[1:] == ("c", "representative")
    none = Q.fidelity_verdict(features.where("feature = 'c'")).first()
    assert math.isnan(none.fidelity) and none.verdict == "insufficient-data"
    assert Q.easy_mode(df.where("x is not null"), F.col("x") > 2, F.col("x") / 10).first().asDict() == {"pass_sim": 0.5, "pass_prod": 0.0, "gap": 0.5, "inflated": True}
    with pytest.raises(Exception, match="no score"):
        Q.easy_mode(df, F.col("x") > 2, F.col("x")).collect()


def test_brackets_of_quantiles_are_drawn_once(spark, monkeypatch):
    monkeypatch.setattr(Q, "FEW", 10)
    values = np.random.default_rng(3).normal(0, 1, 6000)
    rows = spark.createDataFrame([("a", float(x)) for x in values], "g string, v double")
    shares = [0.1, *(0.5 + 0.00015 * i for i in range(8))]  # brackets of one rank that overlap
    counted = rows.groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    for out in (Q.exact_quantiles(rows, "g", "v", shares), Q.exact_quantiles(rows, "g", "v", shares, counted)):
        assert "kll" not in out._jdf.queryExecution().executedPlan().toString()  # else each use would see other sketches
        got = out.first()
        assert got.n == 6000 and np.allclose(got.q, np.quantile(values, shares), rtol=0, atol=1e-12)
