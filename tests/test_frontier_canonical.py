"""Frontiers by blocks and cells, canonical JSON, exact rank tests with ties, Thompson draws."""

import itertools
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from runlens.functions import canonical as C
from runlens.functions import distributions as D
from runlens.operators import evaluation as E
from runlens.operators import frontier as P
from runlens.operators import statistics as S
from runlens.plans import QUERIES


def front(rows, ways):
    sign = [1 if w == "min" else -1 for w in ways]
    ok = [r for r in rows if all(v is not None and math.isfinite(v) for v in r[1:])]
    x = np.array([[s * v for s, v in zip(sign, r[1:], strict=True)] for r in ok]).reshape(len(ok), len(sign))
    return sorted(r[0] for r, v in zip(ok, x, strict=True) if not ((x <= v).all(axis=1) & (x < v).any(axis=1)).any())


@pytest.mark.parametrize(("dims", "n", "block"), [(1, 200, 4096), (2, 3000, 7), (3, 2500, 16), (5, 400, 64), (9, 150, 16)])
def test_frontier_equals_brute_force(spark, monkeypatch, dims, n, block):
    monkeypatch.setattr(P, "BLOCK", block)
    rng = np.random.default_rng(dims)
    x = rng.integers(0, 40, (n, dims)).astype(float) if dims != 3 else np.round(rng.dirichlet(np.ones(dims), n), 3)
    rows = [(i, *map(float, v)) for i, v in enumerate(x)] + [(n, *([None] * dims)), (n + 1, *([float("nan")] * dims)), (n + 2, *([float("inf")] * dims))]
    ways = ["min" if i % 2 == 0 else "max" for i in range(dims)]
    names = [f"c{i}" for i in range(dims)]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in names)).repartition(7)
    assert sorted(r.id for r in P.skyline(df, dict(zip(names, ways, strict=True))).collect()) == front(rows, ways)


def test_points_with_equal_means_stay_together_in_any_order(spark, tmp_path):
    rng = np.random.default_rng(0)
    cents = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 9] * 2)  # 0.045 on average
    rows = [(part, float(x) / 100) for part in range(1, 200) if part % 7 for x in rng.permutation(cents)]
    assert len({list(itertools.accumulate(x for _, x in own))[-1] for _, own in itertools.groupby(rows, lambda r: r[0])}) > 1
    df = spark.createDataFrame(rows, "l_partkey long, l_discount double").withColumns({"l_extendedprice": F.lit(10.0), "l_quantity": F.lit(2.0)})
    df.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = QUERIES["skyline_three"](spark, str(tmp_path)).collect()
    assert len(got) == 171 and {tuple(r)[1:] for r in got} == {(5.0, 0.05, 40.0)}


def test_frontier_of_nothing(spark):
    df = spark.createDataFrame([(1, None)], "id long, a double")
    assert P.skyline(df, {"a": "min"}).count() == 0
    with pytest.raises(ValueError, match="objectives"):
        P.skyline(df, {})


@pytest.mark.parametrize(("x", "said"), [
    (0.0, "0"), (-0.0, "0"), (1.0, "1"), (-1.5, "-1.5"), (1e21, "1e+21"), (1e20, "100000000000000000000"), (123456789012345680000.0, "123456789012345680000"), (1e-6, "0.000001"), (1.5e-7, "1.5e-7"),
    (5e-324, "5e-324"), (1.7976931348623157e308, "1.7976931348623157e+308"), (333333333.33333329, "333333333.3333333"), (4.5, "4.5"), (0.002, "0.002"), (1e23, "1e+23"), (9007199254740993, "9007199254740992"), (0.1 + 0.2, "0.30000000000000004"),
])
def test_numbers_have_their_shortest_form(x, said):
    assert C.number(float(x)) == said and (x == 0 or float(said) == float(x))


def test_canonical_forms(spark):
    cases = {
        '{"b":1,"a":[true,null,"x\\u0041\\/"]}': '{"a":[true,null,"xA/"],"b":1}', '{"\\ufb33":1,"\\ud83d\\ude00":2,"\\u20ac":3,"\\r":4,"1":5,"\\u0080":6}': '{"\\r":4,"1":5,"\x80":6,"€":3,"😀":2,"\ufb33":1}',
        '"\\u000f\\u007f\\n\\u2028"': '"\\u000f\x7f\\n\u2028"', "[]": "[]", " 1e2 ": "100", '{"a":1,"a":2}': '{"a":2}', "12345678901234567890": "12345678901234567000",
        "NaN": None, "1e400": None, '"\\ud800"': None, "{": None, "": None, "[1,]": None,
    }
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string")
    got = {r.t: (r.j, r.h) for r in df.select("t", C.canonical_json(F.col("t")).alias("j"), C.canonical_hash(F.col("t")).alias("h")).collect()}
    assert {k: v[0] for k, v in got.items()} == cases | {None: None}
    assert got["[]"][1] == "sha256:4f53cda18c2baa0c0354bb5f9a3ecbe5ed12ab4d8e11ba873c2f11161202b945" and got["{"][1] is None
    assert all(json.loads(v[0]) == json.loads(k) for k, v in got.items() if v[0] and "1234" not in k)
    keys = spark.createDataFrame([('{"x":1, "y":[2]}',), ('{"y":[2.0],"x":1e0}',), (None,)], "t string").select(C.argument_key(F.col("t"))).distinct().collect()
    assert sorted(r[0] for r in keys) == ["undefined", '{"x":1,"y":[2]}']
    with pytest.raises(Exception, match="no canonical form"):
        df.where("t = 'NaN'").select(C.argument_key(F.col("t"))).collect()
    order = spark.createDataFrame([("\ufb33",), ("😀",), ("a",)], "t string").orderBy(C.code_units(F.col("t"))).collect()
    assert [r.t for r in order] == ["a", "😀", "\ufb33"]


def test_rank_tests_count_ties_exactly(spark):
    def plain(a, b):
        pool, n = a + b, len(a)
        u = lambda x, y: sum((p < q) + (p == q) / 2 for p in x for q in y)
        seen = []
        for pick in itertools.combinations(range(len(pool)), n):
            x = [pool[i] for i in pick]
            seen.append(u(x, [pool[i] for i in range(len(pool)) if i not in pick]))
        mid = n * len(b) / 2
        return sum(abs(v - mid) >= abs(u(a, b) - mid) - 1e-9 for v in seen) / len(seen)

    samples = {"ties": ([1, 1, 2, 2], [2, 2, 3]), "flat": ([5, 5, 5], [5, 5]), "apart": ([1, 2, 3], [4, 5, 6, 7]), "mixed": ([1, 3, 3, 8], [2, 3, 9, 9, 9]), "one": ([1], [1, 2, 2, 3])}
    rows = [(g, arm, float(v)) for g, sides in samples.items() for arm, side in zip("ab", sides, strict=True) for v in side] + [("lone", "a", 1.0)]
    got = {r.g: r for r in S.mann_whitney(spark.createDataFrame(rows, "g string, arm string, v double"), "g", "arm", ("a", "b"), "v").collect()}
    for g, (a, b) in samples.items():
        assert got[g].p == pytest.approx(plain(a, b)), g
    assert got["lone"].p == 1.0 and D.mann_whitney_exact(20.0, 40, 3, [1] * 43) == pytest.approx(D.mann_whitney_exact(100.0, 3, 40, [1] * 43))


def test_draws_follow_their_posterior(spark):
    cells = spark.range(2000).select(F.col("id").alias("cell"))
    seen = spark.range(2000).select(F.col("id").alias("cell"), F.explode(F.array(*(F.lit(i < 6) for i in range(8)))).alias("ok"))
    draw = lambda n: {r.cell: (r.sampled, r["count"]) for r in E.thompson_curriculum(cells.repartition(n), seen, ["cell"], F.col("cell"), F.col("ok"), 5000).collect()}
    a = draw(5)
    x = np.array([v[0] for v in a.values()])
    assert a == draw(1) and abs(x.mean() - 0.7) < 0.01 and abs(x.var() - 0.7 * 0.3 / 11) < 0.002
    assert abs(sum(v[1] for v in a.values()) - 5000) < 1000
    fresh = E.thompson_curriculum(cells.limit(3), seen.where("false"), ["cell"], F.col("cell"), F.col("ok"), 10).collect()
    assert [r.n for r in fresh] == [0, 0, 0]
