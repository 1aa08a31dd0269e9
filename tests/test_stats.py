import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallygrove.functions import dist as D
from tallygrove.operators import stats as S


def bh(p):
    p = np.asarray(p, float)
    order = np.argsort(p)
    m, out, low = len(p), np.empty(len(p)), 1.0
    for rank in range(m, 0, -1):
        low = min(low, p[order[rank - 1]] * m / rank)
        out[order[rank - 1]] = low
    return out


def test_bh_with_ties_nulls_and_groups(spark):
    rng = np.random.default_rng(0)
    p = np.round(rng.random(200) ** 2, 2)
    p[:20] = 10.0 ** -rng.integers(3, 300, 20)
    rows = [(i, "a" if i % 3 else "b", float(v)) for i, v in enumerate(p)] + [(900, "a", None), (901, "a", float("nan")), (902, None, 0.5), (903, "a", -0.1), (904, "a", float("inf"))]
    df = spark.createDataFrame(rows, "i int, g string, p double")
    got = {r.i: r.fdr for r in S.bh_fdr(df, "p", ["g"]).collect()}
    for g in ("a", "b"):
        own = [(i, v) for i, k, v in rows[:200] if k == g]
        for (i, _), want in zip(own, bh([v for _, v in own]), strict=True):
            assert got[i] == pytest.approx(want)
    assert got[902] == 0.5 and all(got[i] is None for i in (900, 901, 903, 904)) and len(got) == len(rows)
    whole = {r.i: r.fdr for r in S.bh_fdr(df.where("i < 200"), "p").collect()}
    assert all(whole[i] == pytest.approx(w) for i, w in enumerate(bh(p)))


def test_robust_z_ranks_and_quantiles(spark):
    df = spark.createDataFrame([("g", 1.0), ("g", 2.0), ("g", 4.0), ("g", float("nan")), ("g", None), ("flat", 3.0), ("flat", 3.0)], "k string, v double")
    z = {(r.k, r.v): r.z for r in S.robust_z(df, "v", ["k"]).where("v is not null and not isnan(v)").collect()}
    assert z[("g", 4.0)] == pytest.approx(2 / 1.4826) and z[("flat", 3.0)] is None
    ties = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 1.0), (4, 9.0)], "i int, v double").withColumn("k", F.lit(1))
    assert {r.i: r.r for r in S.average_ranks(ties, "v", ["k"], "r").collect()} == {1: 2.5, 2: 2.5, 3: 1.0, 4: 4.0}
    w = spark.createDataFrame([("a", float(v), 1.0) for v in range(1, 6)] + [("b", 7.0, 2.0)], "k string, v double, w double")
    assert {r.k: r.q for r in S.hazen_quantile(w, "v", "w", ["k"], 0.5, "q").collect()} == {"a": 3.0, "b": 7.0}
    assert {r.k: (r.n, r.m) for r in S.nearest_quantile(w, "v", ["k"], {"m": 0.25}).collect()} == {"a": (5, 2.0), "b": (1, 7.0)}


def test_correlation_icc_ols_fold(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=50)
    y = x + rng.normal(size=50)
    df = spark.createDataFrame([("a", float(u), float(v), int(i // 2)) for i, (u, v) in enumerate(zip(x, y, strict=True))] + [("b", 1.0, 1.0, 0), ("a", float("nan"), 1.0, 0)], "k string, x double, y double, s int")
    c = {r.k: r for r in S.correlations(df, "x", "y", ["k"]).collect()}
    rank = lambda v: np.argsort(np.argsort(v))
    assert c["a"].n == 50 and c["a"].pearson == pytest.approx(np.corrcoef(x, y)[0, 1]) and c["a"].spearman == pytest.approx(np.corrcoef(rank(x), rank(y))[0, 1]) and c["b"].pearson is None
    o = S.simple_ols(df.where("k = 'a'"), "x", "y", ["k"]).first()
    design = np.column_stack([np.ones(50), x])
    beta, rss, *_ = np.linalg.lstsq(design, y, rcond=None)
    se = np.sqrt(np.diag(np.linalg.inv(design.T @ design)) * rss[0] / 48)
    assert (o.intercept, o.slope, o.se_intercept, o.se_slope) == pytest.approx((beta[0], beta[1], se[0], se[1]))
    icc = S.intraclass(df.where("k = 'a'"), "x", ["k"], "s").first()
    pairs = [(x[2 * i], x[2 * i + 1]) for i in range(25)]
    assert icc.icc == pytest.approx(sum(a * b for a, b in pairs) / sum((a * a + b * b) / 2 for a, b in pairs)) and icc.subjects == 25
    folds = [r.f for r in spark.range(200).select(S.stable_fold(F.col("id"), 4, "s").alias("f")).collect()]
    assert set(folds) == {0, 1, 2, 3}


def test_distributions_against_known_values():
    assert D.t_two_sided(2.0, 10) == pytest.approx(0.07338803, rel=1e-6)
    assert D.t_two_sided(1.0, 1) == pytest.approx(0.5)
    assert D.t_two_sided([0.0, np.nan, np.inf], [5, 5, 5])[[0, 2]].tolist() == [1.0, 0.0]
    assert D.t_quantile(0.975, 10) == pytest.approx(2.2281388, rel=1e-6)
    assert D.f_upper(3.0, 2, 10) == pytest.approx((1 + 2 * 3 / 10) ** -5, rel=1e-9)
    assert D.normal_two_sided(1.959963984540054) == pytest.approx(0.05, rel=1e-9)
    assert D.normal_log_upper(40.0) == pytest.approx(-804.608442, rel=1e-7)
    assert D.neg_log10_p(50.0, 1.0) == pytest.approx((1250 + math.log(50) + 0.5 * math.log(2 * math.pi) - math.log(2) + 1 / 2500) / math.log(10), rel=1e-6)
    assert D.hypergeom_upper(2, 10, 4, 3) == pytest.approx((6 * 6 + 4) / 120)
    assert D.hypergeom_upper(0, 10, 4, 3) == 1.0 and D.hypergeom_upper(4, 10, 4, 3) == 0.0


def test_exact_quantiles_by_bracket_equal_the_aggregate(spark):
    rng = np.random.default_rng(5)
    rows = [("a", float(v)) for v in rng.normal(size=4000)] + [("b", float(v)) for v in rng.integers(0, 4, 500)] + [(None, 1.0), (None, 2.0), ("c", None), ("c", float("nan"))]
    df = spark.createDataFrame(rows, "k string, v double")
    probs = {"lo": 0.01, "mid": 0.5, "hi": 0.999, "top": 1.0}
    one = {r.k: tuple(r) for r in S.exact_quantiles(df, "v", ["k"], probs, spread=False).collect()}
    two = {r.k: tuple(r) for r in S.exact_quantiles(df, "v", ["k"], probs, spread=True).collect()}
    assert set(one) == set(two) == {"a", "b", None}
    for k, want in one.items():
        assert two[k][1:] == pytest.approx(want[1:])
    assert S.exact_quantiles(df, "v", [], {"m": 0.5}, spread=True).first().m == pytest.approx(S.exact_quantiles(df, "v", [], {"m": 0.5}, spread=False).first().m)
    n1, n2 = ({r.k: tuple(r) for r in S.nearest_quantile(df, "v", ["k"], probs, spread=s).collect()} for s in (False, True))
    assert n1 == n2
    m1, m2 = ({r.k: tuple(r) for r in S.median_mad(df.where("k is not null"), "v", ["k"], spread=s).collect()} for s in (False, True))
    assert set(m1) == set(m2) and all(m1[k][1:] == pytest.approx(m2[k][1:]) for k in m1)
