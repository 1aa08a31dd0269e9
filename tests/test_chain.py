"""Scoring chain, slots, components and lookups against brute force."""

import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallygrove.operators import genetics as G
from tallygrove.operators import linkage as L
from tallygrove.operators import qc as Q
from tallygrove.operators import relational as R
from tallygrove.operators import results as O
from tallygrove.operators import stats as S


def roots(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {x: find(x) for x in parent}


def test_components(spark):
    rng = random.Random(0)
    cases = [[], [(1, 1), (None, 2)], [(i, i + 1) for i in range(30)], [(99, i) for i in range(40)], [(rng.randrange(150), rng.randrange(150)) for _ in range(120)]]
    flat = [(c * 1000 + a if a is not None else None, c * 1000 + b) for c, own in enumerate(cases) for a, b in own]
    got = {r.node: r.root for r in L.connected_components(spark.createDataFrame([(a, b, 0) for a, b in flat], "x long, y long, root int"), "x", "y").collect()}
    assert got == roots(flat)
    assert L.connected_components(spark.createDataFrame([], "x long, y long"), "x", "y").count() == 0


def test_components_of_long_paths_settle_in_few_rounds(spark):
    """The second-smallest id amid a path that starts with the smallest: no root hears of it but along the path."""
    rng = random.Random(1)
    rest = rng.sample(range(2, 10_000), 160)
    path = [0, *rest[:80], 1, *rest[80:]]
    flat = list(itertools.pairwise(path))
    rng.shuffle(flat)
    got = {r.node: r.root for r in L.connected_components(spark.createDataFrame(flat, "x long, y long"), "x", "y", max_rounds=12).collect()}
    assert got == dict.fromkeys(path, 0)


def test_overlap_clusters_in_any_order(spark):
    rows = [("b", 1, "g1"), ("b", 2, "g2"), ("b", 3, "g1"), ("b", 3, "g2"), ("b", 4, "g9"), ("c", 5, "g1"), ("c", 6, None)]
    got = {(r.t, r.k): r.cluster for r in O.overlap_clusters(spark.createDataFrame(rows, "t string, k long, gene string"), "t", "k", "gene").collect()}
    assert got == {("b", 1): 1, ("b", 2): 1, ("b", 3): 1, ("b", 4): 4, ("c", 5): 5, ("c", 6): 6}


def test_slot_events(spark):
    tubes = [("a", "S1", 2.0), ("b", "S2", 2.0), ("c", "S3", 2.0), ("d", "S4", 2.0), ("e", "S5", 2.0), ("f", "S6", 2.0), ("g", "S7", 2.0), ("h", "S7", 2.0), ("x", "S8", 2.0)]
    moves = [
        ("a", "S1", "S2", 2.0), ("b", "S2", "S1", 2.0),  # a swap
        ("c", "S3", "S9", 2.0),  # a free slot
        ("d", "S4", "S5", 2.0),  # an occupied one
        ("e", "S5", "S6", 2.0), ("f", "S6", "S5", 2.0), ("x", "S8", "S6", 2.0),  # x's slot holds f, which points elsewhere; e and f swap, yet d's move does not count
        ("g", "S7", "S10", 2.0), ("h", "S7", "S10", 2.0),  # two want one slot
    ]
    got = {r.tube: r.event for r in L.slot_events(spark.createDataFrame(tubes, "tube string, subject string, visit double"), spark.createDataFrame(moves, "tube string, subject string, target string, visit double")).collect()}
    assert got == {"a": "reciprocal", "b": "reciprocal", "c": "one_way", "d": "duplicate_draw", "e": "reciprocal", "f": "reciprocal", "x": "duplicate_draw", "g": "collision", "h": "collision"}
    # a partner that does not go takes its pair with it
    clash = [("a", "S1", "S2", 2.0), ("b", "S2", "S1", 2.0), ("y", "S2b", "S1", 2.0)]
    slots = [("a", "S1", 2.0), ("b", "S2", 2.0), ("y", "S2b", 2.0)]
    got = {r.tube: r.event for r in L.slot_events(spark.createDataFrame(slots, "tube string, subject string, visit double"), spark.createDataFrame(clash, "tube string, subject string, target string, visit double")).collect()}
    assert got["a"] == "reciprocal" and got["b"] == "reciprocal" and got["y"] == "duplicate_draw"


def test_complete_lookup_and_overlap_raise(spark):
    df, look = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert {r.k: r.v for r in R.complete_lookup(df, look, ["k"], ["v"]).collect()} == {1: "a", 2: "b"}
    with pytest.raises(Exception, match="no value for 2"):
        R.complete_lookup(df, look.where("k = 1"), ["k"], ["v"]).collect()
    labels, genos = spark.createDataFrame([("s1",), ("s1",), ("s2",), (None,)], "u string"), spark.createDataFrame([("s1",), ("z",)], "g string")
    assert tuple(L.genotype_overlap(labels, genos, "u", "g").first()) == (2, 1, 0.5)
    with pytest.raises(Exception, match="labelled subjects are genotyped"):
        L.genotype_overlap(labels, genos, "u", "g", 0.9).collect()
    with pytest.raises(Exception, match="repeated genotype"):
        L.genotype_overlap(labels, genos.union(genos), "u", "g").collect()


def test_calls_of_tubes(spark):
    z = [("t1", "A", "A", 9.0), ("t1", "A", "B", 3.0), ("t2", "A", "A", 1.0), ("t2", "A", "C", 8.0), ("t3", "X", "B", 7.0), ("t4", "X", "B", 6.0), ("t5", "Y", "B", 6.0), ("t6", "A", "B", 5.0), ("t7", "A", "A", 6.0), ("t7", "A", "R", 6.5), ("t8", "A", "A", 7.0), ("t8", "A", "R", float("nan")), ("t9", "A", "A", 0.5)]
    scores = spark.createDataFrame(z, "tube string, who string, geno string, z double")
    genos = spark.createDataFrame([(g,) for g in "ABCR"], "geno string")
    kin = spark.createDataFrame([("A", "R", 0.25), ("R", "A", 0.25), ("A", "C", float("nan"))], "a string, b string, k double")
    found = G.concordance(scores, genos, kin, 0.0884, 4.0)
    rows = {r.tube: r for r in found.collect()}
    assert "t6" not in rows and rows["t3"].self_z is None and rows["t3"].nonrel == "B"  # t6: genotyped label without an own score
    assert rows["t7"].best == "R" and rows["t7"].best_kinship == 0.25 and rows["t7"].nonrel_z is None and rows["t7"].rel == "R"
    rule = G.CallRule(best_min=4.0, margin=0.0, mismatch_floor=0.8, match_floor=4.0)
    calls = {r.tube: r.call for r in G.call_tubes(found, F.lit(True), rule).collect()}
    # t3 and t4 agree on a donor, t5 stands alone; a named relative blocks the match of t7
    assert calls == {"t1": "match", "t2": "mismatch", "t3": "mismatch", "t4": "mismatch", "t5": "none", "t7": "none", "t8": "match", "t9": "mismatch"}
    named = {r.tube: r.named_relative for r in G.call_tubes(found, F.lit(True), G.CallRule(4.0, 0.0, 0.8, 4.0, relative_name_margin=0.4)).collect()}
    assert named["t7"] == "R" and named["t1"] is None
    one = {r.tube: r.call for r in G.call_tubes(found, F.col("tube") != "t4", rule).collect()}
    assert one["t3"] == one["t4"] == "none"  # only one fit tube names the donor


def test_discordant_signs_need_more_cohorts(spark):
    rows = [("c1", "x", 1, "A", "G", 0.5, 9.0), ("c2", "y", 1, "G", "A", 0.4, 9.0), ("c3", "z", 1, "A", "G", -0.6, 9.0), ("c4", "z", 1, "A", "G", 0.1, 2.0), ("c1", "x", 2, "A", "T", 0.5, 9.0), ("c2", "y", 2, "A", "T", -0.5, 9.0), ("c3", "z", 2, "A", "T", -0.5, 9.0)]
    df = spark.createDataFrame(rows, "cat string, coh string, site int, a1 string, a2 string, beta double, nlp double")
    got = {(r.cat, r.site): (r.n_same, r.n_opposite) for r in G.sign_discordant(df, ["site"], "cat", "coh", "a1", "a2", "beta", "nlp", 5.0, 2).collect()}
    assert got == {("c1", 1): (0, 2)}  # the others agree once alleles are turned; A/T is ambiguous; c4 is weak


def test_sex_from_rates(spark):
    rows = [("f", f"x{i}", "X", i % 2) for i in range(20)] + [("m", f"x{i}", "X", 2 * (i % 2)) for i in range(20)] + [("m", f"y{i}", "Y", 0) for i in range(10)] + [("f", f"y{i}", "Y", None) for i in range(10)] + [("n", "y1", "Y", 0)]
    r = G.sex_rates(spark.createDataFrame(rows, "iid string, v string, chrom string, dose int"), "iid", "v", "dose", "chrom")
    kind, sex = G.karyotype(F.col("x_het"), F.col("y_call"))
    got = {x.iid: (x.x_het, x.y_call, x.k, x.s) for x in r.withColumns({"k": kind, "s": sex}).collect()}
    assert got == {"f": (1.0, 0.0, "XX", "F"), "m": (0.0, 1.0, "XY", "M"), "n": (None, 0.1, None, None)}


def test_second_genotype_of_a_mixture(spark):
    rng = np.random.default_rng(1)
    pred = rng.normal(size=(12, 80))
    obs = {0: pred[0] + 0.1 * rng.normal(size=80), 1: pred[1] + 0.8 * pred[7] + 0.1 * rng.normal(size=80), 2: pred[2] + 0.3 * rng.normal(size=80)}
    predicted = spark.createDataFrame([(g, p, float(pred[g, p])) for g in range(12) for p in range(80)], "geno long, protein long, y double")
    observed = spark.createDataFrame([(t, p, float(v[p])) for t, v in obs.items() for p in range(80)], "tube long, protein long, x double")
    r = G.score_matrix(observed, predicted)
    table = {(x.tube, x.geno): x.r for x in r.collect()}
    for (t, g), v in table.items():
        assert v == pytest.approx(np.corrcoef(obs[t], pred[g])[0, 1], abs=1e-9)
    mix = G.mixture_scores(r.withColumn("who", F.col("tube")).select("tube", "who", "geno", "r"), G.prediction_correlations(predicted))
    got = {x.tube: (x.second, x.mixture_z) for x in mix.collect()}
    big = np.corrcoef(pred)
    for t in obs:
        u = np.array([(table[t, j] - table[t, t] * big[t, j]) / np.sqrt(1 - big[t, j] ** 2) for j in range(12) if j != t])
        z = (u - np.median(u)) / (1.4826 * np.median(np.abs(u - np.median(u))))
        assert got[t][1] == pytest.approx(z.max(), abs=1e-6)
    assert got[1][0] == 7 and got[1][1] > max(got[0][1], got[2][1])


def test_score_matrix_over_blocks_and_gaps(spark):
    rng = np.random.default_rng(4)
    obs, pred = rng.normal(size=(9, 8)), rng.normal(size=(14, 8))
    obs[rng.random(obs.shape) < 0.3], pred[rng.random(pred.shape) < 0.2] = np.nan, np.nan
    pred[3, ~np.isnan(pred[3])] = 2.0  # no spread: no row
    o = spark.createDataFrame([(f"t{t}", f"p{p}", float(obs[t, p])) for t, p in np.argwhere(~np.isnan(obs))], "tube string, protein string, x double")
    y = spark.createDataFrame([(int(g), f"p{p}", float(pred[g, p])) for g, p in np.argwhere(~np.isnan(pred))], "geno long, protein string, y double")
    want = {}
    for t, g in np.ndindex(9, 14):
        both = ~np.isnan(obs[t]) & ~np.isnan(pred[g])
        if both.sum() >= 3 and g != 3:
            want[f"t{t}", g] = np.corrcoef(obs[t, both], pred[g, both])[0, 1]
    frame = G.score_matrix(o, y)
    got = {(r.tube, r.geno): r for r in frame.collect()}
    assert {k: r.r for k, r in got.items()} == pytest.approx(want, abs=1e-12)
    for t in range(9):
        own = np.array([v for (k, _), v in want.items() if k == f"t{t}"])
        if len(own):
            mad = 1.4826 * np.median(np.abs(own - np.median(own)))
            for (k, g), r in got.items():
                assert k != f"t{t}" or r.z == (pytest.approx((r.r - np.median(own)) / mad, abs=1e-9) if mad > 0 else None)
    same = G.row_correlations(np.array([[1.0, 1.0, 1.0, 5.0], [1.0, 1.0 + 1e-7, 1.0, np.nan]]), np.array([[1.0, 2.0, 4.0, np.nan]]))
    assert np.isnan(same[0, 0]) and same[1, 0] == pytest.approx(np.corrcoef([1.0, 1.0 + 1e-7, 1.0], [1.0, 2.0, 4.0])[0, 1])
    shuffled = frame._jdf.queryExecution().executedPlan().toString()  # noqa: SLF001
    assert shuffled.count("Exchange hashpartitioning(tube") == 0  # pairs are made where they are used, never exchanged


def _chain(spark):
    rng = np.random.default_rng(5)
    pred, obs = rng.normal(size=(20, 9)), rng.normal(size=(30, 9))
    obs[rng.random(obs.shape) < 0.2] = np.nan
    pred[7] = pred[8]  # nearly repeats the label of tubes 7 and 27
    o = spark.createDataFrame([(int(t), int(t % 22 if t < 28 else 8), int(p), float(obs[t, p])) for t, p in np.argwhere(~np.isnan(obs))], "tube long, who long, protein long, x double")
    y = spark.createDataFrame([(int(g), int(p), float(pred[g, p])) for g, p in np.ndindex(pred.shape)], "geno long, protein long, y double")
    return o, y, o.select("tube", "who").distinct()


def test_mixtures_of_a_matrix_are_those_of_its_table(spark):
    o, y, who = _chain(spark)
    table = G.score_matrix(o.drop("who"), y).join(who, "tube").select("tube", "who", "geno", "r")
    want = {r.tube: (r.who, r.second, r.mixture_z) for r in G.mixture_scores(table, G.prediction_correlations(y)).collect()}
    frame = G.matrix_mixtures(o, y)
    got = {r.tube: (r.who, r.second, r.mixture_z) for r in frame.collect()}
    assert len(want) > 20 and got.keys() == want.keys()
    for t, (w, second, z) in want.items():
        assert got[t][:2] == (w, second) and got[t][2] == pytest.approx(z, abs=1e-6)
    assert "hashpartitioning(tube" not in frame._jdf.queryExecution().executedPlan().toString()  # noqa: SLF001


def test_location_leaves_the_own_value_out():
    rng = np.random.default_rng(2)
    x = np.column_stack([np.ones(30), rng.normal(size=30)])
    y = x @ [1.0, 2.0] + rng.normal(0, 0.1, 30)
    got = G.leave_one_out_location(y, x, robust=False)
    for i in range(30):
        keep = np.arange(30) != i
        b = np.linalg.lstsq(x[keep], y[keep], rcond=None)[0]
        assert got[i] == pytest.approx(x[i] @ b)
    y[3] += 50
    robust = G.leave_one_out_location(y, x)
    keep = np.arange(30) != 3
    assert np.abs(robust[keep] - x[keep] @ [1.0, 2.0]).max() < 0.6 < np.abs(G.leave_one_out_location(y, x, False)[keep] - x[keep] @ [1.0, 2.0]).max()
    with pytest.raises(ValueError, match="alone decides"):
        G.leave_one_out_location(np.zeros(4), np.column_stack([np.ones(4), [1, 0, 0, 0]]), False)


def test_scores_less_their_location(spark):
    rng = np.random.default_rng(3)
    pcs = rng.normal(size=(40, 2))
    z = pcs @ [2.0, -1.0] + rng.normal(0, 0.2, 40)
    z[5] += 6
    scores = spark.createDataFrame([("t", 0, g, float(z[g])) for g in range(40)] + [("few", 0, g, 1.0) for g in range(3)], "tube string, who long, geno long, z double")
    comps = spark.createDataFrame([(g, float(a), float(b)) for g, (a, b) in enumerate(pcs)], "geno long, pc1 double, pc2 double")
    got = {(r.tube, r.geno): r.z for r in G.centred_scores(scores, comps, ["pc1", "pc2"]).collect()}
    assert got["t", 0] == z[0] and got["t", 5] == pytest.approx(6, abs=1) and abs(np.median([got["t", g] for g in range(1, 40)])) < 1e-9
    assert all(got["few", g] == 1.0 for g in range(3))


def test_locations_of_a_matrix_are_those_of_its_table(spark):
    o, y, who = _chain(spark)
    pcs = np.random.default_rng(6).normal(size=(19, 2))  # genotype 19 has none
    comps = spark.createDataFrame([(g, float(a), float(b)) for g, (a, b) in enumerate(pcs)], "geno long, pc1 double, pc2 double")
    z = G.score_matrix(o.drop("who"), y).where("z is not null").join(who, "tube").select("tube", "who", "geno", "z")
    want = {(r.tube, r.geno): r.z for r in G.centred_scores(z, comps, ["pc1", "pc2"]).collect()}
    frame = G.matrix_locations(o, y, comps, ["pc1", "pc2"])
    assert {(r.tube, r.geno): r.z for r in frame.collect()} == pytest.approx(want, abs=1e-9) and len(want) > 400
    assert "hashpartitioning(tube" not in frame._jdf.queryExecution().executedPlan().toString()  # noqa: SLF001


def test_genotypes_are_sent_to_tasks_not_to_blocks(spark):
    o, y, _ = _chain(spark)
    frame = G.score_matrix(o.drop("who"), y)
    plan = frame._jdf.queryExecution().optimizedPlan().toString()  # noqa: SLF001
    assert "FlatMapGroupsInPandas" not in plan and "RepartitionByExpression" in plan  # a group for each block would exchange all genotypes with each
    assert frame.count() > 400


def test_windows_flags_courses_and_folds(spark):
    rows = [("D", "2024-01-01", None), ("D", None, "2024-05-01"), ("C", "2024-01-01", None), ("C", None, "2024-02-01"), ("D", "2024-01-01", "2024-01-05")]
    df = spark.createDataFrame(rows, "s string, l string, e string").withColumn("s", F.when(F.col("s") == "D", "DISCONTINUED").otherwise("COMPLETED"))
    got = [str(r[0]) for r in df.select(Q.window_end(F.col("s"), F.to_date("l"), 28, [F.to_date("e"), F.lit(None).cast("date")])).collect()]
    assert got == ["2024-01-29", "None", "None", "2024-02-01", "2024-01-05"]
    flags = spark.createDataFrame([("t1", "no_arm"), ("t1", "other"), ("t2", "no_arm")], "tube string, flag string")
    moved = spark.createDataFrame([("t1", "x", 17), ("t3", None, None)], "tube string, arm string, age int")
    got = {tuple(r) for r in Q.rejudged_flags(flags, moved, "tube", "flag", {"no_arm": F.col("arm").isNull(), "minor": F.col("age") < 18}).collect()}
    assert got == {("t1", "other"), ("t2", "no_arm"), ("t1", "minor"), ("t3", "no_arm")}
    cases = {(1, 1, 0, 9, 9, 9): "Null", (1, 1, 0, 0, 9, 9): "Transient_up", (1, -1, 0, 9, 0, 9): "LateOnset_down", (1, -1, -2, 0, 0, 0): "Reversal_up_down", (-1, 1, 2, 0, 0, 9): "Reversal_down_up", (1, 2, 1, 0, 0, 0): "Progressive_up", (-1, -2, -1, 0, 0, 0): "Progressive_down", (1, 0.5, -0.5, 0, 0, 0): "Sustained_up", (-1, -1, 0, 0, 0, None): "Sustained_down", (-1, 1, 0, 0, None, 9): "Transient_down", (0, 1, 0, None, 0, 9): "LateOnset_up"}
    df = spark.createDataFrame([tuple(float(x) if x is not None else None for x in k) + (v,) for k, v in cases.items()], "a double, b double, c double, p double, q double, r double, want string")
    for r in df.withColumn("got", O.trajectory(*[F.col(c) for c in "abcpqr"])).collect():
        assert r.got == r.want
    ways = spark.createDataFrame([(1.0, -1.0), (2.0, 1.0), (1.0, -0.0), (-1.0, -2.0), (1.0, 1.0)], "f double, m double").select(O.interaction_direction(F.col("f"), F.col("m"))).collect()
    assert [w[0] for w in ways] == ["opposite_sign", "larger_in_F", "larger_in_F", "smaller_in_F", "equal"]
    keys = spark.createDataFrame([("s1",), ("s2",), ("s1",), (None,)], "k string")
    folds = {r.k: r.fold for r in S.digest_folds(keys, "k", 5, 3, "inner").collect()}
    assert folds == {None: None, **{k: int.from_bytes(hashlib.blake2b(f"3\x1finner\x1f{k}".encode(), digest_size=8).digest(), "big") % 5 for k in ("s1", "s2")}}


def test_unfit_verdicts(spark):
    rows = [(None, 9.0, None, False), (10.5, 9.0, 1.0, False), (1.0, 9.0, 1.0, False), (1.0, 9.0, 8.9, False), (1.0, 9.0, None, False), (1.0, 9.0, 1.0, True), (1.0, 2.0, 0.0, None)]
    df = spark.createDataFrame(rows, "s double, b double, c double, r boolean")
    got = [x[0] for x in df.select(L.unfit_verdict(F.col("s"), F.col("b"), F.col("c"), F.col("r"), 10.2, 4.0, 1.0)).collect()]
    assert got == ["no_comparator", "consistent_with_label", "names_other_subject", "uninformative", "names_other_subject", "uninformative", "uninformative"]


def test_ranks_and_sums_in_parts(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = np.round(rng.lognormal(size=3000), 2)
    g = rng.integers(0, 3, 3000)
    df = spark.createDataFrame([(int(a), int(i), float(v)) for i, (a, v) in enumerate(zip(g, x, strict=True))] + [(0, -1, None), (1, -2, float("nan")), (None, -3, 1.0)], "g int, i int, v double")
    monkeypatch.setattr(S, "PARTS", 7)
    ranks = {r.i: r.r for r in S.average_ranks(df, "v", ["g"], "r").collect()}
    assert ranks[-1] is None and ranks[-2] is None and ranks[-3] == 1.0
    for a in range(3):
        own = np.flatnonzero(g == a)
        want = [(x[own] < x[i]).sum() + ((x[own] == x[i]).sum() + 1) / 2 for i in own]
        assert [ranks[int(i)] for i in own] == want
    cut = {r.g: r.cut for r in S.upper_threshold(df.where("g is not null"), "v", ["g"], 0.01).collect()}
    assert all(cut[a] == np.sort(x[g == a])[::-1][int(0.01 * (g == a).sum())] for a in range(3))
    w = df.where("i >= 0").withColumn("w", (F.col("i") % 5 + 1).cast("double"))
    q = {r.g: r.q for r in S.hazen_quantile(w, "v", "w", ["g"], 0.3, "q").collect()}
    for a in range(3):
        own = np.flatnonzero(g == a)
        order = sorted(own, key=lambda i: (x[i], i % 5 + 1))
        ww = np.array([i % 5 + 1.0 for i in order])
        assert q[a] == pytest.approx(np.interp(0.3, (np.cumsum(ww) - ww / 2) / ww.sum(), x[order]))
    sim = {r.g: r.p_simes for r in S.simes(w.withColumn("p", F.col("v") / 100), "p", ["g"]).collect()}
    for a in range(3):
        p = np.sort(x[g == a] / 100)
        assert sim[a] == pytest.approx((p * len(p) / np.arange(1, len(p) + 1)).min())


def test_weighted_outliers_use_the_fit_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(f"s{s}", a, float(v), float(w), s != 0) for s in range(30) for a, (v, w) in enumerate(zip(rng.normal(20 if s == 0 else 0, 1, 12), itertools.cycle([1.0, 0.5, 0.0]), strict=False))]
    got = {r.s: r for r in Q.median_iqr_outliers(spark.createDataFrame(rows, "s string, a int, v double, w double, fit boolean"), "v", "s", 5.0, "w", "fit").collect()}
    assert [k for k, r in got.items() if r.outlier] == ["s0"] and not got["s0"].in_fit and got["s1"].n == 8


def test_pruning_is_the_greedy_order(spark):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 3, (12, 80))
    g = np.array([np.where(rng.random(80) < 0.15, rng.integers(0, 3, 80), base[v // 4]) for v in range(48)])
    df = spark.createDataFrame([(i, v, int(g[v, i]), v // 12) for v in range(48) for i in range(80)], "iid int, v int, dose int, win int")
    links = G.linked_variants(df, "iid", "v", "dose", "win", 0.3)
    got = {r.v: r.kept for r in G.prune(df, links, "v", "dose").collect()}
    r2 = np.corrcoef(g) ** 2
    af = g.mean(axis=1) / 2
    kept = set()
    for v in sorted(range(48), key=lambda v: (-min(af[v], 1 - af[v]), v)):
        if not any(r2[v, k] > 0.3 and k // 12 == v // 12 for k in kept):
            kept.add(v)
    assert {v for v, k in got.items() if k} == kept and len(got) == 48 and len(kept) < 40
    assert all(r.kept for r in G.prune(df, links.limit(0), "v", "dose").collect())
