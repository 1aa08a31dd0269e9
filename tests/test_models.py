import numpy as np
import pytest

from tallygrove.operators import models as M


def test_mmrm_equals_ols_and_recovers_truth():
    rng = np.random.default_rng(0)
    # one visit only: REML and least squares agree, the df is n - p
    y, arm = rng.normal(size=40), ["a", "b"] * 20
    x, c, labels = M.arm_visit_design(arm, [8] * 40, np.zeros((40, 0)), "a")
    r = M.mmrm(y, x, np.arange(40), np.full(40, 8), c)
    beta, _, resid = M.ols(x, y)
    assert labels == [("b", 8)] and r["estimate"][0] == pytest.approx(beta[1] - beta[0], abs=1e-6)
    assert r["se"][0] == pytest.approx(np.sqrt(resid @ resid / 38 * (1 / 20 + 1 / 20)), rel=1e-4) and r["df"][0] == pytest.approx(38, rel=0.02)
    # balanced two visits: the difference of arms at a visit has the two-sample standard error of that visit
    n = 120
    cov = np.array([[1.0, 0.6], [0.6, 2.0]])
    e = rng.multivariate_normal([0, 0], cov, n)
    arms = np.array(["a", "b"])[np.arange(n) % 2]
    yy = e + np.where(arms == "b", 1.0, 0.0)[:, None] * np.array([0.5, 1.5])
    x, c, labels = M.arm_visit_design(np.repeat(arms, 2).tolist(), [8, 20] * n, np.zeros((2 * n, 0)), "a")
    r = M.mmrm(yy.ravel(), x, np.repeat(np.arange(n), 2), np.tile([8, 20], n), c)
    for k in (0, 1):
        a, b = yy[arms == "a", k], yy[arms == "b", k]
        s2 = (a.var(ddof=1) * (len(a) - 1) + b.var(ddof=1) * (len(b) - 1)) / (n - 2)
        assert r["estimate"][k] == pytest.approx(b.mean() - a.mean(), abs=1e-6)
        assert r["se"][k] == pytest.approx(np.sqrt(s2 * (1 / len(a) + 1 / len(b))), rel=1e-3)
        assert r["df"][k] == pytest.approx(n - 2, rel=0.05)
    assert r["sigma"] == pytest.approx(cov, abs=0.6)
    # missing visits do not break it
    keep = np.arange(2 * n) % 7 != 0
    r2 = M.mmrm(yy.ravel()[keep], x[keep], np.repeat(np.arange(n), 2)[keep], np.tile([8, 20], n)[keep], c)
    assert np.all(np.isfinite(r2["se"])) and np.all(r2["df"] > 20)


def test_random_intercept_shares():
    rng = np.random.default_rng(1)
    s = np.repeat(np.arange(300), 3)
    y = rng.normal(0, 2.0, 300)[s] + rng.normal(0, 1.0, 900)
    r = M.random_intercept(y, np.ones((900, 1)), s)
    assert r["share_subject"] == pytest.approx(0.8, abs=0.05) and r["share_fixed"] == pytest.approx(0, abs=1e-9)
    # balanced data: the between and within mean squares give the same variances
    m = y.reshape(300, 3)
    within = m.var(axis=1, ddof=1).mean()
    assert r["var_error"] == pytest.approx(within, rel=1e-3) and r["var_subject"] == pytest.approx(m.mean(axis=1).var(ddof=1) - within / 3, rel=1e-3)


def test_mediation():
    rng = np.random.default_rng(2)
    t = (np.arange(400) % 2).astype(float)
    m = t + rng.normal(size=400)
    y = 2 * m + 0.5 * t + rng.normal(size=400)
    got = M.mediate(y, m, np.ones((400, 1)), t, 500, 0, batch=120)
    assert got["indirect_estimate"] == pytest.approx(2, abs=0.4) and got["indirect_low"] < 2 < got["indirect_high"] and got["indirect_p"] < 0.05 and got["sobel_p"] < 1e-6
    assert got["total_estimate"] == pytest.approx(y[t == 1].mean() - y[t == 0].mean(), abs=1e-9)
    assert M.mediate(y, m, np.ones((400, 1)), t, 500, 0, batch=500)["indirect_low"] == pytest.approx(got["indirect_low"], abs=0.2)


def test_bootstrap_memory_is_bounded_and_draws_stay():
    import tracemalloc

    rng = np.random.default_rng(2)
    n = 20_000
    t = (np.arange(n) % 2).astype(float)
    m = t + rng.normal(size=n)
    y = 2 * m + 0.5 * t + rng.normal(size=n)
    common = np.column_stack([np.ones(n), rng.normal(size=n)])
    tracemalloc.start()
    got = M.mediate(y, m, common, t, 600, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6  # 600 draws of 20,000 rows, in indexes and weights, are some 300 MB
    assert {k: pytest.approx(v, rel=1e-9) for k, v in got.items()} == M.mediate(y, m, common, t, 600, 3, batch=7)
    draws = np.random.default_rng(3).integers(0, n, size=(600, n))  # the generator's one sequence
    xm, xy = np.column_stack([t, common]), np.column_stack([t, m, common])
    boot = []
    for idx in draws[:600]:
        a, b = np.linalg.lstsq(xm[idx], m[idx], rcond=None)[0], np.linalg.lstsq(xy[idx], y[idx], rcond=None)[0]
        boot.append(a[0] * b[1])
    assert [got["indirect_low"], got["indirect_high"]] == pytest.approx(np.percentile(boot, [2.5, 97.5]), rel=1e-9)


def test_mixture_knn_ridge_logistic():
    rng = np.random.default_rng(3)
    x = np.r_[rng.normal(0, 0.5, 600), rng.normal(4, 1.0, 400)]
    fit = M.two_gaussians(x)
    assert fit["mean_low"] == pytest.approx(0, abs=0.1) and fit["mean_high"] == pytest.approx(4, abs=0.2) and 1 < fit["cut"] < 2.5
    a = rng.normal(size=(60, 4))
    a[:, 3] = a[:, 0]
    gaps = a.copy()
    gaps[:10, 3] = np.nan
    full = M.knn_impute(gaps, k=3)
    assert np.corrcoef(full[:10, 3], a[:10, 3])[0, 1] > 0.5 and np.array_equal(full[10:], a[10:])
    brute = gaps[10:]
    d = np.sqrt(((gaps[0, :3] - brute[:, :3]) ** 2).sum(axis=1))
    assert full[0, 3] == pytest.approx(brute[np.argsort(d, kind="stable")[:3], 3].mean())
    z, fold = rng.normal(size=(200, 5)), np.arange(200) % 5
    target = z @ [1, 2, 0, 0, 0] + rng.normal(0, 0.1, 200)
    for model in ("ridge", "elasticnet"):
        got = M.regress_out_of_fold(z, target, fold, np.arange(200) % 4, model, alpha=0.01)
        assert np.corrcoef(got["predicted"], z @ [1, 2, 0, 0, 0])[0, 1] > 0.99
    lab = (z[:, 0] + rng.normal(0, 0.3, 200) > 0).astype(float)
    p = M.logistic_out_of_fold(z, lab, fold)
    assert ((p > 0.5) == (lab == 1)).mean() > 0.85


def _imputed_by_hand(x, own, k=5):
    out = x.copy()
    for i, j in np.argwhere(np.isnan(x)):
        both = ~np.isnan(own) & ~np.isnan(x[i])
        able = np.flatnonzero(~np.isnan(own[:, j]) & both.any(axis=1))
        d = [((x[i] - own[q])[both[q]] ** 2).sum() * x.shape[1] / both[q].sum() for q in able]
        near = able[np.argsort(d, kind="stable")[:k]]
        rest = own[:, j][~np.isnan(own[:, j])]
        out[i, j] = own[near, j].mean() if len(near) else rest.mean() if len(rest) else 0.0
    return out


def test_neighbours_with_gaps_ties_and_few_donors():
    rng = np.random.default_rng(9)
    for x in (np.where(rng.random((300, 6)) < 0.3, np.nan, rng.normal(size=(300, 6))), np.where(rng.random((200, 4)) < 0.15, np.nan, rng.integers(0, 3, (200, 4)).astype(float)), np.where(rng.random((5, 3)) < 0.4, np.nan, rng.normal(size=(5, 3))), np.full((3, 2), np.nan)):
        for donors in (None, rng.random(len(x)) < 0.7):
            assert M.knn_impute(x, donors) == pytest.approx(_imputed_by_hand(x, x if donors is None else x[donors]), abs=1e-9)


def test_far_values_make_no_more_candidates(monkeypatch):
    x = np.random.default_rng(11).normal(size=(3000, 5))
    x[7, 0], x[8, 1], x[:40, 2] = 1e7, -3e6, np.nan
    seen, real = [], np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys: seen.append(len(keys[0])) or real(keys))
    full = M.knn_impute(x)
    assert sum(seen) < 40 * 200  # all pairs are 40 by 3,000
    assert full == pytest.approx(_imputed_by_hand(x, x), abs=1e-9)


def test_neighbours_hold_bounded_blocks():
    import tracemalloc

    x = np.random.default_rng(10).normal(size=(20_000, 8))
    x[:300, 3] = np.nan
    tracemalloc.start()
    full = M.knn_impute(x)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6 and not np.isnan(full).any()  # 256 rows by 20,000 donors in five arrays are over 200 MB


def test_samples_are_rows_of_a_matrix(spark):
    from tallygrove.plans import domain_models as D

    v = spark.createDataFrame([("p", "s1", "b", 2.0), ("p", "s1", "a", 1.0), ("p", "s2", "b", None), ("p", "s3", "c", 3.0), ("q", "s1", "z", 9.0), ("q", "s1", None, 8.0)], "panel string, sample string, assay string, v double")
    got = D.matrix_rows(v, ["panel"], ["sample"]).orderBy("panel", "sample").toPandas()
    assert got["sample"].tolist() == ["s1", "s2", "s3", "s1"]  # one row each, not one for each cell
    assert np.array_equal(D.matrix(got[got.panel == "p"]), [[1, 2, np.nan], [np.nan] * 3, [np.nan, np.nan, 3]], equal_nan=True) and D.matrix(got[got.panel == "q"]).tolist() == [[9.0]]


def test_matrix_kernels():
    rng = np.random.default_rng(4)
    base = rng.normal(size=(100, 2)) @ rng.normal(size=(2, 6)) + rng.normal(0, 0.01, (100, 6))
    scores, load, share = M.principal_scores(base, 2)
    assert share.sum() > 0.999 and scores.shape == (100, 2) and np.all(load[np.abs(load).argmax(axis=0), [0, 1]] > 0)
    left = M.without_components(base - base.mean(axis=0), np.ones(100, bool), 2)
    assert (left**2).sum() < 1e-2 * ((base - base.mean(axis=0)) ** 2).sum()
    assert M.huber_location(np.r_[rng.normal(5, 1, 99), 1000.0]) == pytest.approx(5, abs=0.4)
    stat = rng.normal(size=200)
    inside = np.arange(200) < 20
    t, p, way = M.camera(stat + 3 * inside, inside)
    assert p < 1e-6 and way == "Up"
    # without correlation the test is the two-sample t test with equal variances
    t0, p0, _ = M.camera(stat, inside, 0.0)
    a, b = stat[inside], stat[~inside]
    s2 = (a.var(ddof=1) * 19 + b.var(ddof=1) * 179) / 198
    assert t0 == pytest.approx((a.mean() - b.mean()) / np.sqrt(s2 * (1 / 20 + 1 / 180)), rel=1e-9) and 0 <= p0 <= 1
    rho, p, err = M.rotation_null(np.arange(30.0), np.arange(30.0), np.eye(30), 999, 100, 0)
    assert rho == pytest.approx(1) and p == pytest.approx(0.001) and err < 0.01


def test_group_kernel_is_order_free(spark):
    import pandas as pd
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i % 3, i, float(i)) for i in range(60)], "g int, i int, v double")
    fit = lambda pdf: pd.DataFrame([{"first": int(pdf.i.iloc[0]), "n": len(pdf)}])
    got = {r.g: (r.first, r.n) for r in M.per_group(df.orderBy(F.rand(1)), ["g"], ["i"], fit, "first int, n int").collect()}
    assert got == {0: (0, 20), 1: (1, 20), 2: (2, 20)}


def test_registered_draws_and_starts(spark, smoke_dir):
    from tallygrove.plans import domain_models as D

    p = D.st12(spark, smoke_dir).toPandas()[["indirect_p", "direct_p", "total_p"]].to_numpy().ravel()
    assert len(p) and np.allclose(p * 100_000, np.round(p * 100_000), atol=1e-4) and (np.abs(p * 1000 - np.round(p * 1000)) > 1e-6).any()
    null = D.st39(spark, smoke_dir).toPandas().iloc[0]
    assert null.p * (1 - null.p) / null.error**2 == pytest.approx(1_000_000)
    fits = D.st9(spark, smoke_dir).toPandas().set_index("assay")
    for assay, own in D.assay_samples(D.olink(spark, smoke_dir)).toPandas().groupby("assay"):
        assert fits.loglik[assay] == M.two_gaussians(own.sort_values("sample").v.to_numpy(), starts=10)["loglik"]


def test_rotation_null_with_more_samples_than_statistics():
    rng = np.random.default_rng(7)
    factor = rng.normal(size=(12, 60))
    stat, ranks = rng.normal(size=12), np.arange(12.0)
    z = rng.standard_normal((20_000, 60)) @ factor.T
    rank = lambda a: np.argsort(np.argsort(a, axis=-1), axis=-1).astype(float)
    null = np.array([np.corrcoef(r, ranks)[0, 1] for r in rank(z)])
    rho, p, _ = M.rotation_null(stat, ranks, factor, 20_000, 500, 0)
    assert p == pytest.approx((np.abs(null) >= abs(rho) - 1e-12).mean(), abs=0.02)


def test_corrected_errors_match_the_formula_written_out():
    """Kenward and Roger's covariance from whole matrices, with derivatives in the covariance's elements."""
    rng = np.random.default_rng(8)
    n, k = 18, 3
    e = rng.multivariate_normal([0, 0, 0], [[1, 0.5, 0.2], [0.5, 1.5, 0.4], [0.2, 0.4, 2.0]], n)
    arm = np.array(["a", "b"])[np.arange(n) % 2]
    keep = rng.random((n, k)) > 0.25
    keep[:, 0] = True
    s, v = np.nonzero(keep)
    y = e[s, v] + (arm[s] == "b")
    x, c, _ = M.arm_visit_design(arm[s].tolist(), v.tolist(), rng.normal(size=n)[s][:, None], "a")
    r = M.mmrm(y, x, s, v, c)
    tri = [(i, j) for i in range(k) for j in range(i + 1)]

    def whole(sigma):
        full = np.zeros((len(y), len(y)))
        for p in np.unique(s):
            at = np.flatnonzero(s == p)
            full[np.ix_(at, at)] = sigma[np.ix_(v[at], v[at])]
        return full

    def criterion(theta):
        sigma = np.zeros((k, k))
        for t, (i, j) in zip(theta, tri, strict=True):
            sigma[i, j] = sigma[j, i] = t
        w = np.linalg.inv(whole(sigma))
        a = x.T @ w @ x
        b = np.linalg.solve(a, x.T @ w @ y)
        return np.linalg.slogdet(whole(sigma))[1] + np.linalg.slogdet(a)[1] + (y - x @ b) @ w @ (y - x @ b)

    theta = np.array([r["sigma"][i, j] for i, j in tri])
    h = 1e-3
    hess = np.zeros((6, 6))
    for i in range(6):
        for j in range(6):
            di, dj = np.eye(6)[i] * h, np.eye(6)[j] * h
            hess[i, j] = (criterion(theta + di + dj) - criterion(theta + di - dj) - criterion(theta - di + dj) + criterion(theta - di - dj)) / (4 * h * h)
    info = np.linalg.inv(hess / 2)
    w = np.linalg.inv(whole(r["sigma"]))
    phi = np.linalg.inv(x.T @ w @ x)
    ds = []
    for i, j in tri:
        d = np.zeros((k, k))
        d[i, j] = d[j, i] = 1
        ds.append(whole(d))
    ps = [-x.T @ w @ d @ w @ x for d in ds]
    inner = sum(info[i, j] * (x.T @ w @ ds[i] @ w @ ds[j] @ w @ x - ps[i] @ phi @ ps[j]) for i in range(6) for j in range(6))
    cov = phi + 2 * phi @ inner @ phi
    assert r["se"] == pytest.approx(np.sqrt(np.einsum("cp,pq,cq->c", c, cov, c)), rel=5e-3)
    assert np.all(r["se"] >= r["se_plain"] * 0.999)
    # degrees of freedom: 2 / A with A = sum of W_ij (l'FP_iFl)(l'FP_jFl) / (l'Fl)^2
    for row, df in zip(c, r["df"], strict=True):
        g = np.array([row @ phi @ p @ phi @ row for p in ps])
        assert df == pytest.approx(2 * (row @ phi @ row) ** 2 / (g @ info @ g), rel=2e-2)
    assert np.abs(r["score"]).max() < 0.05


def test_one_model_with_a_covariance_for_each_group_is_the_groups_fits():
    """Without shared coefficients the joint model falls apart into the groups' own."""
    rng = np.random.default_rng(9)
    n = 80
    sex, arm = np.array(["F", "M"])[np.arange(n) % 2], np.array(["a", "b"])[(np.arange(n) // 2) % 2]
    y = rng.normal(size=(n, 2)) * np.where(sex == "F", 1.0, 3.0)[:, None]
    s, v = np.repeat(np.arange(n), 2), np.tile([8, 20], n)
    x, cells = M.cell_design(list(zip(sex[s], arm[s], v, strict=True)), np.zeros((2 * n, 0)))
    c = M.cell_contrasts(cells, x.shape[1], [{("F", "b", 20): 1.0, ("F", "a", 20): -1.0, ("M", "b", 20): -1.0, ("M", "a", 20): 1.0}, {("F", "z", 8): 1.0}])
    assert np.isnan(c[1]).all()
    joint = M.mmrm(y.ravel(), x, s, v, c[:1], group=sex[s])
    own = {}
    for g in "FM":
        at = sex[s] == g
        xg, cg, labels = M.arm_visit_design(arm[s][at].tolist(), v[at].tolist(), np.zeros((at.sum(), 0)), "a")
        own[g] = M.mmrm(y.ravel()[at], xg, s[at], v[at], cg)
    k = labels.index(("b", 20))
    assert joint["estimate"][0] == pytest.approx(own["F"]["estimate"][k] - own["M"]["estimate"][k], abs=1e-6)
    assert joint["se"][0] == pytest.approx(np.hypot(own["F"]["se"][k], own["M"]["se"][k]), rel=1e-3)
    for g, fitted in zip("FM", joint["sigmas"], strict=True):
        assert fitted == pytest.approx(own[g]["sigma"], rel=1e-2, abs=1e-2)


def test_penalised_fits_meet_their_conditions():
    rng = np.random.default_rng(10)
    x = rng.normal(size=(150, 6))
    y = x @ [1.5, -1, 0, 0, 0, 0.02] + rng.normal(0, 0.5, 150)
    b, c = M.elastic_net(x, y, 0.2, 0.5)
    r = y - x @ b - c
    g = x.T @ r / 150 - 0.1 * b
    assert np.allclose(g[b != 0], 0.1 * np.sign(b[b != 0]), atol=1e-6) and np.all(np.abs(g[b == 0]) <= 0.1 + 1e-9) and (b == 0).any() and abs(r.mean()) < 1e-9
    lab = (x[:, 0] + 0.3 * rng.normal(size=150) > 0.6).astype(float)
    w = np.where(lab == 1, 150 / (2 * lab.sum()), 150 / (2 * (150 - lab.sum())))
    for penalty in ("l1", "l2"):
        b, c = M.logistic(x, lab, 0.3, penalty)
        g = -0.3 * (x.T @ (w * (1 / (1 + np.exp(-x @ b - c)) - lab)))
        assert abs((w * (1 / (1 + np.exp(-x @ b - c)) - lab)).sum()) < 1e-4
        if penalty == "l2":
            assert np.allclose(g, b, atol=1e-4)
        else:
            assert np.allclose(g[b != 0], np.sign(b[b != 0]), atol=1e-4) and np.all(np.abs(g[b == 0]) <= 1 + 1e-6) and (b == 0).any()
    fold = np.arange(150) % 5
    b, c, alpha = M.grouped_ridge(x, y, fold)
    z = x - x.mean(axis=0)
    assert np.allclose(z.T @ (y - y.mean() - z @ b), alpha * b, atol=1e-8)
    errors = {a: sum(((y[fold == f] - x[fold == f] @ bb - cc) ** 2).sum() for f in range(5) for bb, cc in [M.ridge(x[fold != f], y[fold != f], a)]) for a in M.RIDGE_ALPHAS}
    assert alpha == min(errors, key=errors.get) and len(M.RIDGE_ALPHAS) == 13 and M.RIDGE_ALPHAS[-1] == pytest.approx(1e4)


def test_residuals_lose_their_line_in_the_actual_value():
    rng = np.random.default_rng(11)
    x = rng.normal(size=(400, 4))
    y = 50 + 5 * x[:, 0] + rng.normal(0, 10, 400)  # weak: plain residuals fall with the actual value
    got = M.regress_out_of_fold(x, y, np.arange(400) % 5, np.arange(400) // 5 % 4)
    slope = lambda r: np.polyfit(y, r, 1)[0]
    assert slope(got["predicted"] - y) < -0.5 and abs(slope(got["corrected"])) < 0.05


def test_outlier_components_come_from_the_fit_rows():
    rng = np.random.default_rng(12)
    x = rng.normal(size=(60, 8))
    x[0] = 40
    fit = np.arange(60) > 0
    scores, z = M.outlier_components(x, fit, np.ones(8), 2)
    assert np.abs(z[0]).max() > 5 > np.abs(z[1:]).max() and np.allclose(z[fit].std(axis=0), 1) and np.allclose(scores[fit].mean(axis=0), 0, atol=1e-9)
    light = np.r_[0.0, np.ones(7)]
    assert np.array_equal(M.outlier_components(x, fit, light, 2)[0], M.outlier_components(np.column_stack([rng.normal(size=60) * 9, x[:, 1:]]), fit, light, 2)[0])
    with pytest.raises(M.NotEstimable):
        M.outlier_components(x, np.arange(60) < 2, np.ones(8))


def test_age_models_are_fitted_once_however_often_the_scale_reads_them(spark, smoke_dir):
    from tallygrove.plans import domain_models as D

    got = D.st31(spark, smoke_dir)
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().optimizedPlan().toString()  # noqa: SLF001  the robust z reads what was kept
    rows = got.toPandas()
    left = rows.residual - rows.residual.median()
    assert len(rows) > 100 and np.allclose(rows.z, left / (1.4826 * left.abs().median()))


def test_checks_of_the_age_models_fit_none_again(spark, smoke_dir):
    from tallygrove.plans import domain_models as D

    got = D.st31_checks(spark, smoke_dir)
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().optimizedPlan().toString()  # noqa: SLF001
    row = got.first()
    assert row.n > 100 and row.predicted
