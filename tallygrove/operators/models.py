"""Model fits that need linear algebra, one group of rows at a time in Arrow-backed grouped maps.

Every kernel is a function of numpy arrays, tested on its own; `per_group` runs it once per group. A group is one assay's
study samples (thousands of rows), which is what a model needs at once; rows are spread over assays, not collected.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tallygrove.functions.dist import normal_two_sided, t_quantile, t_two_sided


def per_group(df: DataFrame, keys: Sequence[str], order: Sequence[str], fit: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """`fit` on every group, its rows in a fixed order, so that results do not depend on the partitioning. A group whose rows
    do not determine the model gives no row."""
    names = list(keys)
    result = [part.split()[0].strip("`") for part in schema.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf.sort_values(list(order), kind="stable").reset_index(drop=True)
        try:
            out = fit(own)
        except NotEstimable:
            return pd.DataFrame({n: pd.Series(dtype=object) for n in [*names, *result]})
        for i, k in enumerate(names):
            out.insert(i, k, own[k].iloc[0] if len(own) else None)
        return out

    kinds = dict(df.dtypes)
    return df.groupBy(*names).applyInPandas(run, ", ".join(f"`{k}` {kinds[k]}" for k in names) + ", " + schema)


class NotEstimable(ValueError):
    """The rows do not determine the model: too few, one arm, or a singular design."""


# --- least squares, residuals, mediation ----------------------------------------------------------------------------
def dummies(values: Sequence, reference=None) -> tuple[np.ndarray, list]:
    """Indicator columns of all levels but the reference (default: the smallest)."""
    levels = sorted({v for v in values if v is not None}, key=str)
    base = reference if reference in levels else (levels[0] if levels else None)
    rest = [v for v in levels if v != base]
    return np.array([[1.0 if x == v else 0.0 for v in rest] for x in values]).reshape(len(values), len(rest)), rest


def ols(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients, standard errors with sigma^2 = rss / max(n - p, 1), residuals; minimum-norm where x lacks rank."""
    inv = np.linalg.pinv(x.T @ x)
    beta = inv @ x.T @ y
    resid = y - x @ beta
    sigma2 = float(resid @ resid) / max(len(y) - x.shape[1], 1)
    return beta, np.sqrt(np.maximum(np.diag(inv), 0) * sigma2), resid


#: Weights of a batch of bootstrap draws held at once.
BOOTSTRAP_CELLS = 4_000_000


def mediate(y: np.ndarray, m: np.ndarray, common: np.ndarray, treat: np.ndarray, sims: int, seed: int, batch: int = 2000) -> dict[str, float]:
    """Mediation by the product of coefficients: indirect a*b, direct, total; percentile intervals and P values from a
    bootstrap over rows (batches bound its memory), and Sobel's analytic P of the indirect effect."""
    n = len(y)
    xm, xy = np.column_stack([treat, common]), np.column_stack([treat, m, common])
    ba, sa, _ = ols(xm, m)
    by, sy, _ = ols(xy, y)
    a, b, direct = ba[0], by[1], by[0]
    est = {"indirect": a * b, "direct": direct, "total": a * b + direct}
    rng = np.random.default_rng(seed)
    draws = {k: [] for k in est}
    batch = max(1, min(batch, BOOTSTRAP_CELLS // n))  # draws follow one another in the generator, however they are batched
    # both models' weighted cross products, and those with the outcomes, are one product with the weights of the draws
    full = np.column_stack([xy, y])
    iu = np.triu_indices(full.shape[1])
    products = np.ascontiguousarray(full[:, iu[0]] * full[:, iu[1]])
    first = np.r_[0, 2 : xy.shape[1]]  # the mediator is column 1
    for at in range(0, sims, batch):
        k = min(batch, sims - at)
        wts = np.empty((k, n))
        for row in wts:
            row[:] = np.bincount(rng.integers(0, n, size=n), minlength=n)
        g = np.zeros((k, full.shape[1], full.shape[1]))
        g[:, iu[0], iu[1]] = g[:, iu[1], iu[0]] = wts @ products
        solve = lambda own, t, g=g: np.einsum("kij,kj->ki", np.linalg.pinv(g[:, own[:, None], own]), g[:, own, t])
        one, two = solve(first, 1), solve(np.arange(xy.shape[1]), xy.shape[1])
        draws["indirect"].append(one[:, 0] * two[:, 1])
        draws["direct"].append(two[:, 0])
        draws["total"].append(one[:, 0] * two[:, 1] + two[:, 0])
    out: dict[str, float] = {}
    for k, v in est.items():
        boot = np.concatenate(draws[k]) if draws[k] else np.array([v])
        low, high = np.percentile(boot, [2.5, 97.5])
        tail = min(int((boot > 0).sum()), int((boot < 0).sum()))
        out |= {f"{k}_estimate": float(v), f"{k}_low": float(low), f"{k}_high": float(high), f"{k}_p": float(min(1.0, max(2 * tail, 1) / len(boot)))}
    se = math.sqrt(a * a * sy[1] ** 2 + b * b * sa[0] ** 2)
    out["sobel_p"] = float(normal_two_sided(a * b / se)) if se > 0 else math.nan
    out["share_mediated"] = est["indirect"] / est["total"] if est["total"] else math.nan
    return out


# --- repeated measures -----------------------------------------------------------------------------------------------
def mmrm(y: np.ndarray, x: np.ndarray, subject: np.ndarray, visit: np.ndarray, contrasts: np.ndarray, steps: int = 60, group: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Mixed model for repeated measures: unstructured covariance over visits, REML, Kenward-Roger errors and df (linear).

    Subjects may lack visits. With `group` (one label per row, constant within a subject) each group has a covariance of its
    own. Covariances are parametrised by their log-Cholesky factors and fitted by Newton steps on the profiled REML
    criterion with numeric derivatives, halved until it falls. The coefficients' covariance gets Kenward and Roger's
    small-sample correction, without second derivatives of the covariance, which vanish in its elements; the inverse of
    the observed information of these elements is their covariance. For one-row contrasts Kenward and Roger's df equals
    Satterthwaite's, and the F scale is 1. Returns the contrasts' estimates, errors (`se_plain` uncorrected), df, t, P and
    the covariances.
    """
    visits = np.unique(visit)
    k = len(visits)
    kinds = np.unique(group) if group is not None else np.array([0])
    tri = [(i, j) for i in range(k) for j in range(i + 1)]
    m = len(tri)
    if not len(contrasts) or len(y) < x.shape[1] + m * len(kinds) + 1 or np.linalg.matrix_rank(x) < x.shape[1]:
        raise NotEstimable(f"{len(y)} rows for {x.shape[1]} coefficients and {k} visits")
    at = np.searchsorted(visits, visit)
    of = np.searchsorted(kinds, group) if group is not None else np.zeros(len(y), np.int64)
    order = np.lexsort((at, subject))
    y, x, subject, at, of = y[order], x[order], subject[order], at[order], of[order]
    starts = np.flatnonzero(np.r_[True, subject[1:] != subject[:-1]])
    # subjects of a group with the same visits share one covariance block
    blocks: dict[tuple, list[tuple[np.ndarray, np.ndarray]]] = {}
    for a, b in zip(starts, np.r_[starts[1:], len(y)], strict=True):
        blocks.setdefault((of[a], *at[a:b]), []).append((x[a:b], y[a:b]))
    groups = [(p[0], np.array(p[1:]), np.stack([u for u, _ in v]), np.stack([w for _, w in v])) for p, v in blocks.items()]
    p = x.shape[1]

    def sigmas(theta: np.ndarray) -> list[np.ndarray]:
        out = []
        for g in range(len(kinds)):
            low = np.zeros((k, k))
            for t, (i, j) in zip(theta[g * m : (g + 1) * m], tri, strict=True):
                low[i, j] = math.exp(np.clip(t, -30, 30)) if i == j else t
            out.append(low @ low.T)
        return out

    def parts(covs: list[np.ndarray]):
        xtx, xty, yty, logdet = np.zeros((p, p)), np.zeros(p), 0.0, 0.0
        for g, pattern, bx, by in groups:
            own = covs[g][np.ix_(pattern, pattern)]
            sign, ld = np.linalg.slogdet(own)
            if sign <= 0:
                return None
            w = np.linalg.inv(own)
            xtx += np.einsum("nip,ij,njq->pq", bx, w, bx, optimize=True)
            xty += np.einsum("nip,ij,nj->p", bx, w, by, optimize=True)
            yty += float(np.einsum("ni,ij,nj->", by, w, by, optimize=True))
            logdet += ld * len(by)
        return xtx, xty, yty, logdet

    def criterion(covs: list[np.ndarray]) -> float:
        got = parts(covs)
        if got is None:
            return math.inf
        xtx, xty, yty, logdet = got
        sign, ld = np.linalg.slogdet(xtx)
        if sign <= 0:
            return math.inf
        return logdet + ld + yty - float(xty @ np.linalg.solve(xtx, xty))

    reml = lambda theta: criterion(sigmas(theta))
    resid = ols(x, y)[2]
    theta = np.array([math.log(max(resid[(at == i) & (of == g)].std() if ((at == i) & (of == g)).any() else 1.0, 1e-3)) if i == j else 0.0 for g in range(len(kinds)) for i, j in tri])

    def derivatives(fn, t0: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        q, f0 = len(t0), fn(t0)
        g, hess = np.zeros(q), np.zeros((q, q))
        e = np.diag(h)
        plus, minus = [fn(t0 + e[i]) for i in range(q)], [fn(t0 - e[i]) for i in range(q)]
        for i in range(q):
            g[i] = (plus[i] - minus[i]) / (2 * h[i])
            hess[i, i] = (plus[i] - 2 * f0 + minus[i]) / h[i] ** 2
            for j in range(i):
                hess[i, j] = hess[j, i] = (fn(t0 + e[i] + e[j]) - plus[i] - plus[j] + 2 * f0 - minus[i] - minus[j] + fn(t0 - e[i] - e[j])) / (2 * h[i] * h[j])
        return g, hess

    value = reml(theta)
    for _ in range(steps):
        g, hess = derivatives(reml, theta, np.full(len(theta), 1e-4))
        if not np.isfinite(hess).all():
            raise NotEstimable("the criterion has no curvature")
        vals, vecs = np.linalg.eigh(hess)
        step = vecs @ ((vecs.T @ g) / np.maximum(np.abs(vals), 1e-6))
        scale = 1.0
        while scale > 1e-8 and not reml(theta - scale * step) < value:
            scale /= 2
        if scale <= 1e-8:
            break
        theta = theta - scale * step
        fresh = reml(theta)
        done = value - fresh < 1e-9 * (abs(value) + 1)
        value = fresh
        if done:
            break
    covs = sigmas(theta)
    xtx, xty, _, _ = parts(covs)
    phi = np.linalg.inv(xtx)
    beta = phi @ xty
    est = contrasts @ beta
    plain = np.einsum("cp,pq,cq->c", contrasts, phi, contrasts)

    # in the elements of the covariances: P_i = -X' W D_i W X, Q_ij = X' W D_i W D_j W X, with D_i the derivative of V
    elements = np.concatenate([[c[i, j] for i, j in tri] for c in covs])

    def of_elements(v: np.ndarray) -> list[np.ndarray]:
        out = []
        for g in range(len(kinds)):
            c = np.zeros((k, k))
            for t, (i, j) in zip(v[g * m : (g + 1) * m], tri, strict=True):
                c[i, j] = c[j, i] = t
            out.append(c)
        return out

    size = np.concatenate([[math.sqrt(c[i, i] * c[j, j]) for i, j in tri] for c in covs])
    _, hess = derivatives(lambda v: criterion(of_elements(v)), elements, 1e-3 * size)
    if not np.isfinite(hess).all():
        raise NotEstimable("the covariance lies at its limit")
    info = np.linalg.pinv(hess / 2)  # the criterion is -2 log REML: its half has the inverse covariance of the elements
    total = len(elements)
    first, second = np.zeros((total, p, p)), np.zeros((total, total, p, p))
    for g, pattern, bx, _ in groups:
        w = np.linalg.inv(covs[g][np.ix_(pattern, pattern)])
        slopes = {}
        for q, (i, j) in enumerate(tri):
            d = np.zeros((k, k))
            d[i, j] = d[j, i] = 1.0
            slopes[g * m + q] = d[np.ix_(pattern, pattern)]
        for i, d in slopes.items():
            first[i] -= np.einsum("nip,ij,njq->pq", bx, w @ d @ w, bx, optimize=True)
            for j, e in slopes.items():
                second[i, j] += np.einsum("nip,ij,njq->pq", bx, w @ d @ w @ e @ w, bx, optimize=True)
    inner = np.einsum("ij,ijpq->pq", info, second) - np.einsum("ij,ipa,ab,jbq->pq", info, first, phi, first, optimize=True)
    adjusted = phi + 2 * phi @ ((inner + inner.T) / 2) @ phi
    var = np.einsum("cp,pq,cq->c", contrasts, adjusted, contrasts)
    grad = -np.einsum("cp,pa,iab,bq,cq->ic", contrasts, phi, first, phi, contrasts, optimize=True)
    spread = np.einsum("ic,ij,jc->c", grad, info, grad)
    df = np.where(spread > 0, 2 * plain**2 / np.maximum(spread, 1e-300), len(starts) - 1.0)
    df = np.clip(df, 1.0, len(y) - p)
    se = np.sqrt(np.maximum(var, plain * 1e-6))
    t = est / se
    return {"estimate": est, "se": se, "se_plain": np.sqrt(plain), "df": df, "t": t, "p": t_two_sided(t, df), "beta": beta, "sigma": covs[0], "sigmas": np.array(covs), "reml": np.array([value]), "score": derivatives(reml, theta, np.full(len(theta), 1e-4))[0]}


def cell_design(cells: Sequence[tuple], covariates: np.ndarray) -> tuple[np.ndarray, list[tuple]]:
    """Cell-means design of the observed cells and centred covariates (means weighted by observed frequency, so that a cell's
    coefficient is its least-squares mean under proportional weights), and the cells in order."""
    levels = sorted(set(cells), key=lambda c: tuple(map(str, c)))
    number = {c: i for i, c in enumerate(levels)}
    x = np.zeros((len(cells), len(levels)))
    x[np.arange(len(cells)), [number[c] for c in cells]] = 1.0
    z = covariates - covariates.mean(axis=0) if covariates.size else np.zeros((len(cells), 0))
    return np.column_stack([x, z]), levels


def cell_contrasts(levels: Sequence[tuple], width: int, wanted: Sequence[dict[tuple, float]]) -> np.ndarray:
    """Contrast rows from cell weights; a contrast with a cell that was not observed is all NaN."""
    number = {c: i for i, c in enumerate(levels)}
    out = np.zeros((len(wanted), width))
    for r, weights in enumerate(wanted):
        for cell, w in weights.items():
            if cell in number:
                out[r, number[cell]] = w
            else:
                out[r] = np.nan
    return out


def arm_visit_design(arm: Sequence, visit: Sequence, covariates: np.ndarray, control) -> tuple[np.ndarray, np.ndarray, list[tuple]]:
    """Cell-means design of arm by visit with centred covariates (their means weighted by observed frequency), the contrasts
    of each arm against the control at each visit, and their labels."""
    arms, visits = sorted(set(arm), key=str), sorted(set(visit))
    cells = [(a, v) for a in arms for v in visits]
    x = np.array([[1.0 if (a, v) == c else 0.0 for c in cells] for a, v in zip(arm, visit, strict=True)])
    z = covariates - covariates.mean(axis=0) if covariates.size else np.zeros((len(arm), 0))
    if control not in arms:
        raise NotEstimable(f"no rows of {control}")
    labels = [(a, v) for a in arms if a != control for v in visits]
    c = np.zeros((len(labels), len(cells) + z.shape[1]))
    for i, (a, v) in enumerate(labels):
        c[i, cells.index((a, v))], c[i, cells.index((control, v))] = 1.0, -1.0
    return np.column_stack([x, z]), c, labels


def random_intercept(y: np.ndarray, x: np.ndarray, subject: np.ndarray) -> dict[str, float]:
    """REML of y = x beta + subject + error: the variances and the shares of fixed, subject and error variance.

    The ratio of the variances is found by golden section on the profiled criterion."""
    codes = np.unique(subject, return_inverse=True)[1]
    m = codes.max() + 1
    size = np.bincount(codes, minlength=m).astype(float)
    sx = np.zeros((m, x.shape[1]))
    np.add.at(sx, codes, x)
    sy = np.bincount(codes, weights=y, minlength=m)
    n, p = x.shape
    xtx0, xty0, yty0 = x.T @ x, x.T @ y, float(y @ y)

    def fit(log_ratio: float):
        r = math.exp(log_ratio)
        w = r / (1 + r * size)
        xtx = xtx0 - (sx * w[:, None]).T @ sx
        xty = xty0 - (sx * w[:, None]).T @ sy
        beta = np.linalg.solve(xtx, xty)
        rss = yty0 - float(w @ (sy * sy)) - float(xty @ beta)
        s2 = max(rss, 1e-300) / (n - p)
        return (n - p) * math.log(s2) + float(np.log1p(r * size).sum()) + np.linalg.slogdet(xtx)[1], s2, beta

    low, high, g = -18.0, 12.0, (math.sqrt(5) - 1) / 2
    for _ in range(120):
        a, b = high - g * (high - low), low + g * (high - low)
        low, high = (low, b) if fit(a)[0] < fit(b)[0] else (a, high)
    best = (low + high) / 2
    _, s2, beta = fit(best)
    vs, vf = s2 * math.exp(best), float(np.var(x @ beta))
    total = vs + vf + s2
    return {"var_subject": vs, "var_error": s2, "var_fixed": vf, "share_fixed": vf / total, "share_subject": vs / total, "share_error": s2 / total}


# --- mixtures, ridge, logistic, neighbours ---------------------------------------------------------------------------
def two_gaussians(x: np.ndarray, starts: int = 10, steps: int = 500, floor: float = 5e-3, seed: int = 0) -> dict[str, float]:
    """Two-component normal mixture by EM from several starts; the components by rising mean, and the x between the means
    where the upper one has probability one half."""
    rng = np.random.default_rng(seed)
    best = None
    for k in range(starts):
        mu = np.sort(np.quantile(x, [0.25, 0.75]) if k == 0 else rng.choice(x, 2, replace=False)).astype(float)
        var, w, last = np.full(2, max(x.var(), floor)), np.full(2, 0.5), -math.inf
        for _ in range(steps):
            logp = np.log(w) - 0.5 * np.log(2 * np.pi * var) - (x[:, None] - mu) ** 2 / (2 * var)
            top = logp.max(axis=1, keepdims=True)
            norm = top[:, 0] + np.log(np.exp(logp - top).sum(axis=1))
            r = np.exp(logp - norm[:, None])
            total = r.sum(axis=0) + 1e-12
            mu, w = (r * x[:, None]).sum(axis=0) / total, total / len(x)
            var = (r * (x[:, None] - mu) ** 2).sum(axis=0) / total + floor
            if abs(norm.mean() - last) < 1e-8:
                break
            last = norm.mean()
        if best is None or last > best[0] + 1e-9:
            o = np.argsort(mu)
            best = (last, mu[o], var[o], w[o])
    ll, mu, var, w = best
    upper = lambda v: math.log(w[1]) - 0.5 * math.log(var[1]) - (v - mu[1]) ** 2 / (2 * var[1]) - (math.log(w[0]) - 0.5 * math.log(var[0]) - (v - mu[0]) ** 2 / (2 * var[0]))
    low, high = mu[0], mu[1]
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if upper(mid) < 0 else (low, mid)
    return {"mean_low": mu[0], "mean_high": mu[1], "var_low": var[0], "var_high": var[1], "weight_high": w[1], "cut": (low + high) / 2, "loglik": ll}


def knn_impute(x: np.ndarray, donors: np.ndarray | None = None, k: int = 5, block: int = 256) -> np.ndarray:
    """NaN cells replaced by the mean of the k nearest donors that have the cell, by Euclidean distance over the columns both
    have, scaled up for those that are missing; the column mean where no donor has it.

    Rows that lack the same columns are searched together, in blocks that meet the donors in blocks. A product of matrices
    gives the distances; donors that may be among the nearest are measured again exactly, so ties go to the first donor.
    """
    out, own = x.copy(), x if donors is None else x[donors]
    have, cols = ~np.isnan(own), x.shape[1]
    count = have.sum(axis=0)
    means = np.where(count > 0, np.nansum(own, axis=0) / np.maximum(count, 1), 0.0)
    need = np.flatnonzero(np.isnan(x).any(axis=1))
    if not len(need) or not len(own):
        out[need] = np.where(np.isnan(out[need]), means, out[need])
        return out
    filled = np.where(have, own - means, 0.0)  # distances are the same about the means, and lose fewer digits
    patterns, of = np.unique(np.isnan(x[need]), axis=0, return_inverse=True)
    of = of.ravel()
    for p, lacks in enumerate(patterns):
        given = np.flatnonzero(~lacks)
        rows = need[of == p]
        if not len(given):
            out[rows] = means
            continue
        v = x[np.ix_(rows, given)] - means[given]
        for j in np.flatnonzero(lacks):
            able = np.flatnonzero(have[:, j])
            whole = have[np.ix_(able, given)].all(axis=1)
            for a in range(0, len(rows), block):
                own_rows = slice(a, a + block)
                near, found = _nearest(v[own_rows], filled[:, given], have[:, given], able[whole], able[~whole], cols, k)
                total = found.sum(axis=1)
                mean = np.where(found, own[near, j], 0.0).sum(axis=1) / np.maximum(total, 1)
                out[rows[own_rows], j] = np.where(total > 0, mean, means[j])
    return out


def _nearest(v: np.ndarray, filled: np.ndarray, have: np.ndarray, whole: np.ndarray, partial: np.ndarray, cols: int, k: int, cells: int = 1_000_000) -> tuple[np.ndarray, np.ndarray]:
    """(indexes, found) of the k nearest donors of every row of v, nearest first. Donors `whole` have all columns of v, those
    `partial` not; donors that share no column are not found."""
    n, g = v.shape
    step = max(1024, cells // n)
    best_d, best_i = np.full((n, k), np.inf), np.zeros((n, k), np.int64)
    square = (v**2).sum(axis=1)
    part = 1e-12 * (g + 1)  # rounding of a distance, as a share of both squares: of a far value only its own pairs are uncertain
    for donors, full in ((whole, True), (partial, False)):
        for at in [0, *range(1024, len(donors), step)] if len(donors) else []:
            own = donors[at : at + (step if at else 1024)]
            f = filled[own]
            norms = (f**2).sum(axis=1)
            if full:
                d, add, times = np.column_stack([-2.0 * v, np.ones(n)]) @ np.column_stack([f, norms * (1 - part)]).T, square * (1 - part), cols / g  # the rest goes into the limit
            else:
                both = have[own].sum(axis=1)
                d = np.column_stack([v**2, -2.0 * v]) @ np.column_stack([have[own], f]).T
                d += norms * (1 - part)
                d -= part * square[:, None]
                d *= cols / np.maximum(both, 1)
                d[:, both == 0] = np.inf
                add, times = np.zeros(n), 1.0
            limit = best_d[:, -1]
            if not np.isfinite(limit).all():
                if len(own) >= k:
                    near = np.argpartition(d, k - 1, axis=1)[:, :k]
                    above = 2 * part * cols * (norms[near] + square[:, None])
                    limit = np.minimum(limit, ((np.take_along_axis(d, near, axis=1) + add[:, None]) * times + above).max(axis=1))
            r, c = np.nonzero(d <= (limit / times - add)[:, None])
            keep = np.isfinite(d[r, c])
            r, c = r[keep], c[keep]
            if not len(r):
                continue
            both = have[own[c]]
            exact = (np.where(both, v[r] - f[c], 0.0) ** 2).sum(axis=1) * cols / both.sum(axis=1)
            old = np.isfinite(best_d)
            rows, ids, ds = np.r_[np.nonzero(old)[0], r], np.r_[best_i[old], own[c]], np.r_[best_d[old], exact]
            order = np.lexsort((ids, ds, rows))
            rows, ids, ds = rows[order], ids[order], ds[order]
            rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
            top = rank < k
            best_d[rows[top], rank[top]], best_i[rows[top], rank[top]] = ds[top], ids[top]
    return best_i, np.isfinite(best_d)


#: Ridge penalties that cross-validation chooses from: thirteen, half a decade apart, from 1e-2 to 1e4.
RIDGE_ALPHAS = tuple(10.0 ** (-2 + 0.5 * i) for i in range(13))


def scaled(train: np.ndarray, *others: np.ndarray) -> list[np.ndarray]:
    """Columns standardised by the training rows' mean and sd."""
    m, s = train.mean(axis=0), train.std(axis=0)
    s = np.where(s > 0, s, 1.0)
    return [(v - m) / s for v in (train, *others)]


def ridge(x: np.ndarray, y: np.ndarray, alpha: float) -> tuple[np.ndarray, float]:
    """Coefficients and intercept with penalty alpha on the centred problem."""
    mx, my = x.mean(axis=0), y.mean()
    z = x - mx
    b = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - my))
    return b, float(my - mx @ b)


def grouped_ridge(x: np.ndarray, y: np.ndarray, fold: np.ndarray, alphas: Sequence[float] = RIDGE_ALPHAS) -> tuple[np.ndarray, float, float]:
    """Ridge whose penalty has the least summed squared error over given (grouped) folds, the smallest on a tie; refitted on
    all rows. Coefficients, intercept, penalty."""
    sse = np.zeros(len(alphas))
    for f in np.unique(fold):
        tr, te = fold != f, fold == f
        if tr.any():
            mx, my, xe, ye = x[tr].mean(axis=0), y[tr].mean(), x[te], y[te]
            z = x[tr] - mx
            gram, q = z.T @ z, z.T @ (y[tr] - my)  # the same for every penalty
            for i, alpha in enumerate(alphas):
                own = np.linalg.solve(gram + alpha * np.eye(x.shape[1]), q)
                sse[i] += float(((ye - xe @ own - float(my - mx @ own)) ** 2).sum())
    best = (sse.min(), float(alphas[int(np.argmin(sse))]))
    b, c = ridge(x, y, best[1])
    return b, c, best[1]


def elastic_net(x: np.ndarray, y: np.ndarray, alpha: float, l1_ratio: float, steps: int = 2000, tol: float = 1e-9) -> tuple[np.ndarray, float]:
    """Minimum of |y - xb - c|^2 / 2n + alpha (l1_ratio |b|_1 + (1 - l1_ratio) |b|^2 / 2) by cyclic coordinate descent."""
    n, p = x.shape
    mx, my = x.mean(axis=0), y.mean()
    z = x - mx
    gram, q = z.T @ z / n, z.T @ (y - my) / n
    b = np.zeros(p)
    for _ in range(steps):
        moved = 0.0
        for j in range(p):
            if gram[j, j] <= 0:
                continue
            r = q[j] - gram[j] @ b + gram[j, j] * b[j]
            fresh = math.copysign(max(abs(r) - alpha * l1_ratio, 0.0), r) / (gram[j, j] + alpha * (1 - l1_ratio))
            moved, b[j] = max(moved, abs(fresh - b[j])), fresh
        if moved < tol:
            break
    return b, float(my - mx @ b)


def logistic(x: np.ndarray, y: np.ndarray, c: float = 1.0, penalty: str = "l2", steps: int = 3000, tol: float = 1e-8) -> tuple[np.ndarray, float]:
    """Logistic model with balanced class weights and penalty |b|^2 / 2 or |b|_1 against c times the loss: accelerated
    proximal gradient steps, the intercept free."""
    n1 = y.sum()
    w = c * np.where(y == 1, len(y) / (2 * n1), len(y) / (2 * (len(y) - n1)))
    z = np.column_stack([np.ones(len(x)), x])
    bound = 0.25 * np.linalg.eigvalsh((z * w[:, None]).T @ z).max() + (1.0 if penalty == "l2" else 0.0)
    b = np.zeros(z.shape[1])
    v, turn = b.copy(), 1.0
    for _ in range(steps):
        g = z.T @ (w * (1 / (1 + np.exp(-np.clip(z @ v, -30, 30))) - y))
        if penalty == "l2":
            g[1:] += v[1:]
        fresh = v - g / bound
        if penalty == "l1":
            fresh[1:] = np.sign(fresh[1:]) * np.maximum(np.abs(fresh[1:]) - 1 / bound, 0.0)
        again = (1 + math.sqrt(1 + 4 * turn * turn)) / 2
        if (v - fresh) @ (fresh - b) > 0:  # restart where momentum points uphill
            again, v = 1.0, fresh
        else:
            v = fresh + (turn - 1) / again * (fresh - b)
        moved = np.abs(fresh - b).max()
        b, turn = fresh, again
        if moved < tol:
            break
    return b[1:], float(b[0])


def logistic_out_of_fold(x: np.ndarray, y: np.ndarray, fold: np.ndarray, c: float = 1.0, penalty: str = "l2") -> np.ndarray:
    """Out-of-fold probabilities; columns standardised on the training part. A fold whose training part has one class gets it."""
    out = np.full(len(y), np.nan)
    for f in np.unique(fold):
        tr, te = fold != f, fold == f
        n1 = y[tr].sum()
        if n1 in (0, tr.sum()):
            out[te] = float(n1 > 0)
            continue
        zt, ze = scaled(x[tr], x[te])
        b, b0 = logistic(zt, y[tr], c, penalty)
        out[te] = 1 / (1 + np.exp(-np.clip(ze @ b + b0, -30, 30)))
    return out


def regress_out_of_fold(x: np.ndarray, y: np.ndarray, fold: np.ndarray, inner: np.ndarray, model: str = "ridge", alpha: float = 0.1667, l1_ratio: float = 0.5, clip: float | None = None) -> dict[str, np.ndarray]:
    """Out-of-fold predictions and bias-corrected residuals of `ridge` (penalty by grouped folds) or `elasticnet`.

    `fold` and `inner` are two independent groupings of the rows by subject. Residuals are predicted minus actual. From them
    a line in the actual value is taken that is fitted, for each outer fold, on its training rows' inner out-of-fold
    residuals, so that held-out values never enter it.
    """
    def fitted(xt: np.ndarray, yt: np.ndarray, ft: np.ndarray, xe: np.ndarray) -> np.ndarray:
        zt, ze = scaled(xt, xe)
        if clip is not None:
            zt, ze = np.clip(zt, -clip, clip), np.clip(ze, -clip, clip)
        if model == "elasticnet":
            b, b0 = elastic_net(zt, yt, alpha, l1_ratio)
        else:
            b, b0, _ = grouped_ridge(zt, yt, ft)
        return ze @ b + b0

    pred, corrected = np.full(len(y), np.nan), np.full(len(y), np.nan)
    for f in np.unique(fold):
        tr, te = fold != f, fold == f
        if tr.sum() < 3:
            pred[te] = y.mean()
            corrected[te] = pred[te] - y[te]
            continue
        pred[te] = fitted(x[tr], y[tr], inner[tr], x[te])
        own = np.full(tr.sum(), np.nan)
        for g in np.unique(inner[tr]):
            a, b = inner[tr] != g, inner[tr] == g
            own[b] = fitted(x[tr][a], y[tr][a], inner[tr][a], x[tr][b]) if a.sum() >= 3 else y[tr].mean()
        yt = y[tr]
        slope = float(((yt - yt.mean()) * (own - yt)).sum() / max(((yt - yt.mean()) ** 2).sum(), 1e-300))
        line = (own - yt).mean() + slope * (y[te] - yt.mean())
        corrected[te] = pred[te] - y[te] - line
    return {"predicted": pred, "corrected": corrected}


# --- matrices of samples ---------------------------------------------------------------------------------------------
def principal_scores(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores, loadings and variance shares of the first k components of the standardised columns (NaN: column median);
    each component's sign makes its largest loading positive."""
    med = np.array([np.median(c[~np.isnan(c)]) if (~np.isnan(c)).any() else 0.0 for c in x.T])
    z = np.where(np.isnan(x), med, x)
    s = z.std(axis=0, ddof=1) if len(z) > 1 else np.ones(x.shape[1])
    z = (z - z.mean(axis=0)) / np.where(s > 0, s, 1.0)
    u, d, vt = np.linalg.svd(z, full_matrices=False)
    k = min(k, len(d))
    sign = np.sign(vt[np.arange(k), np.abs(vt[:k]).argmax(axis=1)])
    share = d**2 / max((d**2).sum(), 1e-300)
    return u[:, :k] * d[:k] * sign, vt[:k].T * sign, share[:k]


def outlier_components(x: np.ndarray, fit: np.ndarray, weights: np.ndarray, k: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Scores of all rows on the first k components of the fit rows, and the same in the fit rows' standard deviations.

    Columns are standardised by the fit rows and scaled by the root of their weights; missing cells must be imputed."""
    if fit.sum() < 3 or x.shape[1] < 2:
        raise NotEstimable("the fit needs three rows and two columns")
    m, s = x[fit].mean(axis=0), x[fit].std(axis=0)
    z = (x - m) / np.where(s > 0, s, 1.0) * np.sqrt(weights)
    centre = z[fit].mean(axis=0)
    _, _, vt = np.linalg.svd(z[fit] - centre, full_matrices=False)
    v = vt[: min(k, len(vt))]
    v = v * np.sign(v[np.arange(len(v)), np.abs(v).argmax(axis=1)])[:, None]
    scores = (z - centre) @ v.T
    sd = scores[fit].std(axis=0)
    return scores, scores / np.where(sd > 0, sd, 1.0)


def without_components(z: np.ndarray, fit: np.ndarray, k: int) -> np.ndarray:
    """Rows of z with the first k right singular directions of the fit rows projected out."""
    _, _, vt = np.linalg.svd(z[fit], full_matrices=False)
    v = vt[: min(k, len(vt))]
    return z - (z @ v.T) @ v


def huber_location(x: np.ndarray, c: float = 1.345, rounds: int = 2) -> float:
    """Huber location by reweighting from the median, in MAD scales."""
    m = float(np.median(x))
    s = 1.4826 * float(np.median(np.abs(x - m)))
    if s <= 0:
        return m
    for _ in range(rounds):
        w = np.minimum(1.0, c * s / np.maximum(np.abs(x - m), 1e-300))
        m = float((w * x).sum() / w.sum())
    return m


def rotation_null(stat: np.ndarray, ranks: np.ndarray, factor: np.ndarray, draws: int, chunk: int, seed: int) -> tuple[float, float, float]:
    """Rank correlation of stat with ranks, and the two-sided add-one P with its Monte Carlo error against statistics drawn
    with the covariance factor @ factor.T (random rotations of the residual space), in chunks of bounded size."""
    rank = lambda a: np.argsort(np.argsort(a, axis=-1, kind="stable"), axis=-1).astype(float)
    norm = lambda r: (r - r.mean(axis=-1, keepdims=True)) / r.std(axis=-1, keepdims=True)
    target = norm(rank(ranks))
    rho = float((norm(rank(stat)) * target).mean())
    rng, k = np.random.default_rng(seed), 0
    if factor.shape[1] > factor.shape[0]:
        factor = np.linalg.qr(factor.T, mode="r").T  # the same covariance from as few normals as there are statistics
    for at in range(0, draws, chunk):
        z = rng.standard_normal((min(chunk, draws - at), factor.shape[1])) @ factor.T
        k += int((np.abs((norm(rank(z)) * target).mean(axis=1)) >= abs(rho) - 1e-12).sum())
    p = (1 + k) / (1 + draws)
    return rho, p, math.sqrt(p * (1 - p) / draws)


def camera(stat: np.ndarray, inside: np.ndarray, correlation: float = 0.01) -> tuple[float, float, str]:
    """Competitive test of a set's mean statistic against the rest, with the variance inflated for a fixed correlation
    between members: t, two-sided P, direction."""
    n, m = len(stat), int(inside.sum())
    rest = n - m
    if m < 1 or rest < 1 or n < 3:
        return math.nan, math.nan, ""
    inflation = 1 + (m - 1) * correlation
    mean, total, var = stat[inside].mean(), stat.mean(), stat.var(ddof=1)
    delta = n / rest * (mean - total)
    pooled = ((n - 1) * var - delta**2 * m * rest / n) / (n - 2)
    t = delta / math.sqrt(max(pooled, 1e-300) * (inflation / m + 1 / rest))
    return float(t), float(t_two_sided(t, n - 2)), "Up" if t > 0 else "Down"


def confidence(estimate: float, se: float, df: float, level: float = 0.95) -> tuple[float, float]:
    q = t_quantile(0.5 + level / 2, df)
    return estimate - q * se, estimate + q * se
