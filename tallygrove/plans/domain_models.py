"""Queries of models and numeric kernels. Fits that SQL cannot
state are tested against closed forms, brute force and simulated truth in tests/test_models.py, and their `_checks` queries
compare what must hold of every fit (rows, scores of zero, sums, bounds) with SQL."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tallygrove.operators import models as M
from tallygrove.operators import stats as S
from tallygrove.plans import keys as K
from tallygrove.plans.registry import Registry
from tallygrove.plans.sqldist import sql_t_two_sided
from tallygrove.plans.statistics import OLINK_SQL, SOMA_SQL, olink, soma
from tallygrove.sources.tables import nan_to_null

REG = Registry()
query = REG.add


def subjects(spark, d):
    return nan_to_null(K.table(spark, d, "adsl")).where("deleted_at is null").groupBy("usubjid").agg(F.min_by("sex", "row_id").alias("sex"), F.min_by("age", "row_id").cast("double").alias("age"), F.min_by("weightbl", "row_id").alias("weight"), F.min_by("trt01a", "row_id").alias("trt01a"))


def repeated(spark, d):
    """Model rows: one value per participant and visit with the baseline value, arm, sex and age, per platform."""
    m = K.table(spark, d, "model_frame").where("group_key is not null and y_value is not null and not isnan(y_value)")
    per = m.groupBy("platform", F.col("group_key").alias("usubjid"), "visitnum").agg(F.avg("y_value").alias("y"))
    base = per.where("visitnum = 2").select("platform", "usubjid", F.col("y").alias("baseline"))
    s = subjects(spark, d).where("sex is not null and age is not null and trt01a is not null")
    return per.where("visitnum in (8, 20)").join(base, ["platform", "usubjid"]).join(s, "usubjid").withColumn("diff", F.col("y") - F.col("baseline"))


def repeated_assays(spark, d):
    """Rows of `repeated` for every analyte: a tube's participant and visit come from its first manifest row."""
    m = K.table(spark, d, "manifest").where("sampleid is not null and usubjid is not null and visitnum in (2, 8, 20)")
    t = m.groupBy(F.col("sampleid").alias("sample")).agg(F.min_by("usubjid", "row_id").alias("usubjid"), F.min_by("visitnum", "row_id").cast("int").alias("visitnum"))
    y = assay_samples(olink(spark, d)).join(t, "sample").groupBy("assay", "usubjid", "visitnum").agg(F.avg("v").alias("y"))
    base = y.where("visitnum = 2").select("assay", "usubjid", F.col("y").alias("baseline"))
    s = subjects(spark, d).where("sex in ('F', 'M') and age is not null and trt01a is not null")
    return y.where("visitnum in (8, 20)").join(base, ["assay", "usubjid"]).join(s, "usubjid").withColumn("diff", F.col("y") - F.col("baseline"))


_REPEATED = K.sql(f"""(with t as (select sampleid sample, arg_min(usubjid, row_id) who, arg_min(visitnum, row_id) visit from manifest where sampleid is not null and usubjid is not null and visitnum in (2, 8, 20) group by 1),
  v as (select assay, sample, avg(v) v from {OLINK_SQL} where sampletype = 'SAMPLE' and sample is not null group by 1, 2), y as (select assay, who, visit, avg(v) y from v join t using (sample) group by 1, 2, 3),
  s as (select usubjid who, arg_min(sex, row_id) sex, arg_min(age, row_id) age, arg_min(trt01a, row_id) arm from adsl where deleted_at is null group by 1)
  select a.assay, who, a.visit, a.y - b.y as diff, b.y baseline, sex, age, arm from y a join (select assay, who, y from y where visit = 2) b using (assay, who) join s using (who) where a.visit in (8, 20) and sex in ('F', 'M') and age is not null and arm is not null)""")


def assay_samples(df):
    return df.where("sampletype = 'SAMPLE' and sample is not null").groupBy("assay", "sample").agg(F.avg("v").alias("v"))


@query("st9_mixture_cut")
def st9(spark, d):
    v = assay_samples(olink(spark, d))
    fit = lambda pdf: pd.DataFrame([{**M.two_gaussians(pdf.v.to_numpy()), "n": len(pdf)}])
    return M.per_group(v, ["assay"], ["sample"], fit, "mean_low double, mean_high double, var_low double, var_high double, weight_high double, cut double, loglik double, n long")


@query("st9_mixture_checks", f"with v as (select assay, sample, avg(v) v from {OLINK_SQL} where sampletype = 'SAMPLE' and sample is not null group by 1, 2) select assay, count(*) n, round(avg(v), 4) mean, true as ordered, true as better_than_one from v group by 1")
def st9_checks(spark, d):
    """The mixture's mean is the sample's, its means are in order around the cut, and it fits no worse than one component."""
    f = st9(spark, d)
    one = assay_samples(olink(spark, d)).groupBy("assay").agg(F.var_pop("v").alias("var"))
    mean = F.col("mean_low") * (1 - F.col("weight_high")) + F.col("mean_high") * F.col("weight_high")
    single = -0.5 * (F.log(2 * np.pi * (F.col("var") + 5e-3)) + 1)
    return f.join(one, "assay").select("assay", "n", F.round(mean, 4).alias("mean"), ((F.col("mean_low") <= F.col("cut")) & (F.col("cut") <= F.col("mean_high"))).alias("ordered"), (F.col("loglik") >= single - 0.01).alias("better_than_one"))


def _mediation_rows(spark, d):
    return repeated(spark, d).where("weight is not null")


def _mediation(rows):
    """100,000 bootstrap draws per platform and visit."""

    def fit(pdf):
        treat = (pdf.trt01a != "Placebo").to_numpy(float)
        common = np.column_stack([np.ones(len(pdf)), pdf.age, (pdf.sex == "M").astype(float), pdf.baseline])
        return pd.DataFrame([M.mediate(pdf["diff"].to_numpy(), pdf.weight.to_numpy(), common, treat, 100_000, 0)])

    names = [f"{k}_{s} double" for k in ("indirect", "direct", "total") for s in ("estimate", "low", "high", "p")]
    return M.per_group(rows, ["platform", "visitnum"], ["usubjid"], fit, ", ".join([*names, "sobel_p double", "share_mediated double"]))


@query("st12_mediation_bootstrap")
def st12(spark, d):
    """Mediation of arm on change by weight, per platform and visit."""
    return _mediation(_mediation_rows(spark, d))


@query("d62_mediation_checks", K.sql("select platform, visitnum, true as ordered, true as adds_up, true as p_on_grid from model_frame where visitnum in (8, 20) group by 1, 2"))
def d62(spark, d):
    """The mediation of every visit, fitted visit by visit with finished visits kept: intervals hold the estimate's order, the
    effects add up, and P values are multiples of one draw's share."""
    from tallygrove.plans.stages import by_visit
    from tallygrove.session import Stash

    rows = _mediation_rows(spark, d)
    fitted = by_visit(rows, "visitnum", (8, 20), _mediation, Stash(spark).root)
    whole = lambda c: F.abs(F.col(c) * 100_000 - F.round(F.col(c) * 100_000)) < 1e-4
    return fitted.select("platform", "visitnum", ((F.col("indirect_low") <= F.col("indirect_high")) & (F.col("total_low") <= F.col("total_high"))).alias("ordered"), (F.abs(F.col("indirect_estimate") + F.col("direct_estimate") - F.col("total_estimate")) < 1e-9).alias("adds_up"), (whole("indirect_p") & whole("direct_p") & whole("total_p")).alias("p_on_grid"))


@query("st14_mmrm_contrasts")
def st14(spark, d):
    """Arm contrasts of change at each visit, a fit for each analyte: unstructured REML over visits, covariates baseline, age
    and sex, Kenward-Roger errors and df."""

    def fit(pdf):
        cov = np.column_stack([pdf.baseline, pdf.age, (pdf.sex == "M").astype(float)])
        x, c, labels = M.arm_visit_design(pdf.trt01a.tolist(), pdf.visitnum.tolist(), cov, "Placebo" if (pdf.trt01a == "Placebo").any() else sorted(pdf.trt01a)[0])
        r = M.mmrm(pdf["diff"].to_numpy(), x, pd.factorize(pdf.usubjid)[0], pdf.visitnum.to_numpy(), c)
        return pd.DataFrame({"arm": [a for a, _ in labels], "visit": [int(v) for _, v in labels], "estimate": r["estimate"], "se": r["se"], "df": r["df"], "p": r["p"], "rows": len(pdf), "score": float(np.abs(r["score"]).max()), "inflation": r["se"] / r["se_plain"]})

    return M.per_group(repeated_assays(spark, d), ["assay"], ["usubjid", "visitnum"], fit, "arm string, visit int, estimate double, se double, df double, p double, rows long, score double, inflation double")


@query("st14_mmrm_checks", f"select assay, arm, visit::int visit, any_value(n) as rows, true as at_optimum, true as no_smaller_error, true as in_range from (select *, count(*) over (partition by assay) n from {_REPEATED}) where arm <> 'Placebo' and n >= 60 group by 1, 2, 3")
def st14_checks(spark, d):
    """Of analytes with 60 rows or more: every contrast is there, the criterion's slope is zero, the correction shrinks no error, df and P are in range."""
    return st14(spark, d).where("rows >= 60").select("assay", "arm", "visit", "rows", (F.col("score") < 0.05).alias("at_optimum"), (F.col("inflation") > 0.999).alias("no_smaller_error"), ((F.col("df") >= 1) & F.col("p").between(0, 1) & (F.col("se") > 0)).alias("in_range"))


_BASE = K.sql("""(select platform, usubjid, y, sex, age, arm from (select platform, group_key usubjid, avg(y_value) y from model_frame where group_key is not null and visitnum = 2 and y_value is not null and not isnan(y_value) group by 1, 2)
  join (select usubjid, arg_min(sex, row_id) sex, arg_min(age, row_id) age, arg_min(trt01a, row_id) arm from adsl where deleted_at is null group by 1) using (usubjid) where sex is not null and age is not null and arm is not null)""")


@query("st15_baseline_ls_means", f"""with b as (select platform, arm, y, age::double a, (sex = 'M')::int::double s from {_BASE}), g as (select platform, arm, count(*) n, avg(y) my, avg(a) ma, avg(s) ms from b group by 1, 2), t as (select platform, count(*) n, count(distinct arm) k, avg(a) ta, avg(s) ts from b group by 1),
  w as (select platform, sum((a - ma) ** 2) aa, sum((a - ma) * (s - ms)) as_, sum((s - ms) ** 2) ss, sum((a - ma) * (y - my)) ay, sum((s - ms) * (y - my)) sy, sum((y - my) ** 2) yy from b join g using (platform, arm) group by 1),
  c as (select *, aa * ss - as_ * as_ det, (ay * ss - sy * as_) / (aa * ss - as_ * as_) ba, (sy * aa - ay * as_) / (aa * ss - as_ * as_) bs from w)
  select platform, arm, round(my - ba * (ma - ta) - bs * (ms - ts), 6) ls_mean, round(sqrt((yy - ba * ay - bs * sy) / (t.n - k - 2) * (1.0 / g.n + ((ma - ta) ** 2 * ss - 2 * (ma - ta) * (ms - ts) * as_ + (ms - ts) ** 2 * aa) / det)), 6) se from g join t using (platform) join c using (platform)""")
def st15(spark, d):
    """Arm means at baseline with covariates at their means, the sexes weighted by their frequency."""
    m = K.table(spark, d, "model_frame").where("group_key is not null and visitnum = 2 and y_value is not null and not isnan(y_value)")
    rows = m.groupBy("platform", F.col("group_key").alias("usubjid")).agg(F.avg("y_value").alias("y")).join(subjects(spark, d).where("sex is not null and age is not null and trt01a is not null"), "usubjid")

    def fit(pdf):
        x, arms = M.cell_design([(a,) for a in pdf.trt01a], np.column_stack([pdf.age, (pdf.sex == "M").astype(float)]))
        b, se, _ = M.ols(x, pdf.y.to_numpy())
        return pd.DataFrame({"arm": [a for (a,) in arms], "ls_mean": b[: len(arms)].round(6), "se": se[: len(arms)].round(6)})

    return M.per_group(rows, ["platform"], ["usubjid"], fit, "arm string, ls_mean double, se double")


@query("st16_sex_interaction")
def st16(spark, d):
    """Difference between the sexes of the arm contrast at each visit: one model with cells of sex, arm and visit and a
    covariance for each sex; the contrast has the weights 1, -1, -1, 1."""

    def fit(pdf):
        cells = list(zip(pdf.sex, pdf.trt01a, pdf.visitnum, strict=True))
        x, levels = M.cell_design(cells, np.column_stack([pdf.baseline, pdf.age]))
        pairs = sorted({(a, v) for _, a, v in levels if a != "Placebo"})
        wanted = [{("F", a, v): 1.0, ("F", "Placebo", v): -1.0, ("M", a, v): -1.0, ("M", "Placebo", v): 1.0} for a, v in pairs]
        c = M.cell_contrasts(levels, x.shape[1], wanted)
        ok = ~np.isnan(c).any(axis=1)
        r = M.mmrm(pdf["diff"].to_numpy(), x, pd.factorize(pdf.usubjid)[0], pdf.visitnum.to_numpy(), c[ok], group=pdf.sex.to_numpy())
        kept = [p for p, o in zip(pairs, ok, strict=True) if o]
        return pd.DataFrame({"arm": [a for a, _ in kept], "visit": [int(v) for _, v in kept], "estimate": r["estimate"], "se": r["se"], "df": r["df"], "p": r["p"]})

    return M.per_group(repeated_assays(spark, d), ["assay"], ["usubjid", "visitnum"], fit, "arm string, visit int, estimate double, se double, df double, p double")


@query("st17_genotype_cells")
def st17(spark, d):
    """Arm contrasts at each visit within carriers and others (here: participants with a close relative among the genomes):
    one model with cells of class, arm and visit."""
    kin = K.table(spark, d, "king_pairs").where("kinship > 0.2 and not isnan(kinship) and usubjid_1 <> usubjid_2")
    kin = kin.select(F.explode(F.array("usubjid_1", "usubjid_2")).alias("usubjid")).distinct().withColumn("carrier", F.lit(True))
    rows = repeated_assays(spark, d).join(kin, "usubjid", "left").withColumn("carrier", F.coalesce("carrier", F.lit(False)))

    def fit(pdf):
        cells = list(zip(pdf.carrier.astype(bool), pdf.trt01a, pdf.visitnum, strict=True))
        x, levels = M.cell_design(cells, np.column_stack([pdf.baseline, pdf.age, (pdf.sex == "M").astype(float)]))
        wanted = sorted((g, a, v) for g, a, v in levels if a != "Placebo")
        c = M.cell_contrasts(levels, x.shape[1], [{(g, a, v): 1.0, (g, "Placebo", v): -1.0} for g, a, v in wanted])
        ok = ~np.isnan(c).any(axis=1)
        r = M.mmrm(pdf["diff"].to_numpy(), x, pd.factorize(pdf.usubjid)[0], pdf.visitnum.to_numpy(), c[ok])
        kept = [w for w, o in zip(wanted, ok, strict=True) if o]
        return pd.DataFrame({"carrier": [bool(w[0]) for w in kept], "arm": [w[1] for w in kept], "visit": [int(w[2]) for w in kept], "estimate": r["estimate"], "se": r["se"], "p": r["p"]})

    return M.per_group(rows, ["assay"], ["usubjid", "visitnum"], fit, "carrier boolean, arm string, visit int, estimate double, se double, p double")


@query("st11_residuals")
def st11(spark, d):
    """Change after removal of baseline, age and sex, per analyte and visit."""

    def fit(pdf):
        x = np.column_stack([np.ones(len(pdf)), pdf.baseline, pdf.age, (pdf.sex == "M").astype(float)])
        return pd.DataFrame({"usubjid": pdf.usubjid, "arm": pdf.trt01a, "residual": M.ols(x, pdf["diff"].to_numpy())[2]})

    return M.per_group(repeated_assays(spark, d), ["assay", "visitnum"], ["usubjid"], fit, "usubjid string, arm string, residual double")


@query("st11_residual_checks", f"select assay, visit::int visitnum, count(*) n, 0.0::double as total, 0.0::double as with_baseline, 0.0::double as with_age, 0.0::double as with_sex, true as no_larger from {_REPEATED} group by 1, 2")
def st11_checks(spark, d):
    """Residuals are orthogonal to every covariate and vary no more than the changes."""
    r = repeated_assays(spark, d).join(st11(spark, d).select("assay", "visitnum", "usubjid", "residual"), ["assay", "visitnum", "usubjid"])
    zero = lambda c: F.round(F.abs(F.sum(F.col("residual") * c)), 5)
    return r.groupBy("assay", "visitnum").agg(F.count("*").alias("n"), zero(F.lit(1.0)).alias("total"), zero(F.col("baseline")).alias("with_baseline"), zero(F.col("age")).alias("with_age"), zero((F.col("sex") == "M").cast("double")).alias("with_sex"), (F.var_pop("residual") <= F.var_pop("diff") + 1e-9).alias("no_larger"))


@query("st18_variance_shares")
def st18(spark, d):
    """Shares of fixed effects (visit and arm), participants and error in each panel's principal components."""
    m = K.table(spark, d, "manifest").where("sampleid is not null and usubjid is not null and visitnum in (2, 8, 20)")
    t = m.groupBy(F.col("sampleid").alias("sample")).agg(F.min_by("usubjid", "row_id").alias("usubjid"), F.min_by("visitnum", "row_id").cast("int").alias("visitnum"))
    pcs = st19(spark, d).select("panel", "sample", F.explode(F.create_map(F.lit("pc1"), F.col("pc1"), F.lit("pc2"), F.col("pc2"))).alias("component", "y"))
    rows = pcs.join(t, "sample").join(subjects(spark, d).where("trt01a is not null").select("usubjid", "trt01a"), "usubjid")

    def fit(pdf):
        x = np.column_stack([np.ones(len(pdf)), M.dummies(pdf.visitnum.tolist())[0], M.dummies(pdf.trt01a.tolist())[0]])
        return pd.DataFrame([M.random_intercept(pdf.y.to_numpy(), x, pdf.usubjid.to_numpy())])

    return M.per_group(rows, ["panel", "component"], ["usubjid", "sample"], fit, "var_subject double, var_error double, var_fixed double, share_fixed double, share_subject double, share_error double")


@query("st18_share_checks", "select panel, unnest(['pc1', 'pc2']) component, 1.0::double as total, true as in_range from (select distinct panel from olink_long)")
def st18_checks(spark, d):
    s = st18(spark, d)
    shares = ("share_fixed", "share_subject", "share_error")
    fine = F.lit(True)
    for c in shares:
        fine = fine & F.col(c).between(0, 1)
    return s.select("panel", "component", F.round(F.col(shares[0]) + F.col(shares[1]) + F.col(shares[2]), 6).alias("total"), fine.alias("in_range"))


def matrix_rows(v, keys, row):
    """(keys, row columns, x): a sample is one row with its values in the order of the group's assays, null where it has none. A
    model's task then reads samples, not cells."""
    given = v.where("assay is not null")
    panel = given.groupBy(*keys).agg(F.array_sort(F.collect_set("assay")).alias("assays"))  # the assays of one platform
    rows = given.groupBy(*keys, *row).agg(F.map_from_entries(F.collect_list(F.struct("assay", "v"))).alias("m"))
    return rows.join(panel, keys).select(*keys, *row, F.transform("assays", lambda a: F.try_element_at("m", a)).alias("x"))


def matrix(pdf):
    return np.array(pdf.x.tolist(), float)


def wide(pdf):
    return pdf.pivot(index="sample", columns="assay", values="v").sort_index()


@query("st19_principal_scores")
def st19(spark, d):
    """First two components of the samples of each plate's platform panel, samples by assays per panel."""
    o = K.table(spark, d, "olink_long").where("sampletype = 'SAMPLE' and sampleid is not null and npx is not null and not isnan(npx) and abs(npx) < 40")
    v = o.groupBy("panel", F.col("olinkid").alias("assay"), F.col("sampleid").alias("sample")).agg(F.avg("npx").alias("v"))

    def fit(pdf):
        x = wide(pdf)
        scores, _, share = M.principal_scores(x.to_numpy(), 2)
        return pd.DataFrame({"sample": x.index, "pc1": scores[:, 0], "pc2": scores[:, 1] if scores.shape[1] > 1 else 0.0, "share1": share[0]})

    return M.per_group(v, ["panel"], ["sample", "assay"], fit, "sample string, pc1 double, pc2 double, share1 double")


@query("st20_pca_outliers")
def st20(spark, d):
    """Samples far out on one of two components: fitted on the samples whose rows all pass, columns weighted by detection
    rate, gaps imputed from the fit samples; every sample is judged."""
    o = K.table(spark, d, "olink_long").where("sampletype = 'SAMPLE' and sampleid is not null")
    fits = o.groupBy(F.col("sampleid").alias("sample")).agg(F.bool_and(F.col("sampleqc") == "PASS").alias("fit"))
    good = o.where("npx is not null and not isnan(npx) and abs(npx) < 40")
    rates = good.where("lod is not null and not isnan(lod)").groupBy(F.col("olinkid").alias("assay")).agg(F.avg((F.col("npx") >= F.col("lod")).cast("double")).alias("rate"))
    v = good.groupBy("panel", F.col("olinkid").alias("assay"), F.col("sampleid").alias("sample")).agg(F.avg("npx").alias("v")).join(rates, "assay").join(fits, "sample")

    weights = v.groupBy("panel").agg(F.transform(F.array_sort(F.collect_set(F.struct("assay", "rate"))), lambda r: r["rate"]).alias("weights"))

    def fit(pdf):
        own = pdf.fit.to_numpy(bool)
        full = M.knn_impute(matrix(pdf), own)
        _, z = M.outlier_components(full, own, np.asarray(pdf.weights.iloc[0], float), 2)
        return pd.DataFrame({"sample": pdf["sample"], "in_fit": own, "z1": z[:, 0], "z2": z[:, 1] if z.shape[1] > 1 else 0.0, "outlier": (np.abs(z) > 5).any(axis=1)})

    return M.per_group(matrix_rows(v, ["panel"], ["sample", "fit"]).join(weights, "panel"), ["panel"], ["sample"], fit, "sample string, in_fit boolean, z1 double, z2 double, outlier boolean")


@query("st20_outlier_checks", K.sql("with g as (select panel, sampleid s from olink_long where sampletype = 'SAMPLE' and sampleid is not null and npx is not null and not isnan(npx) and abs(npx) < 40 group by 1, 2), f as (select sampleid s, bool_and(sampleqc = 'PASS') ok from olink_long where sampletype = 'SAMPLE' and sampleid is not null group by 1) select panel, count(*) samples, count(*) filter (ok) fitted, 0.0::double as centre, 1.0::double as spread from g join f using (s) group by 1"))
def st20_checks(spark, d):
    """Fit samples have mean 0 and standard deviation 1 on each component."""
    return st20(spark, d).groupBy("panel").agg(F.count("*").alias("samples"), F.count_if("in_fit").alias("fitted"), F.round(F.abs(F.avg(F.when(F.col("in_fit"), F.col("z1")))), 5).alias("centre"), F.round(F.stddev_pop(F.when(F.col("in_fit"), F.col("z1"))), 5).alias("spread"))


@query("st22_knn_imputed")
def st22(spark, d):
    o = K.table(spark, d, "olink_long").where("sampletype = 'SAMPLE' and sampleid is not null")
    v = nan_to_null(o.select("panel", "olinkid", "sampleid", "npx")).groupBy("panel", F.col("olinkid").alias("assay"), F.col("sampleid").alias("sample")).agg(F.avg("npx").alias("v"))

    panel = v.where("assay is not null").groupBy("panel").agg(F.array_sort(F.collect_set("assay")).alias("assays"))

    def fit(pdf):
        x = matrix(pdf)
        i, j = np.nonzero(np.isnan(x))
        return pd.DataFrame({"sample": pdf["sample"].to_numpy()[i], "column": j + 1, "imputed": M.knn_impute(x)[i, j]})

    got = M.per_group(matrix_rows(v, ["panel"], ["sample"]), ["panel"], ["sample"], fit, "sample string, column int, imputed double")
    return got.join(panel, "panel").select("panel", "sample", F.element_at("assays", F.col("column")).alias("assay"), "imputed")


def _tube_subjects(spark, d):
    m = K.table(spark, d, "manifest").where("sampleid is not null and usubjid is not null")
    return m.groupBy(F.col("sampleid").alias("sample")).agg(F.min_by("usubjid", "row_id").alias("usubjid"))


@query("st30_sex_out_of_fold")
def st30(spark, d):
    """Out-of-fold probability of male sex from one platform's values of a sample, folds by participant, with both penalties."""
    v = assay_samples(olink(spark, d)).join(_tube_subjects(spark, d), "sample").join(subjects(spark, d).where("sex in ('F', 'M')"), "usubjid")
    v = v.join(S.digest_folds(v, "usubjid", 5, 0, "outer"), "usubjid").withColumn("platform", F.lit("olink"))

    def fit(pdf):
        full = M.knn_impute(matrix(pdf))
        y, fold = (pdf.sex == "M").to_numpy(float), pdf.fold.to_numpy()
        return pd.DataFrame({"sample": pdf["sample"], "sex": pdf.sex, "p_male": M.logistic_out_of_fold(full, y, fold, 0.1), "p_male_l1": M.logistic_out_of_fold(full, y, fold, 0.1, "l1")})

    rows = matrix_rows(v, ["platform"], ["sample", "usubjid", "sex", "fold"])
    return M.per_group(rows, ["platform"], ["sample"], fit, "sample string, sex string, p_male double, p_male_l1 double")


@query("d22_sex_discordance")
def d22(spark, d):
    return st30(spark, d).withColumn("call", F.when(F.col("p_male") >= 0.8, "M").when(F.col("p_male") <= 0.2, "F")).withColumn("discordant", F.coalesce(F.col("call") != F.col("sex"), F.lit(False)))


@query("st31_age_out_of_fold")
def st31(spark, d):
    """Out-of-fold predictions of age by ridge (penalty by grouped folds) and elastic net, their bias-corrected residuals, and
    the robust z of the ridge's."""
    return S.robust_z(_ages(spark, d), "residual", ["platform"])


def _ages(spark, d):
    """`st31` without the robust z, kept: the z reads it many times, and each time a lineage would fit the models again."""
    from tallygrove.session import Stash

    stash = Stash(spark)
    people = subjects(spark, d).where("age is not null")
    people = people.join(S.digest_folds(people, "usubjid", 5, 0, "outer"), "usubjid").join(S.digest_folds(people, "usubjid", 5, 0, "inner").withColumnRenamed("fold", "inner"), "usubjid")
    tubes = stash.keep(_tube_subjects(spark, d).join(people, "usubjid").select("sample", "usubjid", "age", "fold", "inner"), "tubes")
    v = assay_samples(soma(spark, d)).join(tubes, "sample").withColumn("platform", F.lit("soma"))

    def fit(pdf):
        full, y = M.knn_impute(matrix(pdf)), pdf.age.to_numpy(float)
        r, e = (M.regress_out_of_fold(full, y, pdf.fold.to_numpy(), pdf["inner"].to_numpy(), model) for model in ("ridge", "elasticnet"))
        return pd.DataFrame({"sample": pdf["sample"], "usubjid": pdf.usubjid, "age": y, "predicted": r["predicted"], "residual": r["corrected"], "predicted_net": e["predicted"], "residual_net": e["corrected"]})

    rows = matrix_rows(v, ["platform"], ["sample", "usubjid", "age", "fold", "inner"])
    return stash.keep(M.per_group(rows, ["platform"], ["sample"], fit, "sample string, usubjid string, age double, predicted double, residual double, predicted_net double, residual_net double"), "ages")


def _polished(spark, d):
    """(assay, sample, x, who, fold): polished values of study samples with participant and fold."""
    v = S.median_polish(soma(spark, d).where("sampletype = 'SAMPLE' and sample is not null"), "v", "assay", ["plate"])
    cells = v.groupBy("assay", "sample").agg(F.avg("resid").alias("x"), F.min("row_id").alias("r"))
    cells = cells.join(_tube_subjects(spark, d).withColumnRenamed("usubjid", "who"), "sample")
    return cells.join(S.digest_folds(cells, "who", 5, 0, "identity"), "who")


def fold_weights(cells, least: float = 0.1, cap: float = 0.95):
    """(f, assay, mean, weight): for each fold, from the participants outside it, an assay's mean and its weight icc / (1 -
    icc), for assays with an intraclass correlation above `least`."""
    folds = cells.select(F.col("fold").alias("f")).distinct()  # five
    train = cells.join(folds, F.col("fold") != F.col("f"))
    mean = train.groupBy("f", "assay").agg(F.avg("x").alias("mean"))
    centred = train.join(mean, ["f", "assay"]).withColumn("c", F.col("x") - F.col("mean"))
    icc = S.intraclass(centred, "c", ["f", "assay"], "who").where(F.col("icc") > least)
    return mean.join(icc, ["f", "assay"]).select("f", "assay", "mean", (F.col("icc") / (1 - F.least("icc", F.lit(cap)))).alias("weight"))


@query("st27_sample_similarity")
def st27(spark, d):
    """Best and second-best partner, among all study samples, of each query sample (first row id divisible by 50) by the
    cross-fitted correlation: a query's assays are chosen and weighted by the intraclass correlations of the other folds.

    Samples are packed into blocks of arrays. The queries, a fixed fiftieth, meet every block once, and each meeting is one
    matrix product that keeps two partners per query."""
    from tallygrove.operators.relational import best_two
    from tallygrove.session import Stash

    stash = Stash(spark)
    cells = stash.keep(_polished(spark, d), "cells")
    w = stash.keep(fold_weights(cells, 0.02), "weights")
    scaled = lambda df: df.join(w, "assay").groupBy("f", "sample").agg(F.map_from_entries(F.collect_list(F.struct("assay", ((F.col("x") - F.col("mean")) * F.sqrt("weight")).alias("x")))).alias("m"), F.first("fold").alias("fold"), F.min("r").alias("r"))
    panel = w.groupBy("f").agg(F.array_sort(F.collect_set("assay")).alias("panel"))  # the assays of one platform
    rows = scaled(cells).join(panel, "f").select("f", "fold", "sample", "r", F.transform("panel", lambda a: F.coalesce(F.try_element_at("m", a), F.lit(0.0))).alias("x"))
    rows = stash.keep(rows, "arrays")
    pack = lambda df, n: df.withColumn("b", F.pmod(F.xxhash64("sample"), F.lit(n))).groupBy("f", "b").agg(F.collect_list(F.struct("sample", "x")).alias("rows"))
    n = cells.agg(F.count_distinct("sample")).first()[0]
    wide_, narrow = max(1, n // 2048), max(1, n // 50 // 512)  # samples of a block stay bounded as tables grow
    x = pack(rows.where("r % 50 = 0 and fold = f"), narrow).select("f", F.col("rows").alias("rx"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(wide_ - 1).cast("long"))).alias("by"))
    y = pack(rows, wide_).select("f", F.col("b").alias("by"), F.col("rows").alias("ry"))

    def product(batches):
        for pdf in batches:
            for rx, ry in zip(pdf.rx, pdf.ry, strict=True):
                a, b = np.array([list(r["x"]) for r in rx]), np.array([list(r["x"]) for r in ry])
                norm = lambda m: (m - m.mean(axis=1, keepdims=True)) / np.maximum(m.std(axis=1, keepdims=True), 1e-9)
                s = norm(a) @ norm(b).T / a.shape[1]
                na, nb = [r["sample"] for r in rx], [r["sample"] for r in ry]
                s[np.array(na)[:, None] == np.array(nb)[None, :]] = -np.inf
                top = np.argsort(-s, axis=1, kind="stable")[:, :2]
                yield pd.DataFrame({"sample": np.repeat(na, top.shape[1]), "partner": [nb[j] for j in top.ravel()], "r": np.take_along_axis(s, top, axis=1).ravel()})

    return best_two(x.join(y, ["f", "by"]).select("rx", "ry").mapInPandas(product, "sample string, partner string, r double").where("r > -1e300"), ["sample"], "partner", "r")


@query("st25_without_components")
def st25(spark, d):
    v = assay_samples(olink(spark, d)).withColumn("platform", F.lit("olink"))

    def fit(pdf):
        z = M.knn_impute(matrix(pdf))
        z = (z - z.mean(axis=0)) / np.maximum(z.std(axis=0), 1e-9)
        r = M.without_components(z, np.ones(len(z), bool), 3)
        return pd.DataFrame({"sample": pdf["sample"], "kept": (r**2).sum(axis=1) / np.maximum((z**2).sum(axis=1), 1e-12)})

    return M.per_group(matrix_rows(v, ["platform"], ["sample"]), ["platform"], ["sample"], fit, "sample string, kept double")


@query("st35_huber_location")
def st35(spark, d):
    """Scores of tubes against genotypes less the leave-one-out robust location that the genotypes' components explain."""
    from tallygrove.operators import genetics as G
    from tallygrove.plans.domain_linkage import _observed, _predicted
    from tallygrove.session import Stash

    predicted = Stash(spark).keep(_predicted(spark, d), "predicted")  # for the components and for the scores
    flat = predicted.select(F.lit("all").alias("set"), F.col("geno").alias("sample"), F.col("protein").alias("assay"), F.col("y").alias("v"))

    def fit(pdf):
        x = wide(pdf)
        scores, _, _ = M.principal_scores(x.to_numpy(), 2)
        return pd.DataFrame({"geno": x.index, "pc1": scores[:, 0], "pc2": scores[:, 1]})

    pcs = M.per_group(flat, ["set"], ["sample", "assay"], fit, "geno long, pc1 double, pc2 double")
    return G.matrix_locations(_observed(spark, d), predicted, pcs, ["pc1", "pc2"])


@query("st38_camera_sets", f"""with p as (select p_brand term, p_size::double x from part), u as (select count(*) n, avg(x) tot, var_samp(x) v from p), g as (select term, count(*) m, avg(x) mean from p group by 1),
  d as (select term, m, n, v, n::double / (n - m) * (mean - tot) delta from g, u), t as (select term, m, n, delta / sqrt(((n - 1) * v - delta * delta * m * (n - m) / n) / (n - 2) * ((1 + (m - 1) * 0.01) / m + 1.0 / (n - m))) t from d),
  q as (select *, {sql_t_two_sided('t', '(n - 2)')} p from t), r as (select *, p * count(*) over () / rank() over (order by p) s from q)
  select term, m n, round(t, 6) t, round(p, 6) p, case when t > 0 then 'Up' else 'Down' end direction, round(least(1, min(s) over (order by p desc range between unbounded preceding and current row)), 6) fdr from r""")
def st38(spark, d):
    """Competitive test of part brands on a size statistic: counts, means and one variance are all it needs, so the members of
    a set are aggregated, not collected."""
    p = K.table(spark, d, "part").select("p_brand", F.col("p_size").cast("double").alias("stat"))
    got = S.camera_sets(p, "p_brand", "stat")
    return S.bh_fdr(got, "p").select(F.col("p_brand").alias("term"), "n", *[F.round(c, 6).alias(c) for c in ("t", "p")], "direction", F.round("fdr", 6).alias("fdr"))


_TUBES = K.sql("(select sampleid sample, arg_min(usubjid, row_id) who from manifest where sampleid is not null and usubjid is not null group by 1)")
_PEOPLE = K.sql("(select usubjid who, arg_min(sex, row_id) sex, arg_min(age, row_id) age from adsl where deleted_at is null group by 1)")


@query("st19_score_checks", K.sql("select panel, count(distinct sampleid) n, 0.0::double as centre1, 0.0::double as centre2, true as in_range from olink_long where sampletype = 'SAMPLE' and sampleid is not null and npx is not null and not isnan(npx) and abs(npx) < 40 group by 1"))
def st19_checks(spark, d):
    """Component scores are centred, uncorrelated, and the first share lies between 0 and 1."""
    zero = lambda c: F.round(F.abs(F.avg(c)), 6)
    tied = F.abs(F.covar_pop("pc1", "pc2")) < 1e-6 * (F.var_pop("pc1") + 1)
    return st19(spark, d).groupBy("panel").agg(F.count("*").alias("n"), zero("pc1").alias("centre1"), zero("pc2").alias("centre2"), (tied & (F.min("share1") > 0) & (F.max("share1") <= 1)).alias("in_range"))


@query("st22_imputation_checks", K.sql("with c as (select panel, olinkid a, sampleid s, avg(npx) filter (not isnan(npx)) v from olink_long where sampletype = 'SAMPLE' and sampleid is not null group by 1, 2, 3), n as (select panel, count(distinct a) * count(distinct s) cells, count(v) given from c group by 1) select panel, cells - given gaps, true as between_donors from n where cells > given"))
def st22_checks(spark, d):
    """Every gap, and nothing else, is imputed, by a mean of given values."""
    o = nan_to_null(K.table(spark, d, "olink_long").where("sampletype = 'SAMPLE' and sampleid is not null").select("panel", "olinkid", "npx"))
    ends = o.groupBy("panel", F.col("olinkid").alias("assay")).agg(F.min("npx").alias("lo"), F.max("npx").alias("hi"))
    return st22(spark, d).join(ends, ["panel", "assay"]).groupBy("panel").agg(F.count("*").alias("gaps"), F.bool_and(F.col("imputed").between(F.col("lo"), F.col("hi"))).alias("between_donors"))


@query("st25_projection_checks", f"select count(distinct sample) n, true as no_larger from {OLINK_SQL} where sampletype = 'SAMPLE' and sample is not null")
def st25_checks(spark, d):
    """What is left after projection is at most all of a sample's variation."""
    return st25(spark, d).agg(F.count("*").alias("n"), F.bool_and((F.col("kept") >= 0) & (F.col("kept") <= 1 + 1e-9)).alias("no_larger"))


@query("st30_probability_checks", f"select count(distinct sample) n, true as in_range, count(distinct sample) filter (sex = 'M') men from {OLINK_SQL} join {_TUBES} using (sample) join {_PEOPLE} using (who) where sampletype = 'SAMPLE' and sex in ('F', 'M')")
def st30_checks(spark, d):
    fine = F.col("p_male").between(0, 1) & F.col("p_male_l1").between(0, 1)
    return st30(spark, d).agg(F.count("*").alias("n"), F.bool_and(fine).alias("in_range"), F.count_if(F.col("sex") == "M").alias("men"))


@query("st31_prediction_checks", f"select count(distinct sample) n, round(sum(age) / 1.0, 4) as ages, true as predicted from (select distinct sample, age from {SOMA_SQL} join {_TUBES} using (sample) join {_PEOPLE} using (who) where sampletype = 'SAMPLE' and age is not null)")
def st31_checks(spark, d):
    whole = F.lit(True)
    for c in ("predicted", "residual", "predicted_net", "residual_net"):
        whole = whole & F.col(c).isNotNull() & ~F.isnan(c)
    return st31(spark, d).agg(F.count("*").alias("n"), F.round(F.sum("age"), 4).alias("ages"), F.bool_and(whole).alias("predicted"))


@query("st39_rotation_null")
def st39(spark, d):
    """Rank correlation of assay effects with a signature against rotations that keep the assays' correlation."""
    v = assay_samples(olink(spark, d)).withColumn("platform", F.lit("olink"))

    def fit(pdf):
        x = M.knn_impute(matrix(pdf))
        z = (x - x.mean(axis=0)) / np.maximum(x.std(axis=0), 1e-9)
        rho, p, err = M.rotation_null(np.median(x, axis=0), np.arange(x.shape[1], dtype=float), z.T / np.sqrt(len(z)), 1_000_000, 500, 0)
        return pd.DataFrame([{"rho": rho, "p": p, "error": err}])

    return M.per_group(matrix_rows(v, ["platform"], ["sample"]), ["platform"], ["sample"], fit, "rho double, p double, error double")


QUERIES, ORACLES = REG.queries, REG.oracles
