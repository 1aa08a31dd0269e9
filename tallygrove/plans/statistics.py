"""Queries of the statistical operators that SQL can state."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallygrove.functions.dist import hypergeom_p_value, t_p_value
from tallygrove.operators import stats as S
from tallygrove.plans import keys as K
from tallygrove.plans.registry import Registry
from tallygrove.plans.sqldist import sql_t_two_sided
from tallygrove.sources.tables import table

REG = Registry()
query = REG.add

#: Readings of study samples as (assay, plate, sample, value on the log2 scale), without values that cannot be.
SOMA_SQL = K.sql("(select row_id, seqid assay, plateid plate, sampleid sample, sampletype, log2(rfu) v, lod from soma_long where rfu is not null and not isnan(rfu) and rfu > 0.1 and rfu < 1000000)")
OLINK_SQL = K.sql("(select row_id, olinkid assay, plateid plate, sampleid sample, sampletype, npx v, lod from olink_long where npx is not null and not isnan(npx) and abs(npx) < 40)")


def soma(spark, d):
    s = K.table(spark, d, "soma_long").where("rfu is not null and not isnan(rfu) and rfu > 0.1 and rfu < 1000000")
    return s.select("row_id", F.col("seqid").alias("assay"), F.col("plateid").alias("plate"), F.col("sampleid").alias("sample"), "sampletype", F.log2("rfu").alias("v"), "lod")


def olink(spark, d):
    o = K.table(spark, d, "olink_long").where("npx is not null and not isnan(npx) and abs(npx) < 40")
    return o.select("row_id", F.col("olinkid").alias("assay"), F.col("plateid").alias("plate"), F.col("sampleid").alias("sample"), "sampletype", F.col("npx").alias("v"), "lod")


def r6(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


#: A p-like column: a share of parts per supplier and part.
P_SQL = "(select l_suppkey s, l_partkey g, (l_extendedprice * 7919 % 100003) / 100003.0 p from lineitem)"


def p_values(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("g"), ((F.col("l_extendedprice") * 7919 % 100003) / 100003.0).alias("p"))




@query("st1_bh_whole_family", "select p, round(least(1, min(p * m / i) over (order by p desc rows between unbounded preceding and current row)), 6) fdr, n from (select p, count(*) n, sum(count(*)) over (order by p) i, sum(count(*)) over () m from " + P_SQL + " group by p)")
def st1(spark, d):
    return S.bh_fdr(p_values(spark, d), "p").groupBy("p", "fdr").agg(F.count("*").alias("n")).withColumn("fdr", F.round("fdr", 6))


@query("st1_bh_by_group", "select s, p, round(least(1, min(p * m / i) over (partition by s order by p desc rows between unbounded preceding and current row)), 6) fdr, n from (select s, p, count(*) n, sum(count(*)) over (partition by s order by p) i, sum(count(*)) over (partition by s) m from " + P_SQL + " group by s, p)")
def st1g(spark, d):
    return S.bh_fdr(p_values(spark, d), "p", ["s"]).groupBy("s", "p", "fdr").agg(F.count("*").alias("n")).withColumn("fdr", F.round("fdr", 6))


@query("st2_simes", "select g, round(min(p * n / i), 6) p_simes, max(n) n_p from (select g, p, row_number() over (partition by g order by p) i, count(*) over (partition by g) n from " + P_SQL + ") group by g")
def st2(spark, d):
    return r6(S.simes(p_values(spark, d), "p", ["g"]), "p_simes")


@query("st7_robust_z", f"with b as (select assay, median(v) med from {SOMA_SQL} where sampletype = 'SAMPLE' group by 1), m as (select assay, any_value(med) med, median(abs(v - med)) mad from {SOMA_SQL} join b using (assay) where sampletype = 'SAMPLE' group by 1) select row_id, round((v - med) / (1.4826 * mad), 6) z from {SOMA_SQL} join m using (assay)")
def st7(spark, d):
    return S.robust_z(soma(spark, d), "v", ["assay"], F.col("sampletype") == "SAMPLE").select("row_id", F.round("z", 6).alias("z"))


_FAMILY = "(select distinct a.seqid x_assay, b.olinkid y_assay from soma_long a join olink_long b on left(a.uniprot, 2) = left(b.uniprot, 2))"
_PAIRS = f"(select x_assay, y_assay, a.sample, a.v x, b.v y from (select assay x_assay, sample, avg(v) v from {SOMA_SQL} where sampletype = 'SAMPLE' group by 1, 2) a join {_FAMILY} f using (x_assay) join (select assay y_assay, sample, avg(v) v from {OLINK_SQL} where sampletype = 'SAMPLE' group by 1, 2) b using (y_assay) where a.sample = b.sample)"


def pair_frame(spark, d):
    """Values of one sample on both platforms, for assays whose accessions begin alike (a bridge over a shared token)."""
    mean = lambda df, out: df.where("sampletype = 'SAMPLE'").groupBy(F.col("assay").alias(f"{out}_assay"), "sample").agg(F.avg("v").alias(out))
    family = lambda name, key, out: table(spark, d, name).select(F.col(key).alias(out), F.substring("uniprot", 1, 2).alias("family")).distinct()
    pairs = family("soma_long", "seqid", "x_assay").join(family("olink_long", "olinkid", "y_assay"), "family").select("x_assay", "y_assay").distinct()
    return mean(soma(spark, d), "x").join(pairs, "x_assay").join(mean(olink(spark, d), "y"), ["y_assay", "sample"])


@query("st8_pair_correlations", f"with r as (select *, rank() over (partition by x_assay, y_assay order by x) + (count(*) over (partition by x_assay, y_assay, x) - 1) / 2.0 rx, rank() over (partition by x_assay, y_assay order by y) + (count(*) over (partition by x_assay, y_assay, y) - 1) / 2.0 ry from {_PAIRS}) select x_assay, y_assay, count(*) n, round(corr(x, y), 6) pearson, round(corr(rx, ry), 6) spearman from r group by 1, 2")
def st8(spark, d):
    return r6(S.correlations(pair_frame(spark, d), "x", "y", ["x_assay", "y_assay"]), "pearson", "spearman")


_RHO = f"with r as (select *, rank() over (partition by x_assay, y_assay order by x) + (count(*) over (partition by x_assay, y_assay, x) - 1) / 2.0 rx, rank() over (partition by x_assay, y_assay order by y) + (count(*) over (partition by x_assay, y_assay, y) - 1) / 2.0 ry from {_PAIRS}), c as (select x_assay, y_assay, count(*) n, corr(x, y) pearson, corr(rx, ry) spearman from r group by 1, 2)"


@query("st8_correlation_p_values", f"{_RHO}, t as (select *, spearman * sqrt((n - 2) / greatest(1 - spearman ** 2, 1e-300)) t from c where n >= 10 and spearman is not null) select x_assay, y_assay, n, round(spearman, 6) spearman, round({sql_t_two_sided('t', '(n - 2)')}, 6) p from t")
def st8p(spark, d):
    c = S.correlations(pair_frame(spark, d), "x", "y", ["x_assay", "y_assay"], least=10)
    t = F.col("spearman") * F.sqrt((F.col("n") - 2) / F.greatest(1 - F.col("spearman") ** 2, F.lit(1e-300)))
    return r6(c.where("spearman is not null").withColumn("p", t_p_value(t, (F.col("n") - 2).cast("double"))), "spearman", "p").drop("pearson")


@query("st10_ols", "select l_suppkey s, count(*) n, round(covar_pop(l_quantity, l_extendedprice) / var_pop(l_quantity), 4) slope, round(avg(l_extendedprice) - covar_pop(l_quantity, l_extendedprice) / var_pop(l_quantity) * avg(l_quantity), 4) intercept, round(sqrt(greatest(count(*) * (var_pop(l_extendedprice) - covar_pop(l_quantity, l_extendedprice) ** 2 / var_pop(l_quantity)), 0) / greatest(count(*) - 2, 1) / (count(*) * var_pop(l_quantity))), 4) se_slope from lineitem group by 1")
def st10(spark, d):
    fit = S.simple_ols(table(spark, d, "lineitem").withColumnRenamed("l_suppkey", "s"), "l_quantity", "l_extendedprice", ["s"])
    return fit.select("s", "n", *[F.round(c, 4).alias(c) for c in ("slope", "intercept", "se_slope")])


@query("st4_sobel_z", f"with a as (select assay, covar_pop(lod, v) / var_pop(lod) b, sqrt(greatest(count(*) * (var_pop(v) - covar_pop(lod, v) ** 2 / var_pop(lod)), 0) / greatest(count(*) - 2, 1) / (count(*) * var_pop(lod))) se from {OLINK_SQL} where not isnan(lod) group by 1 having var_pop(lod) > 0) select x.assay a, y.assay b, round(x.b * y.b, 6) indirect, round(x.b * y.b / sqrt(x.b ** 2 * y.se ** 2 + y.b ** 2 * x.se ** 2), 6) z from a x join a y on x.assay < y.assay")
def st4(spark, d):
    fit = S.simple_ols(olink(spark, d), "lod", "v", ["assay"]).select("assay", F.col("slope").alias("b"), F.col("se_slope").alias("se"))
    x, y = fit.select(F.col("assay").alias("a"), F.col("b").alias("bx"), F.col("se").alias("sx")), fit.select(F.col("assay").alias("b"), F.col("b").alias("by"), F.col("se").alias("sy"))
    both = x.join(y, F.col("a") < F.col("b"))  # the result is every pair of assays
    z = F.col("bx") * F.col("by") / F.sqrt(F.col("bx") ** 2 * F.col("sy") ** 2 + F.col("by") ** 2 * F.col("sx") ** 2)
    return both.select("a", "b", F.round(F.col("bx") * F.col("by"), 6).alias("indirect"), F.round(z, 6).alias("z"))


@query("st21_hazen_quantile", """with o as (select l_suppkey s, l_extendedprice x, l_quantity w from lineitem), c as (select *, (sum(w) over (partition by s order by x, w rows between unbounded preceding and current row) - w / 2) / sum(w) over (partition by s) p from o),
  e as (select s, max(p) filter (p <= 0.5) lp, arg_max(x, (p, x)) filter (p <= 0.5) lx, min(p) filter (p >= 0.5) hp, arg_min(x, (p, x)) filter (p >= 0.5) hx from c group by 1)
  select s, round(case when lp is null then hx when hp is null then lx when hp = lp then lx else lx + (hx - lx) * (0.5 - lp) / (hp - lp) end, 4) q from e""")  # fmt: skip
def st21(spark, d):
    o = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_extendedprice").alias("x"), F.col("l_quantity").alias("w"))
    return S.hazen_quantile(o, "x", "w", ["s"], 0.5, "q").withColumn("q", F.round("q", 4))


@query("a8_nearest_quantile_and_fence", "with r as (select event_type, value, row_number() over (partition by event_type order by value) - 1 i, count(*) over (partition by event_type) n from events where value is not null and not isnan(value)), q as (select event_type, max(n) n, max(value) filter (i = round_even(0.25 * (n - 1), 0)) q1, max(value) filter (i = round_even(0.75 * (n - 1), 0)) q3 from r group by 1) select event_type, n, q1, q3, round(q1 - 1.5 * (q3 - q1), 6) low, round(q3 + 1.5 * (q3 - q1), 6) high from q")
def a8(spark, d):
    return r6(S.tukey_fence(table(spark, d, "events"), "value", ["event_type"]), "low", "high")


@query("st23_standardise", f"select row_id, round((v - avg(v) over (partition by assay)) / stddev_samp(v) over (partition by assay), 6) z from {OLINK_SQL}")
def st23(spark, d):
    return S.standardise(olink(spark, d), "v", ["assay"]).select("row_id", F.round("z", 6).alias("z"))


@query("st26_intraclass", f"with p as (select assay, sample, sum(v - c) s, sum((v - c) ** 2) q, count(*) n from (select *, avg(v) over (partition by assay) c from {OLINK_SQL} where sampletype = 'SAMPLE' and sample is not null) group by 1, 2 having count(*) >= 2) select assay, round(sum((s * s - q) / 2) / sum((n - 1) * q / 2), 5) icc, count(*) subjects from p group by 1")
def st26(spark, d):
    o = S.standardise(olink(spark, d).where("sampletype = 'SAMPLE' and sample is not null"), "v", ["assay"])
    return S.intraclass(o, "z", ["assay"], "sample").withColumn("icc", F.round("icc", 5))


@query("st28_stable_folds", "select distinct usubjid, (('0x' || left(sha256('s1/' || usubjid), 8))::bigint % 5)::int fold from adsl")
def st28(spark, d):
    return table(spark, d, "adsl").select("usubjid", S.stable_fold(F.col("usubjid"), 5, "s1").alias("fold")).distinct()


@query("st29_grouped_folds_complete", "select (('0x' || left(sha256('s1/' || usubjid), 8))::bigint % 5)::int fold, count(*) n, count(distinct usubjid) subjects from adsl group by 1")
def st29(spark, d):
    a = table(spark, d, "adsl")
    return a.groupBy(S.stable_fold(F.col("usubjid"), 5, "s1").alias("fold")).agg(F.count("*").alias("n"), F.count_distinct("usubjid").alias("subjects"))


def _swept(first: str, effects: tuple[str, ...], rounds: int) -> str:
    """CTEs c0, c1, ... that sweep the medians of each effect out of r in turn, and the last one's name."""
    parts, n = [f"c0 as ({first})"], 0
    for _ in range(rounds):
        for e in effects:
            parts.append(f"c{n + 1} as (select * replace (r - median(r) over (partition by assay, {e}) as r) from c{n})")
            n += 1
    return ", ".join(parts), f"c{n}"


_POLISH, _LAST = _swept(
    K.sql(f"""select s.row_id, assay, plate, arm || '/' || visit cell, v r from {SOMA_SQL} s left join (select sampleid, arg_min(usubjid, row_id) filter (usubjid is not null) who, arg_min(visitnum::int, row_id) filter (visitnum between 1 and 99 and not isnan(visitnum)) visit from manifest where sampleid is not null group by 1) t on t.sampleid = s.sample
    left join (select usubjid, arg_min(trt01a, row_id) filter (trt01a is not null) arm from adsl where usubjid is not null group by 1) a on a.usubjid = t.who where sampletype = 'SAMPLE'"""),
    ("cell", "plate"), 3,
)


@query("st24_median_polish", f"with {_POLISH}, m as (select assay, median(r) med from {_LAST} group by 1), k as (select assay, median(abs(r - med)) mad from {_LAST} join m using (assay) group by 1) select row_id, assay, round(case when mad > 0 then greatest(-6, least(6, r / (1.4826 * mad))) else 0 end, 6) + 0.0 resid from {_LAST} join k using (assay)")
def st24(spark, d):
    """Medians of arm by visit and of plates swept out of each analyte's values in turn, three rounds; samples without arm or
    visit are a group of their own."""
    m = K.table(spark, d, "manifest").where("sampleid is not null")
    fits = F.col("visitnum").between(1, 99) & ~F.isnan("visitnum")
    t = m.groupBy(F.col("sampleid").alias("sample")).agg(F.min_by("usubjid", F.when(F.col("usubjid").isNotNull(), F.col("row_id"))).alias("usubjid"), F.min_by(F.col("visitnum"), F.when(fits, F.col("row_id"))).alias("visit"))
    a = K.table(spark, d, "adsl").where("usubjid is not null").groupBy("usubjid").agg(F.min_by("trt01a", F.when(F.col("trt01a").isNotNull(), F.col("row_id"))).alias("arm"))
    # DuckDB rounds a half visit to the nearest even number, as bround does
    cells = t.join(a, "usubjid", "left").select("sample", F.concat("arm", F.lit("/"), F.bround("visit").cast("int").cast("string")).alias("cell"))
    rows = soma(spark, d).where("sampletype = 'SAMPLE'").join(cells, "sample", "left")
    return S.median_polish(rows, "v", "assay", ["cell", "plate"]).select("row_id", "assay", F.round("resid", 6).alias("resid"))


@query("st24_one_sweep", f"with a as (select *, v - median(v) over (partition by assay, plate) r from {SOMA_SQL} where sampletype = 'SAMPLE'), m as (select assay, median(r) med from a group by 1), k as (select assay, median(abs(r - med)) mad from a join m using (assay) group by 1) select row_id, round(case when mad > 0 then greatest(-6, least(6, r / (1.4826 * mad))) else 0 end, 6) resid from a join k using (assay)")
def st24b(spark, d):
    return S.median_polish(soma(spark, d).where("sampletype = 'SAMPLE'"), "v", "assay", ["plate"], rounds=1).select("row_id", F.round("resid", 6).alias("resid"))


@query("st32_kinship_counts", """with g as (select user_id i, event_type v, least(count(*), 2) % 3 dose from events group by 1, 2)
  select x.i a, y.i b, sum(case when x.dose = 1 and y.dose = 1 then 1 else 0 end)::bigint het_het, sum(case when abs(x.dose - y.dose) = 2 then 1 else 0 end)::bigint opposite, count(*) n from g x join g y on x.v = y.v and x.i < y.i group by 1, 2""")  # fmt: skip
def st32(spark, d):
    g = table(spark, d, "events").groupBy(F.col("user_id").alias("i"), F.col("event_type").alias("v")).agg((F.least(F.count("*"), F.lit(2)) % 3).alias("dose"))
    from tallygrove.operators.genetics import pair_counts

    return pair_counts(g, "i", "v", "dose").select("a", "b", "het_het", "opposite", "n")


@query("st37_overrepresentation_counts", "with u as (select count(*) n, count(*) filter (p_retailprice > 930) d from part) select p_brand term, count(*) m, count(*) filter (p_retailprice > 930) k, any_value(n) n, any_value(d) d from part, u group by 1")
def st37(spark, d):
    p = table(spark, d, "part")
    hit = F.col("p_retailprice") > 930
    u = p.agg(F.count("*").alias("n"), F.count_if(hit).alias("d"))
    return p.groupBy(F.col("p_brand").alias("term")).agg(F.count("*").alias("m"), F.count_if(hit).alias("k")).crossJoin(F.broadcast(u))


_CHOOSE = "lgamma({a} + 1) - lgamma({b} + 1) - lgamma({a} - ({b}) + 1)"
_TAIL = f"list_sum(list_transform(range(k, least(m, d) + 1), lambda i: case when d - i <= n - m then exp({_CHOOSE.format(a='m', b='i')} + {_CHOOSE.format(a='(n - m)', b='d - i')} - ({_CHOOSE.format(a='n', b='d')})) else 0 end))"


@query("st37_overrepresentation_p", f"with u as (select count(*) n, count(*) filter (p_retailprice > 930) d from part), c as (select p_brand term, count(*) m, count(*) filter (p_retailprice > 930) k, any_value(n) n, any_value(d) d from part, u group by 1) select term, m, k, n, d, round({_TAIL}, 6) p from c")
def st37p(spark, d):
    c = st37(spark, d)
    return r6(c.withColumn("p", hypergeom_p_value("k", "n", "m", "d")), "p")


@query("st42_axis_cap", "with t as (select assay, abs(v) a, row_number() over (partition by assay order by abs(v) desc) r from (select olinkid assay, npx v from olink_long where npx is not null and not isnan(npx))) select assay, case when max(a) filter (r = 2) > 0 and max(a) filter (r = 1) > 3 * max(a) filter (r = 2) then max(a) filter (r = 2) end cap, max(a) filter (r = 1) largest from t where r <= 2 group by 1")
def st42(spark, d):
    return S.axis_cap(table(spark, d, "olink_long").select(F.col("olinkid").alias("assay"), "npx"), "npx", ["assay"])


@query("st43_regression_line", f"select assay, round(regr_slope(v, lod), 6) slope, round(regr_intercept(v, lod), 6) intercept from {OLINK_SQL} where not isnan(lod) group by 1 having var_pop(lod) > 0")
def st43(spark, d):
    return r6(S.simple_ols(olink(spark, d), "lod", "v", ["assay"]), "slope", "intercept").select("assay", "slope", "intercept")


@query("st45_tail_threshold", "with r as (select event_type, value, row_number() over (partition by event_type order by value desc) r, count(*) over (partition by event_type) n from events where value is not null) select event_type, value cut, n from r where r = floor(0.01 * n) + 1")
def st45(spark, d):
    return S.upper_threshold(table(spark, d, "events"), "value", ["event_type"], 0.01)


@query("st6_add_one_monte_carlo", "select event_type, count(*) b, count(*) filter (value >= 90) k, round((1 + count(*) filter (value >= 90)) / (1.0 + count(*)), 6) p from events group by 1")
def st6(spark, d):
    e = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("b"), F.count_if(F.col("value") >= 90).alias("k"))
    return e.withColumn("p", F.round((1 + F.col("k")) / (1 + F.col("b")), 6))


@query("st5_empirical_p", "select event_type, round(least(1, 2.0 * least(count(*) filter (value > 50), count(*) filter (value < 50)) / count(*)), 6) p from events where value is not null group by 1")
def st5(spark, d):
    up, down = F.count_if(F.col("value") > 50), F.count_if(F.col("value") < 50)
    return table(spark, d, "events").where("value is not null").groupBy("event_type").agg(F.round(F.least(F.lit(1.0), 2.0 * F.least(up, down) / F.count("*")), 6).alias("p"))


QUERIES, ORACLES = REG.queries, REG.oracles
