"""Further queries of SURVEY 2.3 to 2.9b: primitives and compositions that the other modules do not name."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallygrove.functions.dist import nlp_value, t_p_value, z_p_value
from tallygrove.functions.text import arm_name
from tallygrove.operators import models as M
from tallygrove.operators import relational as R
from tallygrove.operators import results as O
from tallygrove.operators import stats as S
from tallygrove.plans.domain_models import assay_samples, matrix, matrix_rows, subjects
from tallygrove.plans.domain_linkage import _CAT, _PAIRS, kin_pairs
from tallygrove.plans.domain_results import _CHANGES, _CLASSIFIED, _LS, _T, arm_courses, changes, effects, ls_means
from tallygrove.plans import keys as K
from tallygrove.plans.registry import Registry
from tallygrove.plans.sqldist import sql_normal_nlp, sql_normal_two_sided, sql_t_two_sided
from tallygrove.plans.statistics import _RHO, OLINK_SQL, SOMA_SQL, olink, pair_frame, soma
from tallygrove.sources.tables import nan_to_null, table

REG = Registry()
query = REG.add


# --- joins, aggregates, windows --------------------------------------------------------------------------------------
@query("j2_left_annotation", "select l_orderkey, l_linenumber, p_brand, s_name from lineitem left join (select * from part where p_size > 25) p on l_partkey = p_partkey left join supplier on l_suppkey = s_suppkey")
def j2(spark, d):
    p = table(spark, d, "part").where("p_size > 25").select("p_partkey", "p_brand")
    s = table(spark, d, "supplier").select("s_suppkey", "s_name")
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return li.join(p, F.col("l_partkey") == F.col("p_partkey"), "left").join(s, F.col("l_suppkey") == F.col("s_suppkey"), "left").select("l_orderkey", "l_linenumber", "p_brand", "s_name")


@query("j12_position_join_with_residual", "select l_orderkey, l_linenumber, case when l_quantity > p_size then 'above' else 'below' end side, count(*) over (partition by l_orderkey, l_partkey) n from lineitem join part on l_partkey = p_partkey and (l_quantity > p_size + 20 or l_quantity < p_size - 20)")
def j12(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    p = table(spark, d, "part").select("p_partkey", "p_size")
    met = li.join(p, (F.col("l_partkey") == F.col("p_partkey")) & ((F.col("l_quantity") > F.col("p_size") + 20) | (F.col("l_quantity") < F.col("p_size") - 20)))
    return met.select("l_orderkey", "l_linenumber", F.when(F.col("l_quantity") > F.col("p_size"), "above").otherwise("below").alias("side"), F.count("*").over(W.partitionBy("l_orderkey", "l_partkey")).alias("n"))


@query("j18_mapping_expansion", "with m as (select unnest(['SAMPLE', 'SAMPLE', 'PLATE_CONTROL', 'NEGATIVE_CONTROL']) kind, unnest(['study', 'any', 'any', 'blank']) label) select label, count(*) n from soma_long join m on sampletype = kind group by 1")
def j18(spark, d):
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(v).alias("label")) for k, v in (("SAMPLE", "study"), ("SAMPLE", "any"), ("PLATE_CONTROL", "any"), ("NEGATIVE_CONTROL", "blank"))])
    labels = F.transform(F.filter(pairs, lambda x: x["kind"] == F.col("sampletype")), lambda x: x["label"])
    return table(spark, d, "soma_long").select(F.explode(labels).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


@query("a4_any_all", "select siteid, bool_or(hba1cbl > 8) any_high, bool_and(age >= 18) all_adult, count(*) filter (sex = 'F') women from adsl where not isnan(hba1cbl) group by 1")
def a4(spark, d):
    a = nan_to_null(table(spark, d, "adsl")).where("hba1cbl is not null")
    return a.groupBy("siteid").agg(F.bool_or(F.col("hba1cbl") > 8).alias("any_high"), F.bool_and(F.col("age") >= 18).alias("all_adult"), F.count_if(F.col("sex") == "F").alias("women"))


@query("a7_nested_median", f"with m as (select assay, plate, median(v) med from {SOMA_SQL} group by 1, 2) select assay, round(median(med), 6) mid, round(median(abs(med - mm)), 6) spread from (select *, median(med) over (partition by assay) mm from m) group by 1")
def a7(spark, d):
    m = soma(spark, d).groupBy("assay", "plate").agg(F.median("v").alias("m"))
    got = S.median_mad(m, "m", ["assay"])
    return got.select("assay", F.round("med", 6).alias("mid"), F.round("mad", 6).alias("spread"))


@query("a13_value_counts", "select adt_source, count(*) n, round(count(*) / sum(count(*)) over (), 6) share from manifest group by 1")
def a13(spark, d):
    m = table(spark, d, "manifest")
    total = m.agg(F.count("*").alias("all"))
    return m.groupBy("adt_source").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("adt_source", "n", F.round(F.col("n") / F.col("all"), 6).alias("share"))


@query("a17_any_group_passes", f"with r as (select assay, plate, avg(case when v >= lod then 1.0 else 0.0 end) rate, count(*) n from {OLINK_SQL} where sampletype = 'SAMPLE' and not isnan(lod) group by 1, 2) select assay, max(rate) >= 0.999 passes, count(*) plates from r where n >= 10 group by 1")
def a17(spark, d):
    o = olink(spark, d).where("sampletype = 'SAMPLE' and not isnan(lod)")
    r = o.groupBy("assay", "plate").agg(F.avg((F.col("v") >= F.col("lod")).cast("double")).alias("rate"), F.count("*").alias("n")).where("n >= 10")
    return r.groupBy("assay").agg((F.max("rate") >= 0.999).alias("passes"), F.count("*").alias("plates"))


@query("a19_effect_with_fallback", "with m as (select siteid, trt01a, count(*) n, median(age) m from adsl where age is not null and trt01a is not null group by 1, 2), s as (select siteid, median(age) ms, count(*) ns from adsl where age is not null and trt01a is not null group by 1), a as (select median(age) ma from adsl where age is not null and trt01a is not null) select siteid, trt01a, case when n >= 5 then m when ns >= 5 then ms else ma end mid from m join s using (siteid), a")
def a19(spark, d):
    a = table(spark, d, "adsl").where("age is not null and trt01a is not null")
    m = a.groupBy("siteid", "trt01a").agg(F.count("*").alias("n"), F.median("age").alias("m"))
    s = a.groupBy("siteid").agg(F.median("age").alias("ms"), F.count("*").alias("ns"))
    return m.join(s, "siteid").crossJoin(F.broadcast(a.agg(F.median("age").alias("ma")))).select("siteid", "trt01a", F.when(F.col("n") >= 5, F.col("m")).when(F.col("ns") >= 5, F.col("ms")).otherwise(F.col("ma")).alias("mid"))


@query("w4_any_over_subject", K.sql("select row_id, coalesce(bool_or(manifest_exclude is not null) over (partition by usubjid), false) any_excluded, min(visitnum) over (partition by usubjid) anchor from manifest where usubjid is not null and visitnum is not null and not isnan(visitnum)"))
def w4(spark, d):
    w = W.partitionBy("usubjid")
    m = nan_to_null(K.table(spark, d, "manifest")).where("usubjid is not null and visitnum is not null")
    return m.select("row_id", F.coalesce(F.bool_or(F.col("manifest_exclude").isNotNull()).over(w), F.lit(False)).alias("any_excluded"), F.min("visitnum").over(w).alias("anchor"))


@query("w9_average_ranks", "select event_id, rank() over (partition by user_id order by value) + (count(*) over (partition by user_id, value) - 1) / 2.0 r from events where value is not null")
def w9(spark, d):
    return S.average_ranks(table(spark, d, "events").where("value is not null"), "value", ["user_id"], "r").select("event_id", "r")


@query("w10_rank_positions", "select p_partkey, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) i from part")
def w10(spark, d):
    return table(spark, d, "part").select("p_partkey", F.row_number().over(W.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")).alias("i"))


@query("t7_join_on_row_key", "select a.event_id, a.value, b.event_type from events a join events b using (event_id)")
def t7(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", "value").join(e.select("event_id", "event_type"), "event_id")


# --- statistics ------------------------------------------------------------------------------------------------------
@query("st3_t_p_values", f"select assay, plate, round(m / se, 6) t, n, round({sql_t_two_sided('(m / se)', '(n - 1)')}, 6) + 0.0 p from {_LS}")
def st3(spark, d):
    got = ls_means(spark, d).withColumn("t", F.col("m") / F.col("se"))
    return got.select("assay", "plate", F.round("t", 6).alias("t"), "n", F.round(t_p_value("t", (F.col("n") - 1).cast("double")), 6).alias("p"))


@query("st4_normal_p_values", f"select assay, plate, round(z, 5) z, round({sql_normal_two_sided('z')}, 6) p from {_T}")
def st4(spark, d):
    return effects(spark, d).select("assay", "plate", F.round("z", 5).alias("z"), F.round(z_p_value("z"), 6).alias("p"))


@query("st13_design_columns", K.sql("select usubjid, (sex = 'M')::int::double sex_m, (arm = 'Veltide-10_mg')::int::double high from (select usubjid, arg_min(sex, row_id) sex, regexp_replace(regexp_replace(arg_min(trt01a, row_id), '\\s+([0-9])', '-\\1', 'g'), '\\s+', '_', 'g') arm from adsl where deleted_at is null group by 1) where sex is not null and arm is not null"))
def st13(spark, d):
    s = subjects(spark, d).where("sex is not null and trt01a is not null").withColumn("arm", arm_name(F.col("trt01a")))
    return s.select("usubjid", (F.col("sex") == "M").cast("int").cast("double").alias("sex_m"), (F.col("arm") == "Veltide-10_mg").cast("int").cast("double").alias("high"))


@query("st40_signature_correlations", f"with e as (select assay, plate, e from {_T}), s as (select assay, avg(e * e) sig from e group by 1), r as (select plate, rank() over (partition by plate order by e) + (count(*) over (partition by plate, e) - 1) / 2.0 re, rank() over (partition by plate order by sig) + (count(*) over (partition by plate, sig) - 1) / 2.0 rs from e join s using (assay)) select plate, round(corr(re, rs), 5) rho, count(*) n from r group by 1")
def st40(spark, d):
    e = effects(spark, d).select("assay", "plate", "e")
    sig = e.groupBy("assay").agg(F.avg(F.col("e") * F.col("e")).alias("sig"))
    return S.correlations(e.join(sig, "assay"), "e", "sig", ["plate"]).select("plate", F.round("spearman", 5).alias("rho"), "n")


def _panels(spark, d):
    return table(spark, d, "olink_long").select(F.col("olinkid").alias("assay"), "panel", F.col("assay").alias("gene")).distinct()


# --- domain compositions ---------------------------------------------------------------------------------------------
@query("d4_clinical_merge", K.sql("select m.row_id, m.usubjid, a.sex, a.arm from manifest m left join (select usubjid, arg_min(sex, row_id) filter (sex is not null) sex, min(trt01a) arm from adsl group by 1) a on m.usubjid = a.usubjid where m.sampletype = 'SAMPLE'"))
def d4(spark, d):
    a = K.table(spark, d, "adsl").groupBy("usubjid").agg(F.min_by("sex", F.when(F.col("sex").isNotNull(), F.col("row_id"))).alias("sex"), F.min("trt01a").alias("arm"))
    return R.checked_join(K.table(spark, d, "manifest").where("sampletype = 'SAMPLE'").select("row_id", "usubjid"), a, ["usubjid"], "left", "m:1")


@query("d11_assay_flag_list", "select distinct seqid from soma_long group by 1, plateid having count(*) filter (rowcheck = 'FLAG') > 0.07 * count(*)")
def d11(spark, d):
    s = table(spark, d, "soma_long").groupBy("seqid", "plateid").agg(F.count_if(F.col("rowcheck") == "FLAG").alias("f"), F.count("*").alias("n"))
    return s.where("f > 0.07 * n").select("seqid").distinct()


@query("d24_list_matching_first_wins", "with a as (select distinct olinkid, upper(assay) gene, uniprot from olink_long), l as (select olinkid, row_number() over (order by uniprot, olinkid) pos, uniprot from a), e as (select pos, unnest([uniprot, lead]) u from (select pos, uniprot, lead(uniprot) over (order by pos) lead from l)), m as (select olinkid, pos, row_number() over (partition by olinkid order by pos) r from a join e on e.u = a.uniprot) select olinkid, pos entry from m where r = 1")
def d24(spark, d):
    """A protein list whose entries name one or two accessions, matched to assays by any of them; the first entry wins."""
    a = table(spark, d, "olink_long").select("olinkid", "uniprot").distinct()  # the assays of a platform
    order = W.orderBy("uniprot", "olinkid")
    listed = a.select(F.row_number().over(order).cast("bigint").alias("pos"), F.concat_ws("|", "uniprot", F.lead("uniprot").over(order)).alias("accessions"))
    tokens = R.tokens(listed, "pos", F.col("accessions"), r"\|").withColumnRenamed("token", "uniprot")
    return R.keep_first(a.join(tokens, "uniprot"), ["olinkid"], [F.col("pos")]).select("olinkid", F.col("pos").alias("entry"))


@query("d25_feature_matrix")
def d25(spark, d):
    """Feature arrays per sample: repeats averaged, assays missing in over a tenth of the samples left out, gaps imputed."""
    v = assay_samples(olink(spark, d)).withColumn("platform", F.lit("olink"))

    def fit(pdf):
        x = matrix(pdf)
        return pd.DataFrame({"sample": pdf["sample"], "features": list(M.knn_impute(x[:, np.isnan(x).mean(axis=0) <= 0.1]))})

    return M.per_group(matrix_rows(v, ["platform"], ["sample"]), ["platform"], ["sample"], fit, "sample string, features array<double>")


@query("d28_first_visit_window", K.sql("select usubjid, strftime(min(adt) filter (visitnum = 2), '%Y-%m-%d') baseline, count(*) filter (adt >= first_dose) after_dose from manifest join (select usubjid, min(trtsdt) first_dose from adsl group by 1) using (usubjid) where adt is not null group by 1"))
def d28(spark, d):
    a = K.table(spark, d, "adsl").groupBy("usubjid").agg(F.min("trtsdt").alias("first_dose"))
    m = K.table(spark, d, "manifest").where("adt is not null").join(a, "usubjid")
    return m.groupBy("usubjid").agg(F.date_format(F.min(F.when(F.col("visitnum") == 2, F.col("adt"))), "yyyy-MM-dd").alias("baseline"), F.count_if(F.col("adt") >= F.col("first_dose")).alias("after_dose"))


@query("d41_evaluation_against_truth", "with e as (select row_id, visitnum = 8 flagged, visitnum_planned = 8 truth from manifest where visitnum is not null and not isnan(visitnum) and visitnum_planned is not null and not isnan(visitnum_planned)) select count(*) filter (flagged and truth) tp, count(*) filter (flagged and not truth) fp, count(*) filter (not flagged and truth) fn, round(count(*) filter (flagged and truth) / count(*) filter (flagged)::double, 6) as \"precision\" from e")
def d41(spark, d):
    m = nan_to_null(table(spark, d, "manifest")).where("visitnum is not null and visitnum_planned is not null")
    f, t = F.col("visitnum") == 8, F.col("visitnum_planned") == 8
    got = m.agg(F.count_if(f & t).alias("tp"), F.count_if(f & ~t).alias("fp"), F.count_if(~f & t).alias("fn"))
    return got.withColumn("precision", F.round(F.col("tp") / (F.col("tp") + F.col("fp")), 6))


@query("d47_catalogs_with_rank", "select protein, variant, rank, src from (select l_suppkey protein, l_partkey variant, 1 rank, 'air' src from lineitem where l_returnflag = 'A' and l_linestatus = 'F' union select l_suppkey, l_partkey, 2, 'rail' from lineitem where l_returnflag = 'R' and l_linestatus = 'F')")
def d47(spark, d):
    li = table(spark, d, "lineitem").where("l_linestatus = 'F'")
    one = lambda f, r, s: li.where(F.col("l_returnflag") == f).select(F.col("l_suppkey").alias("protein"), F.col("l_partkey").alias("variant"), F.lit(r).alias("rank"), F.lit(s).alias("src"))
    return R.union_relaxed([one("A", 1, "air"), one("R", 2, "rail")]).distinct()


@query("d59_interaction_direction", f"""with c as (select assay, visit, sex, arm <> 'Placebo' treated, x from (select assay, sex, arm, 8 visit, c8 x from {_CHANGES} union all select assay, sex, arm, 20, c20 from {_CHANGES}) where x is not null and sex in ('F', 'M')),
  g as (select assay, visit, sex, treated, avg(x) m, var_samp(x) / count(*) v, count(*) n from c group by all), s as (select a.assay, a.visit, a.sex, a.m - b.m e, a.v + b.v v, a.n + b.n - 2 n from g a join g b on a.assay = b.assay and a.visit = b.visit and a.sex = b.sex and a.treated and not b.treated),
  i as (select f.assay, f.visit, f.e f, m.e m, (f.e - m.e) / sqrt(f.v + m.v) t, f.n + m.n - 2 df from s f join s m on f.assay = m.assay and f.visit = m.visit and f.sex = 'F' and m.sex = 'M' where f.v + m.v > 0)
  select assay, visit, round(f, 9) + 0.0 e_f, round(m, 9) + 0.0 e_m, round({sql_t_two_sided('t', 'df')}, 6) p_int, case when sign(f) <> sign(m) and f <> 0 and m <> 0 then 'opposite_sign' when abs(f) > abs(m) then 'larger_in_F' when abs(f) < abs(m) then 'smaller_in_F' else 'equal' end direction from i""")
def d59(spark, d):
    """Treated-minus-placebo change in each sex, the P of their difference, and its direction."""
    ch = changes(spark, d).where("sex in ('F', 'M')")
    c = ch.select("assay", "sex", (F.col("arm") != "Placebo").alias("treated"), F.explode(F.array(*[F.struct(F.lit(v).alias("visit"), F.col(f"c{v}").alias("x")) for v in (8, 20)])).alias("z")).select("assay", "sex", "treated", "z.*").where("x is not null")
    g = c.groupBy("assay", "visit", "sex").agg(*[a for n, t in (("t", True), ("p", False)) for own in [F.when(F.col("treated") == t, F.col("x"))] for a in (F.avg(own).alias(f"m_{n}"), (F.var_samp(own) / F.count(own)).alias(f"v_{n}"), F.count(own).alias(f"n_{n}"))])
    s = g.select("assay", "visit", "sex", (F.col("m_t") - F.col("m_p")).alias("e"), (F.col("v_t") + F.col("v_p")).alias("v"), (F.col("n_t") + F.col("n_p") - 2).alias("n")).where("e is not null")
    side = lambda k: s.where(F.col("sex") == k).select("assay", "visit", *[F.col(n).alias(f"{n}_{k.lower()}") for n in "evn"])
    i = side("F").join(side("M"), ["assay", "visit"]).where("v_f + v_m > 0").withColumns({"t": (F.col("e_f") - F.col("e_m")) / F.sqrt(F.col("v_f") + F.col("v_m")), "df": F.col("n_f") + F.col("n_m") - 2})
    return i.select("assay", "visit", F.round("e_f", 9).alias("e_f"), F.round("e_m", 9).alias("e_m"), F.round(t_p_value("t", F.col("df").cast("double")), 6).alias("p_int"), O.interaction_direction(F.col("e_f"), F.col("e_m")).alias("direction"))


@query("d63_theme_filter", f"with {_CLASSIFIED}, s as (select distinct assay from b2 where fl < 0.3), p as (select distinct olinkid assay, panel, assay gene from olink_long) select panel, gene from p where assay in (select assay from s) and panel in (select panel from p join s using (assay) group by 1 having count(*) >= 2)")
def d63(spark, d):
    """Panels as themes: those with two or more genes of a significant late change, and these genes."""
    s = arm_courses(spark, d).where("fl < 0.3").select("assay").distinct()
    p = _panels(spark, d).join(s, "assay", "left_semi")
    themes = p.groupBy("panel").agg(F.count("*").alias("n")).where("n >= 2").select("panel")
    return p.join(themes, "panel", "left_semi").select("panel", "gene")


@query("d67_corrected_terms", "with p as (select distinct panel term, assay gene from olink_long), f as (select term, min(gene) lo, max(gene) hi from p group by 1) select term, case when gene = lo then gene || 'X' else gene end gene from p join f using (term) where gene <> hi or lo = hi")
def d67(spark, d):
    """Panels as gene sets, each with one member renamed and one dropped by a correction."""
    from tallygrove.sources.files import corrected_gene_sets

    p = _panels(spark, d).select(F.lit("panels").alias("library"), F.col("panel").alias("term"), "gene", F.lit(0).alias("pos"))
    ends = p.groupBy("library", "term").agg(F.min("gene").alias("lo"), F.max("gene").alias("hi"))
    fix = ends.select("library", "term", F.col("lo").alias("from_symbol"), F.concat("lo", F.lit("X")).alias("to_symbol")).unionByName(ends.where("lo <> hi").select("library", "term", F.col("hi").alias("from_symbol"), F.lit(None).cast("string").alias("to_symbol")))
    return corrected_gene_sets(p, fix).select("term", "gene")


@query("d68_lead_filter", f"with {_CLASSIFIED}, p as (select distinct olinkid assay, panel, assay gene from olink_long), l as (select panel, string_agg(gene, ';' order by gene) lead from p group by 1), x as (select panel, unnest(string_split(lead, ';')) gene from l), s as (select distinct gene from p join b2 using (assay) where fl < 0.3) select panel, string_agg(gene, ';' order by gene) lead, count(*) n from x where gene in (select gene from s) group by 1")
def d68(spark, d):
    """Lead genes of each set, given as one joined text, reduced to those with a significant late change."""
    p = _panels(spark, d)
    lists = p.groupBy("panel").agg(F.array_join(F.array_sort(F.collect_set("gene")), ";").alias("lead"))
    sig = arm_courses(spark, d).where("fl < 0.3").select("assay").distinct().join(p, "assay").select("gene").distinct()
    kept = O.expand_genes(lists, "lead", ";").join(sig, "gene", "left_semi")
    return kept.groupBy("panel").agg(F.array_join(F.array_sort(F.collect_set("gene")), ";").alias("lead"), F.count_distinct("gene").alias("n"))


@query("d69_signatures", f"with m as (select distinct olinkid assay, assay gene, uniprot from olink_long), e as (select arm disease, gene symbol, avg(c20) lfc from {_CHANGES} join m using (assay) where c20 is not null group by 1, 2), k as (select assay, uniprot, gene from m), h as (select symbol, uniprot from (select gene symbol, uniprot from m)) select disease, k.assay, round(avg(lfc), 6) + 0.0 lfc, count(*) n from e join h using (symbol) join k using (uniprot) group by 1, 2")
def d69(spark, d):
    """Signatures: each arm's mean late change per symbol, led to assays by accession and averaged per assay."""
    m = table(spark, d, "olink_long").select(F.col("olinkid").alias("assay"), F.col("assay").alias("symbol"), "uniprot").distinct()
    de = changes(spark, d).where("c20 is not null").join(m.select("assay", "symbol"), "assay").groupBy(F.col("arm").alias("disease"), "symbol").agg(F.avg("c20").alias("lfc"))
    led = de.join(m.select("symbol", "uniprot").distinct(), "symbol").join(m.select("uniprot", "assay").distinct(), "uniprot")
    return led.groupBy("disease", "assay").agg(F.round(F.avg("lfc"), 6).alias("lfc"), F.count("*").alias("n"))


@query("d81_cell_counts", K.sql("select trt01a arm, sex, count(distinct m.usubjid) subjects, count(*) samples, count(distinct m.usubjid) >= 10 enough from manifest m join (select usubjid, min(trt01a) trt01a, min(sex) sex from adsl group by 1) a on m.usubjid = a.usubjid where trt01a is not null and sex is not null group by 1, 2"))
def d81(spark, d):
    a = K.table(spark, d, "adsl").groupBy("usubjid").agg(F.min("trt01a").alias("arm"), F.min("sex").alias("sex")).where("arm is not null and sex is not null")
    j = K.table(spark, d, "manifest").select("usubjid").join(a, "usubjid")
    return j.groupBy("arm", "sex").agg(F.count_distinct("usubjid").alias("subjects"), F.count("*").alias("samples")).withColumn("enough", F.col("subjects") >= 10)


@query("d100_exclusion_tokens", f"""with k as {_CAT}, c as (select *, least(a1, a2) || '/' || greatest(a1, a2) alleles, case when a1 <= a2 then beta else -beta end b from k where nlp >= 0.5 and translate(a1, 'ACGT', 'TGCA') <> a2),
  v as (select x.catalog, x.protein, x.variant, count(distinct y.catalog) filter (sign(x.b) = sign(y.b)) n_same, count(distinct y.catalog) filter (sign(x.b) <> sign(y.b)) n_opposite from c x join c y on x.protein = y.protein and x.variant = y.variant and x.alleles = y.alleles and x.catalog <> y.catalog group by 1, 2, 3),
  o as (select distinct catalog, protein from v where n_opposite >= 2 and n_opposite > n_same + 1) select catalog, count(*) n, count(distinct protein) proteins from k where (catalog, protein) not in (select (catalog, protein) from o) group by 1""")
def d100(spark, d):
    """Catalog rows left after the proteins of every catalog's sign-discordant rows are dropped from that catalog."""
    from tallygrove.operators.genetics import sign_discordant
    from tallygrove.plans.domain_linkage import catalog

    c = catalog(spark, d)
    out = sign_discordant(c, ["protein", "variant"], "catalog", "catalog", "a1", "a2", "beta", "nlp", 0.5, 2).select("catalog", "protein").distinct()
    return c.join(out, ["catalog", "protein"], "left_anti").groupBy("catalog").agg(F.count("*").alias("n"), F.count_distinct("protein").alias("proteins"))


@query("d105_named_donor", f"with {_PAIRS} select a, arg_max(b, (k, b)) donor, max(k) k from pairs group by 1 having max(k) >= 0.2")
def d105(spark, d):
    """The closest relative of every participant, whichever side of a pair they stand on."""
    return kin_pairs(spark, d).groupBy("a").agg(F.max_by("b", F.struct("k", "b")).alias("donor"), F.max("k").alias("k")).where("k >= 0.2")


@query("d108_genotyped_subjects", K.sql("select distinct g.geno_usubjid from genomes g join manifest m on m.usubjid = g.geno_usubjid where g.call_rate >= 0.97"))
def d108(spark, d):
    m = K.table(spark, d, "manifest").select(F.col("usubjid").alias("geno_usubjid"))
    return K.table(spark, d, "genomes").where("call_rate >= 0.97").join(m, "geno_usubjid", "left_semi").select("geno_usubjid").distinct()


@query("d110_expression_frame", f"select s.row_id, s.assay, round(s.v, 6) v, a.target from {SOMA_SQL} s join (select seqid, min(target) target from soma_long group by 1) a on s.assay = a.seqid where s.sampletype = 'SAMPLE' and s.assay in (select seqid from soma_long group by 1 having avg(case when rowcheck = 'FLAG' then 1.0 else 0.0 end) <= 0.06)")
def d110(spark, d):
    raw = table(spark, d, "soma_long")
    good = raw.groupBy(F.col("seqid").alias("assay")).agg(F.min("target").alias("target"), F.avg(F.coalesce(F.col("rowcheck") == "FLAG", F.lit(False)).cast("double")).alias("bad")).where("bad <= 0.06")
    return soma(spark, d).where("sampletype = 'SAMPLE'").join(good, "assay").select("row_id", "assay", F.round("v", 6).alias("v"), "target")


@query("d112_fit_as_columns")
def d112(spark, d):
    """A mixture fit of pair correlations kept beside every pair, and the class of each pair."""
    from tallygrove.plans.domain_models import st9

    fit = st9(spark, d).select("assay", "mean_low", "mean_high", "cut")
    v = assay_samples(olink(spark, d))
    return R.checked_join(v, fit, ["assay"]).withColumn("upper", F.col("v") >= F.col("cut"))


@query("d114_library_summary", f"with {_CLASSIFIED}, p as (select distinct olinkid assay, panel from olink_long), s as (select distinct assay, fl < 0.3 hit from b2 where fl is not null) select panel library, count(distinct assay) members, count(distinct assay) filter (hit) significant from p left join s using (assay) group by 1")
def d114(spark, d):
    hits = arm_courses(spark, d).where("fl is not null").groupBy("assay").agg(F.bool_or(F.col("fl") < 0.3).alias("hit"))
    return _panels(spark, d).join(hits, "assay", "left").groupBy(F.col("panel").alias("library")).agg(F.count_distinct("assay").alias("members"), F.count_if("hit").alias("significant"))


@query("d115_complete_baseline", f"with y as (select assay, sample, avg(v) v from {OLINK_SQL} where sampletype = 'SAMPLE' and sample is not null group by 1, 2), m as (select sample from y group by 1 having count(*) = (select count(distinct assay) from y)), z as (select assay, sample, (v - avg(v) over (partition by assay)) / nullif(stddev_samp(v) over (partition by assay), 0) z from y join m using (sample)) select assay, sample, round(z, 5) z from z where z is not null")
def d115_complete(spark, d):
    """Samples with every analyte, each analyte standardised over them."""
    y = assay_samples(olink(spark, d))
    panel = y.agg(F.count_distinct("assay").alias("all"))
    full = y.groupBy("sample").agg(F.count("*").alias("n")).crossJoin(F.broadcast(panel)).where("n = all").select("sample")  # one row
    return S.standardise(y.join(full, "sample", "left_semi"), "v", ["assay"]).where("z is not null").select("assay", "sample", F.round("z", 5).alias("z"))


@query("d115_assay_level_z", f"select plate, round((avg(z) - any_value(mz)) / any_value(sz), 5) z from (select plate, z, avg(z) over () mz, stddev_samp(z) over () sz from {_T}) group by 1 having any_value(sz) > 0")
def d115(spark, d):
    e = effects(spark, d)
    base = e.agg(F.avg("z").alias("mz"), F.stddev_samp("z").alias("sz"))
    return e.groupBy("plate").agg(F.avg("z").alias("a")).crossJoin(F.broadcast(base)).where("sz > 0").select("plate", F.round((F.col("a") - F.col("mz")) / F.col("sz"), 5).alias("z"))


@query("d118_ls_mean_errors_attached", f"select e.assay, e.plate, round(e.e, 6) + 0.0 e, round(l.se, 6) se, l.n from {_T} e join {_LS} l using (assay, plate)")
def d118(spark, d):
    e = effects(spark, d).select("assay", "plate", F.round("e", 6).alias("e"))
    return R.checked_join(e, ls_means(spark, d).select("assay", "plate", F.round("se", 6).alias("se"), "n"), ["assay", "plate"], "inner", "1:1")


@query("d119_cell_counts_by_arm_sex", K.sql("select platform, visitnum, count(distinct group_key) filter (trt01a = 'Placebo') control, count(distinct group_key) filter (trt01a <> 'Placebo') treated from model_frame where group_key is not null group by 1, 2"))
def d119(spark, d):
    m = K.table(spark, d, "model_frame").where("group_key is not null")
    return m.groupBy("platform", "visitnum").agg(F.count_distinct(F.when(F.col("trt01a") == "Placebo", F.col("group_key"))).alias("control"), F.count_distinct(F.when(F.col("trt01a") != "Placebo", F.col("group_key"))).alias("treated"))


@query("d129_gene_clusters", """with recursive r as (select p_brand b, p_partkey::bigint k, unnest(string_split(p_name, ' ')) g from part), e as (select distinct b, k, g from r),
  w(b, k, m) as (select b, k, k from e union select x.b, y.k, w.m from w join e x on x.b = w.b and x.k = w.k join e y on y.b = x.b and y.g = x.g) select b p_brand, k p_partkey, min(m) "cluster" from w group by 1, 2""")
def d129(spark, d):
    """Labels of a theme (parts of a brand) with overlapping gene lists (words) as clusters."""
    p = table(spark, d, "part").select("p_brand", F.col("p_partkey").cast("bigint").alias("p_partkey"), F.explode(F.split("p_name", " ")).alias("gene"))
    return O.overlap_clusters(p, "p_brand", "p_partkey", "gene")


@query("d130_key_complete_lookup", "select n_name, r_name from nation join region on n_regionkey = r_regionkey")
def d130(spark, d):
    r = table(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    return R.complete_lookup(table(spark, d, "nation").select("n_name", "n_regionkey"), r, ["n_regionkey"], ["r_name"]).select("n_name", "r_name")


@query("d136_trajectory_lines", f"select assay, plate, round(m, 6) m, round(m - 1.959963984540054 * se, 6) low, round(m + 1.959963984540054 * se, 6) high, row_number() over (partition by assay order by plate) step from {_LS}")
def d136(spark, d):
    z = 1.959963984540054
    return ls_means(spark, d).select("assay", "plate", F.round("m", 6).alias("m"), F.round(F.col("m") - z * F.col("se"), 6).alias("low"), F.round(F.col("m") + z * F.col("se"), 6).alias("high"), F.row_number().over(W.partitionBy("assay").orderBy("plate")).alias("step"))


@query("d137_rank_correlation_p", f"{_RHO}, z as (select *, 0.5 * ln((1 + spearman) / (1 - spearman)) * sqrt(n - 3) z from c where n >= 10 and abs(spearman) < 1) select x_assay, y_assay, n, round(spearman, 6) spearman, round(case when abs(z) < 2 then -log10({sql_normal_two_sided('z')}) else {sql_normal_nlp('z')} end, 5) + 0.0 nlp from z")
def d137(spark, d):
    """Large-sample P of a rank correlation by Fisher's z, in log space."""
    c = S.correlations(pair_frame(spark, d), "x", "y", ["x_assay", "y_assay"], least=10).where("n > 3 and abs(spearman) < 1")
    return c.select("x_assay", "y_assay", "n", F.round("spearman", 6).alias("spearman"), F.round(nlp_value(F.atanh("spearman"), 1 / F.sqrt(F.col("n") - 3)), 5).alias("nlp"))


QUERIES, ORACLES = REG.queries, REG.oracles
