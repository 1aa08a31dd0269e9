"""Queries of effect, class, enrichment, annotation and report operators."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallygrove.functions.dist import t_p_value
from tallygrove.functions.text import term_label
from tallygrove.operators import relational as R
from tallygrove.operators import results as O
from tallygrove.operators import stats as S
from tallygrove.plans import keys as K
from tallygrove.plans.registry import Registry
from tallygrove.plans.sqldist import sql_t_two_sided
from tallygrove.plans.statistics import OLINK_SQL, olink, r6
from tallygrove.sources.tables import nan_to_null, table

REG = Registry()
query = REG.add

_M = K.sql("(select platform, group_key g, visitnum v, avg(y_value) y from model_frame where group_key is not null and y_value is not null and not isnan(y_value) group by 1, 2, 3)")


def means(spark, d):
    m = K.table(spark, d, "model_frame").where("group_key is not null and y_value is not null and not isnan(y_value)")
    return m.groupBy("platform", F.col("group_key").alias("g"), F.col("visitnum").alias("v")).agg(F.avg("y_value").alias("y"))


@query("d54_change_from_baseline", f"select a.platform, a.g, a.v, round(a.y - b.y, 6) + 0.0 as \"change\", round(100 * (a.y - b.y) / b.y, 4) + 0.0 pct_change from {_M} a join {_M} b on a.platform = b.platform and a.g = b.g and b.v = 2 where a.v <> 2 and b.y <> 0")
def d54(spark, d):
    c = O.change_from_baseline(means(spark, d), ["platform", "g"], "v", "y", 2).where("baseline <> 0")
    return c.select("platform", "g", "v", F.round("change", 6).alias("change"), F.round("pct_change", 4).alias("pct_change"))


@query("d55_weight_change_wide", K.sql("with w as (select usubjid, max(case when visitnum = 2 then aval end) b, max(case when visitnum = 8 then aval end) w8, max(case when visitnum = 20 then aval end) w20 from visit_records where paramcd = 'WEIGHT' and aval is not null and not isnan(aval) and usubjid is not null group by 1) select usubjid, round(100 * (w8 - b) / b, 4) + 0.0 pct8, round(100 * (w20 - b) / b, 4) + 0.0 pct20, round(coalesce(100 * (w20 - b) / b, 100 * (w8 - b) / b), 4) + 0.0 latest from w where b > 0"))
def d55(spark, d):
    v = nan_to_null(K.table(spark, d, "visit_records")).where("paramcd = 'WEIGHT' and aval is not null and usubjid is not null")
    at = lambda n: F.max(F.when(F.col("visitnum") == n, F.col("aval")))
    w = v.groupBy("usubjid").agg(at(2).alias("b"), at(8).alias("w8"), at(20).alias("w20")).where("b > 0")
    pct = lambda c: 100 * (F.col(c) - F.col("b")) / F.col("b")
    return w.select("usubjid", F.round(pct("w8"), 4).alias("pct8"), F.round(pct("w20"), 4).alias("pct20"), F.round(F.coalesce(pct("w20"), pct("w8")), 4).alias("latest"))


_LS = f"(select assay, plate, avg(v) m, stddev_samp(v) / sqrt(count(*)) se, count(*) n from {OLINK_SQL} where sampletype = 'SAMPLE' group by 1, 2 having count(*) >= 5 and stddev_samp(v) > 0)"


def ls_means(spark, d):
    s = olink(spark, d).where("sampletype = 'SAMPLE'").groupBy("assay", "plate").agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("sd"), F.count("*").alias("n")).where("n >= 5 and sd > 0")
    return s.select("assay", "plate", "m", (F.col("sd") / F.sqrt("n")).alias("se"), "n")


@query("d56_percent_transform", f"with c as (select a.assay, a.plate, a.m - b.m e, a.se from {_LS} a join (select assay, avg(m) m from {_LS} group by 1) b using (assay)) select assay, plate, round((pow(2, e) - 1) * 100, 4) + 0.0 pct, round(pow(2, e) * 0.6931471805599453 * se * 100, 4) pct_se, round((pow(2, e - 1.959963984540054 * se) - 1) * 100, 4) + 0.0 pct_low, round((pow(2, e + 1.959963984540054 * se) - 1) * 100, 4) + 0.0 pct_high from c")
def d56(spark, d):
    l = ls_means(spark, d)
    c = l.withColumn("e", F.col("m") - F.avg("m").over(W.partitionBy("assay")))
    return c.select("assay", "plate", *[F.round(x, 4).alias(k) for k, x in O.log2_percent(F.col("e"), F.col("se")).items()])


@query("d57_fold_change", f"select a.assay, a.plate p1, b.plate p2, round(pow(2, a.m - b.m), 5) fc, round(pow(2, a.m - b.m) * 0.6931471805599453 * sqrt(a.se ** 2 + b.se ** 2), 5) se_fc from {_LS} a join (select assay, plate, m, se from (select *, row_number() over (partition by assay order by plate) r from {_LS}) where r = 1) b on a.assay = b.assay and a.plate > b.plate")
def d57(spark, d):
    l = ls_means(spark, d)
    first = R.keep_first(l, ["assay"], [F.col("plate")]).select("assay", F.col("plate").alias("p2"), F.col("m").alias("mb"), F.col("se").alias("sb"))
    fc, se = O.fold_change(F.col("m"), F.col("se"), F.col("mb"), F.col("sb"))
    return l.join(first, "assay").where("plate > p2").select("assay", F.col("plate").alias("p1"), "p2", F.round(fc, 5).alias("fc"), F.round(se, 5).alias("se_fc"))


_T = f"(select a.assay, a.plate, a.m - b.m e, (a.m - b.m) / sqrt(a.se ** 2 + b.se ** 2) z from {_LS} a join (select assay, avg(m) m, sqrt(avg(se ** 2)) se from {_LS} group by 1) b using (assay))"


def effects(spark, d):
    l = ls_means(spark, d)
    w = W.partitionBy("assay")
    b = l.withColumns({"mb": F.avg("m").over(w), "sb": F.sqrt(F.avg(F.col("se") ** 2).over(w))})
    return b.select("assay", "plate", "n", (F.col("m") - F.col("mb")).alias("e"), ((F.col("m") - F.col("mb")) / F.sqrt(F.col("se") ** 2 + F.col("sb") ** 2)).alias("z"))


#: Changes of each analyte from baseline (visit 2) at visits 8 and 20: tube -> participant and visit by its first manifest row.
_CHANGES = K.sql(f"""(with t as (select sampleid sample, arg_min(usubjid, row_id) who, arg_min(visitnum, row_id) visit from manifest where sampleid is not null and usubjid is not null and visitnum in (2, 8, 20) group by 1),
  v as (select assay, sample, avg(v) v from {OLINK_SQL} where sampletype = 'SAMPLE' and sample is not null group by 1, 2), y as (select assay, who, visit, avg(v) y from v join t using (sample) group by 1, 2, 3),
  w as (select assay, who, max(y) filter (visit = 8) - max(y) filter (visit = 2) c8, max(y) filter (visit = 20) - max(y) filter (visit = 2) c20 from y group by 1, 2),
  s as (select usubjid who, arg_min(trt01a, row_id) arm, arg_min(sex, row_id) sex from adsl where deleted_at is null group by 1)
  select assay, who, arm, sex, c8, c20 from w join s using (who) where arm is not null and (c8 is not null or c20 is not null))""")
_MOMENTS = "avg({x}) e_{n}, stddev_samp({x}) / sqrt(count({x})) s_{n}, count({x}) - 1 d_{n}"


def changes(spark, d):
    m = K.table(spark, d, "manifest").where("sampleid is not null and usubjid is not null and visitnum in (2, 8, 20)")
    t = m.groupBy(F.col("sampleid").alias("sample")).agg(F.min_by("usubjid", "row_id").alias("who"), F.min_by("visitnum", "row_id").alias("visit"))
    v = olink(spark, d).where("sampletype = 'SAMPLE' and sample is not null").groupBy("assay", "sample").agg(F.avg("v").alias("v"))
    y = v.join(t, "sample").groupBy("assay", "who", "visit").agg(F.avg("v").alias("y"))
    at = lambda n: F.max(F.when(F.col("visit") == n, F.col("y")))
    w = y.groupBy("assay", "who").agg((at(8) - at(2)).alias("c8"), (at(20) - at(2)).alias("c20")).where("c8 is not null or c20 is not null")
    s = K.table(spark, d, "adsl").where("deleted_at is null").groupBy(F.col("usubjid").alias("who")).agg(F.min_by("trt01a", "row_id").alias("arm"), F.min_by("sex", "row_id").alias("sex"))
    return w.join(s.where("arm is not null"), "who").select("assay", "who", "arm", "sex", "c8", "c20")


def moments(x, n):
    return [F.avg(x).alias(f"e_{n}"), (F.stddev_samp(x) / F.sqrt(F.count(x))).alias(f"s_{n}"), (F.count(x) - 1).alias(f"d_{n}")]


def _fdr_sql(frame, p, by):
    """FDR within groups, from a CTE with a P column: the step-up as window functions."""
    n = f"count({p}) over (partition by {by})"
    i = f"count({p}) over (partition by {by} order by {p} range between unbounded preceding and current row)"
    return f"(select *, least(1.0, min(q0) over (partition by {by} order by {p} desc nulls last range between unbounded preceding and current row)) fdr_{p} from (select *, {p} * {n} / {i} q0 from {frame}) where {p} is not null union all select *, null::double q0, null::double from {frame} where {p} is null)"


_ARMS = f"""(select assay, arm, {', '.join(_MOMENTS.format(x=x, n=n) for x, n in (('c8', 'e'), ('c20', 'l'), ('c20 - c8', 's')))} from {_CHANGES} group by 1, 2)"""
_P = lambda n: f"case when s_{n} > 0 and d_{n} > 0 then {sql_t_two_sided(f'(e_{n} / s_{n})', f'd_{n}')} end p_{n}"
_CLASSIFIED = f"""a as (select *, {_P('e')}, {_P('l')}, {_P('s')} from {_ARMS}), b1 as (select assay, arm, fdr_p_e fe from {_fdr_sql('a', 'p_e', 'arm')}), b2 as (select assay, arm, fdr_p_l fl from {_fdr_sql('a', 'p_l', 'arm')}), b3 as (select assay, arm, fdr_p_s fs from {_fdr_sql('a', 'p_s', 'arm')})"""


def arm_courses(spark, d):
    """Within-arm changes at both visits and their difference, with P and FDR over analytes within arm and window."""
    a = changes(spark, d).groupBy("assay", "arm").agg(*moments("c8", "e"), *moments("c20", "l"), *moments(F.col("c20") - F.col("c8"), "s"))
    # the three windows as rows, so that one pass makes all families
    rows = a.select("assay", "arm", F.explode(F.array(*[F.struct(F.lit(n).alias("w"), F.col(f"e_{n}").alias("e"), F.col(f"s_{n}").alias("se"), F.col(f"d_{n}").cast("double").alias("df")) for n in "els"])).alias("x")).select("assay", "arm", "x.*")
    ok = (F.col("se") > 0) & (F.col("df") > 0)
    rows = S.bh_fdr(rows.withColumn("p", F.when(ok, t_p_value(F.when(ok, F.col("e") / F.col("se")), F.col("df")))), "p", ["arm", "w"], "f")
    at = lambda n, c: F.max(F.when(F.col("w") == n, F.col(c)))
    return rows.groupBy("assay", "arm").agg(*[at(n, c).alias(k) for n in "els" for c, k in (("e", f"e_{n}"), ("se", f"s_{n}"), ("df", f"d_{n}"), ("p", f"p_{n}"), ("f", f"f{n}"))])


@query("d58_contrast_fdr_counts", f"with a as (select *, case when d_l > 0 and s_l > 0 then {sql_t_two_sided('(e_l / s_l)', 'd_l')} end p_l from {_ARMS}), f as {_fdr_sql('a', 'p_l', 'arm')} select arm, count(*) n, count(*) filter (fdr_p_l < 0.05) significant, count(*) filter (p_l < 0.05) nominal from f group by 1")
def d58(spark, d):
    """Significant late changes per arm after FDR within the arm's family."""
    return arm_courses(spark, d).groupBy("arm").agg(F.count("*").alias("n"), F.count_if(F.col("fl") < 0.05).alias("significant"), F.count_if(F.col("p_l") < 0.05).alias("nominal"))


@query("d60_trajectory_classes", f"""with {_CLASSIFIED}, c as (select a.*, coalesce(fe < 0.3, false) se, coalesce(fl < 0.3, false) sl, coalesce(fs < 0.3, false) ss from a join b1 using (assay, arm) join b2 using (assay, arm) join b3 using (assay, arm))
  select assay, arm, case when not se and not sl then 'Null' when not sl then 'Transient_' || case when e_e > 0 then 'up' else 'down' end when not se then 'LateOnset_' || case when e_l > 0 then 'up' else 'down' end
    when sign(e_e) <> sign(e_l) then 'Reversal_' || case when e_e > 0 then 'up_' else 'down_' end || case when e_l > 0 then 'up' else 'down' end
    when ss and sign(e_s) = sign(e_e) then 'Progressive_' || case when e_e > 0 then 'up' else 'down' end else 'Sustained_' || case when e_e > 0 then 'up' else 'down' end end class from c""")
def d60(spark, d):
    """The level of 0.3 fits these tables' small effects; the operator's default is 0.05."""
    c = arm_courses(spark, d)
    return c.select("assay", "arm", O.trajectory(F.col("e_e"), F.col("e_l"), F.col("e_s"), F.col("fe"), F.col("fl"), F.col("fs"), 0.3).alias("class"))


_MC = "(select l_orderkey o, l_linenumber n, l_discount a, l_tax b, abs(l_discount * 10 - l_tax * 12) c, l_quantity - 25 i, l_extendedprice - 35000 x from lineitem)"


@query("d61_mediation_classes", f"select case when b < 0.05 and c < 0.2 and sign(i) = sign(x) then 'partial' when b < 0.05 and c < 0.2 then 'opposing' when b < 0.05 then 'full' when c < 0.2 then 'direct' when a < 0.05 then 'total' else 'none' end as class, count(*) n from {_MC} group by 1".replace("c < 0.2", "c / 4 < 0.05"))
def d61(spark, d):
    li = table(spark, d, "lineitem")
    c = F.abs(F.col("l_discount") * 10 - F.col("l_tax") * 12) / 4
    cls = O.mediation_class(F.col("l_discount"), F.col("l_tax"), c, F.col("l_quantity") - 25, F.col("l_extendedprice") - 35000)
    return li.groupBy(cls.alias("class")).agg(F.count("*").alias("n"))


@query("d64_panel_top_per_gene", "with q as (select p_brand gene, p_partkey marker, greatest(abs(p_retailprice - 950), abs(p_size - 25)) top from part where p_size > 5), b as (select *, row_number() over (partition by gene order by top desc, marker) r from q) select gene, marker, round(top, 6) top from b where r = 1 order by top desc, gene limit 12")
def d64(spark, d):
    p = table(spark, d, "part").where("p_size > 5").select(F.col("p_brand").alias("gene"), F.col("p_partkey").alias("marker"), (F.col("p_retailprice") - 950).alias("a"), (F.col("p_size") - 25).cast("double").alias("b"))
    return r6(O.best_marker(p, "gene", "marker", ["a", "b"]).orderBy(F.desc("top"), "gene").limit(12), "top")


@query("d65_ranked_genes", "select upper(t.w) gene, round(avg(p_retailprice), 6) stat, count(distinct p_partkey) markers from part, unnest(string_split(p_name, ' ')) t(w) group by 1")
def d65(spark, d):
    g = O.expand_genes(table(spark, d, "part"), "p_name", " ")
    return g.groupBy(F.upper("gene").alias("gene")).agg(F.round(F.avg("p_retailprice"), 6).alias("stat"), F.count_distinct("p_partkey").alias("markers"))


@query("d66_source_groups_collapsed", """with g as (select distinct l_suppkey % 20 gene, l_partkey % 4 + (l_suppkey % 20) // 2 marker from lineitem), s as (select gene, string_agg(distinct marker::varchar, ',' order by marker::varchar) source_group from g group by 1),
  m as (select distinct p_brand term, p_size % 20 gene, p_size % 20 as pos from part), r as (select *, row_number() over (partition by term, source_group order by pos, gene) k from m join s using (gene)) select term, gene, source_group from r where k = 1""")  # fmt: skip
def d66(spark, d):
    li = table(spark, d, "lineitem").select((F.col("l_suppkey") % 20).alias("gene"), (F.col("l_partkey") % 4 + F.floor((F.col("l_suppkey") % 20) / 2)).cast("string").alias("marker")).distinct()
    groups = O.source_groups(li, "gene", "marker")
    members = table(spark, d, "part").select(F.col("p_brand").alias("term"), (F.col("p_size") % 20).cast("bigint").alias("gene"), (F.col("p_size") % 20).alias("pos")).distinct()
    return O.collapse_same_source(members, groups, "term", "gene", "pos").select("term", "gene", "source_group")


_AL = "(select p_name alias, p_brand symbol, (p_size % 3)::int priority from part union all select upper(p_brand), p_brand, 0 from part)"


def aliases(spark, d):
    p = table(spark, d, "part")
    return p.select(F.col("p_name").alias("alias"), F.col("p_brand").alias("symbol"), (F.col("p_size") % 3).cast("int").alias("priority")).unionByName(p.select(F.upper("p_brand").alias("alias"), F.col("p_brand").alias("symbol"), F.lit(0).alias("priority")))


@query("e1_alias_translation", f"with a as {_AL}, b as (select upper(alias) u, symbol from (select *, min(priority) over (partition by upper(alias)) lo from a) where priority = lo), o as (select u, min(symbol) t from b group by 1 having count(distinct symbol) = 1) select p_partkey, coalesce(t, p_name) translated from part left join o on upper(p_name) = u")
def e1(spark, d):
    return O.translate_symbols(table(spark, d, "part"), "p_name", aliases(spark, d)).select("p_partkey", "translated")


@query("e2_ortholog_mapping", "with o as (select distinct p_brand s, p_type t from part where p_size > 48), k as (select distinct upper(t) k from o), n as (select upper(s) k, min(t) x from o group by 1 having count(distinct t) = 1) select distinct m.s symbol, coalesce(k.k, n.x) mapped from (select p_brand s from part union select p_type from part) m left join k on upper(m.s) = k.k left join n on upper(m.s) = n.k where coalesce(k.k, n.x) is not null")
def e2(spark, d):
    p = table(spark, d, "part")
    o = p.where("p_size > 48").select(F.col("p_brand").alias("source_symbol"), F.col("p_type").alias("target_symbol")).distinct()
    m = p.select(F.col("p_brand").alias("symbol")).union(p.select("p_type")).distinct()
    return O.ortholog_map(m, "symbol", o).select("symbol", "mapped")


@query("e3_annotation_overlay", "with u as (select p_partkey k, 'updated' p_type from part where p_size = 7) select p_partkey, p_brand, coalesce(u.p_type, part.p_type) p_type from part left join u on p_partkey = k")
def e3(spark, d):
    p = table(spark, d, "part")
    return O.overlay(p.select("p_partkey", "p_brand", "p_type"), p.where("p_size = 7").select("p_partkey", F.lit("updated").alias("p_type")), ["p_partkey"], ["p_type"])


@query("e4_lift_over", "with c as (select s_suppkey % 3 chrom, s_suppkey * 500000 - 200000 \"start\", s_suppkey * 500000 + 150000 stop, s_suppkey % 3 + 100 new_chrom, s_suppkey * 11 shift from supplier) select p_partkey, coalesce(new_chrom, -1) new_chrom, coalesce(p_partkey * 30011 + shift, -1) new_pos from part left join c on p_partkey % 3 = chrom and p_partkey * 30011 >= \"start\" and p_partkey * 30011 < stop")
def e4(spark, d):
    k = F.col("s_suppkey")
    chain = table(spark, d, "supplier").select((k % 3).alias("chrom"), (k * 500000 - 200000).alias("start"), (k * 500000 + 150000).alias("stop"), (k % 3 + 100).alias("new_chrom"), (k * 11).alias("shift"))
    p = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 3).alias("c"), (F.col("p_partkey") * 30011).alias("pos"))
    return O.lift_over(p, "c", "pos", chain).select("p_partkey", "new_chrom", "new_pos").fillna(-1)


@query("e7_cell_type_summary", "select event_type cell_type, user_id % 50 gene, round(avg(ln(1 + value)), 6) mean_log, round(avg(case when value > 50 then 1.0 else 0.0 end), 6) expressing from events where value is not null group by 1, 2")
def e7(spark, d):
    e = table(spark, d, "events").where("value is not null")
    return e.groupBy(F.col("event_type").alias("cell_type"), (F.col("user_id") % 50).alias("gene")).agg(F.round(F.avg(F.log1p("value")), 6).alias("mean_log"), F.round(F.avg((F.col("value") > 50).cast("double")), 6).alias("expressing"))


@query("d71_annotation_tiers", "with q as (select l_partkey, max(l_extendedprice) top, arg_max(l_suppkey, (l_extendedprice, -l_suppkey)) lead from lineitem group by 1) select p_partkey, case when top > 80000 then 'strong' when top > 40000 then 'moderate' when top is not null then 'weak' else 'none' end tier, coalesce(lead, -1) lead from part left join q on p_partkey = l_partkey")
def d71(spark, d):
    q = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("l_extendedprice").alias("top"), F.max_by("l_suppkey", F.struct("l_extendedprice", -F.col("l_suppkey"))).alias("lead"))
    j = table(spark, d, "part").select("p_partkey").join(q, "p_partkey", "left")
    return j.select("p_partkey", F.when(F.col("top") > 80000, "strong").when(F.col("top") > 40000, "moderate").when(F.col("top").isNotNull(), "weak").otherwise("none").alias("tier"), F.coalesce("lead", F.lit(-1)).alias("lead"))


@query("d72_accession_map", "select coalesce(a.u, b.u) uniprot, coalesce(a.ids, '') soma_ids, coalesce(b.ids, '') olink_ids, a.u is not null on_soma, b.u is not null on_olink from (select uniprot u, string_agg(distinct seqid, '|' order by seqid) ids from soma_long group by 1) a full join (select uniprot u, string_agg(distinct olinkid, '|' order by olinkid) ids from olink_long group by 1) b on a.u = b.u")
def d72(spark, d):
    ids = lambda name, key, out: table(spark, d, name).groupBy("uniprot").agg(F.array_join(F.array_sort(F.collect_set(key)), "|").alias(out))
    both = R.full_coalesced(ids("soma_long", "seqid", "soma_ids"), ids("olink_long", "olinkid", "olink_ids"), ["uniprot"])
    return both.select("uniprot", F.coalesce("soma_ids", F.lit("")).alias("soma_ids"), F.coalesce("olink_ids", F.lit("")).alias("olink_ids"), F.col("soma_ids").isNotNull().alias("on_soma"), F.col("olink_ids").isNotNull().alias("on_olink"))


@query("d73_parallel_lists", "select p_partkey, a, b from (select p_partkey, unnest(string_split(p_name, ' ')) a, unnest(string_split(p_type, ' ')) b from part) where a is not null and b is not null")
def d73(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.explode(F.arrays_zip(F.split("p_name", " ").alias("a"), F.split("p_type", " ").alias("b"))).alias("z"))
    return p.select("p_partkey", "z.a", "z.b").where("a is not null and b is not null")


@query("d74_lab_pairing", K.sql("with l as (select usubjid, paramcd, avg(aval) lab from visit_records where aval > 0 and not isnan(aval) and usubjid is not null group by 1, 2), m as (select group_key usubjid, platform, avg(y_value) y from model_frame where y_value is not null and not isnan(y_value) group by 1, 2) select paramcd, platform, count(*) n, round(corr(ln(lab), y), 6) r from l join m using (usubjid) group by 1, 2"))
def d74(spark, d):
    l = K.table(spark, d, "visit_records").where("aval > 0 and not isnan(aval) and usubjid is not null").groupBy("usubjid", "paramcd").agg(F.avg("aval").alias("lab"))
    m = K.table(spark, d, "model_frame").where("y_value is not null and not isnan(y_value)").groupBy(F.col("group_key").alias("usubjid"), "platform").agg(F.avg("y_value").alias("y"))
    return r6(l.join(m, "usubjid").groupBy("paramcd", "platform").agg(F.count("*").alias("n"), S.safe_corr(F.log("lab"), F.col("y")).alias("r")), "r")


@query("d75_baseline_flag_records", K.sql("with v as (select usubjid, paramcd, arg_min(aval, (case when ablfl = 'Y' then 0 when visitnum = 2 then 1 else 2 end, row_id)) b, min(case when ablfl = 'Y' then 0 when visitnum = 2 then 1 else 2 end) k from visit_records where aval is not null and not isnan(aval) and usubjid is not null and (ablfl = 'Y' or visitnum = 2) group by 1, 2) select usubjid, paramcd, b baseline, case k when 0 then 'flag' else 'visit' end how from v"))
def d75(spark, d):
    v = nan_to_null(K.table(spark, d, "visit_records")).where("aval is not null and usubjid is not null and (ablfl = 'Y' or visitnum = 2)")
    k = F.when(F.col("ablfl") == "Y", 0).when(F.col("visitnum") == 2, 1).otherwise(2)
    g = v.withColumn("k", k).groupBy("usubjid", "paramcd").agg(F.min_by("aval", F.struct("k", "row_id")).alias("baseline"), F.min("k").alias("k"))
    return g.select("usubjid", "paramcd", "baseline", F.when(F.col("k") == 0, "flag").otherwise("visit").alias("how"))


@query("d76_cross_study_join", f"select a.assay, a.plate, round(a.z, 5) z1, round(b.z, 5) z2, sign(a.z) = sign(b.z) agree from {_T} a join (select assay, plate, z from (select *, row_number() over (partition by assay order by plate) r from {_T}) where r = 1) b on a.assay = b.assay and a.plate <> b.plate")
def d76(spark, d):
    e = effects(spark, d)
    first = R.keep_first(e, ["assay"], [F.col("plate")]).select("assay", F.col("plate").alias("pb"), F.col("z").alias("zb"))
    return e.join(first, "assay").where("plate <> pb").select("assay", "plate", F.round("z", 5).alias("z1"), F.round("zb", 5).alias("z2"), (F.signum("z") == F.signum("zb")).alias("agree"))


@query("d77_best_effect_row", f"select plate, arg_max(assay, (round(abs(z), 5), assay)) assay, round(max(abs(z)), 5) z from {_T} group by 1")
def d77(spark, d):
    return effects(spark, d).groupBy("plate").agg(F.max_by("assay", F.struct(F.round(F.abs("z"), 5), "assay")).alias("assay"), F.round(F.max(F.abs("z")), 5).alias("z"))


@query("d79_characteristics", K.sql("with a as (select usubjid, arg_min(coalesce(trt01a, 'none'), row_id) arm, arg_min(age, row_id) filter (age is not null) age, arg_min(sex, row_id) filter (sex is not null) sex from adsl group by 1) select coalesce(arm, 'all') arm, count(*) n, printf('%.2f', round(avg(age), 2)) || ' (' || coalesce(printf('%.2f', round(stddev_samp(age), 2)), '-') || ')' age, printf('%d (%.3f%%)', count(*) filter (sex = 'F'), round(100.0 * count(*) filter (sex = 'F') / count(*), 3)) women from a group by rollup (arm)"))
def d79(spark, d):
    from tallygrove.functions.text import count_share, mean_sd

    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("row_id")))
    a = K.table(spark, d, "adsl").groupBy("usubjid").agg(F.min_by(F.coalesce("trt01a", F.lit("none")), "row_id").alias("arm"), first("age").alias("age"), first("sex").alias("sex"))
    return a.rollup("arm").agg(F.count("*").alias("n"), mean_sd(F.avg("age"), F.stddev_samp("age"), 2).alias("age"), count_share(F.count_if(F.col("sex") == "F"), F.count("*"), 3).alias("women")).withColumn("arm", F.coalesce("arm", F.lit("all")))


@query("d107_first_draw", K.sql("select usubjid, min(adt)::date::varchar first_draw, round(min(age) + date_diff('day', min(trtsdt), min(adt)::date) / 365.25, 5) age_at_draw from manifest join (select usubjid, min(age) age, min(trtsdt) trtsdt from adsl group by 1) using (usubjid) where adt is not null and age is not null group by 1"))
def d107(spark, d):
    a = K.table(spark, d, "adsl").groupBy("usubjid").agg(F.min("age").alias("age"), F.min("trtsdt").alias("trtsdt")).where("age is not null")
    g = K.table(spark, d, "manifest").where("adt is not null").join(a, "usubjid").groupBy("usubjid").agg(F.min("adt").alias("f"), F.min("age").alias("age"), F.min("trtsdt").alias("trtsdt"))
    return g.select("usubjid", F.to_date("f").cast("string").alias("first_draw"), F.round(F.col("age") + F.datediff("f", "trtsdt") / 365.25, 5).alias("age_at_draw"))


@query("d109_marker_labels", "select seqid marker, string_agg(distinct target, '|' order by target) genes, min(target) || ' (' || seqid || ')' label from soma_long group by 1")
def d109(spark, d):
    s = table(spark, d, "soma_long").groupBy(F.col("seqid").alias("marker")).agg(F.array_join(F.array_sort(F.collect_set("target")), "|").alias("genes"), F.min("target").alias("t"))
    return s.select("marker", "genes", F.concat("t", F.lit(" ("), "marker", F.lit(")")).alias("label"))


@query("d111_one_plate_per_sample", K.sql("select sampleid, regexp_extract(min(plateid), '-0*([0-9]+)$', 1)::int plate_no, min(plateid) = max(plateid) one_plate from soma_long where sampletype = 'SAMPLE' and sampleid is not null group by 1"))
def d111(spark, d):
    s = K.table(spark, d, "soma_long").where("sampletype = 'SAMPLE' and sampleid is not null").groupBy("sampleid").agg(F.min("plateid").alias("lo"), F.max("plateid").alias("hi"))
    return s.select("sampleid", F.regexp_extract("lo", "-0*([0-9]+)$", 1).cast("int").alias("plate_no"), (F.col("lo") == F.col("hi")).alias("one_plate"))


@query("d124_term_labels", "select p_partkey, upper(left(replace(p_type, ' ', '_'), 1)) || lower(substr(replace(replace(p_type, ' ', '_'), '_', ' '), 2)) label from part where upper(p_type) = p_type")
def d124(spark, d):
    p = table(spark, d, "part").where("upper(p_type) = p_type")
    return p.select("p_partkey", term_label(F.concat(F.lit("REACTOME_"), F.translate("p_type", " ", "_"), F.lit(" (R-HSA-1)"))).alias("label"))


@query("d127_top_strengths", "select t cell_type, s strength from (select regexp_replace(p_type, ' [A-Z]+$', '') t, max(p_retailprice) s from part where p_size > 10 group by 1) order by s desc, t limit 10")
def d127(spark, d):
    p = table(spark, d, "part").where("p_size > 10").groupBy(F.regexp_replace("p_type", " [A-Z]+$", "").alias("cell_type")).agg(F.max("p_retailprice").alias("strength"))
    return p.orderBy(F.desc("strength"), "cell_type").limit(10)


@query("d128_lead_and_rest", "with b as (select p_brand, p_partkey, p_retailprice, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) r from part), k as (select *, row_number() over (order by p_retailprice desc, p_brand) q from b where r = 1) select p_brand, p_partkey, case when q <= 8 then 'lead' else 'rest' end part from k")
def d128(spark, d):
    best = R.keep_first(table(spark, d, "part").select("p_brand", "p_partkey", "p_retailprice"), ["p_brand"], [F.desc("p_retailprice"), F.col("p_partkey")])
    lead = best.orderBy(F.desc("p_retailprice"), "p_brand").limit(8).select("p_brand", F.lit("lead").alias("part"))
    return best.join(F.broadcast(lead), "p_brand", "left").select("p_brand", "p_partkey", F.coalesce("part", F.lit("rest")).alias("part"))


@query("d132_signed_buckets", f"select assay, plate, case when z > 2 then '++' when z > 1 then '+' when z < -2 then '--' when z < -1 then '-' else '0' end bucket from {_T}")
def d132(spark, d):
    z = F.col("z")
    return effects(spark, d).select("assay", "plate", F.when(z > 2, "++").when(z > 1, "+").when(z < -2, "--").when(z < -1, "-").otherwise("0").alias("bucket"))


@query("d133_counts_with_totals", K.sql("select coalesce(platform, 'both') platform, coalesce(visitnum::varchar, 'all') visit, count(*) n, count(distinct group_key) subjects from model_frame group by cube (platform, visitnum)"))
def d133(spark, d):
    m = K.table(spark, d, "model_frame").withColumn("visit", F.col("visitnum").cast("string"))
    return m.cube("platform", "visit").agg(F.count("*").alias("n"), F.count_distinct("group_key").alias("subjects")).select(F.coalesce("platform", F.lit("both")).alias("platform"), F.coalesce("visit", F.lit("all")).alias("visit"), "n", "subjects")


@query("d135_volcano_frame", "with x as (select l_orderkey o, l_linenumber n, l_tax p from lineitem), t as (select max(-log10(p)) filter (p > 0) top from x) select o, n, round(case when p = 0 then top * 1.05 else -log10(p) end, 6) + 0.0 nlp, p < 0.02 significant from x, t")
def d135(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.col("l_tax").alias("p"))
    return O.capped_nlp(x, "p").select("o", "n", F.round("nlp", 6).alias("nlp"), (F.col("p") < 0.02).alias("significant"))


@query("d138_median_visits", K.sql("select median(n) visits, max(n) most from (select usubjid, count(distinct visitnum) n from visit_records where usubjid is not null and visitnum is not null group by 1)"))
def d138(spark, d):
    v = K.table(spark, d, "visit_records").where("usubjid is not null and visitnum is not null").groupBy("usubjid").agg(F.count_distinct("visitnum").alias("n"))
    return v.agg(F.median("n").alias("visits"), F.max("n").alias("most"))


QUERIES, ORACLES = REG.queries, REG.oracles
