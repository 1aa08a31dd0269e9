"""Queries of quality control."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallygrove.functions import text as X
from tallygrove.operators import qc as Q
from tallygrove.operators import relational as R
from tallygrove.operators import stats as S
from tallygrove.plans import keys as K
from tallygrove.plans.registry import Registry
from tallygrove.plans.statistics import OLINK_SQL, SOMA_SQL, olink, r6
from tallygrove.sources.tables import nan_to_null, table

REG = Registry()
query = REG.add


@query("d1_cohort_samples", K.sql("select sampleid, min(row_id) row_id, any_value(case visitnum when 2 then 0 when 8 then 24 when 20 then 72 end) as \"week\" from (select *, min(visitnum) over (partition by sampleid) lo, max(visitnum) over (partition by sampleid) hi from manifest where visitnum in (2, 8, 20) and sampletype = 'SAMPLE' and manifest_exclude is null and sampleid is not null) where lo = hi group by 1"))
def d1(spark, d):
    m = K.table(spark, d, "manifest").where("visitnum in (2, 8, 20) and sampletype = 'SAMPLE' and manifest_exclude is null and sampleid is not null")
    per = m.groupBy("sampleid").agg(F.min("row_id").alias("row_id"), F.min("visitnum").alias("lo"), F.max("visitnum").alias("hi")).where("lo = hi")
    return per.select("sampleid", "row_id", R.mapped(F.col("lo").cast("int"), {2: 0, 8: 24, 20: 72}).alias("week"))


@query("d2_study_partition", K.sql("select s.row_id from soma_long s where s.sampletype = 'SAMPLE' and exists (select 1 from manifest m where m.sampleid = s.sampleid and m.sampletype = 'SAMPLE') and exists (select 1 from (select seqid from soma_long where sampletype = 'NEGATIVE_CONTROL' group by 1 having count(*) > 3) a where a.seqid = s.seqid)"))
def d2(spark, d):
    s = K.table(spark, d, "soma_long")
    samples = K.table(spark, d, "manifest").where("sampletype = 'SAMPLE'").select("sampleid")
    assays = s.where("sampletype = 'NEGATIVE_CONTROL'").groupBy("seqid").count().where("count > 3").select("seqid")
    return s.where("sampletype = 'SAMPLE'").join(samples, "sampleid", "left_semi").join(assays, "seqid", "left_semi").select("row_id")


@query("d3_control_reclassification", "select row_id, case when starts_with(sampleid, 'NC_') then 'NEGATIVE_CONTROL' when starts_with(sampleid, 'CTRL_') then 'PLATE_CONTROL' when starts_with(sampleid, 'POOL') then 'SAMPLE_CONTROL' else 'SAMPLE' end kind, sampletype is not distinct from case when starts_with(sampleid, 'NC_') then 'NEGATIVE_CONTROL' when starts_with(sampleid, 'CTRL_') then 'PLATE_CONTROL' when starts_with(sampleid, 'POOL') then 'SAMPLE_CONTROL' else 'SAMPLE' end agrees from olink_long")
def d3(spark, d):
    s = F.col("sampleid")
    kind = F.when(s.startswith("NC_"), "NEGATIVE_CONTROL").when(s.startswith("CTRL_"), "PLATE_CONTROL").when(s.startswith("POOL"), "SAMPLE_CONTROL").otherwise("SAMPLE")
    return table(spark, d, "olink_long").select("row_id", kind.alias("kind"), F.col("sampletype").eqNullSafe(kind).alias("agrees"))


@query("d5_visit_age", K.sql("with a as (select usubjid, min(age) age from adsl group by 1), m as (select row_id, usubjid, adt, coalesce(min(case when visitnum = 2 then adt end) over (partition by usubjid), min(adt) over (partition by usubjid)) anchor from manifest where adt is not null and usubjid is not null) select row_id, round(age + date_diff('day', cast(anchor as date), cast(adt as date)) / 365.0, 6) visit_age from m join a using (usubjid) where age is not null"))
def d5(spark, d):
    a = K.table(spark, d, "adsl").groupBy("usubjid").agg(F.min("age").alias("age")).where("age is not null")
    w = W.partitionBy("usubjid")
    m = K.table(spark, d, "manifest").where("adt is not null and usubjid is not null")
    m = m.withColumn("anchor", F.coalesce(F.min(F.when(F.col("visitnum") == 2, F.col("adt"))).over(w), F.min("adt").over(w)))
    return m.join(a, "usubjid").select("row_id", F.round(F.col("age") + F.datediff("adt", "anchor") / 365.0, 6).alias("visit_age"))


@query("d6_reassignment", K.sql("with mv as (select sampleid, max(usubjid) new_subject from manifest where record_source = 'lims' and usubjid is not null group by 1) select m.row_id, coalesce(mv.new_subject, m.usubjid) usubjid, coalesce(mv.new_subject <> m.usubjid, false) moved, a.sex from manifest m left join mv using (sampleid) left join (select usubjid, min(sex) sex from adsl group by 1) a on a.usubjid = coalesce(mv.new_subject, m.usubjid)"))
def d6(spark, d):
    m = K.table(spark, d, "manifest").select("row_id", "sampleid", "usubjid", "record_source")
    mv = m.where("record_source = 'lims' and usubjid is not null").groupBy("sampleid").agg(F.max("usubjid").alias("new_subject"))
    a = K.table(spark, d, "adsl").groupBy("usubjid").agg(F.min("sex").alias("sex"))
    moved = m.join(mv, "sampleid", "left").select("row_id", F.coalesce("new_subject", "usubjid").alias("usubjid"), F.coalesce(F.col("new_subject") != F.col("usubjid"), F.lit(False)).alias("moved"))
    return R.checked_join(moved, a, ["usubjid"], "left", "m:1").select("row_id", "usubjid", "moved", "sex")


_H = "h as (select sampleid, plateid, wellid, bool_or(rowcheck = 'FLAG') block_fail from soma_long where sampletype = 'SAMPLE' and sampleid is not null group by 1, 2, 3), r as (select sampleid, plateid, bool_and(block_fail) run_fail from h group by 1, 2), s as (select sampleid, bool_and(run_fail) sample_fail from r group by 1)"


def _soma_samples(spark, d):
    return K.table(spark, d, "soma_long").where("sampletype = 'SAMPLE' and sampleid is not null")


@query("d8_run_hierarchy", K.sql(f"with {_H} select sampleid, plateid, wellid, block_fail, run_fail, sample_fail from h join r using (sampleid, plateid) join s using (sampleid)"))
def d8(spark, d):
    return Q.run_hierarchy(_soma_samples(spark, d), "sampleid", "plateid", "wellid", F.col("rowcheck") == "FLAG")


@query("d8_kept_values", K.sql(f"with {_H} select row_id, case when not block_fail and not isnan(rfu) then rfu end rfu from soma_long l join h using (sampleid, plateid, wellid) join r using (sampleid, plateid) join s using (sampleid) where l.sampletype = 'SAMPLE' and not (run_fail and not sample_fail)"))
def d8b(spark, d):
    rows = nan_to_null(_soma_samples(spark, d))
    verdicts = Q.run_hierarchy(rows, "sampleid", "plateid", "wellid", F.col("rowcheck") == "FLAG")
    return Q.kept_values(rows, verdicts, ["sampleid", "plateid", "wellid"], "rfu").select("row_id", "rfu")


@query("d9_sample_outliers", "with b as (select seqid, median(rfu) med from soma_long where sampletype = 'SAMPLE' and not isnan(rfu) group by 1), m as (select seqid, any_value(med) med, median(abs(rfu - med)) mad from soma_long join b using (seqid) where sampletype = 'SAMPLE' and not isnan(rfu) group by 1) select sampleid, round(avg(case when abs(rfu - med) > 6 * 1.4826 * mad and (rfu > 5 * med or rfu * 5 < med) then 1.0 else 0.0 end), 6) far_share, count(*) n, avg(case when abs(rfu - med) > 6 * 1.4826 * mad and (rfu > 5 * med or rfu * 5 < med) then 1.0 else 0.0 end) > 0.05 outlier from soma_long join m using (seqid) where sampletype = 'SAMPLE' and not isnan(rfu) group by 1")
def d9(spark, d):
    return r6(Q.mad_outliers(table(spark, d, "soma_long").where("sampletype = 'SAMPLE'"), "rfu", ["seqid"], "sampleid"), "far_share")


@query("d10_assay_verdicts", "select olinkid, round(avg(case when sampleqc <> 'PASS' then 1.0 else 0.0 end), 6) bad_share, count(*) n, case when avg(case when sampleqc <> 'PASS' then 1.0 else 0.0 end) > 0.1 then 'FAIL' when avg(case when sampleqc <> 'PASS' then 1.0 else 0.0 end) > 0 then 'WARN' else 'PASS' end verdict from olink_long where sampletype = 'SAMPLE' group by 1")
def d10(spark, d):
    return r6(Q.fraction_verdict(table(spark, d, "olink_long").where("sampletype = 'SAMPLE'"), ["olinkid"], F.col("sampleqc") != "PASS", 0.1), "bad_share")


@query("d12_saturation", "select seqid, round(avg(case when rfu > 2000 then 1.0 else 0.0 end), 6) high_share, count(*) n, avg(case when rfu > 2000 then 1.0 else 0.0 end) > 0.5 saturated from soma_long where sampletype = 'SAMPLE' and rfu is not null and not isnan(rfu) group by 1")
def d12(spark, d):
    return r6(Q.saturated(table(spark, d, "soma_long").where("sampletype = 'SAMPLE'"), "rfu", "seqid", 2000), "high_share")


@query("d13_signal_to_background", "select seqid, median(case when sampletype = 'SAMPLE' then rfu end) signal, median(case when sampletype = 'NEGATIVE_CONTROL' then rfu end) background, round(median(case when sampletype = 'SAMPLE' then rfu end) / median(case when sampletype = 'NEGATIVE_CONTROL' then rfu end), 6) ratio, median(case when sampletype = 'SAMPLE' then rfu end) / median(case when sampletype = 'NEGATIVE_CONTROL' then rfu end) < 2 low from soma_long where not isnan(rfu) group by 1")
def d13(spark, d):
    return r6(Q.signal_to_background(table(spark, d, "soma_long"), "rfu", "seqid", F.col("sampletype") == "SAMPLE", F.col("sampletype") == "NEGATIVE_CONTROL"), "ratio")


_FLAGS = """(select seqid, 'saturated' flag from soma_long where sampletype = 'SAMPLE' and not isnan(rfu) group by 1 having avg(case when rfu > 2000 then 1.0 else 0.0 end) > 0.5
  union all select seqid, 'low_signal' from soma_long where not isnan(rfu) group by 1 having median(case when sampletype = 'SAMPLE' then rfu end) / median(case when sampletype = 'NEGATIVE_CONTROL' then rfu end) < 12
  union all select seqid, 'flagged' from soma_long group by 1 having avg(case when rowcheck = 'FLAG' then 1.0 else 0.0 end) > 0.06)"""


def assay_flags(spark, d):
    s = table(spark, d, "soma_long")
    sat = Q.saturated(s.where("sampletype = 'SAMPLE'"), "rfu", "seqid", 2000).where("saturated").select("seqid", F.lit("saturated").alias("flag"))
    low = Q.signal_to_background(s, "rfu", "seqid", F.col("sampletype") == "SAMPLE", F.col("sampletype") == "NEGATIVE_CONTROL", 12).where("low").select("seqid", F.lit("low_signal").alias("flag"))
    flagged = Q.fraction_verdict(s, ["seqid"], F.col("rowcheck") == "FLAG", 0.06).where("verdict = 'FAIL'").select("seqid", F.lit("flagged").alias("flag"))
    return R.union_relaxed([sat, low, flagged])


@query("d14_flag_consolidation", f"select seqid, count(distinct flag) flags, string_agg(distinct flag, ';' order by flag) which, case when count(distinct flag) >= 2 then 'FAIL' else 'WARN' end verdict from {_FLAGS} group by 1")
def d14(spark, d):
    return Q.consolidate(assay_flags(spark, d), "seqid", "flag")


@query("d52_flag_summary", f"with f as {_FLAGS} select a.seqid, coalesce(bool_or(flag = 'saturated'), false) saturated, coalesce(bool_or(flag = 'low_signal'), false) low_signal, coalesce(bool_or(flag = 'flagged'), false) flagged, case when coalesce(bool_or(flag = 'saturated'), false) then 'FAIL' when count(flag) > 0 then 'WARN' else 'PASS' end status from (select distinct seqid from soma_long) a left join f using (seqid) group by 1")
def d52(spark, d):
    return Q.flag_summary(table(spark, d, "soma_long").select("seqid").distinct(), assay_flags(spark, d), "seqid", "flag", ["saturated", "low_signal", "flagged"], ["saturated"])


@query("d86_replace_flags", f"select distinct seqid, flag from {_FLAGS} where flag <> 'flagged' union select distinct seqid, 'flagged' from soma_long where rowcheck = 'FLAG'")
def d86(spark, d):
    fresh = table(spark, d, "soma_long").where("rowcheck = 'FLAG'").select("seqid", F.lit("flagged").alias("flag")).distinct()
    return Q.replace_flags(assay_flags(spark, d), fresh, "seqid", "flag")


@query("d15_blank_lod", "with b as (select seqid, median(rfu) med from soma_long where sampletype = 'NEGATIVE_CONTROL' and not isnan(rfu) group by 1) select seqid, round(any_value(med) + 3.0 * 1.4826 * median(abs(rfu - med)), 6) lod, count(*) blanks from soma_long join b using (seqid) where sampletype = 'NEGATIVE_CONTROL' and not isnan(rfu) group by 1")
def d15(spark, d):
    return r6(Q.blank_lod(table(spark, d, "soma_long"), "rfu", "seqid", F.col("sampletype") == "NEGATIVE_CONTROL"), "lod")


@query("d16_control_lod", "select olinkid, round(median(npx) + case when count(*) >= 10 then greatest(0.2, 3 * stddev_samp(npx)) else 0.2 end, 6) lod, case when count(*) >= 10 then 'sd' else 'floor' end as method, count(*) n from olink_long where sampletype = 'NEGATIVE_CONTROL' and not isnan(npx) group by 1")
def d16(spark, d):
    return r6(Q.control_lod(table(spark, d, "olink_long"), "npx", "olinkid", F.col("sampletype") == "NEGATIVE_CONTROL"), "lod")


@query("d17_two_scale_lod", "with n as (select olinkid, median(npx) + greatest(0.2, 3 * stddev_samp(npx)) lod from olink_long where sampletype = 'NEGATIVE_CONTROL' and not isnan(npx) group by 1), p as (select olinkid, plateid, median(npx) pc from olink_long where sampletype = 'PLATE_CONTROL' and not isnan(npx) group by 1, 2) select o.row_id, round(n.lod, 6) lod_npx, round(n.lod - p.pc, 6) lod_pc, case when isnan(o.npx) then null else o.npx >= n.lod end above from olink_long o join n using (olinkid) left join p using (olinkid, plateid) where o.sampletype = 'SAMPLE'")
def d17(spark, d):
    o = nan_to_null(table(spark, d, "olink_long"))
    lod = Q.control_lod(o, "npx", "olinkid", F.col("sampletype") == "NEGATIVE_CONTROL", least=1).select("olinkid", "lod")
    pc = o.where("sampletype = 'PLATE_CONTROL' and npx is not null").groupBy("olinkid", "plateid").agg(F.median("npx").alias("pc"))
    rows = o.where("sampletype = 'SAMPLE'").drop("lod").join(lod, "olinkid").join(pc, ["olinkid", "plateid"], "left")
    return rows.select("row_id", F.round("lod", 6).alias("lod_npx"), F.round(F.col("lod") - F.col("pc"), 6).alias("lod_pc"), (F.col("npx") >= F.col("lod")).alias("above"))


def _cv_sql(src: str, log2: bool) -> str:
    log_cv = "sqrt(exp(({} * 0.6931471805599453) ** 2) - 1) * 100"
    cv = log_cv.format("s") if log2 else "case when m > 0 then s / m * 100 end"
    inter = log_cv.format("stddev_samp(m)") if log2 else "stddev_samp(m) / avg(m) * 100"
    return f"select assay, round(avg({cv}), 5) intra_cv, round({inter}, 5) inter_cv, count(*) plates from (select assay, plate, avg(v) m, stddev_samp(v) s from {src} where sampletype = 'SAMPLE_CONTROL' group by 1, 2 having count(*) >= 2) group by 1"


@query("d18_plate_cv_linear", _cv_sql(SOMA_SQL.replace("log2(rfu) v", "rfu v"), False))
def d18(spark, d):
    raw = table(spark, d, "soma_long").where("sampletype = 'SAMPLE_CONTROL' and rfu > 0.1 and rfu < 1000000 and not isnan(rfu)").select(F.col("seqid").alias("assay"), F.col("plateid").alias("plate"), F.col("rfu").alias("v"))
    cv = S.plate_cv(raw, "v", ["assay"], "plate", False)
    return cv.withColumns({c: F.round(c, 5) for c in ("intra_cv", "inter_cv")})


@query("d18_plate_cv_log2", _cv_sql(OLINK_SQL, True))
def d18b(spark, d):
    cv = S.plate_cv(olink(spark, d).where("sampletype = 'SAMPLE_CONTROL'"), "v", ["assay"], "plate", True)
    return cv.withColumns({c: F.round(c, 5) for c in ("intra_cv", "inter_cv")})


_D19 = f"""with det as (select assay, plate, sum(case when v >= lod then 1 else 0 end) d, count(*) n from {OLINK_SQL} where sampletype = 'SAMPLE' and lod is not null and not isnan(lod) group by 1, 2),
  rate as (select assay, max(d::double / n) best_rate, sum(d)::double / sum(n) all_rate from det group by 1),
  cv as (select assay, avg(sqrt(exp((s * 0.6931471805599453) ** 2) - 1) * 100) intra_cv from (select assay, plate, stddev_samp(v) s from {OLINK_SQL} where sampletype = 'SAMPLE_CONTROL' group by 1, 2 having count(*) >= 2) group by 1)
  select assay, round(best_rate, 6) best_rate, round(all_rate, 6) all_rate, round(intra_cv, 5) intra_cv, case when all_rate < 0.97 and intra_cv > 20 then 'FAIL' when all_rate < 0.97 or intra_cv > 20 then 'WARN' else 'PASS' end status from rate left join cv using (assay)"""


@query("d19_detection_status", _D19)
def d19(spark, d):
    """Detection by plate with a variation gate; each aggregation reads only its columns and sample type."""
    o = olink(spark, d)
    rates = S.detection_rates(o.where("sampletype = 'SAMPLE'"), "v", "lod", ["assay"], "plate")
    cv = S.plate_cv(o.where("sampletype = 'SAMPLE_CONTROL'"), "v", ["assay"], "plate", True)
    low, wide = F.col("all_rate") < 0.97, F.coalesce(F.col("intra_cv") > 20, F.lit(False))
    joined = rates.join(cv, "assay", "left")
    return joined.select("assay", F.round("best_rate", 6).alias("best_rate"), F.round("all_rate", 6).alias("all_rate"), F.round("intra_cv", 5).alias("intra_cv"), F.when(low & wide, "FAIL").when(low | wide, "WARN").otherwise("PASS").alias("status"))


@query("d20_duplicate_assays", "with a as (select p_partkey assay, p_brand || p_type target, p_retailprice rate from part), c as (select target, count(distinct assay) copies from a group by 1 having count(distinct assay) > 1) select a.assay, a.target, c.copies, first_value(assay) over (partition by target order by rate desc, assay) kept, assay <> first_value(assay) over (partition by target order by rate desc, assay) dropped from a join c using (target)")
def d20(spark, d):
    a = table(spark, d, "part").select(F.col("p_partkey").alias("assay"), F.concat("p_brand", "p_type").alias("target"), F.col("p_retailprice").alias("rate"))
    return Q.duplicate_assays(a, "assay", "target", "rate").select("assay", "target", "copies", "kept", "dropped")


@query("d20_duplicate_agreement", f"""with v as (select assay, sample, avg(v) v from {OLINK_SQL} where sampletype = 'SAMPLE' and sample is not null group by 1, 2), r as (select olinkid assay, min(panel) target, avg(case when npx >= lod then 1.0 else 0.0 end) filter (lod is not null and not isnan(lod) and npx is not null and not isnan(npx)) rate from olink_long where sampletype = 'SAMPLE' group by 1),
  k as (select assay, first_value(assay) over (partition by target order by round(rate, 6) desc, assay) kept from r), p as (select x.assay, kept, x.v x, y.v y from k join v x using (assay) join v y on y.assay = kept and y.sample = x.sample where k.assay <> kept),
  q as (select assay, kept, rank() over (partition by assay order by x) + (count(*) over (partition by assay, x) - 1) / 2.0 rx, rank() over (partition by assay order by y) + (count(*) over (partition by assay, y) - 1) / 2.0 ry from p) select assay, kept, count(*) n, round(corr(rx, ry), 6) spearman, case when corr(rx, ry) >= 0.3 then 'concordant' else 'discordant' end "label" from q group by 1, 2""")
def d20_agreement(spark, d):
    """Analytes of a panel as copies of one target: the best detected stays, the others get their rank correlation with it."""
    raw = nan_to_null(table(spark, d, "olink_long").where("sampletype = 'SAMPLE'"))
    seen = F.when(F.col("lod").isNotNull() & F.col("npx").isNotNull(), (F.col("npx") >= F.col("lod")).cast("double"))
    rates = raw.groupBy(F.col("olinkid").alias("assay")).agg(F.min("panel").alias("target"), F.round(F.avg(seen), 6).alias("rate"))
    v = olink(spark, d).where("sampletype = 'SAMPLE' and sample is not null").groupBy("assay", "sample").agg(F.avg("v").alias("v"))
    return r6(Q.duplicate_agreement(v, Q.duplicate_assays(rates, "assay", "target", "rate"), "assay", "sample", "v", 0.3), "spearman")


_D27 = K.sql("""(with a as (select usubjid, case when bool_or(deleted_at is not null) then 'DISCONTINUED' else 'COMPLETED' end status from adsl where usubjid is not null group by 1), v as (select usubjid, cast(max(adt) filter (visitnum <= 20) as date) last_dose, cast(min(adt) filter (paramcd = 'GLUC' and aval > 9) as date) stop from visit_records where usubjid is not null group by 1)
  select usubjid, status, last_dose, case when status = 'DISCONTINUED' and last_dose is null then null else least(case when status = 'DISCONTINUED' then last_dose + 28 end, stop) end window_end from a left join v using (usubjid))""")


@query("d27_window_end", f"select usubjid, status, strftime(last_dose, '%Y-%m-%d') last_dose, strftime(window_end, '%Y-%m-%d') window_end from {_D27}")
def d27(spark, d):
    """On-treatment windows: withdrawn participants 28 days after their last scheduled visit, a high glucose as stop event."""
    a = K.table(spark, d, "adsl").where("usubjid is not null").groupBy("usubjid").agg(F.when(F.bool_or(F.col("deleted_at").isNotNull()), "DISCONTINUED").otherwise("COMPLETED").alias("status"))
    v = nan_to_null(K.table(spark, d, "visit_records")).where("usubjid is not null").groupBy("usubjid").agg(F.to_date(F.max(F.when(F.col("visitnum") <= 20, F.col("adt")))).alias("last_dose"), F.to_date(F.min(F.when((F.col("paramcd") == "GLUC") & (F.col("aval") > 9), F.col("adt")))).alias("stop"))
    w = a.join(v, "usubjid", "left").withColumn("window_end", Q.window_end(F.col("status"), F.col("last_dose"), 28, [F.col("stop")]))
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return w.select("usubjid", "status", day("last_dose"), day("window_end"))


_D21 = f"""o as (select sample, assay, v, lod from {OLINK_SQL} where sampletype = 'SAMPLE' and sample is not null), w as (select assay, avg(case when v >= lod then 1.0 else 0.0 end) w from o where lod is not null and not isnan(lod) group by 1),
  x as (select sample, v, w, (sum(w) over (partition by sample order by v, w rows between unbounded preceding and current row) - w / 2) / sum(w) over (partition by sample) p from o join w using (assay) where w > 0),
  f as (select sampleid sample, bool_and(sampleqc = 'PASS') in_fit from olink_long where sampletype = 'SAMPLE' and sampleid is not null group by 1)"""
_HAZEN = "case when max(p) filter (p <= {q}) is null then arg_min(v, (p, v)) when min(p) filter (p >= {q}) is null then arg_max(v, (p, v)) when max(p) filter (p <= {q}) = min(p) filter (p >= {q}) then arg_max(v, (p, v)) filter (p <= {q}) else arg_max(v, (p, v)) filter (p <= {q}) + (arg_min(v, (p, v)) filter (p >= {q}) - arg_max(v, (p, v)) filter (p <= {q})) * ({q} - max(p) filter (p <= {q})) / (min(p) filter (p >= {q}) - max(p) filter (p <= {q})) end"


@query("d21_median_iqr_outliers", K.sql(f"with {_D21}, h as (select sample, count(*) n, {_HAZEN.format(q=0.5)} med, {_HAZEN.format(q=0.75)} - {_HAZEN.format(q=0.25)} iqr from x group by 1), s as (select avg(med) mm, stddev_pop(med) sm, avg(iqr) mi, stddev_pop(iqr) si from h join f using (sample) where in_fit) select sample, n, in_fit, round(med, 6) med, round(iqr, 6) iqr, round((med - mm) / sm, 5) z_med, round((iqr - mi) / si, 5) z_iqr, abs((med - mm) / sm) > 3 or abs((iqr - mi) / si) > 3 outlier from h join f using (sample), s"))
def d21(spark, d):
    """Assays weigh by their detection rate; mean and sd come from the samples whose rows all pass."""
    o = olink(spark, d).where("sampletype = 'SAMPLE' and sample is not null")
    w = o.where("lod is not null and not isnan(lod)").groupBy("assay").agg(F.avg((F.col("v") >= F.col("lod")).cast("double")).alias("w"))
    fit = K.table(spark, d, "olink_long").where("sampletype = 'SAMPLE' and sampleid is not null").groupBy(F.col("sampleid").alias("sample")).agg(F.bool_and(F.col("sampleqc") == "PASS").alias("fit"))
    got = Q.median_iqr_outliers(o.join(w, "assay").join(fit, "sample"), "v", "sample", 3.0, "w", "fit")
    return got.withColumns({"med": F.round("med", 6), "iqr": F.round("iqr", 6), "z_med": F.round("z_med", 5), "z_iqr": F.round("z_iqr", 5)})


@query("d88_outlier_steps", K.sql(f"with {_D21}, h as (select sample, {_HAZEN.format(q=0.5)} med, {_HAZEN.format(q=0.75)} - {_HAZEN.format(q=0.25)} iqr from x group by 1), s as (select avg(med) mm, stddev_pop(med) sm, avg(iqr) mi, stddev_pop(iqr) si from h join f using (sample) where in_fit), m as (select sample from h, s where abs((med - mm) / sm) > 3 or abs((iqr - mi) / si) > 3), u as (select sampleid sample, avg(case when sampleqc <> 'PASS' then 1.0 else 0.0 end) > 0.1 warned, count(distinct olinkid) < 20 few from olink_long where sampletype = 'SAMPLE' and sampleid is not null group by 1) select sample, sample in (select sample from m) median_iqr, coalesce(warned, false) row_warnings, few few_values, case when sample in (select sample from m) then 'FAIL' when warned or few then 'WARN' else 'PASS' end status from u"))
def d88(spark, d):
    """The sample steps in one go: far medians or ranges fail a sample, many warned rows or few analytes warn."""
    o = K.table(spark, d, "olink_long").where("sampletype = 'SAMPLE' and sampleid is not null")
    per = o.groupBy(F.col("sampleid").alias("sample")).agg(F.avg((F.col("sampleqc") != "PASS").cast("double")).alias("share"), F.count_distinct("olinkid").alias("n"))
    steps = {"median_iqr": d21(spark, d).where("outlier").select("sample"), "row_warnings": per.where("share > 0.1").select("sample"), "few_values": per.where("n < 20").select("sample")}
    return Q.run_steps(per.select("sample"), "sample", steps, ["median_iqr"])


@query("d7_rejudged_flags", K.sql("""with mv as (select sampleid tube, max(usubjid) fresh from manifest where record_source = 'lims' and usubjid is not null group by 1), t as (select sampleid tube, arg_min(usubjid, row_id) who from manifest where sampleid is not null and usubjid is not null group by 1),
  a as (select usubjid who, arg_min(trt01a, row_id) arm, arg_min(age, row_id) age from adsl group by 1), old as (select tube, 'no_arm' flag from t left join a using (who) where arm is null union all select tube, 'minor' from t left join a using (who) where age < 18 union all select distinct sampleid, 'excluded' from manifest where manifest_exclude is not null and sampleid is not null),
  m as (select tube, arm, age from t join mv using (tube) left join a on a.who = fresh where fresh <> t.who), new as (select tube, 'no_arm' flag from m where arm is null union all select tube, 'minor' from m where age < 18)
  select tube, flag from old where not (flag in ('no_arm', 'minor') and tube in (select tube from m)) union select tube, flag from new"""))
def d7(spark, d):
    """Flags on a tube's subject, judged anew for tubes that the lims moves to another subject."""
    m = K.table(spark, d, "manifest").where("sampleid is not null")
    t = m.where("usubjid is not null").groupBy(F.col("sampleid").alias("tube")).agg(F.min_by("usubjid", "row_id").alias("who"), F.max(F.when(F.col("record_source") == "lims", F.col("usubjid"))).alias("fresh"))
    a = K.table(spark, d, "adsl").groupBy("usubjid").agg(F.min_by("trt01a", "row_id").alias("arm"), F.min_by("age", "row_id").alias("age"))
    led = lambda c: t.join(a.withColumnRenamed("usubjid", c), c, "left")
    first = led("who")
    flags = first.where("arm is null").select("tube", F.lit("no_arm").alias("flag")).unionByName(first.where("age < 18").select("tube", F.lit("minor").alias("flag"))).unionByName(m.where("manifest_exclude is not null").select(F.col("sampleid").alias("tube"), F.lit("excluded").alias("flag")).distinct())
    return Q.rejudged_flags(flags, led("fresh").where("fresh <> who"), "tube", "flag", {"no_arm": F.col("arm").isNull(), "minor": F.col("age") < 18})


@query("d23_subject_spread_fence", K.sql("with s as (select usubjid, stddev_samp(aval) sd, count(*) n from visit_records where paramcd = 'WEIGHT' and aval is not null and not isnan(aval) and usubjid is not null group by 1 having count(*) > 2), r as (select *, row_number() over (order by sd) - 1 i, count(*) over () m from s), q as (select max(sd) filter (i = round_even(0.25 * (m - 1), 0)) q1, max(sd) filter (i = round_even(0.75 * (m - 1), 0)) q3 from r) select usubjid, round(sd, 6) sd, n, sd > q3 + 1.5 * (q3 - q1) outlier from s, q"))
def d23(spark, d):
    v = nan_to_null(K.table(spark, d, "visit_records")).where("paramcd = 'WEIGHT' and aval is not null and usubjid is not null")
    s = v.groupBy("usubjid").agg(F.stddev_samp("aval").alias("sd"), F.count("*").alias("n")).where("n > 2").withColumn("family", F.lit(1))
    fence = S.tukey_fence(s, "sd", ["family"]).select("family", "high")
    return s.join(F.broadcast(fence), "family").select("usubjid", F.round("sd", 6).alias("sd"), "n", (F.col("sd") > F.col("high")).alias("outlier"))


_REASON = "case when usubjid is null then 'no subject' when adt is null then 'no date' when visitnum is null or isnan(visitnum) then 'no visit' when visitnum not between 1 and 99 then 'impossible visit' when manifest_exclude is not null then 'excluded' end"


def reasons(spark, d):
    m = nan_to_null(K.table(spark, d, "manifest"))
    return m.withColumn("reason", R.first_reason([
        ("no subject", F.col("usubjid").isNull()), ("no date", F.col("adt").isNull()), ("no visit", F.col("visitnum").isNull()), ("impossible visit", ~F.col("visitnum").between(1, 99)), ("excluded", F.col("manifest_exclude").isNotNull()),
    ]))


@query("d31_first_reason_table", K.sql(f"select coalesce({_REASON}, 'kept') reason, record_source, count(*) samples, count(distinct usubjid) subjects from manifest group by 1, 2"))
def d31(spark, d):
    return Q.exclusion_counts(reasons(spark, d), "reason", ["record_source"], "usubjid")


@query("d26_cascade_survivors", K.sql(f"with r as (select coalesce({_REASON}, 'kept') reason from manifest), k as (select reason, count(*) n, case reason when 'no subject' then 1 when 'no date' then 2 when 'no visit' then 3 when 'impossible visit' then 4 when 'excluded' then 5 else 6 end step from r group by 1) select step, reason, n lost, (sum(n) over () - sum(n) over (order by step))::bigint left_over from k"))
def d26(spark, d):
    order = {"no subject": 1, "no date": 2, "no visit": 3, "impossible visit": 4, "excluded": 5, "kept": 6}
    k = reasons(spark, d).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("lost"))
    k = k.withColumn("step", R.mapped(F.col("reason"), order))
    return k.withColumn("left_over", F.sum("lost").over(W.partitionBy()) - F.sum("lost").over(W.orderBy("step"))).select("step", "reason", "lost", "left_over")


@query("d32_root_reason", K.sql(f"with r as (select row_id, usubjid, visitnum, {_REASON} reason from manifest where usubjid is not null) select usubjid, arg_min(reason, row_id) filter (reason is not null) root, count(*) n, count(reason) lost from r group by 1 having count(reason) > 0"))
def d32(spark, d):
    r = reasons(spark, d).where("usubjid is not null")
    return r.groupBy("usubjid").agg(F.min_by("reason", F.when(F.col("reason").isNotNull(), F.col("row_id"))).alias("root"), F.count("*").alias("n"), F.count("reason").alias("lost")).where("lost > 0")


@query("d30_screening_dates", "select usubjid, strftime(max(adt), '%Y-%m-%d %H:%M:%S') screened from (select usubjid, adt from visit_records where visitnum = 1 union all select usubjid, adt from manifest where visitnum = 1) where usubjid is not null and adt is not null group by 1")
def d30(spark, d):
    every = R.union_relaxed([table(spark, d, t).where("visitnum = 1").select("usubjid", "adt") for t in ("visit_records", "manifest")])
    return every.where("usubjid is not null and adt is not null").groupBy("usubjid").agg(F.date_format(F.max("adt"), "yyyy-MM-dd HH:mm:ss").alias("screened"))


@query("d29_dose_timing", K.sql("select m.row_id, date_diff('day', a.trtsdt, cast(m.adt as date)) days_since_first from manifest m join (select usubjid, min(trtsdt) trtsdt from adsl group by 1) a on a.usubjid = m.usubjid where m.adt is not null and a.trtsdt is not null"))
def d29(spark, d):
    a = K.table(spark, d, "adsl").groupBy("usubjid").agg(F.min("trtsdt").alias("trtsdt")).where("trtsdt is not null")
    return K.table(spark, d, "manifest").where("adt is not null").join(a, "usubjid").select("row_id", F.datediff("adt", "trtsdt").alias("days_since_first"))


@query("d53_breakdown_by_arm", K.sql(f"with a as (select usubjid, min(trt01a) arm from adsl group by 1) select coalesce(arm, 'unknown') arm, coalesce({_REASON}, 'kept') reason, count(*) n, round(count(*) / sum(count(*)) over (partition by coalesce(arm, 'unknown')), 6) share from manifest left join a using (usubjid) group by 1, 2"))
def d53(spark, d):
    a = K.table(spark, d, "adsl").groupBy("usubjid").agg(F.min("trt01a").alias("arm"))
    n = reasons(spark, d).join(a, "usubjid", "left").groupBy(F.coalesce("arm", F.lit("unknown")).alias("arm"), F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy("arm")), 6))


@query("d82_bridge_flag", "select row_id, coalesce(case when lower(trim(cast(bridgesample as varchar))) in ('true', 'y', 'yes', '1') then true when lower(trim(cast(bridgesample as varchar))) in ('false', 'n', 'no', '0', '') then false end, false) bridge from manifest")
def d82(spark, d):
    t = F.lower(F.trim(F.col("bridgesample").cast("string")))
    return table(spark, d, "manifest").select("row_id", F.coalesce(F.when(t.isin("true", "y", "yes", "1"), True).when(t.isin("false", "n", "no", "0", ""), False), F.lit(False)).alias("bridge"))


@query("d83_no_manifest_row", K.sql("select distinct sampleid from soma_long s where sampletype = 'SAMPLE' and sampleid is not null and not exists (select 1 from manifest m where m.sampleid = s.sampleid and m.manifest_exclude is null)"))
def d83(spark, d):
    good = K.table(spark, d, "manifest").where("manifest_exclude is null").select("sampleid")
    return K.table(spark, d, "soma_long").where("sampletype = 'SAMPLE' and sampleid is not null").select("sampleid").distinct().join(good, "sampleid", "left_anti")


@query("d85_study_counts", "select count(distinct case when sampletype = 'SAMPLE' then sampleid end) samples, count(distinct case when sampletype = 'NEGATIVE_CONTROL' then sampleid end) negative_controls, count(distinct case when sampletype = 'PLATE_CONTROL' then sampleid end) plate_controls, count(distinct olinkid) assays, count(distinct plateid) plates from olink_long")
def d85(spark, d):
    return Q.study_counts(table(spark, d, "olink_long"), "sampleid", "olinkid", "plateid", "sampletype", ["SAMPLE", "NEGATIVE_CONTROL", "PLATE_CONTROL"])


@query("d87_group_keys", "select distinct siteid, regexp_replace(regexp_replace(trim(trt01a), '\\s+([0-9])', '-\\1', 'g'), '\\s+', '_', 'g') || '|' || siteid as key from adsl where trt01a is not null and siteid is not null")
def d87(spark, d):
    a = table(spark, d, "adsl").where("trt01a is not null and siteid is not null")
    return a.select("siteid", X.group_key([X.arm_name(F.col("trt01a")), F.col("siteid")]).alias("key")).distinct()


@query("d91_outlier_matrix_cells", f"select sample, assay, round(median(v), 6) v, count(*) n from {OLINK_SQL} where sampletype = 'SAMPLE' and sample is not null group by 1, 2")
def d91(spark, d):
    return olink(spark, d).where("sampletype = 'SAMPLE' and sample is not null").groupBy("sample", "assay").agg(F.round(F.median("v"), 6).alias("v"), F.count("*").alias("n"))


@query("d93_note_match", "select doc_id from documents where contains(lower(text), 'plate') and text is not null")
def d93(spark, d):
    return table(spark, d, "documents").where(F.contains(F.lower("text"), F.lit("plate"))).select("doc_id")


@query("d94_conflicting_notes", "select sampleid, count(distinct manifest_correction) kinds, min(manifest_correction) first from manifest where sampleid is not null and manifest_correction is not null group by 1")
def d94(spark, d):
    m = table(spark, d, "manifest").where("sampleid is not null and manifest_correction is not null")
    return m.groupBy("sampleid").agg(F.size(F.collect_set("manifest_correction")).cast("bigint").alias("kinds"), F.min("manifest_correction").alias("first"))


@query("d95_exclusion_frame", K.sql(f"select row_id, sampleid, usubjid, coalesce({_REASON}, 'kept') reason, true assayed from manifest where sampleid in (select sampleid from soma_long) union all select row_id, sampleid, usubjid, coalesce({_REASON}, 'not assayed'), false from manifest where sampleid is null or sampleid not in (select sampleid from soma_long where sampleid is not null)"))
def d95(spark, d):
    seen = K.table(spark, d, "soma_long").where("sampleid is not null").select("sampleid", F.lit(True).alias("assayed")).distinct()
    r = reasons(spark, d).join(seen, "sampleid", "left").withColumn("assayed", F.coalesce("assayed", F.lit(False)))
    return r.select("row_id", "sampleid", "usubjid", F.coalesce("reason", F.when(F.col("assayed"), "kept").otherwise("not assayed")).alias("reason"), "assayed")


QUERIES, ORACLES = REG.queries, REG.oracles
