"""Queries of projections, joins, aggregations, windows, orders and scalar functions."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallygrove.functions import text as X
from tallygrove.functions.ids import SQL_SUBJECT, standard_subject
from tallygrove.operators import relational as R
from tallygrove.plans import keys as K
from tallygrove.plans.registry import Registry
from tallygrove.sources.tables import nan_to_null, table

REG = Registry()
query = REG.add
VISIT_WEEK = {2: 0, 8: 24, 20: 72}
_US = SQL_SUBJECT.format(x="usubjid")


# --- projections and predicates -------------------------------------------------------------------------------------
@query("proj1_select_rename_extend", "select o_orderkey as \"order\", o_custkey as customer, round(o_totalprice / 100, 6) hundreds, upper(o_orderstatus) status from orders")
def proj1(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("order"), F.col("o_custkey").alias("customer"), "o_totalprice", F.upper("o_orderstatus").alias("status")).withColumn("hundreds", F.round(F.col("o_totalprice") / 100, 6)).drop("o_totalprice")


@query("proj3_filter_range", "select l_orderkey, l_linenumber, l_quantity from lineitem where l_quantity between 10 and 12 and l_discount > 0.05 and l_returnflag in ('A', 'R')")
def proj3(spark, d):
    li = table(spark, d, "lineitem")
    return li.where(F.col("l_quantity").between(10, 12) & (F.col("l_discount") > 0.05) & F.col("l_returnflag").isin("A", "R")).select("l_orderkey", "l_linenumber", "l_quantity")


@query("proj5_case_coalesce_horizontal", """select row_id, case when hba1cbl >= 6.5 then 'diabetic' when hba1cbl >= 5.7 then 'raised' when hba1cbl is null then 'unknown' else 'normal' end class,
  coalesce(trt01a, arm, 'none') arm_used, greatest(weightbl, wstcirbl) largest, least(weightbl, wstcirbl) smallest,
  (case when sex is null then 1 else 0 end) + (case when age is null then 1 else 0 end) + (case when bmibl is null then 1 else 0 end) missing,
  (sex is null or age is null or bmibl is null) any_missing from (select * replace (case when isnan(hba1cbl) then null else hba1cbl end as hba1cbl, case when isnan(weightbl) then null else weightbl end as weightbl,
  case when isnan(wstcirbl) then null else wstcirbl end as wstcirbl, case when isnan(bmibl) then null else bmibl end as bmibl) from adsl)""")  # fmt: skip
def proj5(spark, d):
    a = nan_to_null(table(spark, d, "adsl"))
    miss = [F.col(c).isNull() for c in ("sex", "age", "bmibl")]
    return a.select(
        "row_id",
        F.when(F.col("hba1cbl") >= 6.5, "diabetic").when(F.col("hba1cbl") >= 5.7, "raised").when(F.col("hba1cbl").isNull(), "unknown").otherwise("normal").alias("class"),
        F.coalesce("trt01a", "arm", F.lit("none")).alias("arm_used"),
        F.greatest("weightbl", "wstcirbl").alias("largest"),
        F.least("weightbl", "wstcirbl").alias("smallest"),
        sum(m.cast("int") for m in miss).alias("missing"),
        (miss[0] | miss[1] | miss[2]).alias("any_missing"),
    )


@query("proj9_complete_cases", "select row_id, weightbl, bmibl from adsl where weightbl is not null and bmibl is not null and hba1cbl is not null and isfinite(weightbl) and isfinite(bmibl) and isfinite(hba1cbl) and sex is not null")
def proj9(spark, d):
    return R.complete_cases(table(spark, d, "adsl"), ["weightbl", "bmibl", "hba1cbl", "sex"]).select("row_id", "weightbl", "bmibl")


@query("proj11_null_safe_difference", "select row_id, trt01a, arm from adsl where upper(trt01a) is distinct from upper(arm)")
def proj11(spark, d):
    return table(spark, d, "adsl").where(R.differs(F.upper("trt01a"), F.upper("arm"))).select("row_id", "trt01a", "arm")


@query("proj14_value_map", "select row_id, visitnum, case visitnum when 2 then 0 when 8 then 24 when 20 then 72 else -1 end as \"week\" from model_frame")
def proj14(spark, d):
    return table(spark, d, "model_frame").select("row_id", "visitnum", R.mapped(F.col("visitnum"), VISIT_WEEK, F.lit(-1)).alias("week"))


@query("proj17_conform", "select cast(row_id as varchar) row_id, cast(visitnum as bigint) visitnum, round(y_value, 6) + 0.0 y_value from model_frame")
def proj17(spark, d):
    want = T.StructType([T.StructField("row_id", T.StringType()), T.StructField("visitnum", T.LongType()), T.StructField("y_value", T.DoubleType())])
    m = table(spark, d, "model_frame")
    return R.conform(m.select(*R.available(m, ["row_id", "visitnum", "y_value", "not_there"])), want).withColumn("y_value", F.round("y_value", 6))


# --- joins ----------------------------------------------------------------------------------------------------------
@query("j1_inner", "select l_orderkey, l_linenumber, o_orderpriority, c_mktsegment from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey where o_orderstatus = 'F'")
def j1(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey", "o_orderpriority")
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).select("l_orderkey", "l_linenumber", "o_orderpriority", "c_mktsegment")


@query("j3_checked_many_to_one", K.sql("select m.row_id, m.sid, a.sex, a.age::double age from (select row_id, usubjid u, siteid sid from (select row_id, group_key usubjid, siteid from model_frame)) m left join (select usubjid, arg_min(sex, row_id) filter (sex is not null) sex, arg_min(age, row_id) filter (age is not null) age from adsl group by 1) a on m.u = a.usubjid"))
def j3(spark, d):
    firsts = K.table(spark, d, "adsl").groupBy("usubjid").agg(F.min_by("sex", F.when(F.col("sex").isNotNull(), F.col("row_id"))).alias("sex"), F.min_by("age", F.when(F.col("age").isNotNull(), F.col("row_id"))).alias("age"))
    m = K.table(spark, d, "model_frame").select("row_id", F.col("group_key").alias("usubjid"), F.col("siteid").alias("sid"))
    return R.checked_join(m, firsts, ["usubjid"], "left", "m:1").drop("usubjid").withColumn("age", F.col("age").cast("double"))


@query("j4_semi", K.sql("select row_id, sampleid from manifest m where exists (select 1 from adsl a where a.usubjid = m.usubjid and a.deleted_at is null)"))
def j4(spark, d):
    held = K.table(spark, d, "adsl").where("deleted_at is null").select("usubjid")
    return K.table(spark, d, "manifest").join(held, "usubjid", "left_semi").select("row_id", "sampleid")


@query("j5_anti", "select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT')")
def j5(spark, d):
    urgent = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'")
    return table(spark, d, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("j6_full_coalesced", K.sql("select coalesce(a.u, b.u) u, coalesce(a.draws, 0) draws, coalesce(b.labs, 0) labs from (select usubjid u, count(*) draws from manifest where usubjid is not null group by 1) a full join (select usubjid u, count(*) labs from visit_records where usubjid is not null group by 1) b on a.u = b.u"))
def j6(spark, d):
    draws = K.table(spark, d, "manifest").where("usubjid is not null").groupBy(F.col("usubjid").alias("u")).agg(F.count("*").alias("draws"))
    labs = K.table(spark, d, "visit_records").where("usubjid is not null").groupBy(F.col("usubjid").alias("u")).agg(F.count("*").alias("labs"))
    return R.full_coalesced(draws, labs, ["u"]).fillna(0)


@query("j7_grid_fill", "select r.r_name, e.event_type, coalesce(n, 0) n from region r cross join (select distinct event_type from events) e left join (select r_name, event_type, count(*) n from events join customer on user_id = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where value > 50 group by 1, 2) x on x.r_name = r.r_name and x.event_type = e.event_type")
def j7(spark, d):
    places = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    buyers = table(spark, d, "customer").join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "r_name")
    got = table(spark, d, "events").where("value > 50").join(buyers, F.col("user_id") == F.col("c_custkey")).groupBy("r_name", "event_type").agg(F.count("*").alias("n"))
    return R.grid(got, [table(spark, d, "region").select("r_name"), table(spark, d, "events").select("event_type").distinct()], ["r_name", "event_type"], {"n": 0})


@query("j8_null_safe_join", "select a.row_id, b.n from (select row_id, source_key from (select row_id, nullif(visitnum_source, 'label') source_key from manifest)) a join (select nullif(visitnum_source, 'label') k, count(*) n from manifest group by 1) b on a.source_key is not distinct from b.k")
def j8(spark, d):
    m = table(spark, d, "manifest").select("row_id", F.nullif("visitnum_source", F.lit("label")).alias("source_key"))
    per = m.groupBy(F.col("source_key").alias("k")).agg(F.count("*").alias("n"))
    return R.null_safe_join(m, per, [("source_key", "k")]).select("row_id", "n")


@query("j9_token_bridge", """with t as (select distinct p_partkey k, unnest(string_split(p_name, ' ')) t from part), u as (select distinct p_brand b, unnest(string_split(p_type, ' ')) t from part)
  select k as p_partkey, b as p_brand, string_agg(t, '|' order by t) shared, count(*) n_shared from (select distinct k, b, t.t from t join u on upper(t.t) = upper(u.t)) group by 1, 2 """)
def j9(spark, d):
    p = table(spark, d, "part")
    names = R.tokens(p, "p_partkey", F.col("p_name"), " ").withColumn("token", F.col("token"))
    types = R.tokens(p.select("p_brand", "p_type").distinct(), "p_brand", F.col("p_type"), " ").distinct()
    upper = lambda x: x.withColumns({"own": F.col("token"), "token": F.upper("token")})
    both = upper(names).join(upper(types).drop("own").distinct(), "token").select("p_partkey", "p_brand", F.col("own").alias("token")).distinct()
    return both.groupBy("p_partkey", "p_brand").agg(F.array_join(F.array_sort(F.collect_set("token")), "|").alias("shared"), F.count_distinct("token").alias("n_shared"))


@query("j9_shared_accession_pairs", "select a.seqid, b.olinkid, string_agg(distinct a.uniprot, '|' order by a.uniprot) shared, count(distinct a.uniprot) n_shared from (select distinct seqid, left(uniprot, 3) uniprot from soma_long) a join (select distinct olinkid, left(uniprot, 3) uniprot from olink_long) b on a.uniprot = b.uniprot group by 1, 2")
def j9b(spark, d):
    s = table(spark, d, "soma_long").select("seqid", F.substring("uniprot", 1, 3).alias("token")).distinct()
    o = table(spark, d, "olink_long").select("olinkid", F.substring("uniprot", 1, 3).alias("token")).distinct()
    return R.bridge(s, o, "seqid", "olinkid")


@query("j10_prefix_link", "select distinct s.s_name label, left(s.s_name, n) ref from supplier s, (select distinct left(s_name, 15) r, 15 n from supplier union select distinct left(s_name, 17), 17 from supplier) x where starts_with(s.s_name, x.r)")
def j10(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_name").alias("label"))
    refs = s.select(F.explode(F.array(F.substring("label", 1, 15), F.substring("label", 1, 17))).alias("ref")).distinct()
    return R.prefix_matches(s, refs, "label", "ref").select("label", "ref").distinct()


@query("j11_nearest_date", f"""with v as (select {_US} u, cast(adt as date) vd, row_id r from visit_records where adt is not null and paramcd = 'HBA1C'), m as (select row_id, {_US} u, cast(adt as date) md from manifest where adt is not null)
  select row_id, min(abs(date_diff('day', md, vd))) gap, arg_min(r, (abs(date_diff('day', md, vd))::bigint * 1000000000 + r)) visit_row from m join v using (u) where abs(date_diff('day', md, vd)) <= 3 group by 1""")
def j11(spark, d):
    # a draw meets only records at most three days away: the day is part of the equi key
    v = table(spark, d, "visit_records").where("adt is not null and paramcd = 'HBA1C'").select(standard_subject(F.col("usubjid")).alias("u"), F.to_date("adt").alias("vd"), F.col("row_id").alias("r"))
    v = v.groupBy("u", "vd").agg(F.min("r").alias("r"))
    m = table(spark, d, "manifest").where("adt is not null").select("row_id", standard_subject(F.col("usubjid")).alias("u"), F.to_date("adt").alias("md"))
    near = m.withColumn("vd", F.explode(F.sequence(F.date_sub("md", 3), F.date_add("md", 3)))).join(v, ["u", "vd"])
    best = near.groupBy("row_id").agg(F.min(F.struct(F.abs(F.datediff("md", "vd")).alias("gap"), "r")).alias("b"))
    return best.select("row_id", F.col("b.gap").alias("gap"), F.col("b.r").alias("visit_row"))


@query("j13_other_source_vote", "with b as (select record_source s, visitnum v, round(avg(visitnum_planned), 6) a from manifest where visitnum between 1 and 99 and not isnan(visitnum) and not isnan(visitnum_planned) group by 1, 2) select x.s, x.v, count(*) others, sum(case when y.a <> x.a then 1 else 0 end)::bigint opposed from b x join b y on x.v = y.v and x.s <> y.s group by 1, 2")
def j13(spark, d):
    m = nan_to_null(table(spark, d, "manifest")).where("visitnum between 1 and 99 and visitnum_planned is not null")
    b = m.groupBy(F.col("record_source").alias("s"), F.col("visitnum").alias("v")).agg(F.round(F.avg("visitnum_planned"), 6).alias("a"))
    other = b.select(F.col("s").alias("s2"), F.col("v").alias("v2"), F.col("a").alias("a2"))
    return b.join(other, (F.col("v") == F.col("v2")) & (F.col("s") != F.col("s2"))).groupBy("s", "v").agg(F.count("*").alias("others"), F.sum((F.col("a") != F.col("a2")).cast("long")).alias("opposed"))


@query("j14_matched_else_label", "select p_partkey, coalesce(g.supplier, p_brand) label, g.l_partkey is not null matched from part left join (select l_partkey, 'S' || min(l_suppkey) supplier from lineitem where l_quantity > 45 group by 1) g on p_partkey = l_partkey")
def j14(spark, d):
    got = table(spark, d, "lineitem").where("l_quantity > 45").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.concat(F.lit("S"), F.min("l_suppkey").cast("string")).alias("label"))
    return R.matched_else(table(spark, d, "part").select("p_partkey", "p_brand"), got, ["p_partkey"], "label", F.col("p_brand")).select("p_partkey", "label", "matched")


@query("j15_reciprocal_slots", "with e as (select distinct l_partkey % 200 a, l_suppkey % 200 b from lineitem where l_linenumber = 1) select distinct least(x.a, x.b) a, greatest(x.a, x.b) b from e x join e y on x.a = y.b and x.b = y.a where x.a <> x.b")
def j15(spark, d):
    e = table(spark, d, "lineitem").where("l_linenumber = 1").select((F.col("l_partkey") % 200).alias("a"), (F.col("l_suppkey") % 200).alias("b")).distinct()
    return R.pairs_reciprocal(e, "a", "b")


# --- aggregations ---------------------------------------------------------------------------------------------------
@query("a2_conditional_counts", "select plateid, count(*) n, count(case when not isnan(rfu) then rfu end) n_values, count(*) filter (sampletype = 'SAMPLE') n_samples, bool_or(rowcheck = 'FLAG') any_flag, bool_and(rowcheck = 'PASS') all_pass from soma_long group by 1")
def a2(spark, d):
    s = nan_to_null(table(spark, d, "soma_long").select("plateid", "rfu", "sampletype", "rowcheck"))
    return s.groupBy("plateid").agg(F.count("*").alias("n"), F.count("rfu").alias("n_values"), F.count_if(F.col("sampletype") == "SAMPLE").alias("n_samples"), F.bool_or(F.col("rowcheck") == "FLAG").alias("any_flag"), F.bool_and(F.col("rowcheck") == "PASS").alias("all_pass"))


@query("a5_distinct_counts", "select siteid, count(distinct usubjid) subjects, count(distinct arm) + max(case when arm is null then 1 else 0 end) arms_with_null, min(age) youngest, max(age) oldest, round(avg(age), 6) mean_age, round(stddev_samp(age), 6) sd_age, median(age) median_age from adsl group by 1")
def a5(spark, d):
    return table(spark, d, "adsl").groupBy("siteid").agg(
        F.count_distinct("usubjid").alias("subjects"), (F.count_distinct("arm") + F.max(F.col("arm").isNull().cast("int"))).alias("arms_with_null"), F.min("age").alias("youngest"), F.max("age").alias("oldest"),
        F.round(F.avg("age"), 6).alias("mean_age"), F.round(F.stddev_samp("age"), 6).alias("sd_age"), F.median("age").alias("median_age"),
    )


@query("a9_first_and_argmax", "select o_custkey, arg_min(o_orderkey, (epoch_us(o_orderdate), o_orderkey)) first_order, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) largest_order, max(o_totalprice) largest from orders group by 1")
def a9(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(
        F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("first_order"), F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("largest_order"), F.max("o_totalprice").alias("largest")
    )


@query("a11_ordered_string_aggregate", "select p_brand, string_agg(distinct p_type, '|' order by p_type) types, string_agg(distinct cast(p_size as varchar), ',' order by cast(p_size as varchar)) sizes from part group by 1")
def a11(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set("p_type")), "|").alias("types"), F.array_join(F.array_sort(F.collect_set(F.col("p_size").cast("string"))), ",").alias("sizes"))


@query("a14_keep_first", "select l_partkey, l_orderkey, l_linenumber, l_quantity from (select *, row_number() over (partition by l_partkey order by l_shipdate, l_orderkey, l_linenumber) r from lineitem) where r = 1")
def a14(spark, d):
    li = table(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity", "l_shipdate")
    return R.keep_first(li, ["l_partkey"], [F.col("l_shipdate"), F.col("l_orderkey"), F.col("l_linenumber")]).drop("l_shipdate")


@query("a15_duplicate_keys", "select usubjid, count(*) n, count(distinct loaded_at) loads from adsl group by 1 having count(*) > 1")
def a15(spark, d):
    return table(spark, d, "adsl").groupBy("usubjid").agg(F.count("*").alias("n"), F.count_distinct("loaded_at").alias("loads")).where("n > 1")


@query("a16_pivot", "select usubjid, max(case when visitnum = 2 then aval end) v2, max(case when visitnum = 8 then aval end) v8, max(case when visitnum = 20 then aval end) v20 from visit_records where paramcd = 'WEIGHT' and aval is not null and not isnan(aval) and usubjid is not null group by 1")
def a16(spark, d):
    v = nan_to_null(table(spark, d, "visit_records")).where("paramcd = 'WEIGHT' and aval is not null and usubjid is not null")
    at = lambda n: F.max(F.when(F.col("visitnum") == n, F.col("aval"))).alias(f"v{n}")
    return v.groupBy("usubjid").agg(at(2), at(8), at(20))


@query("a20_grouping_sets", "select coalesce(siteid, 'all') site, coalesce(sex, 'all') sex, count(*) n, round(avg(bmibl), 6) bmi from (select siteid, coalesce(sex, '?') sex, case when isnan(bmibl) then null else bmibl end bmibl from adsl) group by grouping sets ((siteid, sex), (siteid), ())")
def a20(spark, d):
    a = nan_to_null(table(spark, d, "adsl").select("siteid", F.coalesce("sex", F.lit("?")).alias("sex"), "bmibl"))
    return a.rollup("siteid", "sex").agg(F.count("*").alias("n"), F.round(F.avg("bmibl"), 6).alias("bmi")).select(F.coalesce("siteid", F.lit("all")).alias("site"), F.coalesce("sex", F.lit("all")).alias("sex"), "n", "bmi")


@query("a21_best_two", "with s as (select l_partkey, l_suppkey, sum(l_quantity) q from lineitem group by 1, 2), r as (select *, row_number() over (partition by l_partkey order by q desc, l_suppkey) k from s) select l_partkey, max(case when k = 1 then l_suppkey end) best, max(case when k = 1 then q end) best_score, max(case when k = 2 then l_suppkey end)::double as \"second\", max(case when k = 2 then q end) second_score, max(case when k = 1 then q end) - max(case when k = 2 then q end) margin from r where k <= 2 group by 1")
def a21(spark, d):
    s = table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("q"))
    return R.best_two(s, ["l_partkey"], "l_suppkey", "q").withColumn("second", F.col("second").cast("double"))


# --- windows --------------------------------------------------------------------------------------------------------
@query("w1_one_value_per_key", "select row_id, min(visitnum) over (partition by sample_ids) = max(visitnum) over (partition by sample_ids) one_visit from model_frame where sample_ids is not null")
def w1(spark, d):
    w = W.partitionBy("sample_ids")
    return table(spark, d, "model_frame").where("sample_ids is not null").select("row_id", (F.min("visitnum").over(w) == F.max("visitnum").over(w)).alias("one_visit"))


@query("w3_last_before_dose", K.sql("select m.row_id, strftime(max(case when m.adt < a.trtsdt then m.adt end) over (partition by m.usubjid), '%Y-%m-%d %H:%M:%S.%f') last_predose, coalesce(bool_or(m.visitnum = 2) over (partition by m.usubjid), false) has_baseline from manifest m join (select usubjid, min(trtsdt) trtsdt from adsl group by 1) a on m.usubjid = a.usubjid"))
def w3(spark, d):
    a = K.table(spark, d, "adsl").groupBy("usubjid").agg(F.min("trtsdt").alias("trtsdt"))
    w = W.partitionBy("usubjid")
    return K.table(spark, d, "manifest").join(a, "usubjid").select("row_id", F.date_format(F.max(F.when(F.col("adt") < F.col("trtsdt"), F.col("adt"))).over(w), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("last_predose"), F.coalesce(F.bool_or(F.col("visitnum") == 2).over(w), F.lit(False)).alias("has_baseline"))


@query("w6_collisions", "select row_id, count(*) over (partition by accessionnumber, visitnum) n from manifest where sampletype = 'SAMPLE'")
def w6(spark, d):
    return table(spark, d, "manifest").where("sampletype = 'SAMPLE'").select("row_id", F.count("*").over(W.partitionBy("accessionnumber", "visitnum")).alias("n"))


@query("w7_date_order_check", K.sql("select row_id, coalesce(adt < max(adt) over (partition by usubjid order by visitnum, row_id rows between unbounded preceding and 1 preceding), false) out_of_order from manifest where usubjid is not null and adt is not null and visitnum is not null and not isnan(visitnum)"))
def w7(spark, d):
    w = W.partitionBy("usubjid").orderBy("visitnum", "row_id").rowsBetween(W.unboundedPreceding, -1)
    m = nan_to_null(K.table(spark, d, "manifest")).where("usubjid is not null and adt is not null and visitnum is not null")
    return m.select("row_id", F.coalesce(F.col("adt") < F.max("adt").over(w), F.lit(False)).alias("out_of_order"))


@query("w8_row_index", "select event_id, row_number() over (partition by user_id order by ts, event_id) i from events")
def w8(spark, d):
    return table(spark, d, "events").select("event_id", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("i"))


# --- order and sets -------------------------------------------------------------------------------------------------
@query("t3_top_k", "select s_suppkey, s_acctbal from supplier order by s_acctbal desc nulls last, s_suppkey limit 25")
def t3(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", "s_acctbal").orderBy(F.desc_nulls_last("s_acctbal"), "s_suppkey").limit(25)


@query("t4_best_per_group_then_top", "select p_brand, p_partkey, p_retailprice from (select *, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) r from part) where r = 1 order by p_retailprice desc, p_partkey limit 10")
def t4(spark, d):
    best = R.keep_first(table(spark, d, "part").select("p_brand", "p_partkey", "p_retailprice"), ["p_brand"], [F.desc("p_retailprice"), F.col("p_partkey")])
    return best.orderBy(F.desc("p_retailprice"), "p_partkey").limit(10)


@query("t5_custom_order", "select o_orderkey, case o_orderstatus when 'F' then 1 when 'P' then 2 when 'O' then 3 end place from orders order by place, o_orderkey limit 100")
def t5(spark, d):
    return table(spark, d, "orders").select("o_orderkey", R.mapped(F.col("o_orderstatus"), {"F": 1, "P": 2, "O": 3}).alias("place")).orderBy("place", "o_orderkey").limit(100)


@query("t6_union_relaxed", "select platform, assay, panel, count(*) n, min(value) lo, max(value) hi from (select seqid assay, rfu as value, null as panel, 'soma' platform from soma_long where not isnan(rfu) union all select olinkid, npx, panel, 'olink' from olink_long where not isnan(npx)) group by 1, 2, 3")
def t6(spark, d):
    s = nan_to_null(table(spark, d, "soma_long").select(F.col("seqid").alias("assay"), F.col("rfu").alias("value"), F.lit("soma").alias("platform")))
    o = nan_to_null(table(spark, d, "olink_long").select(F.col("olinkid").alias("assay"), F.col("npx").alias("value"), "panel", F.lit("olink").alias("platform")))
    return R.union_relaxed([s, o]).where("value is not null").groupBy("platform", "assay", "panel").agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))


@query("t8_distinct_union", "select usubjid from adsl where usubjid is not null union select usubjid from visit_records where usubjid is not null")
def t8(spark, d):
    return table(spark, d, "adsl").select("usubjid").union(table(spark, d, "visit_records").select("usubjid")).where("usubjid is not null").distinct()


@query("t9_set_algebra", "select usubjid, 'both' side from (select usubjid from manifest where usubjid is not null intersect select usubjid from visit_records) union all select usubjid, 'manifest only' from (select usubjid from manifest where usubjid is not null except select usubjid from visit_records)")
def t9(spark, d):
    m = table(spark, d, "manifest").select("usubjid").where("usubjid is not null")
    v = table(spark, d, "visit_records").select("usubjid")
    return m.intersect(v).withColumn("side", F.lit("both")).unionByName(m.subtract(v).withColumn("side", F.lit("manifest only")))


@query("d131_crosstab", "select siteid, count(*) filter (sex = 'F') \"n_F\", count(*) filter (sex = 'M') \"n_M\", count(*) n from adsl group by 1")
def d131(spark, d):
    return R.crosstab(table(spark, d, "adsl"), "siteid", "sex", ["F", "M"])


# --- scalar functions -----------------------------------------------------------------------------------------------
@query("f1_arm_names", "select distinct trt01a, regexp_replace(regexp_replace(regexp_replace(trim(trt01a), '\\s*/\\s*', '_', 'g'), '\\s+([0-9])', '-\\1', 'g'), '\\s+', '_', 'g') arm, regexp_replace(regexp_replace(regexp_replace(trim(trt01a), '\\s*/\\s*', '_', 'g'), '\\s+([0-9])', '-\\1', 'g'), '\\s+', '_', 'g') || '|' || sex as key from adsl")
def f1(spark, d):
    a = table(spark, d, "adsl")
    return a.select("trt01a", X.arm_name(F.col("trt01a")).alias("arm"), X.group_key([X.arm_name(F.col("trt01a")), F.col("sex")]).alias("key")).distinct()


@query("f2_dates", "select row_id, strftime(cast(adt as date), '%Y-%m-%d') as \"day\", strftime(adt_vendor, '%Y-%m-%d') adt_vendor, date_diff('day', adt_vendor, cast(adt as date)) gap, (select sum(case when substr(strftime(cast(adt as date), '%Y%m%d'), i, 1) <> substr(strftime(adt_vendor, '%Y%m%d'), i, 1) then 1 else 0 end)::int from range(1, 9) t(i)) digits, strftime(strptime(strftime(adt, '%d%b%Y'), '%d%b%Y'), '%Y-%m-%d') from_text from manifest where adt is not null and adt_vendor is not null")
def f2(spark, d):
    m = table(spark, d, "manifest").where("adt is not null and adt_vendor is not null").withColumn("day", F.to_date("adt"))
    got = m.select("row_id", "day", "adt_vendor", F.datediff("day", "adt_vendor").alias("gap"), X.digit_changes(F.col("day"), F.col("adt_vendor")).alias("digits"), X.any_date(F.date_format("day", "ddMMMyyyy")).alias("from_text"))
    return got.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("day", "adt_vendor", "from_text")})


@query("f3_digest", "select row_id, sha256(trim(sampleid)) h from manifest where sampleid is not null")
def f3(spark, d):
    return table(spark, d, "manifest").where("sampleid is not null").select("row_id", X.digest(F.col("sampleid")).alias("h"))


@query("f4_math", "select row_id, round(log2(rfu), 6) l2, round(ln(rfu), 6) l, round(log10(rfu), 6) l10, round(sqrt(rfu), 6) s, round(pow(2, least(log2(rfu), 20)), 4) back from soma_long where rfu > 0.1 and rfu < 1000000 and not isnan(rfu)")
def f4(spark, d):
    s = table(spark, d, "soma_long").where("rfu > 0.1 and rfu < 1000000 and not isnan(rfu)")
    r = lambda x, n=6: F.round(x, n)
    return s.select("row_id", r(F.log2("rfu")).alias("l2"), r(F.log("rfu")).alias("l"), r(F.log10("rfu")).alias("l10"), r(F.sqrt("rfu")).alias("s"), r(F.pow(F.lit(2.0), F.least(F.log2("rfu"), F.lit(20.0))), 4).alias("back"))


@query("f5_arrays", "select p_partkey, len(string_split(p_name, ' ')) n, string_split(p_name, ' ')[1] first, string_split(p_name, ' ')[-1] last, list_contains(string_split(p_name, ' '), 'red') has_red, len(list_intersect(string_split(p_name, ' '), string_split(lower(p_type), ' '))) common from part")
def f5(spark, d):
    words = F.split("p_name", " ")
    return table(spark, d, "part").select("p_partkey", F.size(words).alias("n"), F.element_at(words, 1).alias("first"), F.element_at(words, -1).alias("last"), F.array_contains(words, "red").alias("has_red"), F.size(F.array_intersect(words, F.split(F.lower("p_type"), " "))).alias("common"))


@query("f6_print_formats", "select p_brand, printf('%.1f', round(avg(p_retailprice), 1)) || ' (' || coalesce(printf('%.1f', round(stddev_samp(p_retailprice), 1)), '-') || ')' price, printf('%d (%.2f%%)', count(*) filter (p_size > 25), round(100.0 * count(*) filter (p_size > 25) / count(*), 2)) large, case when avg(p_size) / 50000 < 0.001 then '<0.001' else printf('%.3f', round(avg(p_size) / 50000, 3)) end p from part group by 1")
def f6(spark, d):
    big = F.count_if(F.col("p_size") > 25)
    return table(spark, d, "part").groupBy("p_brand").agg(X.mean_sd(F.avg("p_retailprice"), F.stddev_samp("p_retailprice")).alias("price"), X.count_share(big, F.count("*"), 2).alias("large"), X.p_text(F.avg("p_size") / 50000).alias("p"))


QUERIES, ORACLES = REG.queries, REG.oracles
