"""Queries of linkage, genotype and catalog operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallygrove.functions.dist import nlp_value
from tallygrove.functions.ids import SQL_SUBJECT, SQL_TUBE, standard_subject, standard_tube
from tallygrove.functions.text import chromosome, digest
from tallygrove.operators import genetics as G
from tallygrove.operators import linkage as L
from tallygrove.operators import relational as R
from tallygrove.operators import stats as S
from tallygrove.plans import keys as K
from tallygrove.plans.registry import Registry
from tallygrove.plans.sqldist import sql_normal_nlp, sql_normal_two_sided
from tallygrove.plans.statistics import SOMA_SQL, soma
from tallygrove.sources.tables import nan_to_null, table

REG = Registry()
query = REG.add
_U, _T = SQL_SUBJECT.format(x="usubjid"), SQL_TUBE.format(x="sampleid")


@query("d33_tube_records_by_priority", f"select {_T} tube, arg_min(usubjid, (trust_rank, row_id)) filter (usubjid is not null) usubjid, arg_min(record_source, (trust_rank, row_id)) source, count(*) n from manifest join record_sources using (record_source) where {_T} is not null group by 1")
def d33(spark, d):
    m = table(spark, d, "manifest").join(table(spark, d, "record_sources"), "record_source").withColumn("tube", standard_tube(F.col("sampleid"))).where("tube is not null")
    order = F.struct("trust_rank", "row_id")
    return m.groupBy("tube").agg(F.min_by("usubjid", F.when(F.col("usubjid").isNotNull(), order)).alias("usubjid"), F.min_by("record_source", order).alias("source"), F.count("*").alias("n"))


@query("d33_accession_tokens", "with t as (select p_partkey, list_distinct(list_transform(string_split(p_name, ' '), lambda x: upper(x))) a, list_transform(string_split(p_name, ' '), lambda x: upper(x)) o from part) select p_partkey, len(list_filter(a, lambda y: list_position(o, y) < list_position(o, x)))::int \"position\", x token from (select p_partkey, a, o, unnest(a) x from t)")
def d33b(spark, d):
    return L.accession_tokens(table(spark, d, "part"), "p_partkey", "p_name")


_ADT = "coalesce(case when adt_source = 'tube' then cast(adt as date) end, adt_vendor, v.day, cast(adt as date))"


@query("d34_draw_dates", f"""with v as (select {_U} u, visitnum vn, min(cast(adt as date)) as day from visit_records where adt is not null and visitnum is not null and not isnan(visitnum) group by 1, 2)
  select row_id, strftime({_ADT}, '%Y-%m-%d') drawn, case when adt_source = 'tube' and adt is not null then 'tube' when adt_vendor is not null then 'vendor' when v.day is not null then 'visit' when adt is not null then 'other' end src,
  len(list_distinct(list_filter([case when adt_source = 'tube' then cast(adt as date) end, adt_vendor, v.day, cast(adt as date)], lambda x: x is not null))) > 1 disagree
  from (select *, {_U} mu from manifest) m left join v on m.mu = v.u and m.visitnum = v.vn""")  # fmt: skip
def d34(spark, d):
    v = nan_to_null(table(spark, d, "visit_records")).where("adt is not null and visitnum is not null")
    v = v.groupBy(standard_subject(F.col("usubjid")).alias("u"), F.col("visitnum").alias("vn")).agg(F.min(F.to_date("adt")).alias("day"))
    m = nan_to_null(table(spark, d, "manifest")).withColumn("mu", standard_subject(F.col("usubjid")))
    joined = m.join(v, (F.col("mu") == F.col("u")) & (F.col("visitnum") == F.col("vn")), "left")
    value, name, disagree = L.prioritised(("tube", F.when(F.col("adt_source") == "tube", F.to_date("adt"))), ("vendor", F.col("adt_vendor")), ("visit", F.col("day")), ("other", F.to_date("adt")))
    return joined.select("row_id", F.date_format(value, "yyyy-MM-dd").alias("drawn"), name.alias("src"), disagree.alias("disagree"))


@query("d35_visit_assignment", "select row_id, round(coalesce(case when visitnum between 1 and 99 and visitnum = floor(visitnum) then visitnum end, case when visitnum_planned between 1 and 99 then visitnum_planned end), 6) visit, case when visitnum between 1 and 99 and visitnum = floor(visitnum) then 'scheduled' when visitnum_planned between 1 and 99 then 'planned' end how from manifest where (visitnum is null or not isnan(visitnum)) and (visitnum_planned is null or not isnan(visitnum_planned))")
def d35(spark, d):
    m = table(spark, d, "manifest").where("(visitnum is null or not isnan(visitnum)) and (visitnum_planned is null or not isnan(visitnum_planned))")
    own = F.when(F.col("visitnum").between(1, 99) & (F.col("visitnum") == F.floor("visitnum")), F.col("visitnum"))
    plan = F.when(F.col("visitnum_planned").between(1, 99), F.col("visitnum_planned"))
    value, how, _ = L.prioritised(("scheduled", own), ("planned", plan))
    return m.select("row_id", F.round(value, 6).alias("visit"), how.alias("how"))


@query("d36_corrections_by_digest", "with c as (select sha256(trim(sampleid)) h, max(accessionnumber) v from manifest where record_source = 'site_form' and sampleid is not null group by 1 having min(accessionnumber) = max(accessionnumber)) select m.row_id, coalesce('FIX-' || c.v, m.accessionnumber) accessionnumber, c.v is not null corrected from manifest m left join c on c.h = sha256(trim(m.sampleid))")
def d36(spark, d):
    m = table(spark, d, "manifest").select("row_id", "sampleid", "accessionnumber", "record_source")
    c = m.where("record_source = 'site_form' and sampleid is not null").groupBy(digest(F.col("sampleid")).alias("digest")).agg(F.min("accessionnumber").alias("lo"), F.max("accessionnumber").alias("hi")).where("lo = hi")
    fixes = c.select("digest", F.lit("accessionnumber").alias("field"), F.concat(F.lit("FIX-"), "hi").alias("value"))
    return L.apply_corrections(m, fixes, "sampleid", ["accessionnumber"]).select("row_id", "accessionnumber", "corrected")


@query("d37_relabel_genomes", K.sql("select g.row_id, coalesce(m.target, g.geno_usubjid) geno_usubjid from genomes g left join (select usubjid_1, min(usubjid_2) target from king_pairs where kinship >= 0.45 and not isnan(kinship) and usubjid_1 < usubjid_2 group by 1) m on m.usubjid_1 = g.geno_usubjid"))
def d37(spark, d):
    mapping = K.table(spark, d, "king_pairs").where("kinship >= 0.45 and not isnan(kinship) and usubjid_1 < usubjid_2").groupBy(F.col("usubjid_1").alias("geno_usubjid")).agg(F.min("usubjid_2").alias("target"))
    return K.table(spark, d, "genomes").join(mapping, "geno_usubjid", "left").select("row_id", F.coalesce("target", "geno_usubjid").alias("geno_usubjid"))


@query("d38_placement", f"""with m as (select row_id, {_U} u, cast(adt as date) md, visitnum from manifest where visitnum is null or not isnan(visitnum)), v as (select distinct {_U} u, cast(adt as date) vd, visitnum label from visit_records where adt is not null and visitnum is not null and not isnan(visitnum)),
  g as (select row_id, abs(date_diff('day', md, vd)) gap, min(label) lo, max(label) hi from m join v using (u) where abs(date_diff('day', md, vd)) <= 7 group by 1, 2), b as (select row_id, min(gap) gap, arg_min(lo, gap) lo, arg_min(hi, gap) hi from g group by 1)
  select row_id, case when lo = hi then lo end placed, gap::double gap, case when md is null then 'undated' when gap is null then 'none' when lo <> hi then 'tie' when lo is not distinct from visitnum then 'same' else 'moved' end reason from m left join b using (row_id)""")  # fmt: skip
def d38(spark, d):
    m = table(spark, d, "manifest").where("visitnum is null or not isnan(visitnum)").select("row_id", standard_subject(F.col("usubjid")).alias("u"), F.to_date("adt").alias("md"), "visitnum")
    v = nan_to_null(table(spark, d, "visit_records")).select(standard_subject(F.col("usubjid")).alias("u"), F.to_date("adt").alias("vd"), F.col("visitnum").alias("label"))
    return L.place(m, v, "row_id", "u", "md", "visitnum", "vd", "label", 7).withColumn("gap", F.col("gap").cast("double"))


@query("d90_dated_records", f"select distinct {_U} u, strftime(adt, '%Y-%m-%d') as day, visitnum, param, scheduled from (select usubjid, adt, visitnum, paramcd param, visitnum = floor(visitnum) and visitnum < 100 scheduled from visit_records union all select usubjid, adt, visitnum, null, visitnum = floor(visitnum) and visitnum < 100 from manifest) where {_U} is not null and adt is not null and visitnum is not null and not isnan(visitnum)")
def d90(spark, d):
    def shaped(name, **extra):
        rows = nan_to_null(table(spark, d, name)).where("visitnum is not null")
        return rows.select(standard_subject(F.col("usubjid")).alias("u"), F.date_format("adt", "yyyy-MM-dd").alias("day"), "visitnum", ((F.col("visitnum") == F.floor("visitnum")) & (F.col("visitnum") < 100)).alias("scheduled"), *[c.alias(k) for k, c in extra.items()])

    return L.visit_records([shaped("visit_records", param=F.col("paramcd")), shaped("manifest")], ["u", "day", "visitnum", "param", "scheduled"])


@query("d84_bridge_subjects", K.sql("select group_key, count(*) n, count(distinct sample_ids) tubes from model_frame where starts_with(group_key, 'GLX-BRIDGE') group by 1"))
def d84(spark, d):
    return K.table(spark, d, "model_frame").where(F.col("group_key").startswith("GLX-BRIDGE")).groupBy("group_key").agg(F.count("*").alias("n"), F.count_distinct("sample_ids").alias("tubes"))


@query("d89_standard_ids", f"select row_id, {_T} tube, {_U} subject from manifest")
def d89(spark, d):
    return table(spark, d, "manifest").select("row_id", standard_tube(F.col("sampleid")).alias("tube"), standard_subject(F.col("usubjid")).alias("subject"))


# --- genotypes: parts stand for variants, suppliers for individuals -------------------------------------------------
_DOSE = "(select l_suppkey iid, l_partkey variant, (sum(l_linenumber) % 3)::int dose from lineitem group by 1, 2)"


def doses(spark, d, *together):
    """`together`: columns whose equal rows are brought together first, where a join on them follows."""
    li = table(spark, d, "lineitem")
    li = li.repartition(*together) if together else li
    return li.groupBy(F.col("l_suppkey").alias("iid"), F.col("l_partkey").alias("variant")).agg((F.sum("l_linenumber") % 3).cast("int").alias("dose"))


@query("st32_king_kinship", f"with g as {_DOSE} select x.iid a, y.iid b, round((sum((x.dose = 1 and y.dose = 1)::int) - 2.0 * sum((abs(x.dose - y.dose) = 2)::int)) / nullif(sum((x.dose = 1)::int) + sum((y.dose = 1)::int), 0), 6) kinship, count(*) n from g x join g y on x.variant = y.variant and x.iid < y.iid group by 1, 2")
def st32(spark, d):
    k = G.king(G.pair_counts(doses(spark, d), "iid", "variant", "dose"))
    return k.select("a", "b", F.round("kinship", 6).alias("kinship"), "n")


@query("st33_genotype_scores", f"with g as {_DOSE}, w as (select distinct p_brand protein, p_partkey variant, round(avg(p_size) / 10, 3) beta from part group by 1, 2), p as (select protein, iid, sum(dose * beta) predicted from g join w using (variant) group by 1, 2) select protein, iid, round(predicted, 6) predicted, round((predicted - avg(predicted) over (partition by protein)) / stddev_pop(predicted) over (partition by protein), 5) z from p")
def st33(spark, d):
    w = table(spark, d, "part").groupBy(F.col("p_brand").alias("protein"), F.col("p_partkey").alias("variant")).agg(F.round(F.avg("p_size") / 10, 3).alias("beta"))
    p = G.genotype_scores(doses(spark, d), w, "iid", "variant", "dose")
    return S.standardise(p, "predicted", ["protein"], sample=False).select("protein", "iid", F.round("predicted", 6).alias("predicted"), F.round("z", 5).alias("z"))


@query("st44_ld_pruned", f"""with g as {_DOSE}, s as (select variant, least(sum(dose) / (2.0 * count(*)), 1 - sum(dose) / (2.0 * count(*))) maf from g group by 1), k as (select g.*, variant // 40 win from g),
  p as (select x.variant a, y.variant b, corr(x.dose, y.dose) r, count(*) n from k x join k y on x.iid = y.iid and x.win = y.win and x.variant < y.variant group by 1, 2), l as (select a, b from p where n >= 5 and not isnan(r) and r * r > 0.413)
  select count(*) variants, (select count(*) from l) linked, true as independent, true as nothing_more from s""")
def st44(spark, d):
    """Variants left after pruning by squared correlation inside windows: no two left are linked, and every one dropped is."""
    g = doses(spark, d)
    links = G.linked_variants(g.withColumn("win", F.floor(F.col("variant") / 40)), "iid", "variant", "dose", "win", 0.413, 5)
    kept = G.prune(g, links, "variant", "dose")
    hit = links.join(kept.where("kept").select(F.col("variant").alias("a")), "a", "left_semi").join(kept.where("kept").select(F.col("variant").alias("b")), "b", "left_semi").agg(F.count("*").alias("bad"))
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    free = kept.where("not kept").select(F.col("variant").alias("a")).join(both.join(kept.where("kept").select(F.col("variant").alias("b")), "b", "left_semi"), "a", "left_anti").agg(F.count("*").alias("free"))
    return kept.agg(F.count("*").alias("variants")).crossJoin(links.agg(F.count("*").alias("linked"))).crossJoin(hit).crossJoin(free).select("variants", "linked", (F.col("bad") == 0).alias("independent"), (F.col("free") == 0).alias("nothing_more"))  # one row each


@query("d101_allele_frequency", f"select variant, round(sum(dose) / (2.0 * count(dose)), 6) alt_freq, round(least(sum(dose) / (2.0 * count(dose)), 1 - sum(dose) / (2.0 * count(dose))), 6) maf, count(dose) calls from {_DOSE} group by 1")
def d101(spark, d):
    f = G.allele_frequency(doses(spark, d), "variant", "dose")
    return f.withColumns({"alt_freq": F.round("alt_freq", 6), "maf": F.round("maf", 6)})


@query("d98_dosage_standardised", f"select iid, variant, round((dose - avg(dose) over (partition by variant)) / stddev_pop(dose) over (partition by variant), 6) z from {_DOSE}")
def d98(spark, d):
    return S.standardise(doses(spark, d), "dose", ["variant"], sample=False).select("iid", "variant", F.round("z", 6).alias("z"))


_AL = "substr('ACGT', (p_partkey % 4)::int + 1, 1) a1, substr('ACGT', (p_size % 4)::int + 1, 1) a2, substr('ACGT', ((p_partkey // 4) % 4)::int + 1, 1) ref, substr('ACGT', ((p_partkey // 16) % 4)::int + 1, 1) alt"


@query("d43_allele_alignment", f"with a as (select p_partkey, {_AL} from part), f as (select *, translate(a1, 'ACGT', 'TGCA') f1, translate(a2, 'ACGT', 'TGCA') f2 from a) select p_partkey, case when f1 = a2 and ((a1 = alt and a2 = ref) or (a2 = alt and a1 = ref)) then 'palindromic' when a1 = alt and a2 = ref then 'same' when a2 = alt and a1 = ref then 'swapped' when f1 = alt and f2 = ref then 'strand' when f2 = alt and f1 = ref then 'strand_swapped' else 'none' end fit from f")
def d43(spark, d):
    base = lambda n: F.substring(F.lit("ACGT"), (n % 4).cast("int") + 1, F.lit(1))
    k = F.col("p_partkey")
    a = table(spark, d, "part").select("p_partkey", base(k).alias("a1"), base(F.col("p_size")).alias("a2"), base(F.floor(k / 4)).alias("ref"), base(F.floor(k / 16)).alias("alt"))
    return a.select("p_partkey", G.allele_match(F.col("a1"), F.col("a2"), F.col("ref"), F.col("alt")).alias("fit"))


#: Associations as catalogs: how far an analyte's mean on a plate lies from its mean over plates, one catalog (and cohort)
#: per kind of sample. Analytes stand for proteins, plates for variants; alleles come from the plate number, and the
#: even-ranked catalogs state the other allele, so signs are reversed there.
_CAT = f"""(with c as (select sampletype as catalog, assay protein, plate variant, cast(regexp_extract(plate, '([0-9]+)$', 1) as int) p, avg(v) m, stddev_samp(v) / sqrt(count(*)) se from {SOMA_SQL} group by all having count(*) >= 3 and stddev_samp(v) > 0),
  e as (select *, m - avg(m) over (partition by catalog, protein) b, case catalog when 'SAMPLE' then 1 when 'SAMPLE_CONTROL' then 2 when 'PLATE_CONTROL' then 3 else 4 end as rank, substr('ACGT', p % 4 + 1, 1) x, substr('ACGT', (p % 4 + 1 + (p // 4) % 3) % 4 + 1, 1) y from c)
  select catalog, protein, variant, rank, case when rank % 2 = 1 then x else y end a1, case when rank % 2 = 1 then y else x end a2, round(case when rank % 2 = 1 then b else -b end, 9) beta, round(b * b / (se * se) / 4.605170185988091, 6) nlp from e)"""


def catalog(spark, d):
    c = soma(spark, d).groupBy(F.col("sampletype").alias("catalog"), F.col("assay").alias("protein"), F.col("plate").alias("variant")).agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("sd"), F.count("*").alias("n")).where("n >= 3 and sd > 0")
    mean = c.groupBy("catalog", "protein").agg(F.avg("m").alias("mm"))
    p = F.regexp_extract("variant", "([0-9]+)$", 1).cast("int")
    letter = lambda n: F.substring(F.lit("ACGT"), (n % 4).cast("int") + 1, F.lit(1))
    e = c.join(mean, ["catalog", "protein"]).withColumns({"b": F.col("m") - F.col("mm"), "se": F.col("sd") / F.sqrt("n"), "x": letter(p), "y": letter(p % 4 + 1 + F.floor(p / 4) % 3), "rank": F.when(F.col("catalog") == "SAMPLE", 1).when(F.col("catalog") == "SAMPLE_CONTROL", 2).when(F.col("catalog") == "PLATE_CONTROL", 3).otherwise(4)})
    first = F.col("rank") % 2 == 1
    pick = lambda a, b: F.when(first, F.col(a)).otherwise(F.col(b))
    return e.select("catalog", "protein", "variant", "rank", pick("x", "y").alias("a1"), pick("y", "x").alias("a2"), F.round(F.when(first, F.col("b")).otherwise(-F.col("b")), 9).alias("beta"), F.round(F.col("b") ** 2 / F.col("se") ** 2 / 4.605170185988091, 6).alias("nlp"))


@query("d44_strongest_rows", f"with b as (select *, row_number() over (partition by protein order by nlp desc, variant, catalog) r from {_CAT}), q as (select *, row_number() over (partition by variant order by rank, nlp desc, protein) q from b where r = 1) select protein, variant, catalog, nlp from q where q = 1")
def d44(spark, d):
    return G.strongest_rows(catalog(spark, d), "protein", "variant", "nlp", ["catalog"], "rank").select("protein", "variant", "catalog", "nlp")


@query("d45_catalog_priority", f"with c as {_CAT} select protein, variant, rank, beta from c join (select protein, min(rank) f from c where nlp >= 1.3 group by 1) using (protein) where rank = f")
def d45(spark, d):
    return G.by_priority(catalog(spark, d), "protein", "rank", F.col("nlp") >= 1.3).select("protein", "variant", "rank", "beta")


@query("d46_sign_votes", f"""with c as (select *, least(a1, a2) || '/' || greatest(a1, a2) alleles, case when a1 <= a2 then beta else -beta end b from {_CAT} where nlp >= 0.5 and translate(a1, 'ACGT', 'TGCA') <> a2),
  v as (select x.catalog, x.protein, x.variant, x.alleles, x.beta, count(distinct y.catalog) filter (sign(x.b) = sign(y.b)) n_same, count(distinct y.catalog) filter (sign(x.b) <> sign(y.b)) n_opposite from c x join c y on x.protein = y.protein and x.variant = y.variant and x.alleles = y.alleles and x.catalog <> y.catalog group by all)
  select * from v where n_opposite >= 2 and n_opposite > n_same + 1""")
def d46(spark, d):
    return G.sign_discordant(catalog(spark, d), ["protein", "variant"], "catalog", "catalog", "a1", "a2", "beta", "nlp", 0.5, 2)


#: Scores of a tube (its label: the participant) against genotypes: twenty times the kinship of label and genotype, ten times
#: the call rate for the label's own genotype, moved by the tube's mean value.
_SCORES = K.sql("""(with t as (select sample_ids tube, group_key who, avg(y_value) y from model_frame where platform = 'soma' and sample_ids is not null and group_key is not null and y_value is not null and not isnan(y_value) group by 1, 2),
  n as (select geno_usubjid geno, max(call_rate) c from genomes where geno_usubjid is not null and call_rate is not null group by 1)
  select tube, who, b geno, round(20 * k + y, 6) z from t join pairs on a = who union all select tube, who, geno, round(10 * c + y, 6) from t join n on geno = who)""")
_PAIRS = K.sql("pairs as (select a, b, max(k) k from (select usubjid_1 a, usubjid_2 b, kinship k from king_pairs union all select usubjid_2, usubjid_1, kinship from king_pairs) where a <> b and k is not null and not isnan(k) group by 1, 2)")
_GENO = K.sql("g as (select distinct geno_usubjid geno from genomes where geno_usubjid is not null)")


def kin_pairs(spark, d):
    k = K.table(spark, d, "king_pairs").where("usubjid_1 <> usubjid_2 and kinship is not null and not isnan(kinship)").select(F.col("usubjid_1").alias("a"), F.col("usubjid_2").alias("b"), F.col("kinship").alias("k"))
    return k.unionByName(k.select(F.col("b").alias("a"), F.col("a").alias("b"), "k")).groupBy("a", "b").agg(F.max("k").alias("k"))


def genotype_ids(spark, d):
    return K.table(spark, d, "genomes").where("geno_usubjid is not null").select(F.col("geno_usubjid").alias("geno")).distinct()


def tube_scores(spark, d):
    t = K.table(spark, d, "model_frame").where("platform = 'soma' and sample_ids is not null and group_key is not null and y_value is not null and not isnan(y_value)")
    t = t.groupBy(F.col("sample_ids").alias("tube"), F.col("group_key").alias("who")).agg(F.avg("y_value").alias("y"))
    own = K.table(spark, d, "genomes").where("geno_usubjid is not null and call_rate is not null").groupBy(F.col("geno_usubjid").alias("who")).agg(F.max("call_rate").alias("c"))
    far = t.join(kin_pairs(spark, d).withColumnRenamed("a", "who"), "who").select("tube", "who", F.col("b").alias("geno"), F.round(20 * F.col("k") + F.col("y"), 6).alias("z"))
    return far.unionByName(t.join(own, "who").select("tube", "who", F.col("who").alias("geno"), F.round(10 * F.col("c") + F.col("y"), 6).alias("z")))


_BEST = "arg_min({c}, (-z, geno)) filter ({f})"
_CONCORDANCE = f"""(with {_PAIRS}, {_GENO}, s as (select s.*, k, g.geno is not null genotyped, coalesce(g.geno is not null and k >= 0.0884, false) kin from {_SCORES} s left join pairs on a = who and b = s.geno left join g on g.geno = who),
  w as (select tube, who, bool_or(genotyped) genotyped, max(z) filter (geno = who) self_z, max(z) filter (geno <> who) best_z, {_BEST.format(c='geno', f='geno <> who')} best, {_BEST.format(c='k', f='geno <> who')} best_kinship,
    max(z) filter (geno <> who and not kin) nonrel_z, {_BEST.format(c='geno', f='geno <> who and not kin')} nonrel, max(z) filter (geno <> who and kin) rel_z, {_BEST.format(c='geno', f='geno <> who and kin')} rel, {_BEST.format(c='k', f='geno <> who and kin')} rel_kinship from s group by 1, 2)
  select tube, who, self_z, best_z, case when best_z >= 4 then best end best, case when best_z >= 4 and genotyped then best_kinship end best_kinship, nonrel_z, case when nonrel_z >= 4 then nonrel end nonrel, rel_z, case when rel_z >= 4 then rel end rel, case when rel_z >= 4 then rel_kinship end rel_kinship from w where self_z is not null or not genotyped)"""


def concordances(spark, d):
    return G.concordance(tube_scores(spark, d), genotype_ids(spark, d), kin_pairs(spark, d), 0.0884, 4.0)


@query("d48_self_best_scores", f"select * from {_CONCORDANCE}")
def d48(spark, d):
    return concordances(spark, d)


@query("d49_call_rule", f"""with c as {_CONCORDANCE}, a as (select who, count(nonrel) n, count(distinct nonrel) nd, min(nonrel) one from c group by 1), m as (select *,
    coalesce(self_z is not null and rel is not null and (nonrel_z is null or rel_z >= nonrel_z) and rel_z - self_z >= 0.5 and rel_kinship < 0.354, false) rel_named from c join a using (who))
  select tube, who, case when rel_named then rel end named_relative, case when rel_named or coalesce(self_z is not null and nonrel is not null and nonrel_z - self_z > 0.5, false) or coalesce(self_z < 8, false) or coalesce(self_z is null and n >= 2 and nd = 1 and nonrel = one, false) then 'mismatch'
    when coalesce(self_z >= 9.5, false) and not coalesce(best_z >= 4 and best_kinship >= 0.0884, false) then 'match' else 'none' end call from m""")
def d49(spark, d):
    rule = G.CallRule(best_min=4.0, margin=0.5, mismatch_floor=8.0, match_floor=9.5, relative_name_margin=0.5)
    return G.call_tubes(concordances(spark, d), F.lit(True), rule).select("tube", "who", "named_relative", "call")


@query("d40_slot_events", K.sql("""with f as (select sample_ids tube, group_key g, visitnum visit, row_id from model_frame where platform = 'soma' and sample_ids is not null and group_key is not null),
  t as (select tube, arg_min(g, row_id) subject, arg_min(visit, row_id) visit from f group by 1), p as (select tube, subject, min(g) target, any_value(t.visit) visit from t join f using (tube) where g <> subject group by 1, 2),
  h as (select subject target, visit, count(*) n, min(tube) slot from t group by 1, 2), k as (select p.*, h.slot, case when h.n is null then 'one_way' when h.n = 1 and q.target = p.subject then 'reciprocal' else 'duplicate_draw' end kind from p left join h on h.target = p.target and h.visit = p.visit left join p q on q.tube = h.slot),
  e0 as (select tube, slot, case when kind <> 'duplicate_draw' and count(*) filter (kind <> 'duplicate_draw') over (partition by target, visit) > 1 then 'collision' else kind end event from k),
  e1 as (select tube, slot, case when event = 'reciprocal' and slot not in (select tube from e0 where event in ('one_way', 'reciprocal')) then 'broken_pair' else event end event from e0),
  e2 as (select tube, slot, case when event = 'reciprocal' and slot not in (select tube from e1 where event in ('one_way', 'reciprocal')) then 'broken_pair' else event end event from e1) select tube, event from e2"""))
def d40(spark, d):
    """Tubes that stand under two participants as proposals to move from the first to the other."""
    f = K.table(spark, d, "model_frame").where("platform = 'soma' and sample_ids is not null and group_key is not null").select(F.col("sample_ids").alias("tube"), F.col("group_key").alias("g"), F.col("visitnum").alias("visit"), "row_id")
    t = f.groupBy("tube").agg(F.min_by("g", "row_id").alias("subject"), F.min_by("visit", "row_id").alias("visit"))
    p = t.join(f.select("tube", "g"), "tube").where("g <> subject").groupBy("tube", "subject").agg(F.min("g").alias("target"), F.min("visit").alias("visit"))
    return L.slot_events(t, p)


@query("d42_unfit_tubes", f"""with c as (with {_PAIRS}, {_GENO}, s as (select s.*, k from {_SCORES} s left join pairs on a = who and b = s.geno), r as (select *, row_number() over (partition by tube, who order by z desc, geno) i from s where geno <> who)
    select s.tube, s.who, max(s.z) filter (s.geno = s.who) self_z, max(r.z) filter (r.i = 1) best_z, max(r.z) filter (r.i = 2) second_z, coalesce(max(r.k) filter (r.i = 1) >= 0.0884, false) related from s left join r on r.tube = s.tube and r.who = s.who group by 1, 2),
  u as {K.sql("(select distinct sampleid tube from soma_long where rowcheck = 'FLAG' and sampletype = 'SAMPLE' and sampleid is not null)")}
  select tube, who, case when self_z is null then 'no_comparator' when self_z >= 10.2 then 'consistent_with_label' when best_z >= 4 and best_z - coalesce(second_z, '-inf'::double) >= 1 and not related then 'names_other_subject' else 'uninformative' end verdict from c join u using (tube)""")
def d42(spark, d):
    """Tubes with flagged rows: what their scores say of the label."""
    failed = K.table(spark, d, "soma_long").where("rowcheck = 'FLAG' and sampletype = 'SAMPLE' and sampleid is not null").select(F.col("sampleid").alias("tube")).distinct()
    s = tube_scores(spark, d).join(failed, "tube", "left_semi")
    two = R.best_two(s.where("geno <> who"), ["tube", "who"], "geno", "z").select("tube", "who", F.col("best").alias("other"), F.col("best_score").alias("best_z"), F.col("second_score").alias("second_z"))
    own = s.groupBy("tube", "who").agg(F.max(F.when(F.col("geno") == F.col("who"), F.col("z"))).alias("self_z"))
    kin = kin_pairs(spark, d).select(F.col("a").alias("who"), F.col("b").alias("other"), (F.col("k") >= 0.0884).alias("related"))
    rows = own.join(two, ["tube", "who"], "left").join(kin, ["who", "other"], "left")
    return rows.select("tube", "who", L.unfit_verdict(F.col("self_z"), F.col("best_z"), F.col("second_z"), F.col("related"), 10.2, 4.0, 1.0).alias("verdict"))


@query("d103_genotype_overlap", K.sql("select count(*) labelled, count(g) genotyped, round(count(g) / count(*), 6) share from (select distinct group_key k from model_frame where group_key is not null) left join (select distinct geno_usubjid g from genomes where geno_usubjid is not null) on g = k"))
def d103(spark, d):
    one = genotype_ids(spark, d)  # participants genotyped twice count once here; `genotype_overlap` fails on repeats
    return L.genotype_overlap(K.table(spark, d, "model_frame"), one, "group_key", "geno", 0.1).withColumn("share", F.round("share", 6))


@query("st36_components", K.sql("""with recursive p as (select usubjid_1 a, usubjid_2 b from king_pairs where kinship >= 0.354 and not isnan(kinship)), e as (select a, b from p where a <> b union select b, a from p where a <> b),
  walk(n, r) as (select a, a from e union select e.b, walk.r from walk join e on e.a = walk.n) select n as node, min(r) as root from walk group by n"""))
def st36(spark, d):
    return L.connected_components(K.table(spark, d, "king_pairs").where("kinship >= 0.354 and not isnan(kinship)"), "usubjid_1", "usubjid_2")


#: Calls on X and Y: a part's brand says where its variant lies.
_XY = "(select iid, variant, case when p_brand < 'Brand#25' then 'X' when p_brand > 'Brand#51' then 'Y' else '1' end chrom, dose from " + _DOSE + " join part on p_partkey = variant)"


@query("d51_class_from_rates", f"""with c as {_XY}, f as (select variant from c where chrom = 'X' group by 1 having least(sum(dose) / (2.0 * count(*)), 1 - sum(dose) / (2.0 * count(*))) > 0.05), h as (select iid, avg((dose = 1)::int) x_het from c join f using (variant) where chrom = 'X' group by 1),
  y as (select iid, count(distinct variant) n from c where chrom = 'Y' group by 1), t as (select count(distinct variant) n from c where chrom = 'Y'), r as (select iid, x_het, coalesce(y.n, 0) / t.n y_call from (select distinct iid from c) left join h using (iid) left join y using (iid), t)
  select iid, round(x_het, 6) x_het, round(y_call, 6) y_call, case when x_het >= 0.35 and y_call <= 0.03 then 'XX' when x_het <= 0.3 and y_call >= 0.045 then 'XY' when x_het >= 0.35 and y_call >= 0.045 then 'XXY' when x_het <= 0.3 and y_call <= 0.03 then 'X0' when x_het is not null then 'undetermined' end karyotype,
    case when x_het >= 0.35 and y_call <= 0.03 then 'F' when x_het <= 0.3 and y_call >= 0.045 then 'M' end sex from r""")
def d51(spark, d):
    """Karyotype and sex from rates; the cuts are parameters, here set to the spread of these calls."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("variant"), F.when(F.col("p_brand") < "Brand#25", "X").when(F.col("p_brand") > "Brand#51", "Y").otherwise("1").alias("chrom"))
    r = G.sex_rates(doses(spark, d).join(p, "variant"), "iid", "variant", "dose", "chrom")
    kind, sex = G.karyotype(F.col("x_het"), F.col("y_call"), 0.3, 0.35, 0.03, 0.045)
    return r.select("iid", F.round("x_het", 6).alias("x_het"), F.round("y_call", 6).alias("y_call"), kind.alias("karyotype"), sex.alias("sex"))


_PRED = f"(select iid geno, p_brand protein, sum(dose * beta) y from {_DOSE} join (select distinct p_brand, p_partkey variant, round(p_size / 10, 3) beta from part) using (variant) group by 1, 2)"
_OBS = "(select l_suppkey * 10 + l_linenumber tube, l_suppkey who, p_brand protein, avg(l_quantity * p_size) x from lineitem join part on p_partkey = l_partkey group by 1, 2, 3)"
_ZED = "select *, (x - avg(x) over (partition by {k})) / nullif(stddev_pop(x) over (partition by {k}), 0) zx from {t}"
_R = f"""o as ({_ZED.format(k='tube', t=_OBS)}), q as (select *, (y - avg(y) over (partition by geno)) / nullif(stddev_pop(y) over (partition by geno), 0) zy from {_PRED}),
  r as (select tube, any_value(who) who, geno, corr(zx, zy) r from o join q using (protein) where zx is not null and zy is not null group by tube, geno having count(*) >= 3 and stddev_pop(zx) > 0 and stddev_pop(zy) > 0)"""


def _observed(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("protein"), "p_size")
    li = table(spark, d, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey"))
    v = li.select((F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("tube"), F.col("l_suppkey").alias("who"), "protein", (F.col("l_quantity") * F.col("p_size")).alias("v"))
    return v.repartition("tube").groupBy("tube", "who", "protein").agg(F.avg("v").alias("x"))  # a tube's values are exchanged once, and stay together


def _predicted(spark, d):
    w = table(spark, d, "part").select(F.col("p_brand").alias("protein"), F.col("p_partkey").alias("variant"), F.round(F.col("p_size") / 10, 3).alias("beta"))
    return G.genotype_scores(doses(spark, d, "l_partkey"), w, "iid", "variant", "dose").select(F.col("iid").alias("geno"), "protein", F.col("predicted").alias("y"))


@query("d104_score_matrix", f"with {_R}, b as (select tube, median(r) m from r group by 1), a as (select tube, any_value(m) m, median(abs(r - m)) mad from r join b using (tube) group by 1) select tube, geno, round(r, 6) + 0.0 r, round((r - m) / (1.4826 * nullif(mad, 0)), 4) + 0.0 z from r join a using (tube)")
def d104(spark, d):
    """The chain from dosages and effects to scores: predicted levels per genotype, correlation with each tube, robust z."""
    return G.score_matrix(_observed(spark, d), _predicted(spark, d)).select("tube", "geno", F.round("r", 6).alias("r"), F.round("z", 4).alias("z"))


@query("st34_mixture_scores", f"""with {_R}, s as (select a.geno a, b.geno b, corr(a.zy, b.zy) rr from q a join q b using (protein) where a.geno <> b.geno and a.zy is not null and b.zy is not null group by 1, 2 having count(*) >= 3),
  u as (select r.tube, r.who, r.geno, (r.r - g.r * rr) / sqrt(1 - rr * rr) u from r join r g on g.tube = r.tube and g.geno = r.who join s on s.a = r.who and s.b = r.geno where r.geno <> r.who and 1 - rr * rr > 0.001),
  m as (select tube, median(u) m from u group by 1), d as (select tube, any_value(m) m, median(abs(u - m)) mad from u join m using (tube) group by 1) select tube, any_value(who) who, round(max((u - m) / (1.4826 * mad)), 4) mixture_z from u join d using (tube) where mad > 0 group by tube""")
def st34(spark, d):
    """Score of a second genotype in a tube beside its labelled one, over the chain's predictions."""
    got = G.matrix_mixtures(_observed(spark, d), _predicted(spark, d), least_left=0.001)
    return got.select("tube", "who", F.round("mixture_z", 4).alias("mixture_z"))


@query("s14_king_table_checks", K.sql("select count(*) pairs, count(*) filter (usubjid_1 = usubjid_2) self_pairs, count(*) filter (kinship is null or isnan(kinship)) no_kinship, (count(*) - count(distinct least(usubjid_1, usubjid_2) || '|' || greatest(usubjid_1, usubjid_2))) repeats from king_pairs"))
def s14(spark, d):
    k = K.table(spark, d, "king_pairs")
    return k.agg(
        F.count("*").alias("pairs"), F.count_if(F.col("usubjid_1") == F.col("usubjid_2")).alias("self_pairs"), F.count_if(F.col("kinship").isNull() | F.isnan("kinship")).alias("no_kinship"),
        (F.count("*") - F.count_distinct(F.concat_ws("|", F.least("usubjid_1", "usubjid_2"), F.greatest("usubjid_1", "usubjid_2")))).alias("repeats"),
    )


@query("d97_symmetric_pairs", K.sql("with p as (select least(usubjid_1, usubjid_2) a, greatest(usubjid_1, usubjid_2) b, max(kinship) k from king_pairs where usubjid_1 <> usubjid_2 and kinship is not null and not isnan(kinship) group by 1, 2) select a, b, k from p union all select b, a, k from p"))
def d97(spark, d):
    k = K.table(spark, d, "king_pairs").where("usubjid_1 <> usubjid_2 and kinship is not null and not isnan(kinship)")
    p = k.groupBy(F.least("usubjid_1", "usubjid_2").alias("a"), F.greatest("usubjid_1", "usubjid_2").alias("b")).agg(F.max("kinship").alias("k"))
    return p.unionByName(p.select(F.col("b").alias("a"), F.col("a").alias("b"), "k"))


@query("d50_genomes_per_subject", K.sql("select geno_usubjid, count(*) genomes, round(max(call_rate), 6) best_rate, arg_max(iid, (call_rate, iid)) best from genomes where geno_usubjid is not null and call_rate is not null group by 1"))
def d50(spark, d):
    g = K.table(spark, d, "genomes").where("geno_usubjid is not null and call_rate is not null")
    return g.groupBy("geno_usubjid").agg(F.count("*").alias("genomes"), F.round(F.max("call_rate"), 6).alias("best_rate"), F.max_by("iid", F.struct("call_rate", "iid")).alias("best"))


@query("d138_chromosome_names", "select n_nationkey, case x when '23' then 'X' when '24' then 'Y' when '25' then 'MT' else x end chrom from (select n_nationkey, (n_nationkey + 1)::varchar x from nation)")
def d138(spark, d):
    raw = F.concat(F.lit("chr"), F.lpad((F.col("n_nationkey") + 1).cast("string"), 2, "0"))
    return table(spark, d, "nation").select("n_nationkey", chromosome(raw).alias("chrom"))


@query("st41_neg_log10_p", f"select catalog, protein, variant, round(beta * 50, 4) + 0.0 z, round(case when abs(beta * 50) < 2 then -log10({sql_normal_two_sided('(beta * 50)')}) else {sql_normal_nlp('(beta * 50)')} end, 5) + 0.0 nlp from {_CAT}")
def st41(spark, d):
    """-log10 P recovered from estimate and standard error where the stored P underflows."""
    c = catalog(spark, d).select("catalog", "protein", "variant", (F.col("beta") * 50).alias("beta"), F.lit(1.0).alias("se"))
    return c.select("catalog", "protein", "variant", F.round("beta", 4).alias("z"), F.round(nlp_value("beta", "se"), 5).alias("nlp"))


QUERIES, ORACLES = REG.queries, REG.oracles
