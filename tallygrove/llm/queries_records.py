"""Queries of problems 1, 2, 5 and 6, with oracles where SQL can state the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrove.functions.ids import SQL_SUBJECT, SQL_TUBE, standard_subject, standard_tube
from tallygrove.llm.groups import group_every_record, match_groups
from tallygrove.llm.nearest import nearest_in_time
from tallygrove.llm.splits import component_splits, split_report
from tallygrove.llm.survivors import Bundle, Dependency, best_records, tube_ids
from tallygrove.sources.tables import table

TOLERANCE_S = 48 * 3600
KIN = 0.354
VISIT_OK = "visitnum is not null and not isnan(visitnum) and visitnum between 1 and 99"


def _tubes(spark: SparkSession, d: str) -> DataFrame:
    """Manifest rows with their tube, standard ids and the trust of their source (a fixed table of five rows)."""
    m = table(spark, d, "manifest")
    trust = table(spark, d, "record_sources").select("record_source", "trust_rank")
    tubes = tube_ids(m, "row_id", "sampleid", "accessionnumber").select(F.col("row").alias("row_id"), "tube")
    clean = m.withColumns({"sampleid": standard_tube(F.col("sampleid")), "usubjid": standard_subject(F.col("usubjid"))})
    return clean.join(tubes, "row_id").join(trust, "record_source", "left")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Barcode with accession and visit with its plan come as bundles; that an accession is one participant's decides
    between subjects of equal trust and recency, because the stated choice goes by these first."""
    best = best_records(
        _tubes(spark, d), "tube", "row_id", "trust_rank", "updated_at",
        [
            Bundle("draw", ["sampleid", "accessionnumber"], F.col("sampleid").isNotNull()),
            Bundle("subject", ["usubjid"]),
            Bundle("visit", ["visitnum", "visitnum_planned", "visitnum_source"], F.expr(VISIT_OK)),
        ],
        [Dependency("accessionnumber", "usubjid", binding=False)],
        least_rows=2,
    )
    return best.select(F.col("first_row").alias("first_row_id"), "sampleid", "usubjid", F.round(F.col("visitnum") * 10).cast("bigint").alias("visit_code"))


#: Codes of one accession that some code of ten digits is at most one changed digit or one swap away from are one tube;
#: each field then comes from its best usable row.
P1_SQL = f"""
with recursive m as (
  select m.row_id, {SQL_TUBE.format(x='sampleid')} code, {SQL_SUBJECT.format(x='usubjid')} who, nullif(upper(trim(accessionnumber)), '') scope,
    visitnum, coalesce(trust_rank, 1000000) rank, coalesce(epoch_us(updated_at), -4000000000000000000) upd
  from manifest m left join record_sources using (record_source)),
codes as (select distinct scope, code, substr(code, 4) c from m where scope is not null and regexp_full_match(code, 'TB-[0-9]{{10}}')),
k as (
  select scope, code, c k from codes
  union select scope, code, substr(c, 1, (p - 1)::int) || v || substr(c, (p + 1)::int) from codes, range(1, 11) t(p), range(0, 10) u(v)
  union select scope, code, substr(c, 1, (p - 1)::int) || substr(c, (p + 1)::int, 1) || substr(c, p::int, 1) || substr(c, (p + 2)::int) from codes, range(1, 10) t(p)),
e as (select distinct x.code a, y.code b from k x join k y on x.scope = y.scope and x.k = y.k and x.code <> y.code),
walk(n, r) as (select a, a from e union select e.b, walk.r from walk join e on e.a = walk.n),
tube as (select n, min(r) root from walk group by n),
r as (select coalesce(root, code) tube, m.* from m left join tube on n = code where code is not null)
select min(row_id) first_row_id,
  first(code order by rank, upd desc, row_id) sampleid,
  first(who order by rank, upd desc, row_id) filter (where who is not null) usubjid,
  cast(round(first(visitnum order by rank, upd desc, row_id) filter (where visitnum between 1 and 99 and not isnan(visitnum)) * 10) as bigint) visit_code
from r group by tube having count(*) >= 2
"""


def p1_bundles(spark: SparkSession, d: str) -> DataFrame:
    """Whole bundles: barcode with accession, visit with its plan and source, draw time with its source; one accession is one participant's."""
    best = best_records(
        _tubes(spark, d), "tube", "row_id", "trust_rank", "updated_at",
        [
            Bundle("draw", ["sampleid", "accessionnumber"], F.col("sampleid").isNotNull() & F.col("accessionnumber").isNotNull()),
            Bundle("subject", ["usubjid"]),
            Bundle("visit", ["visitnum", "visitnum_planned", "visitnum_source"], F.expr(VISIT_OK)),
            Bundle("date", ["adt", "adt_source", "adt_vendor"], F.col("adt").isNotNull()),
        ],
        [Dependency("accessionnumber", "usubjid")],
    )
    return best


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    m, v = table(spark, d, "manifest"), table(spark, d, "visit_records")
    who = standard_subject(F.col("usubjid"))
    found = nearest_in_time(m, v, (who, who), ("adt", "adt"), ("row_id", "row_id"), TOLERANCE_S)
    return found.select(F.col("row").alias("row_id"), F.col("match_row").alias("visit_row_id"))


P2_SQL = f"""
with m as (select row_id, {SQL_SUBJECT.format(x='usubjid')} u, epoch_us(adt) t from manifest where adt is not null),
v as (select row_id r, {SQL_SUBJECT.format(x='usubjid')} u, epoch_us(adt) t from visit_records where adt is not null)
select row_id, visit_row_id from (
  select m.row_id, v.r visit_row_id, row_number() over (partition by m.row_id order by abs(m.t - v.t), v.r) k
  from m join v on m.u = v.u and abs(m.t - v.t) <= {TOLERANCE_S * 1_000_000}) where k = 1
"""


def p5_splits(spark: SparkSession, d: str) -> DataFrame:
    got = component_splits(table(spark, d, "model_frame"), "row_id", "group_key", "sample_ids", table(spark, d, "split_targets"))
    return got.select("row_id", "split_name")


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "split_targets")
    return split_report(component_splits(table(spark, d, "model_frame"), "row_id", "group_key", "sample_ids", targets), targets)


def p5_kept_together(spark: SparkSession, d: str) -> DataFrame:
    """Rows, participants and tubes, how many of them stand in two splits, and whether all shares are within 0.02 of their targets."""
    frame, targets = table(spark, d, "model_frame"), table(spark, d, "split_targets")
    got = component_splits(frame, "row_id", "group_key", "sample_ids", targets)
    named = frame.select("row_id", standard_subject(F.col("group_key")).alias("who"), standard_tube(F.col("sample_ids")).alias("tube")).join(got, "row_id")
    of = lambda key: named.where(F.col(key).isNotNull()).groupBy(key).agg((F.min("split_name") != F.max("split_name")).cast("int").alias("torn")).agg(F.count("*").alias(f"{key}s"), F.coalesce(F.sum("torn"), F.lit(0)).alias(f"torn_{key}s"))
    near = split_report(got, targets).agg(F.max(F.abs(F.col("actual_share") - F.col("target_share"))).alias("miss")).select((F.col("miss") < 0.02).alias("near_targets"))
    return got.agg(F.count("*").alias("rows"), F.count("split_name").alias("placed")).crossJoin(of("who")).crossJoin(of("tube")).crossJoin(near)  # one row each


P5_SQL = f"""
select count(*) as rows, count(*) as placed, count(distinct {SQL_SUBJECT.format(x='group_key')}) as whos, 0 as torn_whos,
  count(distinct {SQL_TUBE.format(x='sample_ids')}) as tubes, 0 as torn_tubes, true as near_targets from model_frame
"""


def _kin_groups(spark: SparkSession, d: str) -> DataFrame:
    return match_groups(table(spark, d, "king_pairs"), "usubjid_1", "usubjid_2", "kinship", KIN)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _kin_groups(spark, d).select(F.col("node").alias("geno_usubjid"), "group_id")


P6_SQL = f"""
with recursive p as (
  select {SQL_SUBJECT.format(x='usubjid_1')} a, {SQL_SUBJECT.format(x='usubjid_2')} b from king_pairs where kinship >= {KIN} and not isnan(kinship)),
e as (select a, b from p where a <> b union select b, a from p where a <> b),
walk(n, r) as (select a, a from e union select e.b, walk.r from walk join e on e.a = walk.n)
select n as geno_usubjid, min(r) as group_id from walk group by n
"""


def p6_genomes(spark: SparkSession, d: str) -> DataFrame:
    """Every genome with its group, alone or not."""
    got = group_every_record(table(spark, d, "genomes"), "geno_usubjid", _kin_groups(spark, d))
    return got.select("row_id", "iid", "geno_usubjid", F.col("match_group_id").alias("group_id"))


QUERIES = {"p1_found": p1_found, "p1_bundles": p1_bundles, "p2_found": p2_found, "p5_splits": p5_splits, "p5_report": p5_report, "p5_kept_together": p5_kept_together, "p6_found": p6_found, "p6_genomes": p6_genomes}
ORACLES = {"p1_found": P1_SQL, "p2_found": P2_SQL, "p5_kept_together": P5_SQL, "p6_found": P6_SQL}
