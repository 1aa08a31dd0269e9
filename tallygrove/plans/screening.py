"""Queries of problems 3 and 4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrove.functions.ids import SQL_SUBJECT, SQL_TUBE, standard_subject, standard_tube
from tallygrove.operators.charts import Chart, control_chart, readings_of
from tallygrove.operators.orphans import orphan_references
from tallygrove.sources.tables import table

#: Table, value column, analyte column, whether values are charted on the log2 scale.
PLATFORMS = (("soma_long", "rfu", "seqid", True), ("olink_long", "npx", "olinkid", False))


def _flags(spark: SparkSession, d: str, chart: Chart = Chart()) -> DataFrame:
    limits = {r[0]: (r[1], r[2]) for r in table(spark, d, "platform_limits").select("src_table", "min_possible", "max_possible").collect()}  # two rows
    every = None
    for i, (name, value, analyte, log) in enumerate(PLATFORMS):
        rows = table(spark, d, name).where(~F.col("sampletype").eqNullSafe("NEGATIVE_CONTROL"))
        low, high = (F.lit(x).cast("double") for x in limits.get(name, (None, None)))
        part = readings_of(rows, i, "row_id", ("plateid", analyte), "read_at", value, log, low, high)
        every = part if every is None else every.unionByName(part)
    name_of = F.element_at(F.array(*[F.lit(p[0]) for p in PLATFORMS]), F.col("s") + 1)
    return control_chart(every, chart).select(name_of.alias("src_table"), F.col("r").alias("row_id"), "kind")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _flags(spark, d).select("src_table", "row_id")


def p3_kinds(spark: SparkSession, d: str) -> DataFrame:
    return _flags(spark, d).groupBy("src_table", "kind").agg(F.count("*").alias("readings"))


def p3_limits_and_runs(spark: SparkSession, d: str) -> DataFrame:
    """What the charts say without their spikes: readings that cannot be, and runs of equal ones."""
    return _flags(spark, d, Chart(limit=float("inf")))


P3_RUNS_SQL = """
with c as (
  select 'soma_long' src_table, row_id, plateid || '/' || seqid source, read_at t, rfu v from soma_long where sampletype is distinct from 'NEGATIVE_CONTROL' and rfu is not null and not isnan(rfu) union all
  select 'olink_long', row_id, plateid || '/' || olinkid, read_at, npx from olink_long where sampletype is distinct from 'NEGATIVE_CONTROL' and npx is not null and not isnan(npx)),
w as (select *, v is distinct from lag(v) over (partition by src_table, source order by t, row_id) turn from c),
r as (select *, sum(turn::int) over (partition by src_table, source order by t, row_id) run from w),
n as (select src_table, source, run from r group by 1, 2, 3 having count(distinct t) >= 5)
select src_table, row_id, case when v < min_possible or v > max_possible then 'limit' else 'stuck' end kind
from r join platform_limits using (src_table) left join n using (src_table, source, run) where v < min_possible or v > max_possible or n.run is not null
"""


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    adsl, manifest = table(spark, d, "adsl"), table(spark, d, "manifest")
    subject, tube = standard_subject(F.col("usubjid")), standard_tube(F.col("sampleid"))
    every = None
    for name in ("manifest", "visit_records", "soma_long", "olink_long"):
        rows = table(spark, d, name)
        if name in ("manifest", "visit_records"):
            found = orphan_references(rows, adsl, "row_id", subject, "loaded_at", subject, "loaded_at", "deleted_at", keep=("loaded_at",))
        else:
            found = orphan_references(rows.where("sampletype = 'SAMPLE'"), manifest, "row_id", tube, "loaded_at", tube, "loaded_at", keep=("loaded_at",))
        found = found.select(F.lit(name).alias("src_table"), "row_id", "kind", "loaded_at")
        every = found if every is None else every.unionByName(found)
    return every


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("src_table", "row_id", "kind")


def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    """Orphans per table and month of loading."""
    return _orphans(spark, d).groupBy("src_table", F.date_format("loaded_at", "yyyy-MM").alias("period"), "kind").agg(F.count("*").alias("orphans"))


_U, _S = SQL_SUBJECT.format(x="usubjid"), SQL_TUBE.format(x="sampleid")
_P4 = f"""
with ps as (select {_U} k, loaded_at f, deleted_at u from adsl), pm as (select {_S} k, loaded_at f, null::timestamp u from manifest),
c as (
  select 'manifest' src_table, row_id, {_U} k, loaded_at t, 's' p from manifest union all
  select 'visit_records', row_id, {_U}, loaded_at, 's' from visit_records union all
  select 'soma_long', row_id, {_S}, loaded_at, 'm' from soma_long where sampletype = 'SAMPLE' union all
  select 'olink_long', row_id, {_S}, loaded_at, 'm' from olink_long where sampletype = 'SAMPLE'),
p as (select 's' p, * from ps where k is not null union all select 'm', * from pm where k is not null),
j as (
  select c.src_table, c.row_id, c.t, count(p.k) n, min(p.f) first,
    coalesce(bool_or(p.f <= c.t and (p.u is null or p.u > c.t)), false) ok
  from c left join p on c.p = p.p and c.k = p.k where c.k is not null group by c.src_table, c.row_id, c.t)
select src_table, row_id, t, case when n = 0 then 'missing' when first > t then 'late' else 'deleted' end kind from j where not ok
"""
P4_SQL = f"select src_table, row_id, kind from ({_P4})"
P4_COUNTS_SQL = f"select src_table, strftime(t, '%Y-%m') period, kind, count(*) orphans from ({_P4}) group by 1, 2, 3"

QUERIES = {"p3_found": p3_found, "p3_kinds": p3_kinds, "p3_limits_and_runs": p3_limits_and_runs, "p4_found": p4_found, "p4_counts": p4_counts}
ORACLES = {"p3_limits_and_runs": P3_RUNS_SQL, "p4_found": P4_SQL, "p4_counts": P4_COUNTS_SQL}
