"""Queries of sources, sinks, checks and orchestration: tables written and read again by the engine's
readers, compared with the tables themselves."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tallygrove.operators import relational as R
from tallygrove.plans.registry import Registry
from tallygrove.session import shared_dir
from tallygrove.sources import files as S
from tallygrove.sources.tables import table
from tallygrove.streaming.plates import plate_windows

REG = Registry()
query = REG.add


def scratch(spark, name):
    """A fresh folder below the shared one; Spark's writers and readers take it as it is."""
    return f"{shared_dir(spark)}/io-{name}-{uuid.uuid4().hex}"


@query("s1_scan_text_keeps_ids", "select row_id, sampleid, visitnum, accessionnumber from manifest where sampleid is not null and trim(sampleid) <> '' and (visitnum is null or not isnan(visitnum))")
def s1(spark, d):
    path = scratch(spark, "tsv") + ".tsv"
    m = table(spark, d, "manifest").where("sampleid is not null and trim(sampleid) <> '' and (visitnum is null or not isnan(visitnum))").select("row_id", "sampleid", "visitnum", "accessionnumber")
    m.write.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path, header=True, sep="\t", escape='"')
    text = spark.read.csv(path, header=True, sep="\t", nullValue="", escape='"')
    return S.typed_text(text).withColumn("visitnum", F.col("visitnum").cast("double"))


@query("s3_parquet_pushdown", "select l_orderkey, l_quantity from lineitem where l_shipdate >= timestamp '1998-06-01' and l_quantity > 40")
def s3(spark, d):
    return table(spark, d, "lineitem").where("l_shipdate >= timestamp_ntz '1998-06-01' and l_quantity > 40").select("l_orderkey", "l_quantity")


@query("s9_unpivot_scaled", "with u as (select usubjid, row_id, unnest(['weightbl', 'bmibl', 'wstcirbl']) assay, unnest([weightbl, bmibl, wstcirbl]) v from adsl), s as (select assay, avg(log10(v)) m, stddev_samp(log10(v)) sd from u where v > 0 and not isnan(v) group by 1) select row_id, assay, round((log10(v) - m) / sd, 6) scaled from u join s using (assay) where v > 0 and not isnan(v)")
def s9(spark, d):
    u = S.unpivot_matrix(table(spark, d, "adsl"), ["row_id"], ["weightbl", "bmibl", "wstcirbl"]).where("value > 0 and not isnan(value)")
    return S.scaled_log(u, "assay", "value", F.lit(True)).select("row_id", "assay", F.round("scaled", 6).alias("scaled"))


@query("s10_bundle", "select s.sampleid, count(*) n, round(sum(v.rfu), 4) total from (select distinct sampleid from soma_long where sampleid is not null) s join (select sampleid, rfu from soma_long where not isnan(rfu)) v using (sampleid) group by 1")
def s10(spark, d):
    folder = scratch(spark, "bundle")
    s = table(spark, d, "soma_long").where("sampleid is not null")
    S.write_bundle({"samples": s.select("sampleid").distinct(), "values": s.where("rfu is not null and not isnan(rfu)").select("sampleid", "rfu")}, folder)
    b = S.read_bundle(spark, folder, ["samples", "values"], {"samples": ["sampleid"]})
    return b["samples"].join(b["values"], "sampleid").groupBy("sampleid").agg(F.count("*").alias("n"), F.round(F.sum("rfu"), 4).alias("total"))


@query("s15_gene_sets", "select p_brand term, p_type gene, count(*) n from (select distinct p_brand, p_type from part) group by 1, 2")
def s15(spark, d):
    path = scratch(spark, "sets") + ".json"
    p = table(spark, d, "part").groupBy("p_brand").agg(F.array_sort(F.collect_set("p_type")).alias("g")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("p_brand", "g")))).alias("value"))
    p.coalesce(1).write.text(path)  # a library of brands, one JSON object
    return S.read_gene_sets(spark, path, "brands").groupBy("term", "gene").agg(F.count("*").alias("n"))


@query("s19_long_results", "with a as (select olinkid, case when avg(case when sampleqc <> 'PASS' then 1.0 else 0 end) > 0.055 then 'WARN' else 'PASS' end st from olink_long group by 1), s as (select sampleid, case when bool_and(sampleqc <> 'PASS') then 'FAIL' when bool_or(sampleqc <> 'PASS') then 'WARN' else 'PASS' end st from olink_long where sampleid is not null group by 1) select row_id, case when s.st = 'FAIL' or a.st = 'FAIL' then 'FAIL' when s.st = 'WARN' or a.st = 'WARN' then 'WARN' else 'PASS' end status from olink_long left join s using (sampleid) left join a using (olinkid)")
def s19(spark, d):
    o = table(spark, d, "olink_long")
    bad = F.col("sampleqc") != "PASS"
    a = o.groupBy("olinkid").agg(F.when(F.avg(bad.cast("double")) > 0.055, "WARN").otherwise("PASS").alias("status"))
    s = o.where("sampleid is not null").groupBy("sampleid").agg(F.when(F.bool_and(bad), "FAIL").when(F.bool_or(bad), "WARN").otherwise("PASS").alias("status"))
    return S.long_results(o.select("row_id", "sampleid", "olinkid"), s, a, "sampleid", "olinkid").select("row_id", "status")


@query("s22_partitioned_files", "select o_orderstatus, o_orderpriority, count(*) n, round(sum(o_totalprice), 2) total from orders group by 1, 2")
def s22(spark, d):
    folder = scratch(spark, "parts")
    S.write_partitioned(table(spark, d, "orders").select("o_orderstatus", "o_orderpriority", "o_totalprice"), folder, ["o_orderstatus", "o_orderpriority"])
    back = spark.read.parquet(folder)
    return back.groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("s16_file_digests")
def s16(spark, d):
    """Every parquet file of the folder's tables."""
    return S.file_digests(spark, f"{d}/*.parquet").select(F.regexp_extract("path", "[^/]+$", 0).alias("file"), "length", "sha256")


@query("o7_content_fingerprint", "select count(*) rows, count(distinct o_orderkey) keys from orders")
def o7(spark, d):
    o = table(spark, d, "orders")
    marked = R.content_hash(o, o.columns).select("rows", "total", "mixed")
    shuffled = R.content_hash(o.repartition(7, "o_custkey"), o.columns).select(F.col("total").alias("t2"), F.col("mixed").alias("m2"))
    same = marked.crossJoin(F.broadcast(shuffled)).where("total = t2 and mixed = m2").select("rows")
    return same.crossJoin(F.broadcast(o.agg(F.count_distinct("o_orderkey").alias("keys"))))


@query("stream_plate_windows", "select strftime(read_at, '%Y-%m-%d') as \"day\", plateid, count(*) readings, count(*) filter (rfu is not null and not isnan(rfu)) numbers, count(*) filter (rfu is not null and not isnan(rfu) and rfu >= lod and lod is not null) detected from soma_long where read_at is not null group by 1, 2")
def stream(spark, d):
    s = table(spark, d, "soma_long").where("read_at is not null").withColumn("lod", F.col("lod"))
    return plate_windows(s, "read_at", "plateid", "rfu", "lod")


QUERIES, ORACLES = REG.queries, REG.oracles
