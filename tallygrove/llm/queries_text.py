"""Queries of problems 8, 9 and 10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrove.llm.bpe import count_tokens, encode_corpus
from tallygrove.llm.mixing import mix_report, mix_sources
from tallygrove.llm.subjects import document_areas, fit_areas
from tallygrove.sources.tables import table


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(table(spark, d, "documents"))


def p8_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Token counts per source and language."""
    docs = table(spark, d, "documents")
    sizes = count_tokens(docs.select(F.struct("source", "lang").alias("of"), "text"), "of")
    return sizes.groupBy(F.col("of.source").alias("source"), F.upper("of.lang").alias("lang")).agg(F.count("*").alias("documents"), F.sum("n_tokens").alias("tokens"), F.max("n_tokens").alias("longest"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "mix_targets")
    return mix_report(mix_sources(table(spark, d, "documents"), targets), targets)


def p9_met(spark: SparkSession, d: str) -> DataFrame:
    """Listed sources with texts: their weight among these, and whether tokens (to within the longest document) and uses meet the targets."""
    targets = table(spark, d, "mix_targets")
    mix = mix_sources(table(spark, d, "documents"), targets)
    longest = mix.agg(F.max("n_tokens").alias("longest"))
    report = mix_report(mix, targets).where(F.col("target_weight").isNotNull() & (F.col("tokens") > 0))
    whole = report.agg(F.sum("target_weight").alias("live"), F.sum("mixed_tokens").alias("all_mixed"))
    weight = F.col("target_weight") / F.col("live")
    near = F.abs(F.col("mixed_tokens") - weight * F.col("all_mixed")) <= F.col("longest")
    return report.crossJoin(whole).crossJoin(longest).select("source", F.round(weight, 6).alias("weight"), "documents", near.alias("share_met"), (F.col("most_uses") <= F.col("max_repeats")).alias("cap_met"))  # one row each


P9_MET_SQL = """
select t.source, round(target_weight / sum(target_weight) over (), 6) as weight, n as documents, true as share_met, true as cap_met
from mix_targets t join (select source, count(*) n from documents group by source having max(length(text)) > 0) using (source)
"""


def _areas(spark: SparkSession, d: str, held_out: int | None = None) -> DataFrame:
    docs, labels = table(spark, d, "documents"), table(spark, d, "area_labels")
    names = [r[0] for r in table(spark, d, "subject_areas").select("area").orderBy("area").collect()]  # ten rows
    return document_areas(docs, fit_areas(docs, labels, names, held_out=held_out))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _areas(spark, d).select("doc_id", "area")


def p10_makeup(spark: SparkSession, d: str) -> DataFrame:
    """Documents and subject sentences of each area, and their share of all documents."""
    found = _areas(spark, d)
    docs = table(spark, d, "documents").agg(F.count("*").alias("all_documents"))
    per = found.groupBy("area").agg(F.count("*").alias("documents"), F.sum("sentences").alias("sentences"))
    return per.crossJoin(F.broadcast(docs)).withColumn("share", F.round(F.try_divide(F.col("documents").cast("double"), "all_documents"), 6)).drop("all_documents")


def p10_held_out(spark: SparkSession, d: str) -> DataFrame:
    """Precision and recall per area on the tenth of the labelled documents that the fit leaves out."""
    held = F.pmod(F.xxhash64(F.lit("held"), "doc_id"), F.lit(10)) == 0
    labels = table(spark, d, "area_labels").select("doc_id", "area").distinct().where(held)
    found = _areas(spark, d, held_out=0).where(held).select("doc_id", "area").join(labels.select("doc_id").distinct(), "doc_id", "left_semi")
    both = labels.withColumn("given", F.lit(1)).join(found.withColumn("got", F.lit(1)), ["doc_id", "area"], "full")
    hit = F.count(F.when(F.col("given").isNotNull() & F.col("got").isNotNull(), 1))
    return both.groupBy("area").agg(F.count("given").alias("labelled"), F.count("got").alias("found"), F.round(F.try_divide(hit.cast("double"), F.count("got")), 4).alias("precision"), F.round(F.try_divide(hit.cast("double"), F.count("given")), 4).alias("recall"))


QUERIES = {"p8_ids": p8_ids, "p8_lengths": p8_lengths, "p9_mix": p9_mix, "p9_shares": p9_shares, "p9_met": p9_met, "p10_found": p10_found, "p10_makeup": p10_makeup, "p10_held_out": p10_held_out}
ORACLES = {"p9_met": P9_MET_SQL}
