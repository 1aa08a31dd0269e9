"""Queries of problem 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrove.llm.quantiles import LEVEL0, merged_quantiles, scan_tasks, sketch_levels
from tallygrove.sources.tables import table

PROBS = (0.001, 0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 0.999)
TABLES = (("soma_long", "rfu", "seqid"), ("olink_long", "npx", "olinkid"))


def _percentiles(spark: SparkSession, d: str, levels: tuple[str, ...]) -> DataFrame:
    every, tasks = None, 0
    for name, value, analyte in TABLES:
        t = F.lit(name)
        a = F.col(analyte)
        sets = {"analyte": [t, a], "sampletype": [t, a, F.col("sampletype")], "plate": [t, a, F.col("plateid")], "day": [t, a, F.date_format("read_at", "yyyy-MM-dd")]}
        part = sketch_levels(table(spark, d, name), {value: F.col(value), "lod": F.col("lod")}, {k: sets[k] for k in levels})
        tasks += scan_tasks(table(spark, d, name))
        every = part if every is None else every.unionByName(part)
    return merged_quantiles(every, PROBS, tasks)


def _named(q: DataFrame) -> DataFrame:
    return q.select(
        F.col("key")[0].alias("src_table"), "measure", F.col("key")[1].alias("analyte"), "level", F.try_element_at("key", F.lit(3)).alias("part"), "n",
        *[F.col("q")[i].alias(_label(p)) for i, p in enumerate(PROBS)],
    )


def _label(p: float) -> str:
    return "p" + f"{p * 100:g}".replace(".", "_")


def p7_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles per analyte, and per analyte and sampletype, plate or day."""
    return _named(_percentiles(spark, d, ("analyte", "sampletype", "plate", "day")))


def p7_days_combined(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles per analyte and calendar month, merged from the finished sketches of the days."""
    day = F.col("key")[2]
    months = _percentiles(spark, d, ("day",)).select(
        F.lit("month").alias("level"), F.array(F.col("key")[0], F.col("key")[1], F.substring(day, 1, 7)).alias("key"), "measure",
        F.coalesce(F.unix_date(day.cast("date")), F.lit(-1)).cast("long").alias("part"), F.lit(0).cast("long").alias("seq"), "sketch",
    )
    return _named(merged_quantiles(months, PROBS))


def p7_plates(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles per analyte and plate of groups that the sketch holds whole: there they are exact."""
    return _named(_percentiles(spark, d, ("plate",))).where(F.col("n") <= LEVEL0).drop("level")


P7_PLATES_SQL = " union all ".join(
    f"select '{name}' as src_table, '{m}' as measure, {a} as analyte, plateid as part, count(*) as n, "
    + ", ".join(f"quantile_disc({m}, {p}) as {_label(p)}" for p in PROBS)
    + f" from {name} where {m} is not null and not isnan({m}) group by {a}, plateid having count(*) <= {LEVEL0}"
    for name, value, a in TABLES
    for m in (value, "lod")
)

QUERIES = {"p7_percentiles": p7_percentiles, "p7_days_combined": p7_days_combined, "p7_plates": p7_plates}
ORACLES = {"p7_plates": P7_PLATES_SQL}
