"""Matching records of two tables by nearest time (problem 2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallygrove.session import Stash

#: Records of one entity in one bucket that are ordered in one piece, and cells that a fuller bucket is cut into.
FULL, CELLS = 200_000, 4096


def nearest_in_time(
    left: DataFrame,
    right: DataFrame,
    entity: tuple[Column, Column],
    when: tuple[str, str],
    row: tuple[str, str],
    tolerance_s: int,
    keep_unmatched: bool = False,
    full: int = FULL,
) -> DataFrame:
    """(row, match_row, gap_us): the right record of the same entity nearest in time to each left record, at most the
    tolerance away, the smallest row id among equally near ones.

    Both sides fall into buckets as wide as the tolerance, so a partner can only be in the same or an adjacent bucket.
    Before the join, right records with one time are reduced to their smallest row id, and of an adjacent bucket only
    its last (earlier bucket) or first (later bucket) record can be the nearest: one record per entity and bucket is
    handed over. Within the bucket, the neighbours before and after come from one ordered pass. So no pairs are
    enumerated, however many records one entity has in one bucket. Left rows of one entity at one instant ask once. Buckets
    with more than `full` records of one entity are cut into cells, which hand their border records on in the same way. Null entities or times match nothing (with
    `keep_unmatched` such rows come out with null partner). Repeated left rows each get their partner.
    """
    span = int(tolerance_s) * 1_000_000

    def tidy(df: DataFrame, who: Column, at: str, rid: str) -> DataFrame:
        us = F.unix_micros(F.col(f"`{at}`").cast("timestamp"))
        return df.select(who.alias("e"), us.alias("t"), F.col(f"`{rid}`").alias("r")).withColumn("b", F.floor(F.col("t") / F.lit(span)).cast("long"))

    ours, theirs = tidy(left, entity[0], when[0], row[0]), tidy(right, entity[1], when[1], row[1])
    given = F.col("e").isNotNull() & F.col("t").isNotNull()
    rows = ours.where(given)
    # rows of one entity at one instant have one answer, so each instant asks once
    asked = rows.select("e", "b", "t").distinct()
    known = theirs.where(given).groupBy("e", "b", "t").agg(F.min("r").alias("r"))

    load = asked.select("e", "b").unionByName(known.select("e", "b")).groupBy("e", "b").count().where(F.col("count") > full)
    crowded = Stash(left.sparkSession).keep(load.select("e", "b"), "crowded")
    if crowded.isEmpty():
        asked, known = asked.withColumn("c", F.lit(0).cast("long")), known.withColumn("c", F.lit(0).cast("long"))
    else:
        cell = F.when(F.col("hot"), F.floor(F.col("t") / F.lit(span / CELLS)).cast("long")).otherwise(F.lit(0))
        celled = lambda df: df.join(crowded.withColumn("hot", F.lit(True)), ["e", "b"], "left").withColumn("c", cell).drop("hot")
        asked, known = celled(asked), celled(known)
    borders = known.groupBy("e", "b", "c").agg(F.min(F.struct("t", "r")).alias("first"), F.max(F.struct("t", "r")).alias("last"))
    edges = borders if crowded.isEmpty() else borders.groupBy("e", "b").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    # what the neighbours of bucket b hand to it
    offered = edges.select("e", (F.col("b") + 1).alias("b"), F.col("last").alias("o")).unionByName(edges.select("e", (F.col("b") - 1).alias("b"), F.col("first").alias("o")))
    if crowded.isEmpty():
        offered = offered.withColumn("c", F.lit(0).cast("long"))
    else:
        # to every cell that asks: what its bucket was handed, and the borders of the nearest cells that have records
        cells = asked.select("e", "b", "c").distinct().join(borders, ["e", "b", "c"], "full")
        up, down = Window.partitionBy("e", "b").orderBy("c"), Window.partitionBy("e", "b").orderBy(F.desc("c"))
        earlier = F.last("last", ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, -1))
        later = F.last("first", ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, -1))
        inner = cells.select("e", "b", "c", earlier.alias("p"), later.alias("n")).select("e", "b", "c", F.explode(F.array("p", "n")).alias("o")).where("o is not null")
        offered = asked.select("e", "b", "c").distinct().join(offered, ["e", "b"]).select("e", "b", "c", "o").unionByName(inner)
    blank = F.lit(None).cast(known.schema["r"].dataType).alias("r")
    every = (
        asked.select("e", "b", "c", "t", blank, F.lit(1).alias("side"))
        .unionByName(known.select("e", "b", "c", "t", "r", F.lit(0).alias("side")))
        .unionByName(offered.select("e", "b", "c", F.col("o.t").alias("t"), F.col("o.r").alias("r"), F.lit(0).alias("side")))
    )
    ordered = Window.partitionBy("e", "b", "c").orderBy("t", "side")
    point = F.when(F.col("side") == 0, F.struct("t", "r"))
    before = F.last(point, ignorenulls=True).over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    # a frame of following rows is not incremental: the neighbour after comes from the pass in falling order
    backwards = Window.partitionBy("e", "b", "c").orderBy(F.desc("t"), F.desc("side"))
    after = F.last(point, ignorenulls=True).over(backwards.rowsBetween(Window.unboundedPreceding, -1))
    near = every.select("e", "t", "side", before.alias("p"), after.alias("n")).where("side = 1")
    gap = lambda x: F.abs(F.col("t") - F.col(f"{x}.t"))
    best = F.least(
        F.when(gap("p") <= span, F.struct(gap("p").alias("gap"), F.col("p.r").alias("r"))),
        F.when(gap("n") <= span, F.struct(gap("n").alias("gap"), F.col("n.r").alias("r"))),
    )
    answers = near.select("e", "t", best.alias("best")).where(F.col("best").isNotNull())
    if keep_unmatched:
        found = ours.join(answers, ["e", "t"], "left").select(F.col("r").alias("row"), "best")
    else:
        found = rows.join(answers, ["e", "t"]).select(F.col("r").alias("row"), "best")
    return found.select("row", F.col("best.r").alias("match_row"), F.col("best.gap").alias("gap_us"))
