"""References to records that do not exist, are deleted, or arrive later (problem 4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of the time slots that split a key with many events.
SLOT_US = 7 * 86_400 * 1_000_000


def _micros(value: Column) -> Column:
    return F.unix_micros(value.cast("timestamp"))


def covered_at(probes: DataFrame, intervals: DataFrame) -> DataFrame:
    """The probes (k, t) at which at least one interval [start, stop) of the same key holds.

    Starts minus stops up to t, counted in order. Each key is split into weekly slots; a slot begins with the count the
    earlier slots hand over, so a key with any number of events is spread over many tasks. Null stops never end;
    intervals that stop before they start hold nowhere.
    """
    sound = intervals.where(F.col("start").isNotNull() & (F.col("stop").isNull() | (F.col("stop") > F.col("start"))))
    moves = (
        sound.select("k", F.col("start").alias("t"), F.lit(1).alias("d"))
        .unionByName(sound.where(F.col("stop").isNotNull()).select("k", F.col("stop").alias("t"), F.lit(-1).alias("d")))
        .groupBy("k", "t")
        .agg(F.sum("d").alias("d"))
    )
    slot = F.floor(F.col("t") / F.lit(SLOT_US)).cast("long")
    asked = probes.select("k", "t").distinct().withColumn("slot", slot)
    moves = moves.withColumn("slot", slot)
    # the count at the start of every slot that has probes
    marks = moves.groupBy("k", "slot").agg(F.sum("d").alias("d")).unionByName(asked.select("k", "slot").distinct().withColumn("d", F.lit(0).cast("long")))
    marks = marks.groupBy("k", "slot").agg(F.sum("d").alias("d"))
    before = Window.partitionBy("k").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    opening = marks.select("k", "slot", (F.col("slot") * SLOT_US - 1).alias("t"), F.coalesce(F.sum("d").over(before), F.lit(0)).alias("d"))
    lines = (
        opening.select("k", "slot", "t", "d", F.lit(0).alias("ask"))
        .unionByName(moves.select("k", "slot", "t", "d", F.lit(0).alias("ask")))
        .unionByName(asked.select("k", "slot", "t", F.lit(0).cast("long").alias("d"), F.lit(1).alias("ask")))
    )
    running = Window.partitionBy("k", "slot").orderBy("t", "ask").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.withColumn("held", F.sum("d").over(running)).where("ask = 1 and held > 0").select("k", "t")


def orphan_references(
    children: DataFrame,
    parents: DataFrame,
    row: str,
    key: Column,
    at: str,
    parent_key: Column,
    parent_from: str,
    parent_until: str | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """(row, kind, *keep) for each child row whose key has no parent at the row's own time.

    kind: `missing` (no parent row at any time), `late` (all parents come later), else `deleted`. A parent holds from
    `parent_from` until just before `parent_until` (null: for good). Null keys refer to nothing and are no orphans; a
    null child time counts as after everything, a null parent time as never loaded. Parents are reduced to one row per
    key, children to distinct (key, time) references; the few references that fall between the withdrawal and return of
    a parent are counted out exactly. Only orphan references are joined back to the rows.
    """
    end = F.lit(2**62)
    kids = children.select(F.col(f"`{row}`").alias("r"), key.alias("k"), F.coalesce(_micros(F.col(f"`{at}`")), end).alias("t"), *[F.col(f"`{c}`").alias(f"keep{i}") for i, c in enumerate(keep)]).where(F.col("k").isNotNull())
    stop = _micros(F.col(f"`{parent_until}`")) if parent_until else F.lit(None).cast("long")
    folk = parents.select(parent_key.alias("k"), _micros(F.col(f"`{parent_from}`")).alias("start"), stop.alias("stop")).where(F.col("k").isNotNull())
    known = folk.groupBy("k").agg(F.min("start").alias("first"), F.min(F.when(F.col("stop").isNull(), F.col("start"))).alias("open"))

    refs = kids.select("k", "t").distinct()
    missing = refs.join(known, "k", "left_anti").select("k", "t", F.lit("missing").alias("kind"))
    met = refs.join(known, "k")
    late = F.col("first").isNull() | (F.col("t") < F.col("first"))
    settled = met.where(late).select("k", "t", F.lit("late").alias("kind"))
    found = missing.unionByName(settled)
    if parent_until:
        doubt = met.where(~late & (F.col("open").isNull() | (F.col("t") < F.col("open")))).select("k", "t")
        closing = folk.join(folk.where(F.col("stop").isNotNull()).select("k").distinct(), "k", "left_semi")
        found = found.unionByName(doubt.join(covered_at(doubt, closing), ["k", "t"], "left_anti").select("k", "t", F.lit("deleted").alias("kind")))
    return kids.join(found, ["k", "t"]).select(F.col("r").alias(row), "kind", *[F.col(f"keep{i}").alias(c) for i, c in enumerate(keep)])
