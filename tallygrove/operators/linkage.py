"""Record linkage: corrections by digest, draw dates and visits by source priority, placement of draws into visits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrove.functions.text import digest
from tallygrove.session import Stash


def apply_corrections(rows: DataFrame, corrections: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Rows with fields replaced where a correction names the row's key by its SHA-256.

    `corrections` is (digest, field, value), one entry per digest and field; two entries for one cell fail the plan. Other
    rows are unchanged. The table of corrections is small by nature, yet the join leaves its strategy to the optimizer.
    """
    clash = F.raise_error(F.concat(F.lit("two corrections of "), F.first("field"))).cast("string")
    cells = corrections.groupBy("digest", "field").agg(F.when(F.count("*") > 1, clash).otherwise(F.first("value")).alias("value"))
    wide = cells.groupBy("digest").agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f"__tg_{f}") for f in fields])
    joined = rows.withColumn("__tg_digest", digest(F.col(key))).join(wide.withColumnRenamed("digest", "__tg_digest"), "__tg_digest", "left")
    kinds = dict(rows.dtypes)
    fixed = {f: F.coalesce(F.col(f"__tg_{f}").cast(kinds[f]), F.col(f)) for f in fields}
    touched = F.lit(False)
    for f in fields:
        touched = touched | F.col(f"__tg_{f}").isNotNull()
    return joined.select(*[fixed.get(c, F.col(c)).alias(c) for c in rows.columns], touched.alias("corrected"))


def unused_corrections(rows: DataFrame, corrections: DataFrame, key: str) -> DataFrame:
    """Corrections whose digest no row has, or more than one key has."""
    named = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("k")).distinct().select(digest(F.col("k")).alias("digest"))
    hits = named.groupBy("digest").agg(F.count("*").alias("keys"))
    return corrections.select("digest").distinct().join(hits, "digest", "left").where(F.coalesce("keys", F.lit(0)) != 1).select("digest", F.coalesce("keys", F.lit(0)).alias("keys"))


def prioritised(*sources: tuple[str, Column]) -> tuple[Column, Column, Column]:
    """(value, its source, whether the given sources disagree) by order of preference."""
    value = F.coalesce(*[c for _, c in sources])
    name = F.lit(None).cast("string")
    for label, c in reversed(sources):
        name = F.when(c.isNotNull(), F.lit(label)).otherwise(name)
    given = F.array_compact(F.array(*[c for _, c in sources]))
    return value, name, F.size(F.array_distinct(given)) > 1


def accession_tokens(rows: DataFrame, row: str, label: str, sep: str = "[,; ]+") -> DataFrame:
    """(row, position, token): trimmed non-blank labels of a delimited text, in order, first of equals."""
    parts = F.filter(F.transform(F.split(F.col(label), sep), lambda x: F.upper(F.trim(x))), lambda x: x != "")
    return rows.select(row, F.posexplode(F.array_distinct(parts)).alias("position", "token"))


def visit_records(frames: Sequence[DataFrame], columns: Sequence[str]) -> DataFrame:
    """Distinct dated records of several sources, with null where a source lacks a column; rows without date or subject are left out."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.select(*columns).where(F.col(columns[0]).isNotNull() & F.col(columns[1]).isNotNull()).distinct()


def place(rows: DataFrame, records: DataFrame, row: str, subject: str, day: str, label: str, record_day: str, record_label: str, tolerance: int) -> DataFrame:
    """(row, placed, gap, reason): the visit label of the subject's record nearest in days, within the tolerance.

    Rows meet only records of their subject on the days around them (the day is part of the join key). reason: `same`
    (the row's own label), `moved` (another label), `tie` (equally near records with different labels: not placed),
    `none` (no record near), `undated`.
    """
    near = rows.where(F.col(day).isNotNull()).select(row, subject, F.col(day).alias("__d"), F.explode(F.sequence(F.date_sub(day, tolerance), F.date_add(day, tolerance))).alias("__day"))
    known = records.where(F.col(record_day).isNotNull() & F.col(record_label).isNotNull()).select(subject, F.col(record_day).alias("__day"), F.col(record_label).alias("__label")).distinct()
    met = near.join(known, [subject, "__day"]).withColumn("__gap", F.abs(F.datediff("__day", "__d")))
    per = met.groupBy(row, "__gap").agg(F.min("__label").alias("lo"), F.max("__label").alias("hi"))
    best = per.groupBy(row).agg(F.min(F.struct("__gap", "lo", "hi")).alias("b"))
    found = rows.select(row, label, day).join(best, row, "left")
    reason = F.when(F.col(day).isNull(), "undated").when(F.col("b").isNull(), "none").when(F.col("b.lo") != F.col("b.hi"), "tie").when(F.col("b.lo").eqNullSafe(F.col(label)), "same").otherwise("moved")
    return found.select(row, F.when(F.col("b.lo") == F.col("b.hi"), F.col("b.lo")).alias("placed"), F.col("b.__gap").alias("gap"), reason.alias("reason"))


def connected_components(pairs: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every id of a pair of two different non-null ids; root is the smallest id reachable from node.

    Large-star and small-star by turns, until the pairs are stars: the first ties every larger neighbour of a node to the
    least id of its closed neighbourhood, the second the node and its smaller neighbours to their least. Ties replace pairs,
    so paths shorten by a factor in each round however long they are and wherever their small ids lie. Minima are partial
    aggregates, so a hub is no larger task than others. Order, repeats and self pairs do not matter; an empty table gives no
    rows.
    """
    stash = Stash(pairs.sparkSession)
    x, y = F.col(f"`{a}`"), F.col(f"`{b}`")
    edges = stash.keep(pairs.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct(), "edges")
    for _ in range(max_rounds):
        # stars: no node is tied to two, none is both tied and a centre
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("tied"), F.lit(0).alias("centre")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("tied"), F.lit(1).alias("centre")))
        if ends.groupBy("node").agg(F.sum("tied").alias("tied"), F.max("centre").alias("centre")).where("tied > 1 or tied = 1 and centre = 1").isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("n")).select("u", F.least("u", "n").alias("m"))
        large = stash.keep(both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(floor, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()
        following = stash.keep(small, "edges")
        stash.drop(edges, large)
        edges = following
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def slot_events(tubes: DataFrame, proposals: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(tube, event): what becomes of each proposed move of a tube to another subject at a visit.

    `tubes` is (tube, subject, visit): the slots as labelled. `proposals` is (tube, subject, target, visit). A move into a
    free slot is `one_way`; into a slot whose only tube is itself proposed for this tube's label, `reciprocal`; into any
    other slot, `duplicate_draw`. Of moves that want one slot, none goes (`collision`). A reciprocal move goes only if its
    partner does, which is repeated until nothing changes (`broken_pair`).
    """
    stash = Stash(proposals.sparkSession)
    slots = tubes.where("visit is not null").select(F.col("subject").alias("target"), "visit", F.col("tube").alias("slot")).distinct()
    held = slots.groupBy("target", "visit").agg(F.count("*").alias("n"), F.min("slot").alias("slot"))
    back = proposals.select(F.col("tube").alias("slot"), F.col("target").alias("slot_target"))
    kind = F.when(F.col("n").isNull(), "one_way").when((F.col("n") == 1) & (F.col("slot_target") == F.col("subject")), "reciprocal").otherwise("duplicate_draw")
    typed = proposals.join(held, ["target", "visit"], "left").join(back, "slot", "left").withColumn("kind", kind)
    wanted = typed.where("kind <> 'duplicate_draw'").groupBy("target", "visit").agg(F.count("*").alias("wants"))
    typed = typed.join(wanted, ["target", "visit"], "left").withColumn("event", F.when((F.col("kind") != "duplicate_draw") & (F.col("wants") > 1), "collision").otherwise(F.col("kind")))
    now = stash.keep(typed.select("tube", "slot", "event"), "events")
    for _ in range(max_rounds):
        going = now.where("event in ('one_way', 'reciprocal')").select(F.col("tube").alias("slot"), F.lit(True).alias("partner_goes")).distinct()
        lost = (F.col("event") == "reciprocal") & F.col("partner_goes").isNull()
        following = stash.keep(now.join(going, "slot", "left").select("tube", "slot", F.when(lost, "broken_pair").otherwise(F.col("event")).alias("event"), lost.alias("lost")), "events")
        stash.drop(now)
        now = following.select("tube", "slot", "event")
        now._stash_path = following._stash_path  # noqa: SLF001
        if following.where("lost").isEmpty():
            return now.select("tube", "event")
    raise RuntimeError(f"pairs did not settle in {max_rounds} rounds")


def unfit_verdict(self_z: Column, best_z: Column, second_z: Column, related: Column, self_max: float, best_min: float, margin: float) -> Column:
    """What a failed tube's scores say of its label: no_comparator, consistent_with_label, names_other_subject or uninformative."""
    names = (self_z < self_max) & (best_z >= best_min) & (best_z - F.coalesce(second_z, F.lit(float("-inf"))) >= margin) & ~F.coalesce(related, F.lit(False))
    return F.when(self_z.isNull(), "no_comparator").when(self_z >= self_max, "consistent_with_label").when(names, "names_other_subject").otherwise("uninformative")


def genotype_overlap(labels: DataFrame, genotypes: DataFrame, label: str, iid: str, least: float = 0.1) -> DataFrame:
    """(labelled, genotyped, share), one row. Repeated genotype ids, or fewer than `least` of the labelled subjects with a
    genotype, fail the plan."""
    repeated = genotypes.where(F.col(iid).isNotNull()).groupBy(iid).agg(F.count("*").alias("n"))
    once = repeated.select(F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("repeated genotype "), F.col(iid).cast("string"))).cast("string")).otherwise(F.col(iid)).alias("g"))
    named = labels.where(F.col(label).isNotNull()).select(F.col(label).alias("g")).distinct().join(once.withColumn("there", F.lit(1)), "g", "left")
    got = named.agg(F.count("*").alias("labelled"), F.count("there").alias("genotyped"))
    share = F.try_divide(F.col("genotyped"), F.col("labelled"))
    low = F.coalesce(share, F.lit(0.0)) < least
    return got.select("labelled", "genotyped", F.when(low, F.raise_error(F.concat(F.col("genotyped").cast("string"), F.lit(" of "), F.col("labelled").cast("string"), F.lit(" labelled subjects are genotyped"))).cast("double")).otherwise(share).alias("share"))
