"""Splits that keep related records together (problem 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrove.functions.ids import standard_subject, standard_tube
from tallygrove.llm.graph import star_components
from tallygrove.session import Stash

#: Bins of the hash range over which rows are counted, and seeds of the hash that are tried.
BINS, SEEDS = 4096, 16


def _cuts(rows: list[int], shares: list[float]) -> tuple[list[int], float]:
    """Bins where one range ends and the next begins, so that ranges hold `shares` of the rows as nearly as whole bins
    allow, and the largest miss in parts of all rows."""
    total = sum(rows) or 1
    upto, cuts, at, held = 0.0, [], 0, 0
    for share in shares[:-1]:
        upto += share
        while at < len(rows) and abs(held + rows[at] - upto * total) <= abs(held - upto * total):
            held += rows[at]
            at += 1
        cuts.append(at)
    edges = [0, *cuts, len(rows)]
    miss = max(abs(sum(rows[i:j]) / total - s) for i, j, s in zip(edges, edges[1:], shares, strict=False))
    return cuts, miss


def component_splits(records: DataFrame, row: str, group: str, tube: str, targets: DataFrame) -> DataFrame:
    """(row, component, split_name): every record with one split, no participant and no tube in two splits.

    Records that share a group or a tube id, in any spelling, are one component (large-star and small-star). A record
    with neither id is its own component. Every component, whatever its size, goes by a hash of its id into ranges whose
    shares of the rows are the target shares: rows are counted over BINS parts of the hash range and the ranges end where
    the counted rows reach their share. Of SEEDS fixed seeds of the hash the one whose ranges come nearest is taken, the
    first of equals, as a large component that lies across an end costs up to half its rows. Added rows move the ends a
    little, so only components near an end change their split, unless another seed becomes the nearest. Repeated rows
    keep together; an empty table gives an empty one; `targets` is (split_name, target_share), shares are normalised to a
    sum of 1, null or negative ones count as 0.
    """
    stash = Stash(records.sparkSession)
    rid = F.col(f"`{row}`")
    # 8-byte node ids: should two ids ever share a hash, two components would merge, which leaves every split valid
    narrow = records.select(
        rid.alias("row"),
        F.when(standard_subject(F.col(f"`{group}`")).isNotNull(), F.xxhash64(F.lit("g"), standard_subject(F.col(f"`{group}`")))).alias("g"),
        F.when(standard_tube(F.col(f"`{tube}`")).isNotNull(), F.xxhash64(F.lit("t"), standard_tube(F.col(f"`{tube}`")))).alias("t"),
    ).withColumn("anchor", F.coalesce("t", "g", F.xxhash64(F.lit("r"), F.col("row").cast("string"))))
    narrow = stash.keep(narrow, "nodes")
    labels = star_components(narrow.where(F.col("g").isNotNull() & F.col("t").isNotNull()).select("g", "t"), "g", "t")
    placed = stash.keep(narrow.join(labels.withColumnRenamed("node", "anchor"), "anchor", "left").select("row", F.coalesce("root", "anchor").alias("component")), "placed")
    stash.drop(narrow, labels)

    given = [(r[0], max(float(r[1] or 0.0), 0.0)) for r in targets.select("split_name", "target_share").orderBy("split_name").collect()]
    whole = sum(s for _, s in given) or 1.0
    shares = [(name, s / whole) for name, s in given if s > 0] or given
    if not shares:
        return placed.select(F.col("row").alias(row), "component", F.lit(None).cast("string").alias("split_name"))
    spot = lambda seed: F.pmod(F.xxhash64(F.lit("split"), seed, "component"), F.lit(BINS)).cast("int")
    sizes = placed.groupBy("component").count()
    seeded = sizes.select("component", "count", F.explode(F.sequence(F.lit(0), F.lit(SEEDS - 1))).alias("seed"))
    counted = seeded.groupBy("seed", spot(F.col("seed")).alias("bin")).agg(F.sum("count").alias("rows"))
    rows = [[0] * BINS for _ in range(SEEDS)]
    for r in counted.collect():  # BINS numbers for each of SEEDS seeds
        rows[r["seed"]][r["bin"]] = r["rows"]
    tried = [_cuts(own, [s for _, s in shares]) for own in rows]
    seed = min(range(SEEDS), key=lambda k: (tried[k][1], k))
    name = F.lit(shares[-1][0])
    for (own, _), cut in reversed(list(zip(shares, tried[seed][0], strict=False))):
        name = F.when(F.col("__bin") < cut, own).otherwise(name)
    return placed.withColumn("__bin", spot(F.lit(seed))).select(F.col("row").alias(row), "component", name.alias("split_name"))


def split_report(assigned: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows and actual share per split beside the target share; splits without rows are listed with 0."""
    counted = assigned.groupBy("split_name").agg(F.count("*").alias("rows"), F.countDistinct("component").alias("components"))
    total = assigned.agg(F.count("*").alias("all_rows"))
    return (
        targets.select("split_name", "target_share")
        .join(counted, "split_name", "left")
        .join(F.broadcast(total))
        .select("split_name", "target_share", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("components", F.lit(0)).alias("components"), F.try_divide(F.coalesce("rows", F.lit(0)).cast("double"), "all_rows").alias("actual_share"))
    )
