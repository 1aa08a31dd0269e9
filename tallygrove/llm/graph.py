"""Connected components over tables of pairs.

Two engines share one contract: the input holds pairs (a, b) of comparable ids, the output one row (node, root) for
every id of a pair with two different non-null ids, root being the smallest id reachable from node. Self pairs,
repeated pairs, either order and null ids are harmless; an empty table gives an empty table. No neighbourhood is ever
collected: minima are partial aggregates, so a hub that holds a third of all pairs costs one combined row for each map
task, and the joins that hand the minima back are split by adaptive skew handling.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrove.session import Stash


def _pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    left, right = F.col(f"`{a}`"), F.col(f"`{b}`")
    return df.where(left != right).select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).distinct()


def seed_tree_components(df: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """Components by seed-tree pruning.

    Each round every active vertex tells the smallest id of its closed neighbourhood to that neighbourhood. A vertex
    then ties the minima it heard to the smallest of them; these ties are the next round's pairs. A vertex that nobody
    named as a minimum drops out into the propagation forest as a child of the smallest minimum it heard. When no pair
    is left, only seeds remain, and their ids flow down the forest, latest round first.
    """
    stash = Stash(df.sparkSession)
    edges = stash.keep(_pairs(df, a, b), "pairs")
    forest: list[DataFrame] = []
    for round_no in range(max_rounds):
        if edges.isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("n")).select("u", F.least("u", "n").alias("m"))
        # what each vertex hears: the minimum of every neighbour and of itself
        heard = both.join(lowest, "u").select(F.col("v").alias("x"), "m").unionByName(lowest.select(F.col("u").alias("x"), "m")).distinct()
        heard = stash.keep(heard, f"heard{round_no}")
        best = heard.groupBy("x").agg(F.min("m").alias("parent"), F.max(F.col("x") == F.col("m")).alias("named"))
        pruned = stash.keep(best.where(~F.col("named")).select(F.col("x").alias("node"), "parent"), f"forest{round_no}")
        forest.append(pruned)
        ties = heard.join(best.select("x", "parent"), "x").where(F.col("m") != F.col("parent")).select(F.col("m").alias("u"), F.col("parent").alias("v")).distinct()
        following = stash.keep(ties, f"pairs{round_no}")
        stash.drop(edges, heard)
        edges = following
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stash.drop(edges)
    if not forest:
        return _pairs(df, a, b).select(F.col("u").alias("node"), F.col("v").alias("root")).limit(0)
    # each round's layer is written once; what a parent's root is stands in the layers of later rounds
    layers: list[DataFrame] = []
    last = forest[-1]
    seeds = last.select(F.col("parent").alias("node"), F.col("parent").alias("root")).distinct()
    layers.append(stash.keep(last.select("node", F.col("parent").alias("root")).unionByName(seeds), "layer"))
    for pruned in reversed(forest[:-1]):
        known = reduce(DataFrame.unionByName, layers).withColumnsRenamed({"node": "parent"})
        placed = pruned.join(known, "parent", "left").select("node", "parent", F.coalesce("root", "parent").alias("root"), F.col("root").isNull().alias("fresh"))
        # a parent no later round pruned and no layer names is a seed that met nobody else
        both = F.when(F.col("fresh"), F.array(F.struct("node", "root"), F.struct(F.col("parent").alias("node"), "root"))).otherwise(F.array(F.struct("node", "root")))
        layers.append(stash.keep(placed.select(F.explode(both).alias("x")).select("x.*").distinct(), "layer"))
    stash.drop(*forest)
    return reduce(DataFrame.unionByName, layers)


def star_components(df: DataFrame, a: str, b: str, max_rounds: int = 100) -> DataFrame:
    """Components by alternating large-star and small-star until the pairs stop changing.

    Large-star ties every larger neighbour of a vertex to the minimum of its closed neighbourhood; small-star ties the
    vertex and its smaller neighbours to their minimum. At the fixed point the pairs are stars around the roots.
    """
    stash = Stash(df.sparkSession)
    edges = stash.keep(_pairs(df, a, b), "pairs")

    def mark(pairs: DataFrame) -> tuple:
        row = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return tuple(row)

    before = mark(edges)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("n")).select("u", F.least("u", "n").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stash.keep(large, "large")
        # every pair is now (larger, smaller): the small-star groups each vertex with its smaller neighbours; a pair
        # whose smaller end is the minimum stays as it is, the others tie that end to the minimum instead
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(floor, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()
        following = stash.keep(small, "pairs")
        stash.drop(edges, large)
        edges, after = following, mark(following)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
