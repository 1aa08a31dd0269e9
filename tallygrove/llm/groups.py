"""Consolidating pairwise matches into groups (problem 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrove.functions.ids import standard_subject
from tallygrove.llm.graph import seed_tree_components


def match_groups(pairs: DataFrame, left: str, right: str, score: str | None = None, least: float | None = None) -> DataFrame:
    """(node, group_id) for every id that a qualifying pair links, directly or through others, to another id.

    A pair qualifies if both ids are given (any spelling of a subject id; placeholders are none), they differ, and, with
    `score`, the score is a number (null and NaN are not) of at least `least`. group_id is the smallest id of the group.
    Empty tables give no rows; other columns of `pairs` may have any name.
    """
    chosen = pairs
    if score is not None:
        value = F.col(f"`{score}`")
        chosen = chosen.where(value.isNotNull() & ~F.isnan(value) & (value >= F.lit(least)))
    links = chosen.select(standard_subject(F.col(f"`{left}`")).alias("a"), standard_subject(F.col(f"`{right}`")).alias("b"))
    return seed_tree_components(links, "a", "b").select("node", F.col("root").alias("group_id"))


def group_every_record(records: DataFrame, key: str, groups: DataFrame) -> DataFrame:
    """All records with their group id: the group of their key, else the key itself; null keys stay alone with a null id."""
    own = standard_subject(F.col(f"`{key}`"))
    named = records.withColumn("__tg_key", own)
    found = groups.select(F.col("node").alias("__tg_key"), F.col("group_id").alias("__tg_group"))
    return named.join(found, "__tg_key", "left").select(*[F.col(f"`{c}`") for c in records.columns], F.coalesce("__tg_group", "__tg_key").alias("match_group_id"))
