"""Relational operators with checked cardinalities and stated orders.

Each is a composition of DataFrame operations that Catalyst plans; nothing is collected. Checks that must hold for every
row are part of the plan (`raise_error`), so they run where the rows are and cost no extra job.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of `schema` in its order and types (strict casts); other columns are left out."""
    return df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields])


def available(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Those of `columns` that the frame has, in the given order."""
    return [c for c in columns if c in df.columns]


def complete_cases(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows whose columns are all given; numbers must also be finite."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    keep = []
    for c in columns:
        col = F.col(f"`{c}`")
        keep.append(col.isNotNull())
        if isinstance(kinds[c], (T.DoubleType, T.FloatType)):
            keep.append(~F.isnan(col) & (F.abs(col) != F.lit(float("inf"))))
    return df.where(reduce(lambda a, b: a & b, keep)) if keep else df


def mapped(value: Column, table: Mapping, default: Column | None = None, strict: bool = False) -> Column:
    """The value's entry in a small fixed mapping; without one, `default`, an error (`strict`), or null."""
    cell = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    found = F.try_element_at(cell, value)
    if strict:
        missing = F.raise_error(F.concat(F.lit("no entry for "), F.coalesce(value.cast("string"), F.lit("null"))))
        return F.when(value.isNotNull() & found.isNull(), missing.cast("string")).otherwise(found)
    return F.coalesce(found, default) if default is not None else found


def differs(a: Column, b: Column) -> Column:
    """Null-safe inequality: null and a value differ, two nulls do not."""
    return ~a.eqNullSafe(b)


def assert_unique(df: DataFrame, keys: Sequence[str], what: str = "rows") -> DataFrame:
    """The same rows; the plan fails if two have equal keys. One shuffle on the keys, which later steps can reuse."""
    n = F.count("*").over(Window.partitionBy(*keys))
    shown = F.concat_ws(", ", *[F.concat(F.lit(f"{k}="), F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("null"))) for k in keys])
    bad = F.raise_error(F.concat(F.lit(f"{what} are not unique: "), shown))
    return df.withColumn("__tg_n", n).where(F.when(F.col("__tg_n") > 1, bad.cast("boolean")).otherwise(F.lit(True))).drop("__tg_n")


def checked_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", shape: str = "m:1") -> DataFrame:
    """A join whose cardinality is checked in the plan: `m:1` (right keys unique), `1:1` (both), `1:m` (left), `m:m` (none).

    The right side is reduced to one row per key with its row count, so a violation fails at the key where it occurs and
    never multiplies rows. Null keys match nothing.
    """
    if shape in ("1:1", "1:m"):
        left = assert_unique(left, list(on), "left keys")
    if shape in ("1:1", "m:1"):
        rest = [c for c in right.columns if c not in on]
        n = F.count("*").alias("__tg_n")
        packed = right.groupBy(*on).agg(n, *[F.first(F.struct(*[F.col(f"`{c}`") for c in rest])).alias("__tg_row")] if rest else [])
        shown = F.concat_ws(", ", *[F.concat(F.lit(f"{k}="), F.col(f"`{k}`").cast("string")) for k in on])
        known = reduce(lambda a, b: a & b, [F.col(f"`{k}`").isNotNull() for k in on])
        packed = packed.where(F.when((F.col("__tg_n") > 1) & known, F.raise_error(F.concat(F.lit("right keys are not unique: "), shown)).cast("boolean")).otherwise(F.lit(True)))
        right = packed.select(*[F.col(f"`{k}`") for k in on], *[F.col(f"__tg_row.`{c}`").alias(c) for c in rest])
    return left.join(right, list(on), how)


def null_safe_join(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]], how: str = "inner") -> DataFrame:
    """A join in which null keys are equal."""
    a, b = left.alias("__l"), right.alias("__r")
    return a.join(b, reduce(lambda x, y: x & y, [F.col(f"__l.`{p}`").eqNullSafe(F.col(f"__r.`{q}`")) for p, q in pairs]), how)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key in a total order. A rank limit is pushed below the shuffle (window group limit)."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__tg_rank", rank).where(F.col("__tg_rank") <= n).drop("__tg_rank")


def best_two(df: DataFrame, keys: Sequence[str], label: str, score: str) -> DataFrame:
    """Per key the best and second-best label by score (ties: smaller label first) and their margin; nulls last."""
    order = [F.desc_nulls_last(score), F.asc_nulls_last(label)]
    ranked = df.withColumn("__tg_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__tg_rank <= 2")
    at = lambda r, c: F.max(F.when(F.col("__tg_rank") == r, F.col(c)))
    return ranked.groupBy(*keys).agg(at(1, label).alias("best"), at(1, score).alias("best_score"), at(2, label).alias("second"), at(2, score).alias("second_score"), (at(1, score) - at(2, score)).alias("margin"))


def tokens(df: DataFrame, key: str, text: Column, sep: str = r"[|,;]") -> DataFrame:
    """(key, token): distinct non-blank parts of a delimited text."""
    parts = F.filter(F.transform(F.split(text, sep), lambda x: F.trim(x)), lambda x: x != "")
    return df.select(F.col(f"`{key}`"), F.explode(F.array_distinct(parts)).alias("token"))


def bridge(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Pairs of keys that share a token, with the shared tokens sorted and joined. Both sides are (key, token).

    Token equality is the join key, so nothing is compared pairwise; a token that most rows carry is split by adaptive
    skew handling.
    """
    both = left.withColumnRenamed(left_key, "__l").join(right.withColumnRenamed(right_key, "__r"), "token")
    joined = both.groupBy("__l", "__r").agg(F.array_join(F.array_sort(F.collect_set("token")), "|").alias("shared"), F.count_distinct("token").alias("n_shared"))
    return joined.withColumnsRenamed({"__l": left_key, "__r": right_key if right_key != left_key else f"{right_key}_2"})


def prefix_matches(labels: DataFrame, references: DataFrame, label: str, reference: str, by: Sequence[str] = ()) -> DataFrame:
    """Labels joined to the references that are prefixes of them, within equal `by` columns.

    Each label is cut to the lengths that references have (a small set found by the plan), so the join stays an equi join
    on (by, prefix). Empty references match nothing.
    """
    sized = references.where(F.length(F.col(reference)) > 0)
    lengths = sized.agg(F.collect_set(F.length(reference)).alias("__tg_lengths"))
    cut = labels.crossJoin(F.broadcast(lengths)).withColumn("__tg_length", F.explode("__tg_lengths")).where(F.col("__tg_length") <= F.length(label))
    cut = cut.withColumn(reference, F.substring(F.col(label), F.lit(1), F.col("__tg_length"))).drop("__tg_lengths", "__tg_length")
    return cut.join(sized, [*by, reference])


def full_coalesced(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Full outer join; the key columns hold whichever side has the row."""
    return left.join(right, list(on), "full")


def grid(df: DataFrame, axes: Sequence[DataFrame], on: Sequence[str], fill: Mapping) -> DataFrame:
    """Every combination of the axes' rows, with `fill` where the frame has none. The result is that grid, so its size is the
    product of the axes; how they are paired is left to the optimizer."""
    every = reduce(lambda a, b: a.crossJoin(b), axes)
    return every.join(df, list(on), "left").fillna(dict(fill))


def complete_lookup(df: DataFrame, lookup: DataFrame, on: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The frame with the lookup's values; a row whose key the lookup lacks, or has twice, fails the plan with that key."""
    there = lookup.select(*on, *values, F.lit(True).alias("__tg_there"))
    key = F.concat_ws(", ", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in on])
    kinds = {f.name: f.dataType for f in lookup.schema}
    joined = checked_join(df, there, on, "left", "m:1")
    wanted = lambda v: F.when(F.col("__tg_there"), F.col(v)).otherwise(F.raise_error(F.concat(F.lit("no value for "), key)).cast(kinds[v]))
    return joined.select(*df.columns, *[wanted(v).alias(v) for v in values])


def matched_else(df: DataFrame, preferred: DataFrame, on: Sequence[str], value: str, fallback: Column) -> DataFrame:
    """`value` from the preferred table where it has the key, else the fallback: one left join instead of anti join and union."""
    found = preferred.select(*on, F.col(value).alias("__tg_v"), F.lit(True).alias("__tg_m"))
    return df.join(found, list(on), "left").withColumns({value: F.when(F.col("__tg_m"), F.col("__tg_v")).otherwise(fallback), "matched": F.coalesce("__tg_m", F.lit(False))}).drop("__tg_v", "__tg_m")


def union_relaxed(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of all frames; columns that a frame lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def first_reason(reasons: Sequence[tuple[str, Column]]) -> Column:
    """The first reason, in order of precedence, whose condition is true; null if none is."""
    out = F.lit(None).cast("string")
    for name, holds in reversed(reasons):
        out = F.when(F.coalesce(holds, F.lit(False)), F.lit(name)).otherwise(out)
    return out


def crosstab(df: DataFrame, rows: str, columns: str, values: Sequence[str]) -> DataFrame:
    """Counts by two classes; the values of the second are given, so one aggregation makes the table."""
    return df.groupBy(rows).agg(*[F.count(F.when(F.col(columns) == v, 1)).alias(f"n_{v}") for v in values], F.count("*").alias("n"))


def pairs_reciprocal(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows whose reverse is also there, each unordered pair once."""
    back = df.select(F.col(a).alias("__b"), F.col(b).alias("__a")).distinct()
    hit = df.join(back, (F.col(a) == F.col("__a")) & (F.col(b) == F.col("__b")), "left_semi")
    return hit.select(F.least(a, b).alias(a), F.greatest(a, b).alias(b)).where(F.col(a) != F.col(b)).distinct()


def content_hash(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Order-free fingerprint of a frame: row count and the sum and xor of row hashes."""
    row = F.xxhash64(*[F.col(f"`{c}`") for c in columns])
    return df.select(row.alias("h")).agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.col("h").cast("decimal(20,0)")), F.lit(0)).cast("string").alias("total"), F.bit_xor("h").alias("mixed"))
