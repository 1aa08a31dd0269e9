"""Operators on model results and annotations: effect transforms, classes, enrichment preparation, annotation tiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallygrove.operators.linkage import connected_components

def change_from_baseline(df: DataFrame, keys: Sequence[str], visit: str, value: str, baseline) -> DataFrame:
    """Each later row with its key's baseline value, change and percent change; one window, no self join."""
    base = F.max(F.when(F.col(visit) == baseline, F.col(value))).over(Window.partitionBy(*keys))
    out = df.withColumn("baseline", base).where(F.col("baseline").isNotNull() & (F.col(visit) != baseline))
    return out.withColumns({"change": F.col(value) - F.col("baseline"), "pct_change": F.when(F.col("baseline") != 0, 100 * (F.col(value) - F.col("baseline")) / F.col("baseline"))})


def log2_percent(estimate: Column, se: Column, z: float = 1.959963984540054) -> dict[str, Column]:
    """A log2 effect as percent change with its delta-method error and interval."""
    ln2 = 0.6931471805599453
    return {
        "pct": (F.pow(F.lit(2.0), estimate) - 1) * 100,
        "pct_se": F.pow(F.lit(2.0), estimate) * ln2 * se * 100,
        "pct_low": (F.pow(F.lit(2.0), estimate - z * se) - 1) * 100,
        "pct_high": (F.pow(F.lit(2.0), estimate + z * se) - 1) * 100,
    }


def fold_change(a: Column, se_a: Column, b: Column, se_b: Column) -> tuple[Column, Column]:
    """Fold change 2**(a - b) of two log2 means and its delta-method error."""
    fc = F.pow(F.lit(2.0), a - b)
    return fc, fc * 0.6931471805599453 * F.sqrt(se_a**2 + se_b**2)


def trajectory(early: Column, late: Column, shift: Column, fdr_early: Column, fdr_late: Column, fdr_shift: Column, alpha: float = 0.05) -> Column:
    """Course of a response over two visits, one of eleven classes.

    None of both changes significant: Null; only the early one: Transient; only the late one: LateOnset, each up or down by
    its sign; both with opposite signs: Reversal; both with one sign: Progressive if the late-minus-early contrast is
    significant in that direction, else Sustained."""
    sig = lambda c: F.coalesce(c < alpha, F.lit(False))
    e, l, s = sig(fdr_early), sig(fdr_late), sig(fdr_shift)
    way = lambda x: F.when(x > 0, "up").otherwise("down")
    named = lambda name, x: F.concat(F.lit(f"{name}_"), way(x))
    opposite = F.signum(early) != F.signum(late)
    further = s & (F.signum(shift) == F.signum(early))
    return (
        F.when(~e & ~l, "Null").when(~l, named("Transient", early)).when(~e, named("LateOnset", late))
        .when(opposite, F.concat(F.lit("Reversal_"), way(early), F.lit("_"), way(late)))
        .when(further, named("Progressive", early)).otherwise(named("Sustained", early))
    )


def interaction_direction(women: Column, men: Column) -> Column:
    """How an effect in women compares with that in men: opposite_sign, larger_in_F, smaller_in_F or equal."""
    return F.when((F.signum(women) != F.signum(men)) & (women != 0) & (men != 0), "opposite_sign").when(F.abs(women) > F.abs(men), "larger_in_F").when(F.abs(women) < F.abs(men), "smaller_in_F").otherwise("equal")


def mediation_class(total_fdr: Column, indirect_fdr: Column, direct_fdr: Column, indirect: Column, direct: Column, alpha: float = 0.05) -> Column:
    """none, total, direct, full (indirect only), partial (both, same sign) or opposing (both, opposite signs)."""
    sig = lambda c: F.coalesce(c < alpha, F.lit(False))
    i, d = sig(indirect_fdr), sig(direct_fdr)
    return F.when(i & d & (F.signum(indirect) == F.signum(direct)), "partial").when(i & d, "opposing").when(i, "full").when(d, "direct").when(sig(total_fdr), "total").otherwise("none")


def best_marker(df: DataFrame, gene: str, marker: str, effects: Sequence[str]) -> DataFrame:
    """Per gene the marker with the largest absolute effect over several columns (ties: smaller id)."""
    top = F.greatest(*[F.abs(F.col(e)) for e in effects]) if len(effects) > 1 else F.abs(F.col(effects[0]))
    ranked = df.withColumn("top", top).where("top is not null").withColumn("__tg_r", F.row_number().over(Window.partitionBy(gene).orderBy(F.desc("top"), F.asc(marker))))
    return ranked.where("__tg_r = 1").select(gene, marker, "top")


def expand_genes(df: DataFrame, genes: str, sep: str = r"\|") -> DataFrame:
    """One row per gene of a joined gene list; blank parts are left out."""
    return df.withColumn("gene", F.explode(F.array_distinct(F.filter(F.transform(F.split(genes, sep), lambda x: F.trim(x)), lambda x: x != ""))))


def source_groups(df: DataFrame, gene: str, marker: str) -> DataFrame:
    """(gene, source_group): genes measured by the same set of markers share a group, named by the sorted markers."""
    return df.groupBy(gene).agg(F.array_join(F.array_sort(F.collect_set(marker)), ",").alias("source_group"))


def collapse_same_source(members: DataFrame, groups: DataFrame, term: str, gene: str, position: str) -> DataFrame:
    """Members of a set with only the first, by position, of genes that share a source group."""
    joined = members.join(groups, gene)
    ranked = joined.withColumn("__tg_r", F.row_number().over(Window.partitionBy(term, "source_group").orderBy(position, gene)))
    return ranked.where("__tg_r = 1").drop("__tg_r")


def translate_symbols(df: DataFrame, symbol: str, aliases: DataFrame) -> DataFrame:
    """Symbols in approved form. `aliases` is (alias, symbol, priority); an alias that leads to several symbols at its best
    priority stays as it is, as does an unknown one. Case does not matter."""
    best = aliases.withColumn("a", F.upper("alias")).withColumn("lo", F.min("priority").over(Window.partitionBy("a"))).where("priority = lo")
    one = best.groupBy("a").agg(F.count_distinct("symbol").alias("n"), F.min("symbol").alias("to")).where("n = 1").select("a", "to")
    return df.withColumn("a", F.upper(symbol)).join(one, "a", "left").withColumn("translated", F.coalesce("to", F.col(symbol))).drop("a", "to")


def ortholog_map(df: DataFrame, symbol: str, orthologs: DataFrame) -> DataFrame:
    """Members kept if they already are an ortholog's symbol, mapped if they have exactly one ortholog, dropped otherwise.
    `orthologs` is (source_symbol, target_symbol)."""
    known = orthologs.select(F.upper("target_symbol").alias("k")).distinct().withColumn("is_target", F.lit(True))
    one = orthologs.groupBy(F.upper("source_symbol").alias("k")).agg(F.count_distinct("target_symbol").alias("n"), F.min("target_symbol").alias("to")).where("n = 1").select("k", "to")
    joined = df.withColumn("k", F.upper(symbol)).join(known, "k", "left").join(one, "k", "left")
    return joined.withColumn("mapped", F.when(F.col("is_target"), F.col("k")).otherwise(F.col("to"))).where("mapped is not null").drop("k", "to", "is_target")


def overlay(base: DataFrame, updates: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Base rows with values overridden where an update row has the key and the value; updates must be unique."""
    from tallygrove.operators.relational import checked_join

    fresh = updates.select(*keys, *[F.col(v).alias(f"__tg_{v}") for v in values])
    return checked_join(base, fresh, keys, "left", "m:1").select(*[F.coalesce(f"__tg_{c}", c).alias(c) if c in values else F.col(c) for c in base.columns])


def lift_over(df: DataFrame, chrom: str, pos: str, chain: DataFrame, bin_size: int = 1 << 17) -> DataFrame:
    """Positions on the new build by chain blocks (chrom, start, stop, new_chrom, shift): blocks are cut into bins, so the
    interval lookup is an equi join on chromosome and bin. Positions in no block have null; blocks must not overlap."""
    bins = chain.withColumn("__tg_bin", F.explode(F.sequence(F.floor(F.col("start") / bin_size), F.floor((F.col("stop") - 1) / bin_size)))).withColumnRenamed("chrom", "__tg_chrom")
    at = df.withColumn("__tg_bin", F.floor(F.col(pos) / bin_size))
    cond = (at["__tg_bin"] == bins["__tg_bin"]) & (F.col(chrom) == F.col("__tg_chrom")) & (F.col(pos) >= F.col("start")) & (F.col(pos) < F.col("stop"))
    joined = at.join(bins, cond, "left").drop("__tg_bin", "__tg_chrom")
    return joined.select(*df.columns, F.col("new_chrom"), (F.col(pos) + F.col("shift")).alias("new_pos"))


def capped_nlp(df: DataFrame, p: str, factor: float = 1.05) -> DataFrame:
    """-log10 of p; zeros get the largest finite value times a factor."""
    raw = F.when(F.col(p) > 0, -F.log10(F.col(p)))
    top = df.select(F.max(raw).alias("__tg_top"))
    return df.crossJoin(F.broadcast(top)).withColumn("nlp", F.when(F.col(p) == 0, F.col("__tg_top") * factor).otherwise(raw)).drop("__tg_top")


def overlap_clusters(rows: DataFrame, group: str, label: str, gene: str) -> DataFrame:
    """(group, label, cluster): labels of a group whose gene lists overlap, directly or through others, are one cluster, named
    by its smallest label. `rows` is (group, label, gene). Labels without genes stand alone.

    Merging lists one after the other gives these clusters in any order; here they are the components of labels and genes.
    """
    spell = lambda kind, c: F.concat_ws("\u0001", F.lit(kind), F.col(group).cast("string"), F.col(c).cast("string"))
    links = rows.where(F.col(gene).isNotNull()).select(spell("g", gene).alias("a"), spell("l", label).alias("b"))
    roots = connected_components(links, "a", "b").withColumnRenamed("node", "__tg_node")
    named = rows.select(group, label).distinct().withColumn("__tg_node", spell("l", label)).join(roots, "__tg_node", "left")
    root = F.coalesce("root", "__tg_node")
    least = named.groupBy(root.alias("__tg_root")).agg(F.min(label).alias("cluster"))
    return named.withColumn("__tg_root", root).join(least, "__tg_root").select(group, label, "cluster")
