"""Quality control of long measurement tables: verdict hierarchies, limits of detection, rates, flags, summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrove.operators.stats import MAD_SCALE, correlations, exact_quantiles, finite, hazen_quantiles, median_mad


def run_hierarchy(rows: DataFrame, sample: str, run: str, block: str, failed: Column) -> DataFrame:
    """(sample, run, block, block_fail, run_fail, sample_fail): a block fails if any of its rows does, a run if all its
    blocks do, a sample if all its runs do. Three nested aggregations; each reuses the partitioning of the one before."""
    blocks = rows.groupBy(sample, run, block).agg(F.bool_or(F.coalesce(failed, F.lit(False))).alias("block_fail"))
    runs = blocks.groupBy(sample, run).agg(F.bool_and("block_fail").alias("run_fail"))
    samples = runs.groupBy(sample).agg(F.bool_and("run_fail").alias("sample_fail"))
    return blocks.join(runs, [sample, run]).join(samples, sample)


def kept_values(rows: DataFrame, verdicts: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Rows without the failed runs of samples that have a good run; values of failed blocks in kept runs are null."""
    joined = rows.join(verdicts, list(keys)).where(~(F.col("run_fail") & ~F.col("sample_fail")))
    return joined.withColumn(value, F.when(~F.col("block_fail"), F.col(value)))


def fraction_verdict(rows: DataFrame, by: Sequence[str], bad: Column, fail_above: float, warn_above: float = 0.0) -> DataFrame:
    """Per group the share of bad rows and FAIL above one limit, WARN above another, else PASS."""
    share = F.avg(F.coalesce(bad, F.lit(False)).cast("double"))
    return rows.groupBy(*by).agg(share.alias("bad_share"), F.count("*").alias("n")).withColumn("verdict", F.when(F.col("bad_share") > fail_above, "FAIL").when(F.col("bad_share") > warn_above, "WARN").otherwise("PASS"))


def mad_outliers(rows: DataFrame, value: str, by: Sequence[str], unit: str, k: float = 6.0, fold: float = 5.0, share: float = 0.05) -> DataFrame:
    """Per unit (sample) the share of its values that lie more than k scaled MADs and `fold`-fold from the median of `by`;
    flagged above `share`. `value` is positive and on the linear scale."""
    base = median_mad(rows, value, by).drop("n")
    x = finite(F.col(value))
    far = (F.abs(x - F.col("med")) > k * MAD_SCALE * F.col("mad")) & ((x > fold * F.col("med")) | (x * fold < F.col("med")))
    joined = rows.join(base, list(by)).where(x.isNotNull())
    return joined.groupBy(unit).agg(F.avg(far.cast("double")).alias("far_share"), F.count("*").alias("n")).withColumn("outlier", F.col("far_share") > share)


def blank_lod(rows: DataFrame, value: str, assay: str, blank: Column, k: float = 3.0) -> DataFrame:
    """Estimated limit of detection per assay: median + k scaled MADs of the blanks."""
    return median_mad(rows, value, [assay], blank).select(assay, (F.col("med") + k * MAD_SCALE * F.col("mad")).alias("lod"), F.col("n").alias("blanks"))


def control_lod(rows: DataFrame, value: str, assay: str, control: Column, floor: float = 0.2, k: float = 3.0, least: int = 10) -> DataFrame:
    """Limit of detection per assay from negative controls: median + max(floor, k sd); method `sd` with enough controls, else `floor`."""
    own = rows.where(control).select(assay, finite(F.col(value)).alias("__tg_v")).where("__tg_v is not null")
    spread_of = own.groupBy(assay).agg(F.stddev_samp("__tg_v").alias("sd"))
    s = exact_quantiles(own, "__tg_v", [assay], {"med": 0.5}).join(spread_of, assay)
    spread = F.when((F.col("n") >= least) & F.col("sd").isNotNull(), F.greatest(F.lit(floor), k * F.col("sd"))).otherwise(F.lit(floor))
    return s.select(assay, (F.col("med") + spread).alias("lod"), F.when(F.col("n") >= least, "sd").otherwise("floor").alias("method"), "n")


def signal_to_background(rows: DataFrame, value: str, assay: str, signal: Column, blank: Column, least: float = 2.0) -> DataFrame:
    """Median of the signal rows over the median of the blanks; flagged below `least`. Assays with neither are left out."""
    mid = lambda kind, out: exact_quantiles(rows.where(kind).select(assay, value), value, [assay], {out: 0.5}).drop("n")
    agg = mid(signal, "signal").join(mid(blank, "background"), assay, "full")
    return agg.withColumn("ratio", F.when(F.col("background") > 0, F.col("signal") / F.col("background"))).withColumn("low", F.col("ratio") < least)


def saturated(rows: DataFrame, value: str, assay: str, above: float, share: float = 0.5) -> DataFrame:
    """Assays with more than `share` of their numbers above a limit."""
    x = finite(F.col(value))
    return rows.where(x.isNotNull()).groupBy(assay).agg(F.avg((x > above).cast("double")).alias("high_share"), F.count("*").alias("n")).withColumn("saturated", F.col("high_share") > share)


def consolidate(flags: DataFrame, unit: str, flag: str, fail_at: int = 2) -> DataFrame:
    """One verdict per unit from a tall table of flags: FAIL with `fail_at` different flags, WARN with one."""
    return flags.groupBy(unit).agg(F.count_distinct(flag).alias("flags"), F.array_join(F.array_sort(F.collect_set(flag)), ";").alias("which")).withColumn("verdict", F.when(F.col("flags") >= fail_at, "FAIL").when(F.col("flags") >= 1, "WARN").otherwise("PASS"))


def replace_flags(flags: DataFrame, fresh: DataFrame, unit: str, flag: str) -> DataFrame:
    """The flags with those of the fresh table's kinds replaced by it; distinct."""
    kinds = fresh.select(flag).distinct()
    return flags.join(kinds, flag, "left_anti").select(unit, flag).unionByName(fresh.select(unit, flag)).distinct()


def flag_summary(units: DataFrame, flags: DataFrame, unit: str, flag: str, names: Sequence[str], fail: Sequence[str]) -> DataFrame:
    """One row per unit with a boolean per flag name and the status FAIL > WARN > PASS. Names are given, so the pivot is one
    aggregation; a flag outside the names fails the plan."""
    known = F.when(F.col(flag).isin(*names), F.col(flag)).otherwise(F.raise_error(F.concat(F.lit("unknown flag "), F.coalesce(F.col(flag), F.lit("null")))).cast("string"))
    wide = flags.select(unit, known.alias("__tg_f")).groupBy(unit).agg(*[F.bool_or(F.col("__tg_f") == n).alias(n) for n in names])
    joined = units.join(wide, unit, "left").select(*units.columns, *[F.coalesce(n, F.lit(False)).alias(n) for n in names])
    any_of = lambda ns: reduce(lambda a, b: a | b, [F.col(n) for n in ns], F.lit(False))
    return joined.withColumn("status", F.when(any_of(fail), "FAIL").when(any_of([n for n in names if n not in fail]), "WARN").otherwise("PASS"))


def run_steps(units: DataFrame, unit: str, steps: Mapping[str, DataFrame], fail: Sequence[str]) -> DataFrame:
    """Units with a boolean per step and their status: each step is the table of the units that it flags, `fail` names the
    steps that fail a unit (the others warn). Steps are independent, so they are planned and run together."""
    flags = reduce(lambda a, b: a.unionByName(b), [df.select(unit, F.lit(name).alias("flag")).distinct() for name, df in steps.items()])
    return flag_summary(units, flags, unit, "flag", list(steps), fail)


def duplicate_assays(assays: DataFrame, assay: str, target: str, rate: str) -> DataFrame:
    """Assays that share a target: the one detected most stays (ties: smaller id), the others are marked."""
    from tallygrove.operators.relational import keep_first

    several = assays.join(assays.groupBy(target).agg(F.count_distinct(assay).alias("copies")).where("copies > 1"), target)
    best = keep_first(several, [target], [F.desc_nulls_last(rate), F.asc(assay)]).select(target, F.col(assay).alias("kept"))
    return several.join(best, target).withColumn("dropped", F.col(assay) != F.col("kept"))


def median_iqr_outliers(rows: DataFrame, value: str, sample: str, k: float = 5.0, weight: str | None = None, fit: str | None = None) -> DataFrame:
    """Samples whose weighted median or interquartile range lies more than k standard deviations from the mean.

    Quantiles are Hazen's with the weight of each row's assay (1 without `weight`; rows without a positive weight are left
    out). Mean and population sd come from the samples whose `fit` is true (all without it); every sample is judged.
    """
    own = rows.withColumn("__tg_w", F.col(weight) if weight else F.lit(1.0))
    q = hazen_quantiles(own, value, "__tg_w", [sample], {"med": 0.5, "q1": 0.25, "q3": 0.75})
    counted = own.where(finite(F.col(value)).isNotNull() & (F.col("__tg_w") > 0)).groupBy(sample).agg(F.count("*").alias("n"), F.bool_or(F.col(fit) if fit else F.lit(True)).alias("in_fit"))
    per = counted.join(q, sample).withColumn("iqr", F.col("q3") - F.col("q1"))
    base = per.where("in_fit")
    stats = base.agg(F.avg("med").alias("mm"), F.stddev_pop("med").alias("sm"), F.avg("iqr").alias("mi"), F.stddev_pop("iqr").alias("si"))
    z = lambda v, m, s: F.when(F.col(s) > 0, (F.col(v) - F.col(m)) / F.col(s)).otherwise(0.0)
    out = per.crossJoin(F.broadcast(stats)).withColumns({"z_med": z("med", "mm", "sm"), "z_iqr": z("iqr", "mi", "si")})  # one row
    return out.select(sample, "n", "in_fit", "med", "iqr", "z_med", "z_iqr", ((F.abs("z_med") > k) | (F.abs("z_iqr") > k)).alias("outlier"))


def window_end(status: Column, last_dose: Column, days: int, stops: Sequence[Column] = ()) -> Column:
    """End of the on-treatment window: for DISCONTINUED the last dose plus `days`, none from dosing otherwise; the earliest
    stop date moves it forward. A discontinued subject without a last dose has no window."""
    out = status == "DISCONTINUED"
    base = F.when(out, F.date_add(last_dose, days))
    first = F.least(base, *stops) if stops else base  # nulls do not count
    return F.when(~F.coalesce(out & last_dose.isNull(), F.lit(False)), first)


def duplicate_agreement(values: DataFrame, duplicates: DataFrame, assay: str, sample: str, value: str, least: float = 0.8) -> DataFrame:
    """(assay, kept, n, spearman, label) of every dropped duplicate and the assay kept in its place, over the samples of both:
    `concordant` from `least` up, `discordant` below, `unknown` without a correlation."""
    pairs = duplicates.where("dropped").select(F.col(assay).alias("a"), F.col("kept").alias("b"))
    side = lambda k, v: values.select(F.col(assay).alias(k), F.col(sample).alias("s"), F.col(value).alias(v))
    met = pairs.join(side("a", "x"), "a").join(side("b", "y"), ["b", "s"])
    rho = correlations(met, "x", "y", ["a", "b"], least=3).select("a", "b", "n", "spearman")
    label = F.when(F.col("spearman") >= least, "concordant").when(F.col("spearman") < least, "discordant").otherwise("unknown")
    return pairs.join(rho, ["a", "b"], "left").select(F.col("a").alias(assay), F.col("b").alias("kept"), F.coalesce("n", F.lit(0)).alias("n"), "spearman", label.alias("label"))


def rejudged_flags(flags: DataFrame, moved: DataFrame, unit: str, flag: str, rules: dict[str, Column]) -> DataFrame:
    """Flags after units got new labels: of the moved units, the flags that `rules` names hold exactly where the rule does on
    the new labels (null counts as not); all other flags stay."""
    fresh = moved.select(unit, F.explode(F.array(*[F.struct(F.lit(n).alias("f"), F.coalesce(c, F.lit(False)).alias("on")) for n, c in rules.items()])).alias("x")).select(unit, F.col("x.f").alias(flag), "x.on")
    kept = flags.join(fresh.select(unit, flag), [unit, flag], "left_anti").select(unit, flag)
    return kept.unionByName(fresh.where("on").select(unit, flag)).distinct()


def study_counts(rows: DataFrame, sample: str, assay: str, plate: str, kind: str, kinds: Sequence[str]) -> DataFrame:
    """Distinct samples per sample type, assays and plates: one aggregation over distinct keys."""
    return rows.agg(*[F.count_distinct(F.when(F.col(kind) == k, F.col(sample))).alias(f"{k.lower()}s") for k in kinds], F.count_distinct(assay).alias("assays"), F.count_distinct(plate).alias("plates"))


def exclusion_counts(samples: DataFrame, reason: str, by: Sequence[str], subject: str) -> DataFrame:
    """Rows and subjects per reason and group; rows without a reason count as kept."""
    return samples.groupBy(F.coalesce(F.col(reason), F.lit("kept")).alias("reason"), *by).agg(F.count("*").alias("samples"), F.count_distinct(subject).alias("subjects"))
