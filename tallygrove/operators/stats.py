"""Statistical operators as DataFrame compositions: no Python runs per row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallygrove.session import Stash, plan_bytes

#: Frames beyond this estimate have their exact quantiles taken by bracketing; up to it, a group's distinct values fit one
#: aggregation buffer even if one group holds them all. Both ways give the same values.
ONE_BUFFER_BYTES = 64 << 20
#: Parts that a group's values are cut into, so that no task orders a whole group.
PARTS = 64

MAD_SCALE = 1.4826  #: fixed value: makes the median absolute deviation of a normal sample its standard deviation


def finite(x: Column) -> Column:
    """The number if it is one and finite, else null."""
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def matched(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on columns of equal names, null keys meeting null keys; the keys of the left side stay."""
    if not on:
        return left.crossJoin(F.broadcast(right))  # one row: the aggregate of the whole table
    named = right.withColumnsRenamed({k: f"__tg_k{i}" for i, k in enumerate(on)})
    cond = F.lit(True)
    for i, k in enumerate(on):
        cond = cond & left[f"`{k}`"].eqNullSafe(F.col(f"__tg_k{i}"))
    return left.join(named, cond, how).drop(*[f"__tg_k{i}" for i in range(len(on))])


def _p_bin(p: Column) -> Column:
    """Monotone bin of a P value: 4,032 equal bins from 1/64 up, 32 for every halving below."""
    return F.when(p >= 1 / 64, F.floor(p * 4096) + 40_000).otherwise(F.floor((F.log2(F.greatest(p, F.lit(1e-320))) + 1100) * 32)).cast("int")


def running_sums(per: DataFrame, keys: Sequence[str], order: Sequence[str], measure: str, part: Column | None = None) -> DataFrame:
    """`per` with `__tg_r`, the sum of `measure` up to and with the row in rising order within its group, `__tg_m`, the
    group's sum, and `__tg_b`, its part. Rows must be distinct in keys and order.

    Groups are cut into parts by their first order column (by default at approximate quantiles). A row's sum is that of
    the parts before plus that inside its part, so the largest sort is a part of a group.
    """
    if part is None:
        ends = per.groupBy(*keys).agg(F.percentile_approx(order[0], [i / PARTS for i in range(1, PARTS)], 1000).alias("__tg_e"))
        cut = matched(per, ends, keys)
        cut = cut.withColumn("__tg_b", F.size(F.filter("__tg_e", lambda e: e < F.col(order[0])))).drop("__tg_e")
    else:
        cut = per.withColumn("__tg_b", part)
    family = Window.partitionBy(*keys)
    sums = cut.groupBy(*keys, "__tg_b").agg(F.sum(measure).alias("__tg_n"))
    before = F.coalesce(F.sum("__tg_n").over(family.orderBy("__tg_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.withColumns({"__tg_o": before, "__tg_m": F.sum("__tg_n").over(family)}).drop("__tg_n")
    inside = Window.partitionBy(*keys, "__tg_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return matched(cut, offsets, [*keys, "__tg_b"]).withColumn("__tg_r", F.col("__tg_o") + F.sum(measure).over(inside)).drop("__tg_o")


def bh_fdr(df: DataFrame, p: str, by: Sequence[str] = (), out: str = "fdr") -> DataFrame:
    """Benjamini-Hochberg step-up FDR within groups; null, NaN, infinite and negative p-values get null and do not count.

    Tied p-values share the smallest adjusted value among them, so ties need no further order, and what is ranked is one row
    per distinct p-value. P-values fall into bins: ranks are a bin's offset plus the rank inside it, and the running minimum
    is that inside the bin and of the bins above, so no task sorts a whole family.
    """
    value = finite(F.col(p))
    work = df.withColumn("__tg_p", F.when(value >= 0, value))
    keys = list(by)
    per = work.where(F.col("__tg_p").isNotNull()).groupBy(*keys, "__tg_p").agg(F.count("*").alias("__tg_c"))
    raw = running_sums(per, keys, ["__tg_p"], "__tg_c", _p_bin(F.col("__tg_p"))).withColumn("__tg_q", F.col("__tg_p") * F.col("__tg_m") / F.col("__tg_r"))
    least = raw.groupBy(*keys, "__tg_b").agg(F.min("__tg_q").alias("__tg_l"))
    above = least.withColumn("__tg_a", F.min("__tg_l").over(Window.partitionBy(*keys).orderBy(F.desc("__tg_b")).rowsBetween(Window.unboundedPreceding, -1))).drop("__tg_l")
    low = F.min("__tg_q").over(Window.partitionBy(*keys, "__tg_b").orderBy(F.desc("__tg_p")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    table = matched(raw.withColumn("__tg_w", low), above, [*keys, "__tg_b"]).select(*keys, "__tg_p", F.least(F.lit(1.0), "__tg_w", "__tg_a").alias(out))
    return matched(work, table, [*keys, "__tg_p"], "left").drop("__tg_p")


def simes(df: DataFrame, p: str, by: Sequence[str], out: str = "p_simes") -> DataFrame:
    """Simes combination per group: the least of p(i) * n / i over the sorted finite p-values.

    Among tied p-values the last has the least value, so one row per distinct p-value is ranked, in bins.
    """
    per = df.select(*by, finite(F.col(p)).alias("__tg_p")).where("__tg_p is not null").groupBy(*by, "__tg_p").agg(F.count("*").alias("__tg_c"))
    ranked = running_sums(per, by, ["__tg_p"], "__tg_c", _p_bin(F.col("__tg_p")))
    return ranked.groupBy(*by).agg(F.min(F.col("__tg_p") * F.col("__tg_m") / F.col("__tg_r")).alias(out), F.max("__tg_m").alias("n_p"))


def exact_quantiles(df: DataFrame, value: str, by: Sequence[str], probs: dict[str, float], spread: bool | None = None, nearest: bool = False) -> DataFrame:
    """Exact quantiles of the finite values per group, and their count `n`: interpolated linearly, or (`nearest`) the value at
    index round-half-even(q * (n - 1)).

    Small frames use the built-in aggregate, which holds a group's distinct values in one buffer. Large ones (`spread`, by
    default decided from the optimizer's size estimate) bracket each quantile with a mergeable summary of known rank error,
    count what lies below the bracket and sort only the values inside, about a thousandth of the group.
    """
    own = df.select(*by, finite(F.col(value)).alias("__tg_x")).where("__tg_x is not null")
    keys = list(by)
    if not (plan_bytes(own) > ONE_BUFFER_BYTES if spread is None else spread):
        if not nearest:
            return own.groupBy(*keys).agg(F.count("*").alias("n"), *[F.percentile("__tg_x", p).alias(name) for name, p in probs.items()])
        ranked = running_sums(own.groupBy(*keys, "__tg_x").agg(F.count("*").alias("__tg_c")), keys, ["__tg_x"], "__tg_c")
        reached = lambda q: F.col("__tg_r") > F.bround(F.lit(q) * (F.col("__tg_m") - 1))
        return ranked.groupBy(*keys).agg(F.max("__tg_m").alias("n"), *[F.min(F.when(reached(q), F.col("__tg_x"))).alias(name) for name, q in probs.items()])
    accuracy, names = 20_000, list(probs)
    ends = [min(max(p + d * 4 / accuracy, 0.0), 1.0) for p in probs.values() for d in (-1, 1)]
    cut = own.groupBy(*keys).agg(F.count("*").alias("__tg_n"), F.percentile_approx("__tg_x", ends, accuracy).alias("__tg_e"))
    met = matched(own, cut, keys)
    out = cut.select(*keys, F.col("__tg_n").alias("n"))
    for j, name in enumerate(names):
        low, high = F.col("__tg_e")[2 * j], F.col("__tg_e")[2 * j + 1]
        # equal values are one row with a count, so ties of any number stay small
        near = met.where(F.col("__tg_x").between(low, high)).groupBy(*keys, "__tg_x").agg(F.count("*").alias("__tg_c"), F.first("__tg_n").alias("__tg_n"))
        # the values next to the bracket serve where the interpolation reaches one rank beyond it
        below = met.groupBy(*keys).agg(F.count_if(F.col("__tg_x") < low).alias("__tg_u"), F.max(F.when(F.col("__tg_x") < low, F.col("__tg_x"))).alias("__tg_prv"), F.min(F.when(F.col("__tg_x") > high, F.col("__tg_x"))).alias("__tg_nxt"))
        placed = matched(running_sums(near, keys, ["__tg_x"], "__tg_c"), below, keys)
        at = F.lit(probs[name]) * (F.col("__tg_n") - 1)
        at = F.bround(at) if nearest else at
        # zero-based ranks that a value covers: up to __tg_u + __tg_r - 1
        top = F.col("__tg_u") + F.col("__tg_r") - 1
        one, two = (F.when(F.max(r) < F.max("__tg_u"), F.max("__tg_prv")).otherwise(F.coalesce(F.min(F.when(top >= r, F.col("__tg_x"))), F.max("__tg_nxt"))) for r in (F.floor(at), F.ceil(at)))
        part = F.max(at - F.floor(at))
        out = matched(out, placed.groupBy(*keys).agg((one + (two - one) * part).alias(name)), keys)
    return out


def median_mad(df: DataFrame, value: str, by: Sequence[str], where: Column | None = None, spread: bool | None = None) -> DataFrame:
    """Per group the median, the raw MAD and the count of the numbers (of the rows where `where` holds)."""
    x = finite(F.col(value))
    own = df.select(*[F.col(b) for b in by], F.when(where, x).otherwise(None).alias("__tg_v") if where is not None else x.alias("__tg_v")).where("__tg_v is not null")
    mid = exact_quantiles(own, "__tg_v", by, {"med": 0.5}, spread)
    joined = matched(own, mid, by)
    far = joined.withColumn("__tg_v", F.abs(F.col("__tg_v") - F.col("med")))
    mad = exact_quantiles(far, "__tg_v", by, {"mad": 0.5}, spread).drop("n")
    return matched(mid, mad, by).select(*by, "med", "n", "mad")


def robust_z(df: DataFrame, value: str, by: Sequence[str], null_mask: Column | None = None, out: str = "z") -> DataFrame:
    """(x - median) / (1.4826 MAD) with both from the rows of the null mask; null where the MAD is 0 or no row is in the mask."""
    base = median_mad(df, value, by, null_mask).drop("n")
    joined = matched(df, base, by, "left")
    return joined.withColumn(out, F.when(F.col("mad") > 0, (finite(F.col(value)) - F.col("med")) / (F.lit(MAD_SCALE) * F.col("mad")))).drop("med", "mad")


def average_ranks(df: DataFrame, value: str, by: Sequence[str], out: str) -> DataFrame:
    """The frame with average ranks of ties within groups (1-based); rows without a number have none and do not count.

    Distinct values are ranked in parts of a group and joined back, so no task orders a whole group.
    """
    work = df.withColumn("__tg_v", finite(F.col(value).cast("double")))
    per = work.where("__tg_v is not null").groupBy(*by, "__tg_v").agg(F.count("*").alias("__tg_c"))
    ranks = running_sums(per, by, ["__tg_v"], "__tg_c").select(*by, "__tg_v", (F.col("__tg_r") - (F.col("__tg_c") - 1) / F.lit(2.0)).alias(out))
    return matched(work, ranks, [*by, "__tg_v"], "left").drop("__tg_v")


def safe_corr(x: str | Column, y: str | Column) -> Column:
    """Pearson correlation; null without spread, where the built-in one fails under ANSI rules."""
    return F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x) * F.var_pop(y)))


def correlations(df: DataFrame, x: str, y: str, by: Sequence[str], least: int = 3) -> DataFrame:
    """Pearson and Spearman on finite pairs per group, null below `least` pairs or without spread."""
    ok = df.select(*by, finite(F.col(x)).alias("__tg_x"), finite(F.col(y)).alias("__tg_y")).where("__tg_x is not null and __tg_y is not null")
    ranked = average_ranks(average_ranks(ok, "__tg_x", by, "__tg_rx"), "__tg_y", by, "__tg_ry")
    spread = (F.min("__tg_x") < F.max("__tg_x")) & (F.min("__tg_y") < F.max("__tg_y")) & (F.count("*") >= least)
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), F.when(spread, safe_corr("__tg_x", "__tg_y")).alias("pearson"), F.when(spread, safe_corr("__tg_rx", "__tg_ry")).alias("spearman"))


def hazen_quantiles(df: DataFrame, value: str, weight: str, by: Sequence[str], probs: dict[str, float]) -> DataFrame:
    """Weighted Hazen quantiles per group: values at cumulative weight minus half their own, over the total, interpolated
    linearly between the two neighbours of each quantile and constant beyond the first and last. Weights must be positive."""
    own = df.select(*by, finite(F.col(value)).alias("__tg_x"), finite(F.col(weight)).alias("__tg_w")).where("__tg_x is not null and __tg_w > 0")
    # equal rows are one with a count: the j-th of them stands at (sum before + (j - 1/2) weight) / total
    per = own.groupBy(*by, "__tg_x", "__tg_w").agg(F.count("*").alias("__tg_c")).withColumn("__tg_s", F.col("__tg_c") * F.col("__tg_w"))
    summed = running_sums(per, by, ["__tg_x", "__tg_w"], "__tg_s").withColumn("__tg_f", F.col("__tg_r") - F.col("__tg_s"))
    at = lambda j: (F.col("__tg_f") + (j - 0.5) * F.col("__tg_w")) / F.col("__tg_m")
    ends = []
    for name, q in probs.items():
        turn = (F.lit(q) * F.col("__tg_m") - F.col("__tg_f")) / F.col("__tg_w") + 0.5
        last, next_ = F.least(F.floor(turn), F.col("__tg_c")), F.greatest(F.ceil(turn), F.lit(1))
        ends.append(F.max(F.when(last >= 1, F.struct(at(last).alias("p"), F.col("__tg_x").alias("x")))).alias(f"__tg_l_{name}"))
        ends.append(F.min(F.when(next_ <= F.col("__tg_c"), F.struct(at(next_).alias("p"), F.col("__tg_x").alias("x")))).alias(f"__tg_h_{name}"))
    met = summed.groupBy(*by).agg(*ends)

    def between(name: str, q: float) -> Column:
        l, h = F.col(f"__tg_l_{name}"), F.col(f"__tg_h_{name}")
        inner = l["x"] + (h["x"] - l["x"]) * (F.lit(q) - l["p"]) / (h["p"] - l["p"])
        return F.when(l.isNull(), h["x"]).when(h.isNull(), l["x"]).when(h["p"] == l["p"], l["x"]).otherwise(inner)

    return met.select(*by, *[between(name, q).alias(name) for name, q in probs.items()])


def hazen_quantile(df: DataFrame, value: str, weight: str, by: Sequence[str], q: float, out: str) -> DataFrame:
    """One weighted Hazen quantile per group."""
    return hazen_quantiles(df, value, weight, by, {out: q})


def nearest_quantile(df: DataFrame, value: str, by: Sequence[str], probs: dict[str, float], spread: bool | None = None) -> DataFrame:
    """Quantiles by the nearest-rank rule: the value at index round-half-even(q * (n - 1)) of the sorted finite values."""
    return exact_quantiles(df, value, by, probs, spread, nearest=True)


def tukey_fence(df: DataFrame, value: str, by: Sequence[str], k: float = 1.5) -> DataFrame:
    """Lower and upper fence from the nearest-rank quartiles."""
    q = nearest_quantile(df, value, by, {"q1": 0.25, "q3": 0.75})
    return q.select(*by, "n", "q1", "q3", (F.col("q1") - k * (F.col("q3") - F.col("q1"))).alias("low"), (F.col("q3") + k * (F.col("q3") - F.col("q1"))).alias("high"))


def plate_cv(df: DataFrame, value: str, assay: Sequence[str], plate: str, log2_scale: bool) -> DataFrame:
    """Per assay the intra-plate CV (mean over plates) and inter-plate CV (of plate means), in percent.

    Plates need two values. On the linear scale CV is sd / mean of positive means; on the log2 scale it is
    sqrt(exp((sd ln 2)^2) - 1).
    """
    x = finite(F.col(value))
    ln2 = 0.6931471805599453
    plates = df.select(*assay, F.col(plate), x.alias("__tg_x")).where("__tg_x is not null").groupBy(*assay, plate).agg(F.avg("__tg_x").alias("__tg_m"), F.stddev_samp("__tg_x").alias("__tg_s"), F.count("*").alias("__tg_n")).where("__tg_n >= 2")
    log_cv = lambda s: F.sqrt(F.exp(F.pow(s * ln2, F.lit(2.0))) - 1) * 100
    cv = log_cv(F.col("__tg_s")) if log2_scale else F.when(F.col("__tg_m") > 0, F.col("__tg_s") / F.col("__tg_m") * 100)
    across = F.stddev_samp("__tg_m")
    inter = log_cv(across) if log2_scale else F.when(F.avg("__tg_m") > 0, across / F.avg("__tg_m") * 100)
    return plates.withColumn("__tg_cv", cv).groupBy(*assay).agg(F.avg("__tg_cv").alias("intra_cv"), inter.alias("inter_cv"), F.count("*").alias("plates"))


def detection_rates(df: DataFrame, value: str, lod: str, assay: Sequence[str], group: str) -> DataFrame:
    """Per assay the best and overall share of finite values at or above the limit of detection, by group."""
    x, limit = finite(F.col(value)), finite(F.col(lod))
    counted = df.select(*assay, F.col(group), x.alias("__tg_x"), limit.alias("__tg_l")).where("__tg_x is not null and __tg_l is not null").groupBy(*assay, group).agg(F.count(F.when(F.col("__tg_x") >= F.col("__tg_l"), 1)).alias("__tg_d"), F.count("*").alias("__tg_n"))
    return counted.groupBy(*assay).agg(F.max(F.col("__tg_d") / F.col("__tg_n")).alias("best_rate"), (F.sum("__tg_d") / F.sum("__tg_n")).alias("all_rate"), F.count("*").alias("groups"))


def intraclass(df: DataFrame, value: str, unit: Sequence[str], subject: str) -> DataFrame:
    """Intraclass correlation per unit from within-subject pairs: sum over subjects of (s^2 - q) / 2 over sum of (n - 1) q / 2,
    with s the sum and q the sum of squares of a subject's values, over subjects with two values or more."""
    x = finite(F.col(value))
    per = df.select(*unit, subject, x.alias("__tg_x")).where("__tg_x is not null").groupBy(*unit, subject).agg(F.sum("__tg_x").alias("__tg_s"), F.sum(F.col("__tg_x") ** 2).alias("__tg_q"), F.count("*").alias("__tg_n")).where("__tg_n >= 2")
    num, den = F.sum((F.col("__tg_s") ** 2 - F.col("__tg_q")) / 2), F.sum((F.col("__tg_n") - 1) * F.col("__tg_q") / 2)
    return per.groupBy(*unit).agg(F.when(den > 0, num / den).alias("icc"), F.count("*").alias("subjects"))


def standardise(df: DataFrame, value: str, by: Sequence[str], sample: bool = True, out: str = "z") -> DataFrame:
    """(x - mean) / sd within groups; null where the sd is 0 or undefined."""
    x = finite(F.col(value))
    own = df.select(*by, x.alias("__tg_x")).groupBy(*by).agg(F.avg("__tg_x").alias("__tg_a"), (F.stddev_samp if sample else F.stddev_pop)("__tg_x").alias("__tg_d"))
    return matched(df, own, by, "left").withColumn(out, F.when(F.col("__tg_d") > 0, (x - F.col("__tg_a")) / F.col("__tg_d"))).drop("__tg_a", "__tg_d")


def median_polish(df: DataFrame, value: str, unit: str, effects: Sequence[str], rounds: int = 3, clip: float = 6.0, out: str = "resid") -> DataFrame:
    """Residuals after sweeping out group medians of each effect per unit, `rounds` times; then scaled by 1.4826 MAD per
    unit, clipped, and 0 where there is no value or no spread."""
    work = df.withColumn(out, finite(F.col(value)))
    spread = plan_bytes(work) > ONE_BUFFER_BYTES
    stash = Stash(df.sparkSession)
    for _ in range(rounds):
        for e in effects:
            mids = exact_quantiles(work, out, [unit, e], {"__tg_mid": 0.5}, spread).drop("n")
            work = matched(work, mids, [unit, e], "left").withColumn(out, F.col(out) - F.coalesce("__tg_mid", F.lit(0.0))).drop("__tg_mid")
        work = stash.keep(work, "polished")  # every sweep reads the values twice, so plans would double with each
    base = median_mad(work, out, [unit], spread=spread).select(unit, F.col("mad").alias("__tg_mad"))
    scaled = F.when(F.col("__tg_mad") > 0, F.col(out) / (MAD_SCALE * F.col("__tg_mad")))
    return work.join(base, unit, "left").withColumn(out, F.coalesce(F.greatest(F.lit(-clip), F.least(F.lit(clip), scaled)), F.lit(0.0))).drop("__tg_mad")


def simple_ols(df: DataFrame, x: str, y: str, by: Sequence[str]) -> DataFrame:
    """Slope, intercept and their standard errors per group, with sigma^2 = rss / max(n - 2, 1)."""
    ok = df.select(*by, finite(F.col(x)).alias("__tg_x"), finite(F.col(y)).alias("__tg_y")).where("__tg_x is not null and __tg_y is not null")
    s = ok.groupBy(*by).agg(F.count("*").alias("n"), F.avg("__tg_x").alias("mx"), F.avg("__tg_y").alias("my"), F.var_pop("__tg_x").alias("vx"), F.var_pop("__tg_y").alias("vy"), F.covar_pop("__tg_x", "__tg_y").alias("cxy"))
    b = F.col("cxy") / F.col("vx")
    rss = F.greatest(F.col("n") * (F.col("vy") - F.col("cxy") ** 2 / F.col("vx")), F.lit(0.0))
    sigma2 = rss / F.greatest(F.col("n") - 2, F.lit(1))
    fitted = s.where("vx > 0 and n >= 2")
    return fitted.select(*by, "n", b.alias("slope"), (F.col("my") - b * F.col("mx")).alias("intercept"), F.sqrt(sigma2 / (F.col("n") * F.col("vx"))).alias("se_slope"), F.sqrt(sigma2 * (1 / F.col("n") + F.col("mx") ** 2 / (F.col("n") * F.col("vx")))).alias("se_intercept"))


def axis_cap(df: DataFrame, value: str, by: Sequence[str], ratio: float = 3.0) -> DataFrame:
    """Per group the second-largest absolute value where the largest exceeds it by the ratio, else null: where to cut an axis."""
    a = F.abs(finite(F.col(value)))
    top = df.select(*by, a.alias("__tg_a")).where("__tg_a is not null").withColumn("__tg_r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("__tg_a")))).where("__tg_r <= 2")
    first, second = F.max(F.when(F.col("__tg_r") == 1, F.col("__tg_a"))), F.max(F.when(F.col("__tg_r") == 2, F.col("__tg_a")))
    return top.groupBy(*by).agg(F.when(second.isNotNull() & (second > 0) & (first > ratio * second), second).alias("cap"), first.alias("largest"))


def upper_threshold(df: DataFrame, value: str, by: Sequence[str], rate: float) -> DataFrame:
    """The smallest cut such that at most `rate` of a group's values lie above it: the (k+1)-th largest, k = floor(rate * n)."""
    own = df.select(*by, finite(F.col(value)).alias("__tg_x")).where("__tg_x is not null").groupBy(*by, "__tg_x").agg(F.count("*").alias("__tg_c"))
    ranked = running_sums(own, by, ["__tg_x"], "__tg_c")
    above, k = F.col("__tg_m") - F.col("__tg_r"), F.floor(F.lit(rate) * F.col("__tg_m"))
    return ranked.where((above <= k) & (k < above + F.col("__tg_c"))).select(*by, F.col("__tg_x").alias("cut"), F.col("__tg_m").alias("n"))


def camera_sets(members: DataFrame, term: str, stat: str, correlation: float = 0.01) -> DataFrame:
    """(term, n, t, p, direction): competitive test of each set's mean statistic against the rest of the universe, with the
    variance inflated for a fixed correlation between members.

    `members` holds each member of the universe once, with its set (null for none). Sets of all members have no row."""
    from tallygrove.functions.dist import t_p_value

    x = finite(F.col(stat))
    own = members.select(term, x.alias("__tg_x")).where("__tg_x is not null")
    all_ = own.agg(F.count("*").alias("__tg_n"), F.avg("__tg_x").alias("__tg_a"), F.var_samp("__tg_x").alias("__tg_v"))
    sets = own.where(F.col(term).isNotNull()).groupBy(term).agg(F.count("*").alias("n"), F.avg("__tg_x").alias("__tg_m"))
    n, m = F.col("__tg_n"), F.col("n")
    j = sets.crossJoin(F.broadcast(all_)).where((n > m) & (n > 2)).withColumn("__tg_d", n / (n - m) * (F.col("__tg_m") - F.col("__tg_a")))  # one row
    pooled = F.greatest(((n - 1) * F.col("__tg_v") - F.col("__tg_d") ** 2 * m * (n - m) / n) / (n - 2), F.lit(1e-300))
    t = F.col("__tg_d") / F.sqrt(pooled * ((1 + (m - 1) * correlation) / m + 1 / (n - m)))
    out = j.withColumn("t", t).withColumn("p", t_p_value("t", (n - 2).cast("double")))
    return out.select(term, "n", "t", "p", F.when(F.col("t") > 0, "Up").otherwise("Down").alias("direction"))


def stable_fold(key: Column, folds: int, salt: str = "") -> Column:
    """A fold number that depends on the key, the salt and nothing else, so that rows added later move no other."""
    return F.pmod(F.conv(F.substring(F.sha2(F.concat(F.lit(salt), F.lit("/"), key.cast("string")), 256), 1, 8), 16, 10).cast("bigint"), F.lit(folds)).cast("int")


def digest_folds(df: DataFrame, key: str, folds: int, seed: int = 0, salt: str = "outer") -> DataFrame:
    """(key, fold) of every distinct key: an 8-byte BLAKE2b digest of seed, salt and key, modulo the number of folds.

    A key's fold depends on nothing else, and partitions of different salts are independent. Distinct keys are hashed in
    Arrow batches, as no built-in function gives this digest."""
    import hashlib

    import pandas as pd

    def fold(keys):
        number = lambda k: int.from_bytes(hashlib.blake2b(f"{seed}\x1f{salt}\x1f{k}".encode(), digest_size=8).digest(), "big")
        return keys.map(lambda k: None if k is None else number(k) % folds).astype("Int32")

    fold.__annotations__ = {"keys": pd.Series, "return": pd.Series}
    return df.select(key).distinct().withColumn("fold", F.pandas_udf(fold, "int")(F.col(key).cast("string")))


def partial_correlation(df: DataFrame, x: str, y: str, given: str, by: Sequence[str], least: int = 4) -> DataFrame:
    """Correlation of x and y per group after removal of a third variable, on rows where all three are finite; null below
    `least` rows or where two of them determine each other."""
    named = {"__tg_x": x, "__tg_y": y, "__tg_z": given}
    ok = df.select(*by, *[finite(F.col(c)).alias(n) for n, c in named.items()]).where("__tg_x is not null and __tg_y is not null and __tg_z is not null")
    spread = F.lit(True)
    for n in named:
        spread = spread & (F.min(n) < F.max(n))
    r = ok.groupBy(*by).agg(F.count("*").alias("n"), *[F.when(spread, safe_corr(f"__tg_{a}", f"__tg_{b}")).alias(f"__tg_{a}{b}") for a, b in ("xy", "xz", "yz")])
    left = (1 - F.col("__tg_xz") ** 2) * (1 - F.col("__tg_yz") ** 2)
    partial = F.when((F.col("n") >= least) & (left > 1e-12), (F.col("__tg_xy") - F.col("__tg_xz") * F.col("__tg_yz")) / F.sqrt(left))
    return r.select(*by, "n", F.col("__tg_xy").alias("r"), partial.alias("partial_r"))
