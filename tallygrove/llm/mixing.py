"""Mixing sources to target weights by entropy balancing (problem 9)."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallygrove.llm.bpe import VOCABULARY, count_tokens
from tallygrove.session import Stash

#: Newton stops when every source's tokens are this close, in parts of its target; it must get there in so many steps.
CLOSE, STEPS = 1e-10, 100
#: Bins of one refinement of the rounding threshold, and refinements.
BINS, PASSES = 1 << 16, 2
#: A table of sources up to so many rows is broadcast; a longer one is joined as the optimizer sees fit.
BROADCAST_SOURCES = 20_000


def _source_table(spark: SparkSession, sources: dict[str, dict[str, float]], names: tuple[str, ...]) -> DataFrame:
    """(s, names...) as a table of known size."""
    order = sorted(sources)
    made = spark.createDataFrame(pa.table({"s": pa.array(order, pa.string()), **{n: pa.array([float(sources[s][n]) for s in order], pa.float64()) for n in names}}))
    return F.broadcast(made) if len(order) <= BROADCAST_SOURCES else made


def mix_sources(
    docs: DataFrame,
    targets: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    vocabulary: str = VOCABULARY,
    total_tokens: float | None = None,
) -> DataFrame:
    """(key, source, n_tokens, rate, copies) for every document: how often the mix uses it.

    `targets` is (source, target_weight, max_repeats), one row per listed source. Weights of listed sources that have
    tokens and may repeat are scaled to sum 1. The mix has `total_tokens`, or without it the most tokens that all weights
    and caps allow. Entropy balancing then finds the document rates nearest to equal rates, in relative entropy, whose
    tokens meet every source's target: rates min(cap, exp(a_s * tokens)), the a_s from Newton iterations on the convex
    dual. Each iteration is over the table of (source, token count, documents), which is aggregated once and whose size
    does not grow with copies of a length. Rates are rounded down, or up where a fixed hash of the document falls below
    the fraction; a threshold per source, refined over histograms, shifts that hash so that the copies' tokens meet the
    target to within half a document. A source whose tilt does not settle raises. Documents of unlisted or null sources, and documents without tokens, have 0 copies. Repeated
    rows of one key are kept as rows, each with its own copies. An empty table or empty targets give no copies.
    """
    stash = Stash(docs.sparkSession)
    sized = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{source}`").alias("s"), F.col(f"`{text}`").alias("t"))
    packed = sized.select(F.struct("k", "s").alias("ks"), "t")
    counted = count_tokens(packed, "ks", "t", vocabulary).select(F.col("ks.k").alias("k"), F.col("ks.s").alias("s"), "n_tokens")
    counted = stash.keep(counted, "sizes")
    wanted = {r[0]: (max(float(r[1] or 0), 0.0), max(int(r[2] or 0), 0)) for r in targets.select("source", "target_weight", "max_repeats").collect() if r[0] is not None}
    hist = stash.keep(counted.where(F.col("n_tokens") > 0).join(targets.select(F.col("source").alias("s")).distinct(), "s", "left_semi").groupBy("s", "n_tokens").count(), "lengths")
    held = {r["s"]: (int(r["tokens"]), int(r["longest"])) for r in hist.groupBy("s").agg(F.sum(F.col("n_tokens") * F.col("count")).alias("tokens"), F.max("n_tokens").alias("longest")).collect()}
    live = {s: w for s, (w, cap) in wanted.items() if w > 0 and cap > 0 and s in held}
    span = sum(live.values())
    state: dict[str, dict[str, float]] = {}
    if live:
        most = min(wanted[s][1] * held[s][0] / (w / span) for s, w in live.items())
        total = min(total_tokens, most) if total_tokens is not None else most
        for s, w in live.items():
            cap, goal = wanted[s][1], total * w / span
            # tokens in units of the source's longest document keep the exponent small; a tilt of 1e6 means the cap binds everywhere
            full = goal >= cap * held[s][0] * (1 - 1e-12)
            state[s] = {"goal": goal, "cap": cap, "unit": 1.0 / held[s][1], "tilt": 1e6 if full else 0.0, "low": -math.inf, "high": math.inf, "done": full}

    power = F.exp(F.least(F.col("tilt") * F.col("n_tokens") * F.col("unit"), F.lit(700.0)))
    rate = F.least(power, F.col("cap"))
    inner = F.when(power < F.col("cap"), power).otherwise(0.0)
    for _ in range(STEPS):
        going = {s: v for s, v in state.items() if not v["done"]}
        if not going:
            break
        given = hist.join(_source_table(docs.sparkSession, going, ("tilt", "unit", "cap")), "s")
        sums = given.groupBy("s").agg(F.sum(rate * F.col("n_tokens") * F.col("count")).alias("f"), F.sum(inner * F.col("n_tokens") * F.col("n_tokens") * F.col("unit") * F.col("count")).alias("g"))
        for r in sums.collect():  # one row for each source of the targets
            v = state[r["s"]]
            miss = r["f"] - v["goal"]
            if abs(miss) <= CLOSE * v["goal"]:
                v["done"] = True
                continue
            v["high" if miss > 0 else "low"] = v["tilt"]
            low, high = v["low"], v["high"]
            if high - low < 1e-14 * max(1.0, abs(low)):
                v["done"] = True  # no number lies between: the nearest that a tilt can come
                continue
            step = v["tilt"] - miss / r["g"] if r["g"] > 0 else math.nan
            if not low < step < high or not math.isfinite(step):
                step = (low + high) / 2 if math.isfinite(low) and math.isfinite(high) else (v["tilt"] * 2 + (1 if miss < 0 else -1))
            v["tilt"] = step
    missed = sorted(s for s, v in state.items() if not v["done"])
    if missed:
        raise RuntimeError(f"the weights did not settle in {STEPS} steps for {len(missed)} sources, among them {missed[:5]}")

    names = ("tilt", "unit", "cap")
    # whole copies depend on source and length only, so their tokens come from the table of lengths
    sure = hist.join(_source_table(docs.sparkSession, state, names), "s").groupBy("s").agg(F.sum(F.floor(rate) * F.col("n_tokens") * F.col("count")).alias("n"))
    for r in sure.collect():
        state[r["s"]]["need"] = state[r["s"]]["goal"] - int(r["n"])
    draw = F.pmod(F.xxhash64(F.lit("mix"), F.col("k").cast("string")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    # a document is rounded up if its lift is below the threshold of its source; without correction that is 0
    lift = F.when(rate > F.floor(rate), draw - (rate - F.floor(rate)))
    width = 2.0
    for v in state.values():
        v["edge"] = -1.0
    for refined in range(1, (PASSES if state else 0) + 1):
        width /= BINS
        given = counted.where(F.col("n_tokens") > 0).join(_source_table(docs.sparkSession, state, (*names, "edge", "need")), "s")
        place = F.floor((lift - F.col("edge")) / F.lit(width))
        bins = given.select("s", "need", place.alias("b"), "n_tokens").where(F.col("b").between(0, BINS - 1)).groupBy("s", "need", "b").agg(F.sum("n_tokens").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        over = bins.withColumn("upto", upto).withColumn("over", F.col("upto") > F.col("need"))
        ends = over.groupBy("s").agg(F.min(F.when(F.col("over"), F.struct("b", "upto", (F.col("upto") - F.col("n")).alias("held")))).alias("end"), F.sum("n").alias("all"))
        met = {r["s"]: r for r in ends.collect()}
        for s, v in state.items():
            if s in met and met[s]["end"] is not None:
                end = met[s]["end"]
                # the last document goes in if that comes nearer to the target than leaving it out
                v["edge"] += (end["b"] + (refined == PASSES and end["upto"] - v["need"] < v["need"] - end["held"])) * width
                v["need"] -= end["held"]
            else:
                v["edge"] += BINS * width
                v["need"] -= met[s]["all"] if s in met else 0
    stash.drop(hist)
    # an empty table of sources leaves every rate 0
    rated = counted.join(_source_table(docs.sparkSession, state, (*names, "edge")), "s", "left")
    used = F.col("tilt").isNotNull() & (F.col("n_tokens") > 0)
    copies = F.floor(rate) + F.coalesce((lift < F.col("edge")).cast("bigint"), F.lit(0))
    return rated.select(
        F.col("k").alias(key), F.col("s").alias(source), "n_tokens", F.round(F.when(used, rate).otherwise(0.0), 9).alias("rate"), F.when(used, copies).otherwise(F.lit(0)).cast("bigint").alias("copies")
    )


def mix_report(mix: DataFrame, targets: DataFrame, source: str = "source") -> DataFrame:
    """One row per listed source, and one per unlisted one: target and actual share of tokens, documents, copies, most uses."""
    per = mix.groupBy(F.col(f"`{source}`").alias("source")).agg(
        F.count("*").alias("documents"),
        F.sum("n_tokens").alias("tokens"),
        F.sum("copies").alias("copies"),
        F.sum(F.col("copies") * F.col("n_tokens")).alias("mixed_tokens"),
        F.max("copies").alias("most_uses"),
    )
    total = per.agg(F.sum("mixed_tokens").alias("all_tokens"))
    want = targets.select(F.col("source").alias("w"), "target_weight", "max_repeats")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return (
        per.join(want, F.col("source").eqNullSafe(F.col("w")), "full")
        .crossJoin(F.broadcast(total))
        .select(
            F.coalesce("source", "w").alias("source"), "target_weight", "max_repeats", zero("documents"), zero("tokens"), zero("copies"), zero("mixed_tokens"), zero("most_uses"),
            F.round(F.try_divide(F.coalesce("mixed_tokens", F.lit(0)).cast("double"), "all_tokens"), 6).alias("actual_share"),
        )
    )
