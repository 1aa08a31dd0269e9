"""Implausible spikes in measurements: robust exponentially weighted control charts per source (problem 3)."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallygrove.session import Stash

HOUR_US, SECOND_US = 3_600_000_000, 1_000_000


@dataclass(frozen=True)
class Chart:
    """`limit` scales beyond its outermost level make a reading a spike; `clip` scales bound what one reading may move.

    `pace` and `scale_pace` are the weights of a new reading in mean and scale. A second level needs `least_level` of the
    readings and a distance of `apart` scales. Sources with fewer than `least_points` plausible readings have no chart.
    `run` equal readings in a row are stuck. A source of more than `block` rows is charted in pieces of about as many that
    hand on their state.
    """

    limit: float = 5.5
    clip: float = 3.0
    pace: float = 0.03
    scale_pace: float = 0.01
    trim: float = 0.05
    least_level: float = 0.06
    apart: float = 4.5
    least_points: int = 8
    least_scale: float = 1e-3
    run: int = 5
    block: int = 50_000


def _levels(x: np.ndarray, n: np.ndarray, c: Chart) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower and upper level and the scale of each row of x, which is sorted, its n values first.

    Of the trimmed values the best split in two parts is taken as two levels if they lie apart, else all are one level.
    """
    rows, width = x.shape
    cut = np.maximum(np.ceil(c.trim * n), 1).astype(np.int64)
    m = n - 2 * cut
    at = np.arange(width)
    shift = x[np.arange(rows), n // 2]  # sums around the median keep their digits
    core = np.where((at >= cut[:, None]) & (at < (n - cut)[:, None]), x - shift[:, None], 0.0)
    s1, s2 = np.cumsum(core, axis=1), np.cumsum(core * core, axis=1)
    t1, t2 = s1[:, -1:], s2[:, -1:]
    k = at + 1 - cut[:, None]  # values left of a split behind column j
    rest = m[:, None] - k
    least = np.maximum(3, np.ceil(c.least_level * n)).astype(np.int64)[:, None]
    ok = (k >= np.maximum(least - cut[:, None], 2)) & (rest >= np.maximum(least - cut[:, None], 2))
    with np.errstate(divide="ignore", invalid="ignore"):
        inner = (s2 - s1 * s1 / k) + ((t2 - s2) - (t1 - s1) ** 2 / rest)
        inner = np.where(ok, np.maximum(inner, 0.0), np.inf)
        j = inner.argmin(axis=1)
        pick = np.arange(rows)
        best, kk = inner[pick, j], k[pick, j]
        lo, hi = s1[pick, j] / kk, (t1[:, 0] - s1[pick, j]) / (m - kk)
        within = np.sqrt(best / m)
        whole = np.sqrt(np.maximum(t2[:, 0] - t1[:, 0] ** 2 / m, 0.0) / m)
        two = np.isfinite(best) & (hi - lo > c.apart * within)
    # what trimming takes from the spread of a normal level: both tails of one level, one tail of each of two
    scale = np.where(two, within * 1.12, whole * 1.26)
    mid = t1[:, 0] / m
    return shift + np.where(two, lo, mid), shift + np.where(two, hi, mid), np.maximum(scale, c.least_scale)


def _scores(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, c: Chart) -> np.ndarray:
    """For every value its distance beyond the outermost level in scales of the chart at its time; NaN values have none."""
    out = np.zeros(len(values))
    order = np.argsort(sizes, kind="stable")
    at = 0
    while at < len(order):
        width = int(sizes[order[at]])
        upto = at
        # sources of nearly the same length share one matrix of at most four million cells
        while upto < len(order) and sizes[order[upto]] <= max(width * 1.25, width + 4) and (upto - at + 1) * sizes[order[upto]] <= 4_000_000:
            upto += 1
        upto = max(upto, at + 1)
        own = order[at:upto]
        at = upto
        width = int(sizes[own].max())
        idx = starts[own][:, None] + np.arange(width)[None, :]
        inside = np.arange(width)[None, :] < sizes[own][:, None]
        x = np.where(inside, values[np.minimum(idx, len(values) - 1)], np.nan)
        n = np.count_nonzero(~np.isnan(x), axis=1)
        keep = n >= c.least_points
        if not keep.any():
            continue
        x, n, idx, inside = x[keep], n[keep], idx[keep], inside[keep]
        lo, hi, scale = _levels(np.sort(x, axis=1), n, c)
        base, single = scale.copy(), lo == hi
        z = np.zeros_like(x)
        for t in range(x.shape[1]):
            v = x[:, t]
            seen = ~np.isnan(v)
            up, down = v - hi, v - lo
            z[:, t] = np.where(seen, np.where(up > 0, up, np.where(down < 0, down, 0.0)) / scale, 0.0)
            upper = np.abs(up) <= np.abs(down)
            step = np.where(seen, np.clip(np.where(upper, up, down), -c.clip * scale, c.clip * scale), 0.0)
            hi = hi + np.where(upper | single, c.pace * step, 0.0)
            lo = lo + np.where(~upper | single, c.pace * step, 0.0)
            scale = np.where(seen, np.clip(scale + c.scale_pace * (1.2533 * np.abs(step) - scale), 0.6 * base, 1.7 * base), scale)
        out[idx[inside]] = z[inside]
    return out


def _trace(x: np.ndarray, lo: float, hi: float, scale: float, base: float, single: bool, c: Chart) -> tuple[np.ndarray, float, float, float]:
    """What `_scores` gives for one piece of a source that starts from a known state, and the state at its end."""
    z = np.zeros(len(x))
    least, most = 0.6 * base, 1.7 * base
    for i, v in enumerate(x.tolist()):
        if v != v:
            continue
        up, down = v - hi, v - lo
        if up > 0:
            z[i] = up / scale
        elif down < 0:
            z[i] = down / scale
        upper = abs(up) <= abs(down)
        bound = c.clip * scale
        step = min(max(up if upper else down, -bound), bound)
        if upper or single:
            hi = hi + c.pace * step
        if not upper or single:
            lo = lo + c.pace * step
        scale = min(max(scale + c.scale_pace * (1.2533 * abs(step) - scale), least), most)
    return z, lo, hi, scale


_OUT = pa.schema([("s", pa.int32()), ("r", pa.int64()), ("kind", pa.string()), ("h", pa.int64()), ("g", pa.int32()), ("b", pa.int64()), ("side", pa.string()), ("v", pa.float64()), ("n", pa.int64())])


def _charted(cols: dict[str, np.ndarray], c: Chart) -> pa.RecordBatch:
    """Flags of complete blocks, whose rows are in the order of source, block, time and row id."""
    h, g, b, t, r, v, log, bad, s, hot = (cols[k] for k in ("h", "g", "b", "t", "r", "v", "log", "bad", "s", "hot"))
    size = len(h)
    fresh = np.r_[True, (h[1:] != h[:-1]) | (g[1:] != g[:-1]) | (b[1:] != b[:-1])]
    starts = np.flatnonzero(fresh)
    sizes = np.diff(np.r_[starts, size])
    with np.errstate(divide="ignore", invalid="ignore"):
        x = np.where(bad, np.nan, np.where(log, np.log2(np.where(v > 0, v, np.nan)), v))
    known = hot[starts]
    z = _scores(x, starts[~known], sizes[~known], c)
    for i, m in zip(starts[known], sizes[known], strict=True):
        if not np.isnan(cols["lo"][i]):  # else too few readings for a chart
            z[i : i + m] = _trace(x[i : i + m], *(float(cols[k][i]) for k in ("lo", "hi", "scale", "base")), bool(cols["single"][i]), c)[0]
    spike = np.abs(z) > c.limit
    # runs of equal readings; repeated rows share the time of what they repeat and add nothing to a run
    turn = np.r_[True, v[1:] != v[:-1]] | fresh
    place = (np.r_[True, t[1:] != t[:-1]] | fresh).astype(np.int64)
    run = np.cumsum(turn) - 1
    length = np.add.reduceat(np.where(turn, 1, place), np.flatnonzero(turn))[run]
    stuck = length >= c.run
    kind = np.where(bad, "limit", np.where(spike, "spike", np.where(stuck, "stuck", "")))
    found = np.flatnonzero(kind != "")
    parts = [(s[found], r[found], kind[found].astype(object), *[None] * 6)]
    if hot.any():
        first, last = np.flatnonzero(turn), np.r_[np.flatnonzero(turn)[1:], size] - 1
        for k in np.flatnonzero(hot[starts]):
            i, j = starts[k], starts[k] + sizes[k] - 1
            lead, trail = run[i], run[j]
            for q, side in ((lead, "W" if lead == trail else "L"), (trail, "R")):
                if side == "R" and lead == trail:
                    continue
                own = np.arange(first[q], last[q] + 1)
                own = own[kind[own] == ""]
                fill = lambda a, m: np.repeat(a, m)
                for rows, what in ((np.array([-1]), "sum"), (r[own], "edge")):
                    m = len(rows)
                    if m:
                        parts.append((fill(s[i], m), rows, fill(np.array([what], dtype=object), m), fill(h[i], m), fill(g[i], m), fill(b[i], m), fill(np.array([side], dtype=object), m), fill(v[first[q]], m), fill(length[first[q]], m)))
    batches = [pa.RecordBatch.from_arrays([pa.array(col, type=f.type) if col is not None else pa.nulls(len(p[0]), f.type) for col, f in zip(p, _OUT, strict=True)], schema=_OUT) for p in parts]
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0] if sum(map(len, batches)) else batches[0]


def _whole_levels(values: DataFrame, chart: Chart, stash: Stash) -> DataFrame:
    """(h, g, lo, hi, base, single) of each source as `_levels` gives them, from (h, g, x): no task needs a whole source.

    Equal values are counted once, ranges of values are tasks, and sums of the ranges before go into running sums.
    """
    counts = stash.keep(values.groupBy("h", "g", "x").agg(F.count("*").alias("c")), "values")
    parts = counts.count() // chart.block + 1
    ranges = stash.keep(counts.repartitionByRange(parts, "h", "g", "x").withColumn("p", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("h", "g", "p").orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("h", "g").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)

    def running(df: DataFrame, *names: str) -> DataFrame:
        sums = df.groupBy("h", "g", "p").agg(*[F.sum(n).alias(n) for n in names])
        earlier = sums.select("h", "g", "p", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"{n}_0") for n in names])
        return df.join(earlier, ["h", "g", "p"]).withColumns({f"{n}_to": F.sum(n).over(inside) + F.col(f"{n}_0") for n in names})

    sizes = ranges.groupBy("h", "g").agg(F.sum("c").alias("n"), F.percentile_approx("x", 0.5).alias("shift")).where(F.col("n") >= chart.least_points)
    sizes = sizes.withColumn("cut", F.greatest(F.ceil(F.lit(chart.trim) * F.col("n")), F.lit(1)))
    kept = F.greatest(F.least("c_to", F.col("n") - F.col("cut")) - F.greatest(F.col("c_to") - F.col("c"), "cut"), F.lit(0))
    ranked = running(ranges, "c").join(sizes, ["h", "g"]).withColumns({"kept": kept, "y": F.col("x") - F.col("shift")})
    ranked = stash.keep(ranked.select("h", "g", "p", "x", "y", "n", "cut", "shift", "kept", (F.col("kept") * F.col("y")).alias("s1"), (F.col("kept") * F.col("y") * F.col("y")).alias("s2")), "ranked")
    totals = ranked.groupBy("h", "g").agg(F.first("n").alias("n"), F.first("cut").alias("cut"), F.first("shift").alias("shift"), F.sum("s1").alias("t1"), F.sum("s2").alias("t2")).withColumn("m", F.col("n") - 2 * F.col("cut"))
    least = F.greatest(F.greatest(F.lit(3), F.ceil(F.lit(chart.least_level) * F.col("n"))) - F.col("cut"), F.lit(2))
    # equal values are parted at most where a level has its least share
    splits = running(ranked, "kept", "s1", "s2").select("h", "g", "y", "kept", "kept_to", "s1_to", "s2_to").join(totals.withColumn("least", least), ["h", "g"])
    splits = splits.withColumn("k", F.explode(F.array_distinct(F.array("kept_to", "least", F.col("m") - F.col("least")))))
    splits = splits.where("k <= kept_to and k > kept_to - kept and k >= least and k <= m - least")
    over = F.col("kept_to") - F.col("k")
    splits = splits.withColumns({"a1": F.col("s1_to") - over * F.col("y"), "a2": F.col("s2_to") - over * F.col("y") * F.col("y")})
    inner = F.greatest(F.expr("(a2 - a1 * a1 / k) + ((t2 - a2) - (t1 - a1) * (t1 - a1) / (m - k))"), F.lit(0.0))
    best = splits.groupBy("h", "g").agg(F.min(F.struct(inner.alias("inner"), "k", "a1")).alias("best"))
    got = totals.join(best, ["h", "g"], "left").select("h", "g", "shift", "t1", "t2", "m", "best.*")
    got = got.withColumns({"within": F.sqrt(F.col("inner") / F.col("m")), "whole": F.sqrt(F.greatest(F.expr("t2 - t1 * t1 / m"), F.lit(0.0)) / F.col("m")), "low": F.expr("a1 / k"), "high": F.expr("(t1 - a1) / (m - k)")})
    two = F.coalesce(F.col("high") - F.col("low") > F.lit(chart.apart) * F.col("within"), F.lit(False))
    pick = lambda a, b: F.when(two, a).otherwise(b)
    return got.select("h", "g", (F.col("shift") + pick(F.col("low"), F.expr("t1 / m"))).alias("lo"), (F.col("shift") + pick(F.col("high"), F.expr("t1 / m"))).alias("hi"), F.greatest(pick(F.col("within") * 1.12, F.col("whole") * 1.26), F.lit(chart.least_scale)).alias("base")).withColumn("single", F.col("lo") == F.col("hi"))


def _starts(rows: DataFrame, chart: Chart, stash: Stash) -> DataFrame:
    """(h, g, b, lo, hi, scale, base, single): the chart's state at the start of every block of the big sources.

    All blocks start from the levels of their whole source, then those whose predecessor ends in another state are charted
    again from that. A chart forgets its start, so this soon settles; sources where it does not, as one with a level that no
    reading visits for long, are followed block by block in one task each from where they are settled.
    """
    x = F.when(~F.col("bad"), F.when(~F.col("log"), F.col("v")).when(F.col("v") > 0, F.log2("v")))
    rows = rows.select("h", "g", "b", "t", "r", x.alias("x"))
    levels = stash.keep(_whole_levels(rows.where("x is not null").select("h", "g", "x"), chart, stash), "levels")
    packed = rows.groupBy("h", "g", "b").agg(F.sort_array(F.collect_list(F.struct("t", "r", "x"))).alias("x")).select("h", "g", "b", F.transform("x", lambda e: e["x"]).alias("x"))
    packed = stash.keep(packed, "packed")
    following = F.lead("b").over(Window.partitionBy("h", "g").orderBy("b"))
    starts = packed.select("h", "g", "b", following.alias("after")).join(levels.withColumn("scale", F.col("base")), ["h", "g"])
    names = ["h", "g", "b", "after", "lo", "hi", "scale", "base", "single"]
    starts = stash.keep(starts.select(names), "starts")

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        came, state = None, ()
        for batch in batches:
            out = []
            for i, d in enumerate(batch.drop_columns(["x"]).to_pylist()):
                if not d["chain"] or came != (d["h"], d["g"], d["b"]):
                    state = (d["lo"], d["hi"], d["scale"])
                x = batch.column("x")[i].values.to_numpy(zero_copy_only=False)
                state = _trace(x, *state, d["base"], d["single"], chart)[1:]
                came = (d["h"], d["g"], d["after"])
                out.append({"h": d["h"], "g": d["g"], "b": d["after"]} | dict(zip(("lo_", "hi_", "scale_"), state, strict=True)))
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("h", pa.int64()), ("g", pa.int32()), ("b", pa.int64()), *[(k, pa.float64()) for k in ("lo_", "hi_", "scale_")]]))

    due, chain = starts, False
    for rounds in itertools.count(1):
        given = due.where("after is not null").join(packed, ["h", "g", "b"]).select(*names, F.lit(chain).alias("chain"), "x")
        if chain:
            given = given.repartition("h", "g").sortWithinPartitions("h", "g", "b")
        told = given.mapInArrow(ends, "h long, g int, b long, lo_ double, hi_ double, scale_ double")
        moved = starts.join(told, ["h", "g", "b"]).where("lo_ != lo or hi_ != hi or scale_ != scale")
        moved = stash.keep(moved.select("h", "g", "b", "after", F.col("lo_").alias("lo"), F.col("hi_").alias("hi"), F.col("scale_").alias("scale"), "base", "single"), "moved")
        if moved.isEmpty():
            return starts.drop("after")
        starts = stash.keep(starts.join(moved, ["h", "g", "b"], "left_anti").unionByName(moved), "starts")
        if chain:
            return starts.drop("after")
        due, chain = moved, rounds >= 3
        if chain:
            first = moved.groupBy("h", "g").agg(F.min("b").alias("from"))
            due = starts.join(first, ["h", "g"]).where(F.col("b") >= F.col("from")).select(names)


def control_chart(readings: DataFrame, chart: Chart = Chart()) -> DataFrame:
    """(s, r, kind) of implausible readings.

    `readings` has s (int: which table), r (row id), e1 and e2 (the source), t (time), v (value), log (chart on the
    log2 scale), low and high (what can occur; null: no limit). kind: `limit` (outside low to high), `spike`, `stuck`;
    a reading of several kinds has the first. Null and NaN values are skipped; null sources are sources of their own;
    null times come last. Sources are hashed to tasks; one with more than `chart.block` rows is split in time into
    blocks that start from the whole source's levels as the block before left them, and runs of equal readings are joined
    again across blocks, so that the flags are those of the source in one piece. An empty table gives no rows.
    """
    clean = readings.where(F.col("v").isNotNull() & ~F.isnan("v"))
    ids = [F.coalesce(F.col(e).cast("string"), F.lit("\0")) for e in ("e1", "e2")]
    narrow = clean.select(
        F.xxhash64("s", *ids).alias("h"),
        F.hash(*ids, F.col("s")).alias("g"),
        F.coalesce(F.unix_micros(F.col("t").cast("timestamp")), F.lit(2**62)).alias("t"),
        "r",
        F.col("v").cast("double").alias("v"),
        "log",
        (F.coalesce(F.col("v") < F.col("low"), F.lit(False)) | F.coalesce(F.col("v") > F.col("high"), F.lit(False))).alias("bad"),
        F.col("s").cast("int").alias("s"),
    )
    spark = readings.sparkSession
    stash = Stash(spark)
    state = ["lo", "hi", "scale", "base", "single"]
    big = stash.keep(narrow.groupBy("h", "g").count().where(F.col("count") > chart.block).select("h", "g"), "hot")
    if big.isEmpty():
        ready = narrow.withColumns({"b": F.lit(0).cast("long"), "hot": F.lit(False)})
        state = []
    else:
        # big sources only: whole hours share a block while they fit, an hour that does not is cut by seconds
        hour, second = F.floor(F.col("t") / F.lit(HOUR_US)), F.floor(F.col("t") / F.lit(SECOND_US))
        theirs = narrow.join(big, ["h", "g"], "left_semi").select("h", "g", hour.alias("hour"), second.alias("second"))
        per_hour = theirs.groupBy("h", "g", "hour").count()
        before = Window.partitionBy("h", "g").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
        hours = per_hour.select("h", "g", "hour", "count", F.floor(F.coalesce(F.sum("count").over(before), F.lit(0)) / chart.block).alias("b1"))
        full = hours.where(F.col("count") > chart.block).select("h", "g", "hour")
        per_second = theirs.join(full, ["h", "g", "hour"], "left_semi").groupBy("h", "g", "hour", "second").count()
        earlier = Window.partitionBy("h", "g", "hour").orderBy("second").rowsBetween(Window.unboundedPreceding, -1)
        seconds = per_second.select("h", "g", "second", F.floor(F.coalesce(F.sum("count").over(earlier), F.lit(0)) / chart.block).alias("b2"))
        ready = (
            narrow.withColumns({"hour": hour, "second": second})
            .join(hours.drop("count"), ["h", "g", "hour"], "left")
            .join(seconds, ["h", "g", "second"], "left")
            .withColumns({"b": F.coalesce("b1", F.lit(0)) * (1 << 24) + F.coalesce("b2", F.lit(0)), "hot": F.col("b1").isNotNull()})
            .drop("hour", "second", "b1", "b2")
        )
        starts = _starts(ready.where("hot"), chart, stash)
        ready = ready.join(starts, ["h", "g", "b"], "left")
    ready = ready.select("h", "g", "b", "t", "r", "v", "log", "bad", "s", "hot", *state).repartition("h", "g", "b").sortWithinPartitions("h", "g", "b", "t", "r")
    names = ready.columns

    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def emit(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, rows
            full = pa.Table.from_batches(held).combine_chunks()
            cols = {n: full.column(n).to_numpy(zero_copy_only=False) for n in names}
            end = rows
            if not final:
                same = (cols["h"] == cols["h"][-1]) & (cols["g"] == cols["g"][-1]) & (cols["b"] == cols["b"][-1])
                end = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            held = full.slice(end).to_batches() if end < rows else []
            rows -= end
            if end:
                yield _charted({n: a[:end] for n, a in cols.items()}, chart)

        for batch in batches:
            if len(batch):
                held.append(batch)
                rows += len(batch)
            if rows >= 200_000:
                yield from emit(False)
        if rows:
            yield from emit(True)

    flags = ready.mapInArrow(flag, "s int, r long, kind string, h long, g int, b long, side string, v double, n long")
    plain = flags.where(~F.col("kind").isin("sum", "edge")).select("s", "r", "kind")
    if big.isEmpty():
        return plain
    flags = stash.keep(flags, "flags")
    plain = flags.where(~F.col("kind").isin("sum", "edge")).select("s", "r", "kind")
    # chain the first and last runs of neighbouring blocks
    along = Window.partitionBy("h", "g").orderBy("b", F.col("side") == "R")
    sums = flags.where("kind = 'sum'").select("h", "g", "b", "side", "v", "n")
    chained = sums.withColumn("joins", F.coalesce((F.lag("v").over(along) == F.col("v")) & (F.lag("b").over(along) != F.col("b")), F.lit(False)))
    island = chained.withColumn("i", F.sum((~F.col("joins")).cast("long")).over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    long_runs = island.join(island.groupBy("h", "g", "i").agg(F.sum("n").alias("total")).where(F.col("total") >= chart.run), ["h", "g", "i"]).select("h", "g", "b", "side")
    edges = flags.where("kind = 'edge'").join(long_runs, ["h", "g", "b", "side"], "left_semi").select("s", "r", F.lit("stuck").alias("kind"))
    return plain.unionByName(edges)


def readings_of(df: DataFrame, table_no: int, row: str, source: tuple[str, str], time: str, value: str, log: bool, low: Column, high: Column) -> DataFrame:
    return df.select(F.lit(table_no).alias("s"), F.col(row).alias("r"), F.col(source[0]).alias("e1"), F.col(source[1]).alias("e2"), F.col(time).alias("t"), F.col(value).alias("v"), F.lit(log).alias("log"), low.alias("low"), high.alias("high"))
