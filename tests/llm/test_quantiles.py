import numpy as np
import pytest
from pyspark.sql import functions as F

from tallygrove.llm.quantiles import ERROR, LEVEL0, Both, Compactor, merged_quantiles, sketch_levels

PROBS = [0.0001, 0.001, 0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 0.999, 0.9999]


def worst(values, answers):
    ordered, n, out = np.sort(values), len(values), 0.0
    for p, v in zip(PROBS, answers, strict=True):
        want = max(1, int(np.ceil(p * n)))
        low, high = np.searchsorted(ordered, v, "left") + 1, np.searchsorted(ordered, v, "right")
        miss = max(low - want, want - high, 0)
        out = max(out, miss / (min(want, n - want) + 1))
    return out


@pytest.mark.parametrize("kind", ["lognormal", "ties", "sorted", "falling"])
@pytest.mark.parametrize("parts", [1, 30, 700])
def test_relative_rank_error_over_merges(kind, parts):
    rng = np.random.default_rng(parts)
    x = rng.lognormal(size=200_000) if kind != "ties" else rng.integers(0, 50, 200_000).astype(float)
    x = np.sort(x) if kind == "sorted" else -np.sort(-x) if kind == "falling" else x
    total = Both()
    for part in np.array_split(x, parts):
        one = Both()
        for piece in np.array_split(part, 3):
            one.add(piece)
        total.merge(Both.unpack(one.pack()))
    assert total.lo.n == len(x) and worst(x, total.quantiles(PROBS)) <= ERROR
    assert len(total.pack()) < 400_000


def test_small_groups_are_exact_and_packing_is_lossless():
    x = np.random.default_rng(0).normal(size=LEVEL0)
    one = Both()
    one.add(x)
    assert one.quantiles([0.5, 0.9]) == [np.sort(x)[LEVEL0 // 2 - 1], np.sort(x)[int(np.ceil(0.9 * LEVEL0)) - 1]]
    assert Both.unpack(one.pack()).quantiles(PROBS) == one.quantiles(PROBS)
    assert np.isnan(Compactor().quantiles([0.5])[0])


def test_frames(spark):
    rows = [("a", "x", 1.0), ("a", "x", float("nan")), ("a", "y", None), ("a", "y", 3.0), (None, "x", 5.0), (None, "x", 5.0), ("b", "x", None)]
    df = spark.createDataFrame(rows, "level string, key string, measure double").repartition(3)
    got = merged_quantiles(sketch_levels(df, {"m": F.col("measure")}, {"one": [F.col("level")], "two": [F.col("level"), F.col("key")]}), [0.5, 1.0])
    out = {(r.level, tuple(r.key)): (r.n, r.q) for r in got.collect()}
    assert out == {("one", ("a",)): (2, [1.0, 3.0]), ("one", (None,)): (2, [5.0, 5.0]), ("two", ("a", "x")): (1, [1.0, 1.0]), ("two", ("a", "y")): (1, [3.0, 3.0]), ("two", (None, "x")): (2, [5.0, 5.0])}
    assert merged_quantiles(sketch_levels(df.limit(0), {"m": F.col("measure")}, {"one": [F.col("level")]}), [0.5]).count() == 0


def test_days_merge_to_the_same_as_all(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i % 30), float(v)) for i, v in enumerate(rng.lognormal(size=30_000))]
    df = spark.createDataFrame(rows, "day int, v double").repartition(5)
    days = merged_quantiles(sketch_levels(df, {"v": F.col("v")}, {"day": [F.col("day")]}), [0.5])
    every = merged_quantiles(days.select(F.lit("all").alias("level"), F.array(F.lit("all")).alias("key"), "measure", F.lit(0).cast("long").alias("part"), F.col("key")[0].cast("long").alias("seq"), "sketch"), PROBS).collect()[0]
    assert every.n == 30_000 and worst(np.array([v for _, v in rows]), every.q) <= ERROR


def test_merge_does_not_depend_on_arrival_and_hot_groups_go_in_spans(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.lognormal(size=60_000)
    df = spark.createDataFrame([(float(v),) for v in x], "v double").repartition(20)
    parts = sketch_levels(df, {"v": F.col("v")}, {"all": [F.lit("a")]})
    rows = parts.collect()
    assert sorted(r.part for r in rows) == list(range(20))
    kept = lambda order: spark.createDataFrame([rows[i] for i in order], parts.schema).repartition(7)
    monkeypatch.setattr("tallygrove.llm.quantiles.FAN", 4)
    one = merged_quantiles(kept(range(20)), PROBS).collect()
    two = merged_quantiles(kept(rng.permutation(20)), PROBS).collect()
    assert one == two and len(one) == 1 and one[0].n == 60_000 and worst(x, one[0].q) <= ERROR
    monkeypatch.setattr("tallygrove.llm.quantiles.FAN", 256)
    assert merged_quantiles(kept(range(20)), PROBS).collect() == merged_quantiles(kept(rng.permutation(20)), PROBS, 20).collect()
