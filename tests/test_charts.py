import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallygrove.operators.charts import Chart, control_chart

SCHEMA = "s int, r long, e1 string, e2 string, t timestamp, v double, log boolean, low double, high double, extra string"
START = dt.datetime(2024, 1, 1)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def source(values, e1="P", e2="A", first=1, s=0, log=False, low=-40.0, high=40.0):
    return [(s, first + i, e1, e2, START + dt.timedelta(seconds=40 * i), None if v is None else float(v), log, low, high, "x") for i, v in enumerate(values)]


def flags(df):
    return {(r.s, r.r): r.kind for r in df.collect()}


def test_spikes_levels_limits_and_runs(spark):
    rng = np.random.default_rng(0)
    one = rng.normal(5, 0.2, 92)
    one[[10, 50]] = [9.0, 1.0]
    two = np.where(rng.random(92) < 0.25, 3.0, 5.0) + rng.normal(0, 0.1, 92)
    two[70] = 7.0
    run = rng.normal(2, 0.3, 60)
    run[20:25] = 2.111
    run[40:44] = 1.999
    bad = rng.normal(0, 1, 40)
    bad[5] = 999.0
    rows = source(one, first=1) + source(two, e2="B", first=1001) + source(run, e2="C", first=2001) + source(bad, e2="D", first=3001)
    got = flags(control_chart(frame(spark, rows)))
    want = {(0, 11): "spike", (0, 51): "spike", (0, 1071): "spike", **{(0, 2021 + i): "stuck" for i in range(5)}, (0, 3006): "limit"}
    assert got == want


def test_nulls_nan_repeats_and_empty(spark):
    rng = np.random.default_rng(1)
    values = list(rng.normal(5, 0.2, 40))
    values[3], values[7] = None, float("nan")
    for i in (10, 11, 13, 14, 15):
        values[i] = 5.05
    values[12] = None  # skipped: the run goes on
    rows = source(values)
    # a repeated row takes no part in the length of a run, but shares its fate
    rows += [(0, 900, "P", "A", rows[10][4], 5.05, False, -40.0, 40.0, "x")]
    four = list(rng.normal(5, 0.2, 40))
    for i in (20, 21, 22, 23):
        four[i] = 5.0
    extra = source(four, e2="B", first=2001)
    rows += extra + [(0, 2900, "P", "B", extra[21][4], 5.0, False, -40.0, 40.0, "x")]
    got = flags(control_chart(frame(spark, rows)))
    assert got == {**{(0, 1 + i): "stuck" for i in (10, 11, 13, 14, 15)}, (0, 900): "stuck"}
    assert control_chart(frame(spark, [])).count() == 0
    assert control_chart(frame(spark, source([None, float("nan")]))).count() == 0


def test_null_sources_short_sources_and_constant_values(spark):
    rows = [(0, 1, None, "A", START, 99.0, False, -40.0, 40.0, "x"), (0, 2, None, None, None, 3.0, False, None, None, "x")]
    rows += source([1.0, 1.0, 50.0], e1="short", first=10)
    # constant but for one far reading: runs of equals are stuck, the far one a spike
    rows += source([2.0] * 6 + [9.0] + [2.0] * 6, e1="flat", first=100, low=None, high=None)
    got = flags(control_chart(frame(spark, rows)))
    assert got == {(0, 1): "limit", (0, 12): "limit", **{(0, 100 + i): "stuck" for i in range(13) if i != 6}, (0, 106): "spike"}


@pytest.mark.parametrize("block", [7, 25])
def test_split_source_gives_the_same_runs_and_limits(spark, block):
    rng = np.random.default_rng(2)
    v = rng.normal(5, 0.2, 400)
    v[95:130] = 4.9  # crosses many blocks
    v[200:204] = 5.1  # too short
    v[300:305] = 5.2
    v[10] = 99.0
    df = frame(spark, source(v))
    chart = Chart(limit=1e9)
    whole = flags(control_chart(df, chart))
    cut = flags(control_chart(df, Chart(limit=1e9, block=block)))
    assert cut == whole and len(whole) == 41


def test_big_source_spikes_stay(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(5, 0.2, 3000)
    where = rng.choice(3000, 25, replace=False)
    v[where] += rng.choice([-4, 4], 25)
    got = flags(control_chart(frame(spark, source(v)), Chart(block=500)))
    assert {r - 1 for _, r in got} == set(where.tolist())


@pytest.mark.parametrize("block", [60, 400])
def test_split_source_gives_the_same_spikes_as_whole(spark, block):
    rng = np.random.default_rng(4)
    v = rng.normal(5, 0.2, 1625)
    v[900:1030] = rng.normal(2, 0.2, 130)  # a normal second level of 8 %, all in few blocks
    v[1100:] += 0.5  # a shift
    v[[100, 950, 1300, 1623]] = [8.0, 9.0, 0.0, -3.0]  # the last one in a block of few readings
    ties = np.round(rng.normal(3, 0.3, 900), 1)
    ties[:60] = 1.0
    rows = source(v) + source(2.0**ties, e2="B", first=5001, log=True) + source(rng.normal(0, 1, 50), e2="C", first=9001)
    whole = flags(control_chart(frame(spark, rows), Chart(run=6)))
    cut = flags(control_chart(frame(spark, rows), Chart(run=6, block=block)))
    assert cut == whole
    assert {r - 1 for (_, r), k in whole.items() if k == "spike" and r < 5000} >= {100, 950, 1300, 1623}


def test_levels_of_a_whole_source_from_ranges(spark):
    from tallygrove.operators.charts import _levels, _whole_levels
    from tallygrove.session import Stash

    rng = np.random.default_rng(5)
    groups = [rng.normal(5, 0.2, 501), np.r_[rng.normal(5, 0.2, 450), rng.normal(9, 0.2, 50)], np.round(rng.normal(0, 1, 400), 1), np.r_[np.full(300, 1.0), np.full(40, 7.0)], np.full(20, 3.0)]
    rows = [(k, 0, float(x)) for k, g in enumerate(groups) for x in g]
    got = {r.h: r for r in _whole_levels(spark.createDataFrame(rows, "h long, g int, x double"), Chart(block=90), Stash(spark)).collect()}
    for k, g in enumerate(groups):
        lo, hi, scale = (a[0] for a in _levels(np.sort(g)[None, :], np.array([len(g)]), Chart()))
        assert (got[k].lo, got[k].hi, got[k].base) == pytest.approx((lo, hi, scale), rel=1e-6) and got[k].single == (lo == hi)


@pytest.mark.parametrize(("block", "n"), [(7, 701), (25, 1002), (250, 1258), (1000, 2004)])
def test_short_last_blocks_lose_no_spike(spark, block, n):
    """Spikes in every part and in the last readings; the last block has one to eight readings."""
    rng = np.random.default_rng(block)
    v = rng.normal(5, 0.2, n)
    where = np.r_[rng.choice(n - 30, 12, replace=False), n - 2]
    v[where] += rng.choice([-4, 4], len(where))
    v[n // 2 : n // 2 + n // 9] += 2.0  # a second level of its own time
    df = frame(spark, source(v))
    whole, cut = flags(control_chart(df)), flags(control_chart(df, Chart(block=block)))
    assert cut == whole and {r - 1 for _, r in whole} >= set(where.tolist()) - set(range(n // 2, n // 2 + n // 9))
