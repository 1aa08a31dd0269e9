import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tallygrove.operators.orphans import orphan_references

DAY = dt.datetime(2024, 1, 1)


def at(n):
    return None if n is None else DAY + dt.timedelta(hours=n)


def run(spark, kids, folk, until=True):
    c = spark.createDataFrame([(i, k, at(t), "z") for i, k, t in kids], "row_id long, fk string, loaded_at timestamp, kind string")
    p = spark.createDataFrame([(k, at(a), at(b), 1) for k, a, b in folk], "pk string, loaded_at timestamp, deleted_at timestamp, t int")
    got = orphan_references(c, p, "row_id", F.col("fk"), "loaded_at", F.col("pk"), "loaded_at", "deleted_at" if until else None)
    return {r.row_id: r.kind for r in got.collect()}


def brute(kids, folk):
    out = {}
    for i, k, t in kids:
        if k is None:
            continue
        own = [(a, b) for p, a, b in folk if p == k]
        t_ = float("inf") if t is None else t
        if not own:
            out[i] = "missing"
        elif not any(a is not None and a <= t_ for a, _ in own):
            out[i] = "late"
        elif not any(a is not None and a <= t_ and (b is None or b > t_) for a, b in own):
            out[i] = "deleted"
    return out


def test_kinds_and_edges(spark):
    folk = [("a", 5, None), ("b", 1, 10), ("b", 20, None), ("c", 1, 10), ("c", 1, 10), (None, 0, None), ("d", None, None), ("e", 8, 4), ("e", 2, 9)]
    kids = [(1, "a", 5), (2, "a", 4), (3, "b", 9), (4, "b", 10), (5, "b", 15), (6, "b", 20), (7, "c", 11), (8, "x", 3), (9, None, 3), (10, "d", 3), (11, "a", None), (12, "c", 1), (13, "c", 1), (14, "e", 6)]
    got = run(spark, kids, folk)
    assert got == brute(kids, folk) == {2: "late", 4: "deleted", 5: "deleted", 7: "deleted", 8: "missing", 10: "late"}


def test_empty(spark):
    assert run(spark, [], [("a", 1, None)]) == {}
    assert run(spark, [(1, "a", 2)], []) == {1: "missing"}


@pytest.mark.parametrize("seed", range(3))
def test_random_against_brute_force(spark, seed):
    rng = random.Random(seed)
    # one key with most rows, months of comings and goings
    key = lambda: rng.choice(["hot"] * 6 + ["b", "c", "d"])
    folk = [(key(), (s := rng.randrange(0, 3000)), rng.choice([None] if rng.random() < 0.02 else [s + rng.randrange(1, 60)])) for _ in range(60)]
    kids = [(i, rng.choice([key(), "none"]), rng.randrange(0, 3200)) for i in range(300)]
    assert run(spark, kids, folk) == brute(kids, folk)
