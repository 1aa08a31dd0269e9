import random

import pytest

from tallygrove.llm.graph import seed_tree_components, star_components
from tallygrove.llm.groups import group_every_record, match_groups

ENGINES = [seed_tree_components, star_components]


def brute(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {x: find(x) for x in parent}


def run(spark, engine, pairs, kind="long"):
    df = spark.createDataFrame([(a, b, 1) for a, b in pairs], f"left {kind}, right {kind}, u int")
    rows = engine(df, "left", "right").collect()
    assert len({r.node for r in rows}) == len(rows)
    return {r.node: r.root for r in rows}


SHAPES = {
    "empty": [],
    "self and null": [(1, 1), (None, 2), (3, None), (None, None)],
    "chain": [(i, i + 1) for i in range(40)],
    "reverse chain": [(40 - i, 39 - i) for i in range(40)],
    "star": [(0, i) for i in range(1, 60)],
    "star around the largest": [(99, i) for i in range(60)],
    "repeats and both orders": [(5, 3), (3, 5), (5, 3), (9, 8), (8, 8)],
    "two cliques and a bridge": [(i, j) for i in range(8) for j in range(i)] + [(20 + i, 20 + j) for i in range(8) for j in range(i)] + [(7, 27)],
}


@pytest.mark.parametrize("engine", ENGINES)
@pytest.mark.parametrize("name", SHAPES)
def test_shapes(spark, engine, name):
    assert run(spark, engine, SHAPES[name]) == brute(SHAPES[name])


@pytest.mark.parametrize("engine", ENGINES)
@pytest.mark.parametrize("seed", range(2))
def test_random(spark, engine, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(7, rng.randrange(300)) for _ in range(80)]
    assert run(spark, engine, pairs) == brute(pairs)
    words = [(f"n{a:04d}", f"n{b:04d}") for a, b in pairs]
    assert run(spark, engine, words, "string") == brute(words)


def test_match_groups_scores_and_spellings(spark):
    rows = [
        ("GLX-101-0000002", "glx/101/0000003", 0.4), ("GLX 101 0000003", "GLX-101-0000004", 0.354), ("GLX-101-0000005", "GLX-101-0000006", 0.3539),
        ("GLX-101-0000007", "GLX-101-0000008", float("nan")), ("GLX-101-0000007", "GLX-101-0000009", None), (None, "GLX-101-0000002", 0.5), ("NA", "NA", 0.5), ("GLX-101-0000007", "GLX-101-0000007", 0.5),
    ]
    df = spark.createDataFrame(rows, "root string, node string, kinship double")
    groups = match_groups(df, "root", "node", "kinship", 0.354)
    got = {r.node: r.group_id for r in groups.collect()}
    assert got == dict.fromkeys(["GLX-101-0000002", "GLX-101-0000003", "GLX-101-0000004"], "GLX-101-0000002")
    records = spark.createDataFrame([(1, "GLX-101-0000004"), (2, "GLX-101-0000009"), (3, None), (4, "glx-101-0000004")], "n int, node string")
    every = {r.n: r.match_group_id for r in group_every_record(records, "node", groups).collect()}
    assert every == {1: "GLX-101-0000002", 2: "GLX-101-0000009", 3: None, 4: "GLX-101-0000002"}
