import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallygrove.operators import relational as R


def test_checked_join_and_unique(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (2, "d")], "k int, x string")
    right = spark.createDataFrame([(1, 10.0), (2, 20.0)], "k int, y double")
    got = {(r.k, r.x): r.y for r in R.checked_join(left, right, ["k"]).collect()}
    assert got == {(1, "a"): 10.0, (2, "b"): 20.0, (None, "c"): None, (2, "d"): 20.0}
    twice = right.unionByName(right.where("k = 2"))
    with pytest.raises(Exception, match="right keys are not unique"):
        R.checked_join(left, twice, ["k"]).collect()
    with pytest.raises(Exception, match="left keys are not unique"):
        R.checked_join(left, right, ["k"], shape="1:1").collect()
    assert R.assert_unique(right, ["k"]).count() == 2
    assert R.checked_join(left.limit(0), right, ["k"]).count() == 0


def test_null_keys_maps_and_reasons(spark):
    df = spark.createDataFrame([(1, None), (None, "p"), (2, "q")], "a int, b string")
    assert R.null_safe_join(df, df.select(F.col("a").alias("c")), [("a", "c")]).count() == 3
    got = [r[0] for r in df.orderBy(F.asc_nulls_first("a")).select(R.mapped(F.col("b"), {"p": "P"}, F.lit("-"))).collect()]
    assert got == ["P", "-", "-"]
    with pytest.raises(Exception, match="no entry for"):
        df.select(R.mapped(F.col("b"), {"p": "P"}, strict=True)).collect()
    reason = R.first_reason([("no a", F.col("a").isNull()), ("q", F.col("b") == "q")])
    assert [r[0] for r in df.orderBy(F.asc_nulls_first("a")).select(reason).collect()] == ["no a", None, "q"]
    assert [r[0] for r in df.orderBy(F.asc_nulls_first("a")).select(R.differs(F.col("a"), F.lit(1))).collect()] == [True, False, True]


def test_complete_conform_and_hash(spark):
    df = spark.createDataFrame([(1.0, "x"), (float("nan"), "x"), (float("inf"), "x"), (None, "x"), (2.0, None)], "v double, s string")
    assert [r.v for r in R.complete_cases(df, ["v", "s"]).collect()] == [1.0]
    want = T.StructType([T.StructField("s", T.StringType()), T.StructField("v", T.FloatType())])
    assert R.conform(df, want).schema.simpleString() == "struct<s:string,v:float>"
    one, two = R.content_hash(df, df.columns).first(), R.content_hash(df.repartition(5), df.columns).first()
    assert one == two and one != R.content_hash(df.limit(4), df.columns).first()


def test_prefix_bridge_grid_and_best_two(spark):
    labels = spark.createDataFrame([("AB123",), ("AB1",), ("X",), (None,)], "label string")
    refs = spark.createDataFrame([("AB",), ("AB12",), ("",), (None,), ("ZZ",)], "ref string")
    assert {(r.label, r.ref) for r in R.prefix_matches(labels, refs, "label", "ref").collect()} == {("AB123", "AB"), ("AB123", "AB12"), ("AB1", "AB")}
    a = R.tokens(spark.createDataFrame([(1, "p|q|"), (2, " q ;r"), (3, None), (4, "")], "i int, t string"), "i", F.col("t"))
    b = spark.createDataFrame([("m", "q"), ("m", "p"), ("n", "r"), ("n", "s")], "j string, token string")
    assert {(r.i, r.j): (r.shared, r.n_shared) for r in R.bridge(a, b, "i", "j").collect()} == {(1, "m"): ("p|q", 2), (2, "m"): ("q", 1), (2, "n"): ("r", 1)}
    cells = spark.createDataFrame([("x", 1, 5)], "g string, v int, n int")
    full = R.grid(cells, [spark.createDataFrame([("x",), ("y",)], "g string"), spark.createDataFrame([(1,), (2,)], "v int")], ["g", "v"], {"n": 0})
    assert {(r.g, r.v): r.n for r in full.collect()} == {("x", 1): 5, ("x", 2): 0, ("y", 1): 0, ("y", 2): 0}
    scores = spark.createDataFrame([("k", "b", 2.0), ("k", "a", 2.0), ("k", "c", None), ("o", "z", 1.0)], "k string, l string, s double")
    assert {r.k: (r.best, r.second, r.margin) for r in R.best_two(scores, ["k"], "l", "s").collect()} == {"k": ("a", "b", 0.0), "o": ("z", None, None)}
