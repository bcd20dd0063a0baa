"""Two-level windows and salted joins against plain ones."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from evidra.operators.skew import salted_lookup, two_level_last, two_level_running


def rows(spark, seed):
    rnd = random.Random(seed)
    data = [(i, rnd.choice(["hot", "hot", "hot", "a", None]), rnd.randrange(50), rnd.choice([None, None, rnd.randrange(9)])) for i in range(400)]
    return spark.createDataFrame(data, "i int, g string, t int, v int").withColumn("b", F.floor(F.col("t") / 10))


def test_running(spark):
    df = rows(spark, 1).withColumn("one", F.lit(1))
    w = Window.partitionBy("g").orderBy("t", "i").rowsBetween(Window.unboundedPreceding, -1)
    want = {r.i: r.x for r in df.withColumn("x", F.coalesce(F.sum("one").over(w), F.lit(0))).collect()}
    assert {r.i: r.x for r in two_level_running(df, "g", "b", ["t", "i"], "one", "x").collect()} == want


def test_last(spark):
    df = rows(spark, 2)
    for own, end in ((True, 0), (False, -1)):
        w = Window.partitionBy("g").orderBy("t", "i").rowsBetween(Window.unboundedPreceding, end)
        want = {r.i: r.x for r in df.withColumn("x", F.last("v", ignorenulls=True).over(w)).collect()}
        assert {r.i: r.x for r in two_level_last(df, "g", "b", ["t", "i"], "v", "x", include_own=own).collect()} == want


def test_salted(spark):
    df = rows(spark, 3)
    lookup = spark.createDataFrame([("hot", 240, "H"), ("a", 80, "A"), ("none", 1, "N")], "g string, n int, name string")
    got = salted_lookup(df, lookup, "g", "n", 400, F.col("i"))
    assert got.count() == 400 and {(r.g, r.name) for r in got.collect()} == {("hot", "H"), ("a", "A"), (None, None)}
    spread = got.where("g = 'hot'")
    assert set(spread.columns) == {*df.columns, "name"}
