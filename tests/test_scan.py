"""Prefix scans over even parts against windows over whole keys."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from foliograph.operators import grid as G
from foliograph.operators import lines as L
from foliograph.operators import scan as P


def rows(spark, n, keys, seed=1):
    r = random.Random(seed)
    data = [(r.choice(keys), i, r.choice([None, *range(40)]), float(r.randrange(5 * n)), r.randrange(1, 9)) for i in range(n)]
    r.shuffle(data)
    return spark.createDataFrame(data, "k string, i long, v long, a double, w long").withColumn("b", F.col("a") + F.col("w"))


CASES = [(0, ["x"]), (1, ["x"]), (3, ["x", None]), (600, ["x"]), (600, ["x"] * 30 + [None, "y", "z"]), (500, [f"k{i}" for i in range(400)])]


@pytest.mark.parametrize("n, keys", CASES)
def test_scans_equal_windows(spark, n, keys):
    df = rows(spark, n, keys).persist()
    w = Window.partitionBy("k").orderBy("i")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    same = lambda a, b, *cols: sorted(map(repr, a.select(*cols).collect())) == sorted(map(repr, b.select(*cols).collect()))
    s = P.even_rows(df, ["k"], ["i"], parts=2)
    assert same(P.running(s, F.col("v"), "max", "o", before=True), df.withColumn("o", F.max("v").over(before)), "k", "i", "o")
    assert same(P.running(s, F.col("v"), "sum", "o"), df.withColumn("o", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0))), "k", "i", "o")
    assert same(P.running(s, F.col("v"), "last", "o"), df.withColumn("o", F.last("v", ignorenulls=True).over(w)), "k", "i", "o")
    for step in (-1, 1):
        assert same(P.neighbour(s, F.col("v"), step, "o"), df.withColumn("o", F.lag("v", -step).over(w)), "k", "i", "o")
    df.unpersist()


@pytest.mark.parametrize("n, keys", CASES[3:5])
def test_operators_equal_windows(spark, n, keys):
    df = rows(spark, n, keys).persist()
    same = lambda a, b: a.columns == b.columns and sorted(map(repr, a.collect())) == sorted(map(repr, b.select(*a.columns).collect()))
    for f in (lambda even: L.accept_increasing(df, ["k"], ["i"], "v", even=even), lambda even: L.carry(df, ["k"], ["i"], "v", "c", even=even), lambda even: L.extents(df.select("k", "i"), ["k"], "i", F.lit(-1), even=even)):
        assert same(f(True).select(*sorted(f(True).columns)), f(False).select(*sorted(f(False).columns)))
    stream = df.select(F.lit("d").alias("doc_id"), F.col("w").alias("page"), F.col("a").alias("y"), F.col("i").alias("ord"))
    mark = stream.where("ord % 7 = 0").withColumn("mark", F.lit(1))
    assert same(L.merge_stream(stream, mark, even=True), L.merge_stream(stream, mark))
    islands = lambda out: out.groupBy("k", "island").agg(F.min("a"), F.max("b"), F.count("*"))
    assert same(islands(P.running_islands(df, ["k"], "a", "b", 1.0, ties=("i",))), islands(G.running_islands(df, ["k"], "a", "b", 1.0)))
    runs = lambda out: out.groupBy("k", "run").agg(F.count("*"), F.min("i"))
    old = G.contiguous_groups(df, ["k"], ["i"], "v")
    first = old.groupBy("k").agg(F.min("run").alias("r0"))  # the window's first run is 0 if it begins with a null
    old = old.join(first, old["k"].eqNullSafe(first["k"])).select(old["*"], "r0").withColumn("run", F.col("run") - F.col("r0") + 1).drop("r0")
    assert same(runs(P.contiguous_groups(df, ["k"], ["i"], "v")), runs(old))
    ok = F.coalesce(F.col("v") < 38, F.lit(True))
    assert same(P.until_first_miss(df, ["k"], ["i"], ok), G.stop_at_first_miss(df, ["k"], ["i"], ok))
    df.unpersist()


def test_parts_are_even_whatever_the_keys(spark):
    """One key holds all rows; no part is above the mean by more than a tenth, and the windows add no exchange to the even one."""
    n = 20_000
    df = spark.range(n).select(F.lit("x").alias("k"), F.pmod(F.xxhash64("id"), F.lit(1000)).alias("i"), "id")
    s = P.even_rows(df, ["k"], ["i", "id"], parts=7)
    sizes = [r["count"] for r in s.rows.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 7 and max(sizes) <= 1.1 * n / 7
    plan = P.running(s, F.col("id"), "max", "m")._jdf.queryExecution().executedPlan().toString()
    window = plan[plan.index("Window [max(id") :]
    assert "REPARTITION_BY_NUM" in window[window.index("Exchange") :].split("\n")[0]
