"""The join of intervals by bins against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from foliograph.operators.intervals import interval_join


@pytest.mark.parametrize("seed, unit", [(1, 1.0), (2, 0.25), (3, 50.0)])
def test_pairs_equal_a_range_join(spark, seed, unit):
    r = random.Random(seed)

    def rows(n, points=False):
        out = []
        for i in range(n):
            lo = r.choice([r.uniform(-40, 200), float(r.randrange(-40, 200))])
            out.append((i, r.choice(["x", "x", "x", "y", None]), lo, lo if points or r.random() < 0.2 else lo + r.choice([0.5, 1, 2, 17.3, 64, 300])))
        return [*out, (n, "x", None, 1.0), (n + 1, "x", 5.0, None), (n + 2, "x", 9.0, 3.0), (0, "x", 1.0, 2.0), (0, "x", 1.0, 2.0)]

    a, b = rows(120, points=seed == 1), rows(60)
    left, right = spark.createDataFrame(a, "i long, k string, lo double, hi double"), spark.createDataFrame(b, "j long, k string, z0 double, z1 double")
    ok = lambda t: None not in (t[2], t[3]) and t[2] <= t[3]
    want = sorted((x[0], y[0]) for x in a for y in b if ok(x) and ok(y) and x[1] == y[1] and x[1] is not None and x[2] <= y[3] and y[2] <= x[3])
    assert sorted((t.i, t.j) for t in interval_join(left, right, ["k"], ("lo", "hi"), ("z0", "z1"), unit).collect()) == want and want
    assert interval_join(left.limit(0), right, ["k"], ("lo", "hi"), ("z0", "z1"), unit).count() == 0


def test_one_page_spreads_over_tasks(spark):
    """Words and zones of one page, and one zone that covers it all: the exchange is by bin too, so that no task holds the page."""
    words = spark.range(40_000).select(F.lit(1).alias("page"), F.col("id").alias("w"), (F.col("id") * 7 % 40_000).cast("double").alias("x"))
    zones = spark.range(400).select(F.lit(1).alias("page"), F.col("id").alias("z"), (F.col("id") * 100.0).alias("z0"), F.when(F.col("id") == 0, 40_000.0).otherwise(F.col("id") * 100.0 + 40).alias("z1"))
    pairs = interval_join(words, zones, ["page"], ("x", "x"), ("z0", "z1"), unit=64)
    assert pairs.count() == 40_000 + 399 * 41
    spread = pairs.where("z > 0").groupBy(F.floor(F.col("x") / 64)).count().agg(F.count("*"), F.max("count")).first()
    assert spread[0] > 500 and spread[1] <= 64
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "a_bin" in plan[plan.index("Join") :].split("\n")[0]


def test_an_interval_is_filed_only_in_levels_that_the_other_side_has(spark):
    from foliograph.operators.intervals import filed_levels

    levels = spark.createDataFrame([(0,), (2,), (5,)], "own int")
    assert [r[0] for r in levels.orderBy("own").select(filed_levels(F.col("own"), [0, 2, 4])).collect()] == [[0, 2, 4], [2, 4], [5]]
    assert [r[0] for r in levels.orderBy("own").select(filed_levels(F.col("own"), [])).collect()] == [[0], [2], [5]]


def test_words_of_one_place_meet_a_zone_once(spark):
    from foliograph.plans import catalog

    text = catalog.queries()["zones_of_one_page"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Aggregate") == 2 and text.index("Join") < text.rindex("Aggregate")
