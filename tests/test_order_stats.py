"""Exact order statistics against sorted lists."""

import math
import random

import pytest
from pyspark.sql import functions as F

from foliograph.operators import order_stats as Q

SHARES = (0.0, 0.1, 0.5, 0.999, 1.0)


def plain(data, shares):
    by = {}
    for k, v in data:
        if v is not None:
            by.setdefault(k, []).append(v)
    out = []
    for k, vs in by.items():
        vs.sort(key=lambda x: (math.isnan(x), x))
        out += [(k, q, len(vs), vs[min(int(q * len(vs)), len(vs) - 1)]) for q in shares]
    return sorted(map(repr, out))


@pytest.mark.parametrize("hot", [1, 4, 10_000])  # no key, some keys, every key is narrowed down
@pytest.mark.parametrize("case", ["ties", "distinct", "edges"])
def test_equal_to_sorted_lists(spark, case, hot):
    r = random.Random(5)
    if case == "edges":
        data = [(None, 1.0), (None, float("nan")), ("a", None), ("b", 2.0), ("b", 2.0), ("b", None), ("c", float("-inf")), ("c", float("inf")), ("c", -0.5)]
    else:
        value = (lambda: float(r.randrange(5))) if case == "ties" else (lambda: r.random())
        data = [(r.choice(["a"] * 8 + ["b", "c", None]), value()) for _ in range(3000)]
    df = spark.createDataFrame(data, "k string, v double")
    got = Q.order_statistics(df, ["k"], "v", SHARES, hot=hot).collect()
    assert sorted(map(repr, map(tuple, got))) == plain(data, SHARES)


def test_empty_without_key_and_large_integers(spark):
    empty = spark.createDataFrame([], "k string, v long")
    assert Q.order_statistics(empty, ["k"], "v").count() == 0 and Q.order_statistics(empty, [], "v").count() == 0
    n = 2**60  # beyond what the sketch tells apart
    df = spark.range(n, n + 1001).select(F.col("id").alias("v"))
    assert [tuple(x) for x in Q.order_statistics(df, [], "v", (0.5,)).collect()] == [(0.5, 1001, n + 500)]


def test_a_bad_sketch_costs_no_result(spark, monkeypatch):
    monkeypatch.setattr(F, "percentile_approx", lambda c, near, accuracy: F.array(*[F.min(c) + F.lit(400.0)] * len(near)))
    df = spark.range(1000).select(F.lit("a").alias("k"), F.col("id").cast("double").alias("v"))
    got = {x.share: x.v for x in Q.order_statistics(df, ["k"], "v", (0.1, 0.4, 0.9)).collect()}
    assert got == {0.1: 100.0, 0.4: 400.0, 0.9: 900.0}


def test_only_the_range_of_a_rank_is_ordered(spark, monkeypatch):
    """One key with many distinct values: a thousandth of them reaches the scan."""
    seen = []
    real = Q.scan.even_rows
    monkeypatch.setattr(Q.scan, "even_rows", lambda df, *a: seen.append(df.count()) or real(df, *a))
    df = spark.range(200_000).select(F.xxhash64("id").alias("v"))
    got = Q.order_statistics(df, [], "v", (0.5,)).first()
    assert seen[0] < 400 and got.v == sorted(x.v for x in df.collect())[100_000]
