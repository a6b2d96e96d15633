"""Exact order statistics of keys of any size.

A window over a key's distinct values is one task for the key. Here only keys of at most 1 / HOT of all rows take that way; the others, HOT at most, are
narrowed down first: a mergeable sketch proposes two splitters about each wanted rank, one pass counts the rows below and between them, and only the values of the range that the counts
prove to hold the rank are ordered, by the prefix scan over even parts. A bad sketch costs time, never the result.

The statistic of share q of n values is the one with floor(q * n) values before it, the last at most; 0.5 is the upper median. Null values take no part, so a key of nulls alone has no
row; a null key is a key; NaN comes last, as everywhere in Spark. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliograph.operators import scan
from foliograph.sources.scratch import written

HOT = 10_000  # a key is hot above this part of all rows
ACCURACY = 10_000  # of the sketch; the range about a rank holds some 4 / ACCURACY of a key's rows
SHARES = (0.0, 0.25, 0.5, 0.75, 1.0)


def order_statistics(df: DataFrame, key: list[str], value: str, shares: tuple[float, ...] = SHARES, hot: int = HOT) -> DataFrame:
    """(key, share, n, value): the exact order statistics of each key's values, which are numbers, dates or times."""
    k = F.struct(*key) if key else F.struct(F.lit(0).alias("all"))
    rows = df.where(F.col(value).isNotNull()).select(k.alias("_k"), F.col(value).alias("_v"))
    sizes = written(rows.groupBy("_k").agg(F.count("*").alias("n")))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    large = sizes.where(F.col("n") * hot > total).withColumnRenamed("_k", "h_k")  # fewer than `hot` rows
    found = _whole(rows, large, shares).unionByName(_narrowed(rows, large, shares))
    return found.select(*[F.col("_k")[c].alias(c) for c in key], "share", "n", F.col("_v").alias(value))


def _wanted(sizes: DataFrame, shares: tuple[float, ...]) -> DataFrame:
    """A row for each share, with its rank from 0."""
    every = sizes.withColumn("share", F.explode(F.array(*[F.lit(float(q)) for q in shares])))
    return every.withColumn("rank", F.least(F.floor(F.col("share") * F.col("n")), F.col("n") - 1))


def _whole(rows: DataFrame, large: DataFrame, shares: tuple[float, ...]) -> DataFrame:
    """The statistics of the keys that aren't large, each ordered in one window."""
    small = rows.join(F.broadcast(large), F.col("_k") == F.col("h_k"), "left_anti").groupBy("_k", "_v").agg(F.count("*").alias("c"))
    key = Window.partitionBy("_k")
    placed = small.withColumn("_to", F.sum("c").over(key.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(key))
    every = _wanted(placed, shares)
    return every.where((F.col("rank") < F.col("_to")) & (F.col("rank") >= F.col("_to") - F.col("c"))).select("_k", "share", "n", "_v")


def _narrowed(rows: DataFrame, large: DataFrame, shares: tuple[float, ...]) -> DataFrame:
    """The statistics of large keys, out of the ranges that hold their ranks."""
    near = [min(1.0, max(0.0, q + step * 2 / ACCURACY)) for q in shares for step in (-1, 1)]
    marked = rows.join(F.broadcast(large), F.col("_k") == F.col("h_k")).groupBy("h_k").agg(F.percentile_approx("_v", near, ACCURACY).alias("near"), F.count("*").alias("n"))
    places = F.array_position(F.array(*[F.lit(float(q)) for q in shares]), F.col("share")).cast("int")
    wanted = _wanted(marked, shares).select("h_k", "share", "n", "rank", F.element_at("near", 2 * places - 1).alias("lo"), F.element_at("near", 2 * places).alias("hi"))
    wanted = written(wanted)  # as many rows as large keys and shares
    v = F.col("_v")
    met = rows.join(F.broadcast(wanted), F.col("_k") == F.col("h_k"))
    counted = met.groupBy("_k", "share", "n", "rank", "lo", "hi").agg(F.count_if(v < F.col("lo")).alias("below"), F.count_if((v >= F.col("lo")) & (v <= F.col("hi"))).alias("between"))
    side = F.when(F.col("rank") < F.col("below"), -1).when(F.col("rank") < F.col("below") + F.col("between"), 0).otherwise(1)
    before = F.when(F.col("side") < 0, F.lit(0)).when(F.col("side") == 0, F.col("below")).otherwise(F.col("below") + F.col("between"))
    ranges = counted.withColumn("side", side).select(F.col("_k").alias("h_k"), "share", "n", "lo", "hi", "side", (F.col("rank") - before).alias("rank"))
    ranges = written(ranges)
    inside = F.when(F.col("side") < 0, v < F.col("lo")).when(F.col("side") > 0, v > F.col("hi")).otherwise((v >= F.col("lo")) & (v <= F.col("hi")))
    held = rows.join(F.broadcast(ranges), F.col("_k") == F.col("h_k")).where(inside).groupBy("_k", "share", "n", "rank", "_v").agg(F.count("*").alias("c"))
    placed = scan.running(scan.even_rows(held, ["_k", "share"], ["_v"]), F.col("c"), "sum", "_to")
    return placed.where((F.col("rank") < F.col("_to")) & (F.col("rank") >= F.col("_to") - F.col("c"))).select("_k", "share", "n", "_v")
