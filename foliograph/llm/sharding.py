"""Uniform shuffle into shards of exact size, by a hypergeometric communication matrix, in DataFrame functions.

Every row gets a number, its input partition and its position there, and is written with it once; all that is random is a seeded
hash of that number, so what a row holds has no part in where it goes. Rows are dealt to blocks by such a hash. The counts of the
blocks (one number a block) reach the driver, which draws how many rows each block sends to each shard: a matrix with the blocks'
counts as row sums and the exact shard sizes as column sums, each row from the multivariate hypergeometric law given what the
shards still lack. A block ranks its rows by a second hash (the local permutation) and deals them out by its row of the matrix; a
third orders the rows inside their shard, ranked in sub-ranges whose counts are added up.

Only the given columns travel, and what has been dealt is written once before slots are counted. Blocks and sub-ranges are 4 for each
shuffle partition, so a task holds a share of the rows, never a shard, however many rows are equal. Same input partitions, seed and
shuffle partitions give the same result.

Edge cases: null, empty and very long texts are rows like others, of size 1 the first two; equal rows and ties in any column are
ordinary rows, told apart by their numbers; null doc_ids are ordinary rows; all columns are carried in `_row`, whatever their names;
an empty table gives an empty result.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize


def _stirling_rest(n: int) -> float:
    """log n! less Stirling's formula for it; the series is exact to double precision from 16 on."""
    if n < 16:
        return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi) if n else 0.0
    x = 1 / (n * n)
    return (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - x / 1188) * x) * x) * x) / n


def _deviance(x: int, mean: float) -> float:
    """x log(x / mean) + mean - x, without the loss of digits where x is near the mean."""
    if abs(x - mean) < 0.1 * (x + mean):
        v = (x - mean) / (x + mean)
        total, term, j = (x - mean) * v, 2 * x * v, 1
        while True:
            term *= v * v
            j += 2
            if total + term / j == total:
                return total
            total += term / j
    return x * math.log(x / mean) + mean - x


def _log_binomial(x: int, n: int, p: float) -> float:
    """log of the binomial probability by its saddle point; for large n, where the terms of log-factorials would cancel, too."""
    if x == 0:
        return n * math.log1p(-p)
    if x == n:
        return n * math.log(p)
    return _stirling_rest(n) - _stirling_rest(x) - _stirling_rest(n - x) - _deviance(x, n * p) - _deviance(n - x, n * (1 - p)) + 0.5 * math.log(n / (2 * math.pi * x * (n - x)))


def log_hypergeometric(x: int, good: int, bad: int, draws: int) -> float:
    """log of the probability of x good ones among the draws."""
    total = good + bad
    if draws in (0, total):
        return 0.0
    p = draws / total
    return _log_binomial(x, good, p) + _log_binomial(draws - x, bad, p) - _log_binomial(draws, total, p)


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """Draw exact to double precision, for populations of any size: by inversion from the mode outward where the law is narrow, else by ratio of uniforms
    (Stadlober), in a bounded number of steps on average."""
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    total = good + bad
    if 2 * draws > total:
        return good - hypergeometric(rng, good, bad, total - draws)
    if good > bad:
        return draws - hypergeometric(rng, bad, good, draws)
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
    top = log_hypergeometric(mode, good, bad, draws)
    spread = math.sqrt(draws * (good / total) * (bad / total) * ((total - draws) / max(1, total - 1)))
    if spread > 30:
        middle, width = draws * good / total + 0.5, 2 * math.sqrt(2 / math.e) * math.sqrt(spread * spread + 0.5) + 3 - 2 * math.sqrt(3 / math.e)
        while True:
            x = 1 - rng.random()
            at = math.floor(middle + width * (rng.random() - 0.5) / x)
            if low <= at <= high and 2 * math.log(x) <= log_hypergeometric(at, good, bad, draws) - top:
                return at
    p = math.exp(top)
    u = rng.random() - p
    up = down = mode
    p_up = p_down = p
    while u > 0 and (up < high or down > low):
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            u -= p_up
            if u <= 0:
                return up
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            u -= p_down
            if u <= 0:
                return down
    return mode


def communication_matrix(blocks: list[int], shards: int, seed: int) -> list[list[int]]:
    """Row sums are the blocks' counts; column sums are the shard sizes, at most one apart."""
    total = sum(blocks)
    lack = [total // shards + (j < total % shards) for j in range(shards)]
    rng, matrix = random.Random(seed), []
    for count in blocks:
        row, left, rest = [], count, sum(lack)
        for j in range(shards):
            rest -= lack[j]
            n = hypergeometric(rng, lack[j], rest, left)
            row.append(n)
            left -= n
        lack = [a - b for a, b in zip(lack, row)]
        matrix.append(row)
    return matrix


def _uniform(seed: int, salt: str) -> Column:
    return F.xxhash64(F.lit(f"{salt}:{seed}"), "_at")


def shard_rows(rows: DataFrame, shards: int = 8, seed: int = 17) -> DataFrame:
    """All columns of rows as struct `_row`, with shard (int) and slot (long, gapless from 0 in a shard)."""
    spark = rows.sparkSession
    blocks = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbered = materialize(rows.select(F.struct(*[rows[c] for c in rows.columns]).alias("_row"), F.monotonically_increasing_id().alias("_at")), "rows")
    block = F.pmod(_uniform(seed, "block"), F.lit(blocks)).cast("int")
    base = numbered.select("_row", block.alias("_block"), _uniform(seed, "local").alias("_local"), _uniform(seed, "final").alias("_final"), "_at")
    counts = dict(base.groupBy("_block").count().collect())
    held = [counts.get(b, 0) for b in range(blocks)]
    matrix = communication_matrix(held, shards, seed)
    bounds = [[sum(row[: j + 1]) for j in range(shards)] for row in matrix]
    dealt = F.broadcast(spark.createDataFrame([(b, *x) for b, x in enumerate(bounds)], "_block int, " + ", ".join(f"_c{j} long" for j in range(shards))))
    ranked = base.withColumn("_rank", F.row_number().over(Window.partitionBy("_block").orderBy("_local", "_at")))
    shard = F.lit(shards - 1)
    joined = ranked.join(dealt, "_block")
    for j in reversed(range(shards - 1)):
        shard = F.when(F.col("_rank") <= F.col(f"_c{j}"), F.lit(j)).otherwise(shard)
    sub = F.pmod(F.shiftrightunsigned("_final", 20), F.lit(blocks)).cast("int")
    placed = materialize(joined.select("_row", "_final", "_at", shard.alias("shard"), sub.alias("_sub")), "placed")
    inside = placed.withColumn("_n", F.row_number().over(Window.partitionBy("shard", "_sub").orderBy("_final", "_at")))
    # shards x sub-ranges numbers at most, whatever the input
    sizes = placed.groupBy("shard", "_sub").count()
    before = sizes.select(F.col("shard").alias("s_shard"), F.col("_sub").alias("s_sub"), (F.sum("count").over(Window.partitionBy("shard").orderBy("_sub")) - F.col("count")).alias("_before"))
    out = inside.join(F.broadcast(before), (F.col("shard") == F.col("s_shard")) & (F.col("_sub") == F.col("s_sub")))
    return out.select("_row", F.col("shard").cast("int").alias("shard"), (F.col("_before") + F.col("_n") - 1).cast("long").alias("slot"))


def op10_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return shard_rows(rows).select("_row.*", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


ORACLE: dict[str, str] = {}
