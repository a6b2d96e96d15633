"""Joins of intervals by bins: words and zones, lines and tables, captions and grids of one page, however many there are.

Each interval has a level, the power of two of `unit` that its length fits in, so it touches two bins of its level at most. It is filed in the bins of its own level and of
every higher one that intervals of the other side have; two intervals meet at the higher of their levels, in equal bins of equal keys. They may share two bins: the pair belongs to the
one where the later of both begins. So work spreads over bins, not keys, and a long interval is filed a few times a level, not once a unit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _level(lo: Column, hi: Column, unit: float) -> Column:
    return F.greatest(F.ceil(F.log2(F.greatest((hi - lo) / unit, F.lit(1.0)))), F.lit(0)).cast("int")


def filed_levels(own: Column, others: list[int]) -> Column:
    """The levels that an interval is filed in: its own, and those above it that the other side has."""
    return F.concat(F.array(own), F.filter(F.array(*[F.lit(n) for n in others]).cast("array<int>"), lambda n: n > own))


def interval_join(left: DataFrame, right: DataFrame, key: list[str], left_ends: tuple[str, str], right_ends: tuple[str, str], unit: float = 1.0) -> DataFrame:
    """All pairs of rows with equal keys whose closed intervals have a point in common, each pair once; key columns once. Other names must differ. Points are intervals with equal ends; rows with
    a null end or an end before its start meet nothing."""

    def sized(df: DataFrame, ends: tuple[str, str], side: str) -> DataFrame:
        lo, hi = (F.col(c).cast("double") for c in ends)
        ok = df.where(lo.isNotNull() & hi.isNotNull() & (lo <= hi))
        return ok.select(*[F.col(k).alias(f"{side}_{k}") for k in key], F.struct(*df.columns).alias(side), lo.alias(f"{side}_lo"), hi.alias(f"{side}_hi"), _level(lo, hi, unit).alias(f"{side}_level"))

    a, b = sized(left, left_ends, "a"), sized(right, right_ends, "b")
    levels = lambda df, side: sorted(r[0] for r in df.select(f"{side}_level").distinct().collect())  # noqa: E731, logarithms of lengths

    def filed(df: DataFrame, side: str, others: list[int]) -> DataFrame:
        at = df.withColumn(f"{side}_at", F.explode(filed_levels(F.col(f"{side}_level"), others)))
        width = F.pow(F.lit(2.0), f"{side}_at") * unit
        return at.withColumn(f"{side}_bin", F.explode(F.sequence(F.floor(F.col(f"{side}_lo") / width), F.floor(F.col(f"{side}_hi") / width))))

    met = (F.col("a_at") == F.col("b_at")) & (F.col("a_bin") == F.col("b_bin"))
    for k in key:
        met &= F.col(f"a_{k}") == F.col(f"b_{k}")
    both = filed(a, "a", levels(b, "b")).join(filed(b, "b", levels(a, "a")), met)
    width = F.pow(F.lit(2.0), "a_at") * unit
    once = (F.col("a_at") == F.greatest("a_level", "b_level")) & (F.col("a_bin") == F.floor(F.greatest("a_lo", "b_lo") / width))
    pairs = both.where((F.col("a_lo") <= F.col("b_hi")) & (F.col("b_lo") <= F.col("a_hi")) & once)
    return pairs.select("a.*", *[F.col(f"b.`{c}`") for c in right.columns if c not in key])
