"""Distributed prefix scans: running values over keys of any length, one of which may hold all rows.

A window over a key is one task for the key. Here rows are sorted by key and order over range partitions and written; their places follow from the sizes of these
partitions, and cut the whole into parts that differ by one row at most, whatever the keys. A running value is then computed in three steps:
within each part by a window over (part, key); over the parts from one summary for each, of the key that the part ends with, as only that key can go on;
and joined back as the value carried into the part's first key. Summaries are associative: maximum, sum, last non-null. They are as many as parts, so they are broadcast.

Order columns must tell the rows of a key apart where the result depends on it. Null keys are a key. Empty frames give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliograph.sources.scratch import written

_LOCAL = 33  # monotonically_increasing_id keeps the partition above these bits


@dataclass
class EvenRows:
    """Rows in even parts. `rows` has the columns of the frame and _row, from 0, and _part; `bounds` the first and last key of each part."""

    rows: DataFrame
    sorted_: DataFrame
    bounds: DataFrame
    key: Column
    names: list[str]
    parts: int

    @property
    def local(self):
        return Window.partitionBy("_part", *self.names).orderBy("_row")

    def with_(self, name: str, value: Column) -> EvenRows:
        """The same rows with one more column, made of the others."""
        return EvenRows(self.rows.withColumn(name, value), self.sorted_.withColumn(name, value), self.bounds, self.key, self.names, self.parts)

    def result(self) -> DataFrame:
        return self.rows.drop("_part", "_row")


def even_rows(df: DataFrame, key: list[str], order: list[str], parts: int | None = None) -> EvenRows:
    """Sort df by key and order and cut it into even parts, as many as the session's shuffle partitions if not given."""
    by = [F.col(c) for c in (*key, *order)]
    placed = written(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()))
    chunk = F.shiftright("_at", _LOCAL)
    sizes = placed.groupBy(chunk.alias("_chunk")).agg(F.count("*").alias("n"))  # a row for each range partition
    every = F.sum("n").over(Window.partitionBy())
    offsets = sizes.select(F.col("_chunk").alias("o_chunk"), (F.sum("n").over(Window.orderBy("_chunk")) - F.col("n")).alias("offset"), every.alias("total"))
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    row = F.col("offset") + F.col("_at").bitwiseAND(F.lit((1 << _LOCAL) - 1))
    joined = placed.join(F.broadcast(offsets), chunk == F.col("o_chunk")).withColumn("_row", row)
    # a small table has as many parts as rows at most
    wide = joined.withColumn("_part", F.floor(F.col("_row") * F.least(F.lit(parts), F.col("total")) / F.col("total")).cast("int")).drop("_at", "o_chunk", "offset", "total")
    one = F.struct(*[F.col(c) for c in key]) if key else F.struct(F.lit(0).alias("one"))
    bounds = written(wide.groupBy("_part").agg(F.min_by(one, "_row").alias("first"), F.max_by(one, "_row").alias("last")))
    return EvenRows(wide.repartitionById(parts, "_part"), wide, bounds, one, list(key), parts)


def _carried(s: EvenRows, summary: DataFrame, prefix) -> EvenRows:
    """s with the column _carry in its rows: the prefix of the summaries of the parts before, where they end with the key that the part begins with."""
    step = Window.partitionBy("last").orderBy("_part")
    order = Window.orderBy("_part")  # as many rows as parts
    known = s.bounds.join(summary, "_part").withColumn("so_far", prefix(F.col("total"), step))
    carry = known.select(F.col("_part").alias("c_part"), "first", F.when(F.lag("last").over(order).eqNullSafe(F.col("first")), F.lag("so_far").over(order)).alias("_carry"))
    joined = s.rows.join(F.broadcast(carry), F.col("_part") == F.col("c_part"), "left")
    return EvenRows(joined.withColumn("_carry", F.when(s.key.eqNullSafe(F.col("first")), F.col("_carry"))).drop("c_part", "first"), s.sorted_, s.bounds, s.key, s.names, s.parts)


def _ending(s: EvenRows) -> DataFrame:
    """The rows of the key that each part ends with."""
    ends = s.bounds.select(F.col("_part").alias("e_part"), F.col("last").alias("e_last"))
    return s.sorted_.join(F.broadcast(ends), (F.col("_part") == F.col("e_part")) & s.key.eqNullSafe(F.col("e_last")))


def running(s: EvenRows, value: Column, how: str, name: str, before: bool = False) -> DataFrame:
    """The rows of s with the maximum, sum or last non-null value of their key so far, `before` the row or including it."""
    frame = s.local.rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    if how == "max":
        total, local = F.max(value), F.max(value).over(frame)
        prefix = lambda c, w: F.max(c).over(w)
        joined = lambda a, b: F.greatest(a, b)
    elif how == "sum":
        total, local = F.sum(value), F.sum(value).over(frame)
        prefix = lambda c, w: F.sum(c).over(w)
        joined = lambda a, b: F.coalesce(a + b, a, b)
    elif how == "last":
        total, local = F.max(F.when(value.isNotNull(), F.struct("_row", value.alias("v"))))["v"], F.last(value, ignorenulls=True).over(frame)
        prefix = lambda c, w: F.last(c, ignorenulls=True).over(w)
        joined = lambda a, b: F.coalesce(b, a)
    else:
        raise ValueError(how)
    summary = _ending(s).groupBy("_part").agg(total.alias("total"))
    rows = _carried(s, summary, prefix).rows
    return rows.withColumn("_local", local).withColumn(name, joined(F.col("_carry"), F.col("_local"))).drop("_carry", "_local")


def neighbour(s: EvenRows, value: Column, step: int, name: str) -> DataFrame:
    """The rows of s with the value of the row before (step -1) or after (step 1) in their key, null where there is none."""
    beside, edge = (F.lag, F.max_by) if step < 0 else (F.lead, F.min_by)
    order = Window.orderBy("_part")
    side, mine = ("last", "first") if step < 0 else ("first", "last")
    ends = s.sorted_.groupBy("_part").agg(edge(F.struct(value.alias("v")), "_row").alias("e"))
    known = s.bounds.join(ends, "_part")
    across = known.select(F.col("_part").alias("n_part"), F.col(mine).alias("n_key"), F.when(beside(side).over(order).eqNullSafe(F.col(mine)), beside("e").over(order)["v"]).alias("_across"))
    rows = s.rows.join(F.broadcast(across), F.col("_part") == F.col("n_part"), "left")
    inner = beside(F.struct(value.alias("v"))).over(s.local)
    return rows.withColumn("_inner", inner).withColumn(name, F.when(F.col("_inner").isNotNull(), F.col("_inner")["v"]).when(s.key.eqNullSafe(F.col("n_key")), F.col("_across"))).drop("_inner", "_across", "n_part", "n_key")


# --- the operators of the line stream and of one-dimensional sets, for keys of any length


def _again(s: EvenRows, rows: DataFrame) -> EvenRows:
    """rows, in which a scan has added columns, written for a second scan over the same parts."""
    kept = written(rows)
    return EvenRows(kept.repartitionById(s.parts, "_part"), kept, s.bounds, s.key, s.names, s.parts)


def accept_increasing(df: DataFrame, key: list[str], order: list[str], value: str, name: str = "accepted") -> DataFrame:
    """As in lines: whether a value exceeds all before it."""
    out = running(even_rows(df, key, order), F.col(value), "max", "_most", before=True)
    return out.withColumn(name, F.col(value) > F.coalesce("_most", F.lit(0))).drop("_most", "_part", "_row")


def carry(df: DataFrame, key: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """As in lines: the last non-null value so far."""
    return running(even_rows(df, key, order), F.col(value), "last", name).drop("_part", "_row")


def extents(df: DataFrame, key: list[str], order: str, end: Column) -> DataFrame:
    """As in lines: half-open stretches from each row to the next of its key, the last to `end`."""
    out = neighbour(even_rows(df, key, [order]), F.col(order), 1, "hi")
    return out.withColumn("lo", F.col(order)).withColumn("hi", F.coalesce("hi", end)).drop("_part", "_row")


def numbered(df: DataFrame, key: list[str], order: list[str], name: str = "line_no") -> DataFrame:
    """The place of each row in its key, from 1."""
    return running(even_rows(df, key, order), F.lit(1).cast("long"), "sum", name).drop("_part", "_row")


def running_islands(df: DataFrame, key: list[str], start: str, end: str, gap: float, name: str = "island", ties: tuple[str, ...] = ()) -> DataFrame:
    """As in grid: the number of the island of each interval; two scans, one for the largest end and one for the count of new islands."""
    s = even_rows(df, key, [start, end, *ties])
    so_far = running(s, F.col(end), "max", "_most", before=True)
    fresh = so_far.withColumn("_new", F.coalesce((F.col(start) - F.col("_most") >= gap).cast("long"), F.lit(0).cast("long"))).drop("_most")
    return running(_again(s, fresh), F.col("_new"), "sum", name).drop("_new", "_part", "_row")


def contiguous_groups(df: DataFrame, key: list[str], order: list[str], value: str, name: str = "run") -> DataFrame:
    """As in grid: the number of the run of equal values that each row is in. The first row of a key opens run 1."""
    s = even_rows(df, key, order)
    boxed = F.struct(F.col(value).alias("v"))
    before = neighbour(s, boxed, -1, "_before")
    changed = before.withColumn("_c", F.when(F.col("_before").isNull() | ~F.col(value).eqNullSafe(F.col("_before")["v"]), 1).otherwise(0).cast("long")).drop("_before")
    return running(_again(s, changed), F.col("_c"), "sum", name).drop("_c", "_part", "_row")


def until_first_miss(df: DataFrame, key: list[str], order: list[str], ok: Column) -> DataFrame:
    """As stop_at_first_miss in grid: the rows of each key before its first that isn't ok."""
    s = even_rows(df.withColumn("_bad", (~ok).cast("long")), key, order)
    return running(s, F.col("_bad"), "sum", "_miss").where("_miss = 0").drop("_miss", "_bad", "_part", "_row")
