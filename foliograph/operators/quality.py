"""Counters, text coverage and the gate that fails a build."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliograph.functions.text import tokens

# The floors of the gate.
FLOORS = {"articles": 151, "sections": 2890, "items": 7000, "definitions": 185, "coverage_pct": 99.5, "tables": 200, "reliable_tables": 130}
EXAMPLES = {"lost lines": 25, "broken references": 100, "repeated ids": 10}
MOST_NARROW, RELIABLE, MIN_LINE, MIN_SHARE = 12, 0.95, 25, 0.60


def counters(records: DataFrame) -> DataFrame:
    """One row of counts over parse records."""
    node = F.col("rec") == "node"
    return records.agg(
        F.countDistinct(F.when(node, F.col("article"))).alias("articles"), F.count_if(node & F.col("parent_id").isNull()).alias("sections"), F.count_if(node & F.col("parent_id").isNotNull()).alias("items"),
        *[F.count_if(F.col("rec") == r).alias(r + "s") for r in ("note", "exception", "figure", "definition")],
    )


def distinct_references(nodes: DataFrame, pattern: str) -> tuple[DataFrame, DataFrame]:
    """The sorted references of each article, and how many there are in all."""
    refs = nodes.select("article", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("ref"))
    return refs.groupBy("article").agg(F.array_sort(F.collect_set("ref")).alias("refs")), refs.agg(F.countDistinct("ref").alias("references"))


def coverage(lines: DataFrame, vocabulary: DataFrame, key: list[str], line_key: list[str], text: str = "text", min_chars: int = MIN_LINE, min_share: float = MIN_SHARE) -> DataFrame:
    """(line_key, words, found, covered) of every line of at least min_chars characters with a word: covered if min_share of its words are in its key's vocabulary (key, term)."""
    long = lines.where(F.char_length(F.trim(text)) >= min_chars).select(*line_key, F.explode(tokens(F.col(text))).alias("term"))
    known = vocabulary.select(*key, "term").distinct().withColumn("_in", F.lit(1))
    hit = long.join(known, [*key, "term"], "left")
    out = hit.groupBy(*line_key).agg(F.count("*").alias("words"), F.count("_in").alias("found"))
    return out.withColumn("covered", F.col("found") >= F.lit(min_share) * F.col("words"))


def vocabulary(*texts: tuple[DataFrame, list[str], str]) -> DataFrame:
    """(key, term): every word of the given (frame, key columns, text column)."""
    parts = [df.select(*key, F.explode(tokens(F.coalesce(F.col(c), F.lit("")))).alias("term")) for df, key, c in texts]
    return reduce(DataFrame.unionByName, parts).distinct()


def coverage_summary(covered: DataFrame) -> DataFrame:
    """Lines, lost lines and the exact share, beside the rounded percentage."""
    lost = F.count_if(~F.col("covered"))
    return covered.agg(F.count("*").alias("lines"), lost.alias("lost"), (1 - lost / F.count("*")).alias("share"), F.round(100 * (1 - lost / F.count("*")), 2).alias("coverage_pct"))


def empty_sections(nodes: DataFrame, annotations: DataFrame) -> DataFrame:
    """Sections without text, items or notes."""
    parents = nodes.where("parent_id is not null").select(F.col("parent_id").alias("p")).distinct()
    noted = annotations.select(F.col("node_id").alias("p")).distinct()
    return nodes.where("parent_id is null and coalesce(text, '') = ''").join(parents.union(noted), F.col("id") == F.col("p"), "left_anti").select("id")


def articles_without_sections(articles: DataFrame, nodes: DataFrame) -> DataFrame:
    return articles.join(nodes.select(F.col("article").alias("num")).distinct(), "num", "left_anti").select("num")


def duplicates(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def out_of_order(df: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose value isn't above that of the row before."""
    return df.withColumn("_p", F.lag(value).over(Window.partitionBy(*key).orderBy(*order))).where(F.col(value) <= F.col("_p")).drop("_p")


def uneven_rows(positions: DataFrame, tables: DataFrame) -> DataFrame:
    """(id, row): rows of cells that don't cover exactly the table's columns, once each."""
    rows = positions.groupBy("id", "row").agg(F.first("covered").alias("covered"))
    return rows.join(tables.select("id", "cols"), "id").where("covered <> cols").select("id", "row")


def columns_without_data(positions: DataFrame, tables: DataFrame) -> DataFrame:
    """(id, col) of columns that no cell with text covers, counting spans."""
    every = tables.select("id", F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("col"))
    filled = positions.where(F.trim("t") != "").select("id", F.explode(F.sequence(F.col("col"), F.col("col") + F.col("cs") - 1)).alias("col")).distinct()
    return every.join(filled, ["id", "col"], "left_anti")


def examples(name: str, offenders: DataFrame, order: list[str], text: str) -> DataFrame:
    """(check, text): the first offenders of a check, as many as its report shows."""
    return offenders.orderBy(*order).limit(EXAMPLES[name]).select(F.lit(name).alias("check"), F.col(text).cast("string").alias("text"))


def histogram(tables: DataFrame, quality: str = "quality") -> DataFrame:
    q = F.col(quality)
    return tables.agg(F.count_if(q >= RELIABLE).alias("reliable"), F.count_if((q >= 0.8) & (q < RELIABLE)).alias("fair"), F.count_if(q < 0.8).alias("poor"), F.avg(q).alias("mean"))


def upper_median(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """(key, low, middle, high); the middle of an even number is the upper one. Equal values are counted before they meet, so
    no task gathers a key's rows."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*key, value).agg(F.count("*").alias("_n"))
    group = Window.partitionBy(*key)
    below = F.sum("_n").over(group.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumn("_below", below).withColumn("_all", F.sum("_n").over(group))
    middle = F.min(F.when(F.col("_below") > F.floor(F.col("_all") / 2), F.col(value)))
    return ranked.groupBy(*key).agg(F.min(value).alias("low"), middle.alias("middle"), F.max(value).alias("high"))


def check(name: str, value: DataFrame, column: str, floor: float | None = None, ceiling: float | None = None) -> DataFrame:
    """One row (check, value, bound, ok) from a one-row frame."""
    v = F.col(column).cast("double")
    ok: Column = (v >= F.lit(floor)) if floor is not None else (v <= F.lit(ceiling))
    return value.select(F.lit(name).alias("check"), v.alias("value"), F.lit(float(floor if floor is not None else ceiling)).alias("bound"), F.coalesce(ok, F.lit(False)).alias("ok"))


@dataclass(frozen=True)
class Measure:
    """A line of the gate: an aggregate with a floor or a ceiling (0 if neither is given)."""

    name: str
    value: Column
    floor: float | None = None
    ceiling: float | None = None

    @property
    def bound(self) -> float:
        return float(self.floor if self.floor is not None else self.ceiling or 0)


def measured(df: DataFrame, *measures: Measure) -> DataFrame:
    """A row (check, value, bound, ok) for each measure, all from one aggregation over df; a value that is null fails."""
    totals = df.agg(*[m.value.cast("double").alias(f"m{i}") for i, m in enumerate(measures)])
    lines = [F.struct(F.lit(m.name).alias("check"), F.col(f"m{i}").alias("value"), F.lit(m.bound).alias("bound"), F.coalesce(F.col(f"m{i}") >= m.bound if m.floor is not None else F.col(f"m{i}") <= m.bound, F.lit(False)).alias("ok")) for i, m in enumerate(measures)]
    return totals.select(F.inline(F.array(*lines)))


def tallied(*tagged: tuple[DataFrame, Column, dict[str, Column]]) -> DataFrame:
    """(_key, counts): every key of the given (frame, key, {count: of a row}) with the sums of its counts, 0 where a frame doesn't have the key.

    Each frame is read once and all meet in one grouping, summed within tasks before they move, so that checks between collections (what is repeated, missing, empty or unknown) are
    plain conditions on a key's counts. Keys of several kinds
    are told apart by a prefix. Null keys are a key."""
    names = sorted({n for _, _, counts in tagged for n in counts})
    parts = []
    for df, key, counts in tagged:
        every = [F.coalesce(counts[n].cast("long"), F.lit(0).cast("long")).alias(n) if n in counts else F.lit(0).cast("long").alias(n) for n in names]
        parts.append(df.select(key.cast("string").alias("_key"), *every))
    return reduce(DataFrame.unionByName, parts).groupBy("_key").agg(*[F.sum(n).alias(n) for n in names])


def key_measures(tally: DataFrame, *measures: Measure) -> DataFrame:
    """`measured` over a tally; an empty one measures 0."""
    return measured(tally, *[Measure(m.name, F.coalesce(m.value, F.lit(0)), m.floor, m.ceiling) for m in measures])


def none_of(name: str, offenders: DataFrame) -> DataFrame:
    """One row that is ok if the frame is empty."""
    return check(name, offenders.agg(F.count("*").alias("n")), "n", ceiling=0)


def report(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


class GateFailed(RuntimeError):
    """A check of the gate didn't hold."""


def enforce(gate: DataFrame) -> None:
    """Raise with all failed checks at once. The report has a row for each check."""
    failed = gate.where(~F.col("ok")).collect()
    if failed:
        raise GateFailed("; ".join(f"{r['check']}: {r['value']:g} against {r['bound']:g}" for r in failed))
