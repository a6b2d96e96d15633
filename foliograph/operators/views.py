"""Navigation and page queries over the parsed collections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliograph.operators.grid import contiguous_groups


def prev_next(df: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("previous", F.lag(value).over(w)).withColumn("next", F.lead(value).over(w))


def sections_by_part(nodes: DataFrame) -> DataFrame:
    """Sections of each article with the number of the stretch of equal parts they stand in."""
    return contiguous_groups(nodes.where("parent_id is null"), ["article"], ["ord"], "part", "stretch")


def with_part_title(nodes: DataFrame, parts: DataFrame) -> DataFrame:
    p = parts.select(F.col("article").alias("p_article"), F.col("label").alias("p_letter"), F.col("title").alias("part_title"))
    return nodes.join(p, (F.col("article") == F.col("p_article")) & (F.col("part") == F.col("p_letter")), "left").drop("p_article", "p_letter")


def anchored_tables(anchors: DataFrame, tables: DataFrame) -> DataFrame:
    """(node_id, seq, table columns) of anchors whose table exists."""
    a = anchors.select(F.col("id").alias("node_id"), F.col("ref").alias("t_id"), "seq")
    return a.join(tables, F.col("t_id") == tables["id"]).drop("t_id")


def loose_tables(tables: DataFrame, anchors: DataFrame) -> DataFrame:
    """Tables of an article that no node anchors."""
    return tables.where(F.col("article").isNotNull()).join(anchors.select(F.col("ref").alias("id")), "id", "left_anti")


def general_tables(tables: DataFrame) -> DataFrame:
    """Tables outside all articles, by page and id."""
    return tables.where(F.col("article").isNull()).orderBy("page", "id")


def article_view(num: int, nodes: DataFrame, annotations: DataFrame, anchors: DataFrame, backlinks: DataFrame) -> DataFrame:
    """All nodes of an article in order, each with its notes and exceptions by seq, its tables and who cites it, from the chunks of its backlinks."""
    n = annotations.groupBy(F.col("node_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("seq", "kind", "label", "text"))).alias("annotations"))
    a = anchors.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("seq", "ref"))).alias("tables"))
    b = backlinks.groupBy("id").agg(F.array_sort(F.flatten(F.collect_list("sources"))).alias("cited_by"))
    return nodes.where(F.col("article") == num).join(n, "id", "left").join(a, "id", "left").join(b, "id", "left").orderBy("ord")


def figures_of_page(tables: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows and verified tables in all, and sections or terms for each part."""
    totals = tables.agg(F.count("*").alias("tables"), F.sum(F.size("rows")).alias("rows"), F.count_if(F.col("verificada").isNotNull()).alias("verified"))
    return totals, parts.groupBy("part").agg(F.count("*").alias("n"))


def by_part(definitions: DataFrame) -> DataFrame:
    """Glossary terms by part, then term."""
    return definitions.orderBy("part", "term")
