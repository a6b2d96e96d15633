"""The citation graph: adjacency, backlinks, roll-up, rankings, broken targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 100_000  # sources in a row of published backlinks


def outgoing(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set("dst")).alias("targets"))


def incoming(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("id")).agg(F.array_sort(F.collect_set("src")).alias("sources"))


def incoming_chunks(edges: DataFrame, most: int = CHUNK) -> DataFrame:
    """(id, chunk, sources): backlinks in numbered chunks of about `most` sources, so that a target that every page cites is neither one row
    nor one task. Chunks are dealt by a hash of the source; most targets have one."""
    once = edges.select(F.col("dst").alias("id"), "src").distinct()
    counts = once.groupBy("id").agg(F.ceil(F.count("*") / most).cast("int").alias("parts"))
    wide = counts.where("parts > 1").select(F.col("id").alias("w_id"), "parts")  # at most sources / most targets
    chunk = F.pmod(F.xxhash64("src"), F.coalesce("parts", F.lit(1))).cast("int")
    dealt = once.join(F.broadcast(wide), F.col("id") == F.col("w_id"), "left").select("id", chunk.alias("chunk"), "src")
    return dealt.groupBy("id", "chunk").agg(F.array_sort(F.collect_list("src")).alias("sources"))


def rollup(edges: DataFrame, delimiter: str = "(", most: int | None = None) -> DataFrame:
    """Backlinks of the id up to the first delimiter: an array for each id, or with `most` chunks as of incoming_chunks, as they are published."""
    up = edges.select("src", F.split_part("dst", F.lit(delimiter), F.lit(1)).alias("dst"))
    return incoming_chunks(up, most) if most else incoming(up)


def top_cited(edges: DataFrame, n: int = 30) -> DataFrame:
    """(id, citations) of the n most cited, ties by id."""
    return edges.groupBy(F.col("dst").alias("id")).agg(F.countDistinct("src").alias("citations")).orderBy(F.desc("citations"), "id").limit(n)


def ranked_share(top: DataFrame) -> DataFrame:
    """rank and share of the maximum of a top list, which is short by construction."""
    order = Window.orderBy(F.desc("citations"), "id")
    return top.withColumn("rank", F.row_number().over(order)).withColumn("share", F.col("citations") / F.max("citations").over(Window.partitionBy()))


def by_type(edges: DataFrame) -> DataFrame:
    return edges.groupBy("type").agg(F.count("*").alias("edges"))


def summary(edges: DataFrame) -> DataFrame:
    return edges.agg(F.count("*").alias("edges"), F.countDistinct("src").alias("sources"), F.countDistinct("dst").alias("targets"))


def broken(edges: DataFrame, index: DataFrame, prefixed: str = r"^(tabla|parte|cap|art):") -> DataFrame:
    """Edges whose target is no node; prefixed targets are checked by `dangling`."""
    return edges.where(~F.rlike("dst", F.lit(prefixed))).join(index.select(F.col("id").alias("dst")), "dst", "left_anti")


def dangling(edges: DataFrame, prefix: str, keys: DataFrame, key: str) -> DataFrame:
    """Edges to prefix:key whose key isn't in the frame."""
    some = edges.where(F.col("dst").startswith(prefix + ":")).withColumn("_k", F.substring("dst", len(prefix) + 2, 10_000))
    return some.join(keys.select(F.col(key).cast("string").alias("_k")), "_k", "left_anti").drop("_k")


def described(ranked: DataFrame, index: DataFrame) -> DataFrame:
    """A ranking with the title and article of each id, empty and null where unknown."""
    i = index.select(F.col("id").alias("i_id"), "title", "article")
    return ranked.join(i, F.col("id") == F.col("i_id"), "left").select(*ranked.columns, F.coalesce("title", F.lit("")).alias("title"), "article")


def node_index(articles: DataFrame, nodes: DataFrame) -> DataFrame:
    """One flat index of articles, sections and items; a text without title is represented by its first 80 characters."""
    a = articles.select(F.concat(F.lit("art:"), F.col("num").cast("string")).alias("id"), F.lit("articulo").alias("kind"), "title", F.col("num").alias("article"), "chapter", "page")
    kind = F.when(F.col("parent_id").isNull(), "seccion").otherwise("inciso")
    n = nodes.join(articles.select(F.col("num").alias("a_num"), "chapter"), F.col("article") == F.col("a_num"), "left")
    return a.unionByName(n.select("id", kind.alias("kind"), F.coalesce(F.nullif("title", F.lit("")), F.substring("text", 1, 80)).alias("title"), "article", "chapter", "page"))
