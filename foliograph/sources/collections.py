"""Sources and sinks: page texts, positioned lines and words, JSON collections, images, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliograph.functions.text import fix_glyphs, is_furniture, truncate


def read_collection(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A JSON array or object with a fixed schema; defaults are applied by the caller."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the path exists in whatever store it names."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_optional(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """As read_collection; empty if there is no such file."""
    return read_collection(spark, path, schema) if exists(spark, path) else spark.createDataFrame([], schema)


def with_defaults(df: DataFrame, **defaults) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def page_texts(pages: DataFrame) -> DataFrame:
    """(doc_id, page, text) with broken glyphs repaired."""
    return pages.withColumn("text", fix_glyphs(F.col("text")))


def plain_lines(pages: DataFrame) -> DataFrame:
    """Lines of page texts without geometry: all at height 0."""
    return page_texts(pages).select("doc_id", "page", F.posexplode(F.split("text", "\n")).alias("ord", "text")).withColumn("y", F.lit(0.0)).withColumn("kind", F.lit("text")).where(~is_furniture(F.col("text")))


def positioned_lines(pages: DataFrame) -> DataFrame:
    """Lines of pages(doc_id, page, blocks) whose blocks hold lines of spans: array<struct<lines: array<struct<y0, y1, spans: array<struct<text, size>>>>>>."""
    block = pages.select("doc_id", "page", F.posexplode("blocks").alias("b", "block"))
    line = block.select("doc_id", "page", "b", F.posexplode("block.lines").alias("l", "line"))
    text = fix_glyphs(F.array_join(F.transform("line.spans", lambda s: s["text"]), ""))
    return line.select("doc_id", "page", F.col("line.y0").alias("y"), F.col("line.y1").alias("y1"), (F.col("b") * 10_000 + F.col("l")).alias("ord"), text.alias("text"), F.lit("text").alias("kind"), F.col("line.spans").alias("spans")).where(~is_furniture(F.col("text")))


def words(pages: DataFrame, y_min: float = -1.0) -> DataFrame:
    """Positioned words below y_min, glyphs repaired, furniture dropped."""
    return pages.where(F.col("y0") > y_min).withColumn("text", fix_glyphs(F.col("text"))).where(~is_furniture(F.col("text")))


def images(placements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each image's bytes once, by its reference, and every placement without them."""
    return placements.select("xref", "data").dropDuplicates(["xref"]), placements.drop("data")


def write_images(stored: DataFrame, folder: str) -> None:
    stored.write.mode("overwrite").parquet(folder)


def write_collection(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_compact(df: DataFrame, path: str) -> None:
    """One compact JSON object a line, null fields left out."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def write_articles(nodes: DataFrame, path: str, without: int = 100) -> None:
    """A partition for each article but the glossary."""
    nodes.where(F.col("article") != without).write.mode("overwrite").partitionBy("article").parquet(path)


def index_report(articles: DataFrame, census: DataFrame) -> DataFrame:
    """(ord, value): the plain-text index, a line for each article, and how many census rows disagree with it."""
    key = ["doc_id", "num"] if "doc_id" in articles.columns and "doc_id" in census.columns else ["num"]
    a = articles.join(census.withColumnRenamed("article", "num"), key, "left")
    line = F.concat(F.lpad(F.col("num").cast("string"), 4, " "), F.lit("  "), F.rpad(truncate(F.col("title"), 60), 60, " "), F.lit("  "), F.array_join(F.coalesce("parts", F.array().cast("array<string>")), ""), F.lit("  "), F.size(F.coalesce("sections", F.array().cast("array<int>"))).cast("string"))
    missing = a.agg(F.count_if(F.col("sections").isNull()).alias("n")).select(F.lit(10_000_000).alias("ord"), F.concat(F.lit("discrepancies: "), F.col("n").cast("string")).alias("value"))
    return a.select(F.col("num").alias("ord"), line.alias("value")).unionByName(missing)


def markdown_rows(tables: DataFrame) -> DataFrame:
    """(id, value): a Markdown table row for each table of a review list."""
    bar = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|"))
    cells = [F.col("id"), bar(truncate(F.col("title"), 70)), F.format_string("%.2f", F.col("quality")), F.col("usos").cast("string"), F.format_string("%.2f", F.col("prio"))]
    return tables.select("id", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))


def write_report(rows: DataFrame, order: list[str], path: str) -> None:
    """A text report in order, in one file: reports are short by nature."""
    rows.orderBy(*order).coalesce(1).select("value").write.mode("overwrite").text(path)
