"""The line stream of documents from their pages, and the whole way from pages to published collections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliograph.operators import grid as D
from foliograph.operators import lines as L
from foliograph.plans.build import build
from foliograph.plans.build_tables import build_tables, table_marks
from foliograph.sources import pdf
from foliograph.sources.collections import plain_lines, positioned_lines

# What opens and closes the contents, and how far in the closing word must be.
CONTENTS, INTRODUCTION, LEAST_CONTENTS = "INDICE DEL CONTENIDO", "INTRODUCCION", 2000


def contents_lines(pages: DataFrame, first: int = 2, last: int = 9) -> DataFrame:
    """Numbered lines of the contents: those of the given pages from the heading, if there is one, to the introduction."""
    doc = Window.partitionBy("doc_id")
    order = doc.orderBy("page", "ord")
    lines = plain_lines(pages.where(F.col("page").between(first, last))).withColumn("line_no", F.row_number().over(order).cast("long"))
    head = F.col("text").contains(CONTENTS)
    lines = lines.withColumn("begun", F.max(head).over(order) | ~F.max(head).over(doc)).where("begun").drop("begun")
    lines = lines.withColumn("at", F.sum(F.char_length("text") + 1).over(order) - F.char_length("text") - 1)
    close = F.when(F.col("text").endswith(INTRODUCTION), F.col("at") + F.char_length("text") - len(INTRODUCTION))
    lines = lines.withColumn("close", F.min(close).over(doc))
    return lines.where((F.coalesce("close", F.lit(0)) <= LEAST_CONTENTS) | (F.col("at") < F.col("close"))).select("doc_id", "page", "line_no", "text")


def image_marks(placements: DataFrame) -> DataFrame:
    """Marks (doc_id, page, y, kind, ref, w, h) that put each placement of an image into the line stream."""
    return placements.select("doc_id", "page", F.col("y0").alias("y"), F.lit("img").alias("kind"), F.col("xref").cast("string").alias("ref"), "w", "h")


def build_lines(pages: DataFrame, target: str, regions: DataFrame | None = None, tables: DataFrame | None = None, images: DataFrame | None = None, body_page: int = 9) -> tuple[DataFrame, DataFrame]:
    """(lines, toc) of the documents, written below target as `build` reads them, with `chapters` and `titles` beside them.

    pages: doc_id, page, text and, where positions are known, blocks. regions, tables: as `build_tables` returns them. images: marks.
    Lines inside a table's region are left out, and a mark stands where each table and image starts. Only listed articles
    with a heading in the body are in toc; a line belongs to the last of them that has begun.
    """

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{target}/{name}")
        return df.sparkSession.read.parquet(f"{target}/{name}")

    text = positioned_lines(pages) if "blocks" in pages.columns else plain_lines(pages)
    text = text.select("doc_id", "page", "y", "ord", "text", "kind", F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("w"), F.lit(None).cast("int").alias("h"))
    marks = []
    if regions is not None and tables is not None:
        text = L.outside_zones(text, regions)
        marks.append(table_marks(regions, tables))
    if images is not None:
        marks.append(images)
    stream = kept(L.merge_stream(text, *marks), "stream")

    contents = kept(contents_lines(pages), "contents")
    kept(L.chapters(contents), "chapters")
    kept(L.chapters(contents, L.TOC_TITLE), "titles")
    listed = L.table_of_contents(contents)
    starts = kept(L.find_articles(stream.where("kind = 'text'"), listed, body_page), "starts")
    begun = stream.join(starts.withColumnRenamed("num", "start"), ["doc_id", "line_no"], "left")
    toc = listed.join(begun.where("start is not null").select("doc_id", F.col("start").alias("num"), "page"), ["doc_id", "num"])
    inside = L.carry(begun, ["doc_id"], ["line_no"], "start", "article").where("article is not null")
    lines = inside.select("doc_id", "article", "line_no", "page", "kind", "text", "ref", "w", "h")
    return kept(lines, "lines"), kept(toc.select("num", "title", "chapter", "page"), "toc")


def build_from_pages(pages: DataFrame, target: str, gate: bool = True, floors: dict[str, float] | None = None) -> DataFrame:
    """Published collections of one document, and the gate's report, from its pages as `sources.pdf.read_pages` gives them. They are decoded once."""
    source = f"{target}/source"
    pages.write.mode("overwrite").parquet(f"{source}/pages")
    pages = pages.sparkSession.read.parquet(f"{source}/pages")
    height = pages.agg(F.max("height")).first()[0] or 0.0
    lines = positioned_lines(pages).withColumn("superscript", D.superscript_mark(F.col("spans")))
    tables, regions = build_tables(lines, pdf.words(pages), pdf.rects(pages), f"{target}/geometry", L.table_of_contents(contents_lines(pages)), height)
    tables = tables.withColumns({"verificada": F.lit(None).cast("string"), "sin_numero": F.lit(False)})  # an overlay sets them
    tables.write.mode("overwrite").parquet(f"{source}/tables")
    regions.write.mode("overwrite").parquet(f"{source}/regions")
    tables, regions = (pages.sparkSession.read.parquet(f"{source}/{n}") for n in ("tables", "regions"))
    build_lines(pages, source, regions, tables, image_marks(pdf.placements(pages)))
    return build(pages.sparkSession, source, target, gate, floors)
