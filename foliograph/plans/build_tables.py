"""Tables from positioned lines, words and rectangles: captions, extents, layouts, merged cells, assembly, regions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliograph.operators import grid as D
from foliograph.operators import lines as L
from foliograph.sources.collections import words as clean_words


def with_doc(df: DataFrame) -> DataFrame:
    """df with a doc_id, empty where it has none: all of one document."""
    return df if "doc_id" in df.columns else df.withColumn("doc_id", F.lit(""))


def build_tables(lines: DataFrame, words: DataFrame, rects: DataFrame, target: str, toc: DataFrame | None = None, page_height: float = 792.0, body_page: int = 10) -> tuple[DataFrame, DataFrame]:
    """(tables, regions) of the documents. lines: doc_id, page, y, y1, text, superscript; words: doc_id, page, x0, y0, x1, y1, text, ord; rects:
    doc_id, page, x0, y0, x1, y1; doc_id may be missing for a single document.

    Document and page are the equi keys of every join by position. A table over several pages takes its columns from its widest, best
    scored page. Each step is used by several others, so it is written below target and read back.
    """

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{target}/{name}")
        return df.sparkSession.read.parquet(f"{target}/{name}")

    lines, words, rects = with_doc(lines), with_doc(words), with_doc(rects)
    heads = kept(D.captions(lines, L.CAPTION_TITLE, body_page), "captions")
    rules = kept(D.classify_rules(rects.withColumn("table_id", F.col("doc_id"))), "rules")
    whole = rules.select(*D.PAGE).distinct().select(*D.PAGE, F.lit(0.0).alias("top"), F.lit(page_height).alias("bottom"))
    drawn_bands = kept(D.row_bands(rules, whole), "page_bands").withColumnRenamed("table_id", "doc_id")
    pages = kept(D.table_pages(drawn_bands, heads, page_height), "table_pages")
    key = F.concat_ws("|", "doc_id", "id")  # a table in all documents
    zones = pages.select(F.col("doc_id").alias("z_doc"), key.alias("z_id"), F.col("page").alias("z_page"), F.col("y0").alias("top"), F.col("y1").alias("bottom"))

    def within(df: DataFrame, low: str, high: str) -> DataFrame:
        hit = (F.col("doc_id") == F.col("z_doc")) & (F.col("page") == F.col("z_page")) & (F.col(high) >= F.col("top") - 2) & (F.col(low) <= F.col("bottom") + 2)
        return df.join(zones, hit).withColumn("table_id", F.col("z_id")).drop("doc_id", "z_doc", "z_id", "z_page", "top", "bottom")

    ink = kept(within(clean_words(words), "y0", "y1"), "table_words")
    vertical = F.col("orient") == "v"
    spans = rules.withColumnRenamed("table_id", "doc_id").withColumn("a", F.when(vertical, F.col("lo")).otherwise(F.col("pos"))).withColumn("b", F.when(vertical, F.col("hi")).otherwise(F.col("pos")))
    drawn = kept(within(spans, "a", "b").drop("a", "b"), "table_rules")
    zone = zones.select(F.col("z_id").alias("table_id"), F.col("z_page").alias("page"), "top", "bottom")
    bands = kept(D.row_bands(drawn, zone), "bands")
    models = kept(D.page_models(ink, drawn, bands), "models")
    cells = kept(D.one_width(models, ink, drawn, bands), "page_cells")

    first = heads.where("nth = 1")
    more = D.title_lines(lines, first).groupBy("doc_id", "id").agg(F.array_sort(F.collect_list(F.struct("y", "text"))).alias("p"))
    titled = first.join(more, ["doc_id", "id"], "left").select("doc_id", "id", F.concat_ws(" ", "title", F.array_join(F.col("p.text"), " ")).alias("title"))
    flag, title = L.informative(F.col("title"))
    number = F.regexp_extract("id", r"^(\d{3})-", 1).try_cast("int")
    info = titled.select("doc_id", F.col("id").alias("own_id"), key.alias("id"), F.trim(title).alias("title"), flag.alias("informativa"), number.alias("article"))
    if toc is not None:  # tables of unknown articles stand outside all articles
        known = toc.select(F.col("num").alias("known")).distinct()
        info = info.join(known, F.col("article") == F.col("known"), "left").withColumn("article", F.col("known")).drop("known")
    last = pages.groupBy("doc_id", "id").agg(F.max_by(F.struct("page", F.col("y1").alias("bottom")), "page").alias("l")).select("doc_id", "id", "l.page", "l.bottom")
    notes = kept(D.footnotes(lines, last, L.FOOTNOTE, L.CAPTION), "notes")
    texts = notes.groupBy(key.alias("id")).agg(F.array_sort(F.collect_list(F.struct("note", "text"))).alias("n")).select("id", F.col("n.text").alias("notes"))
    grids = cells.groupBy(F.col("table_id").alias("id")).agg(F.first("grid").alias("grid"))
    tables = D.assemble(cells.select(*D.PAGE, "rows"), kept(info, "info"), texts).join(grids, "id")
    return tables.withColumn("id", F.col("own_id")).drop("own_id"), D.regions(pages, heads, notes)


def table_marks(regions: DataFrame, tables: DataFrame) -> DataFrame:
    """Marks (doc_id, page, y, kind, ref) that put each table into the line stream just above its first region."""
    first = L.keep_first(regions, ["doc_id", "id"], ["page", "y0"])
    found = first.join(tables.select("doc_id", "id", "article"), ["doc_id", "id"], "left")
    return found.select("doc_id", "page", (F.col("y0") - 0.01).alias("y"), F.lit("tbl").alias("kind"), F.concat_ws("|", F.coalesce(F.col("article").cast("string"), F.lit("0")), "id").alias("ref"))
