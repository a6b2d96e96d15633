"""A table over two pages with a caption, a note and a drawn grid, from geometry to published cells."""

import pytest
from pyspark.sql import functions as F

from foliograph.plans.build_tables import build_tables, table_marks
from foliograph.sources import pdf


def document(spark):
    lines = [(12, 690.0, 698.0, "Tabla 310-15.- Ampacidades"), (12, 700.0, 708.0, "permisibles de conductores"), (13, 105.0, 112.0, "* Solo cobre"), (13, 300.0, 308.0, "Texto que sigue.")]
    words, rects = [], []
    for page, top, rows in ((12, 720.0, [("Tipo", "Valor"), ("alto", "5")]), (13, 20.0, [("medio", "6"), ("bajo", "7"), ("nulo", "0")])):
        bottom = top + 25.0 * len(rows)
        rects += [(page, x - 0.5, top, x + 0.5, bottom) for x in (50.0, 150.0, 250.0)]
        rects += [(page, 50.0, y - 0.5, 250.0, y + 0.5) for y in (top + 25.0 * k for k in range(len(rows) + 1))]
        for k, (a, b) in enumerate(rows):
            words += [(page, 60.0, top + 25 * k + 8, 90.0, top + 25 * k + 16, a, 2 * k), (page, 160.0, top + 25 * k + 8, 190.0, top + 25 * k + 16, b, 2 * k + 1)]
    return (
        spark.createDataFrame(lines, "page int, y double, y1 double, text string").withColumn("superscript", F.lit(False)),
        spark.createDataFrame(words, "page int, x0 double, y0 double, x1 double, y1 double, text string, ord int"),
        spark.createDataFrame(rects, "page int, x0 double, y0 double, x1 double, y1 double"),
    )


def test_tables_from_geometry(spark, tmp_path):
    toc = spark.createDataFrame([(310,)], "num int")
    tables, regions = build_tables(*document(spark), str(tmp_path), toc=toc)
    t = tables.collect()
    assert len(t) == 1
    t = t[0]
    assert (t.id, t.title, t.article, t.pages, t.cols, t.header_rows, t.quality, t.grid, t.notes) == ("310-15", "Ampacidades permisibles de conductores", 310, [12, 13], 2, 1, 1.0, "rejilla", ["* Solo cobre"])
    assert [[c.t for c in r] for r in t["rows"]] == [["Tipo", "Valor"], ["alto", "5"], ["medio", "6"], ["bajo", "7"], ["nulo", "0"]]
    assert [(r.page, r.y0, r.y1) for r in regions.collect()] == [(12, 690.0, 770.0), (13, 20.0, 114.0)]
    mark = table_marks(regions, spark.createDataFrame([("", "310-15", 310)], "doc_id string, id string, article int")).first()
    assert (mark.page, mark.kind, mark.ref) == (12, "tbl", "310|310-15")


def test_pdf_pages_need_the_decoder(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF")
    pages = pdf.read_pages(spark, str(tmp_path))
    assert pages.columns[:3] == ["doc_id", "page", "height"] and pdf.words(pages).columns[2:] == ["x0", "y0", "x1", "y1", "text", "ord"]
    with pytest.raises(Exception, match="pymupdf"):
        pages.collect()
