"""Pages of PDF files, where the optional decoder `pymupdf` is installed on the workers.

One row for each page: text, positioned lines with their spans, words, thin and thick rectangles, image placements. Each file is decoded by
one task; files are read by Spark, so they may be in any store.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BOX = "x0:double,y0:double,x1:double,y1:double"
PAGES = (
    "doc_id string, page int, height double, text string, "
    "blocks array<struct<lines:array<struct<y0:double,y1:double,spans:array<struct<text:string,size:double>>>>>>, "
    f"words array<struct<{BOX},text:string,ord:int>>, rects array<struct<{BOX}>>, images array<struct<{BOX},xref:int,w:int,h:int,data:binary>>"
)


def _page(doc, path: str, number: int) -> dict:
    page = doc[number]
    blocks = [{"lines": [{"y0": x["bbox"][1], "y1": x["bbox"][3], "spans": [{"text": s["text"], "size": s["size"]} for s in x["spans"]]} for x in b["lines"]]} for b in page.get_text("dict")["blocks"] if "lines" in b]
    box = lambda r: {"x0": r.x0, "y0": r.y0, "x1": r.x1, "y1": r.y1}
    images = []
    for xref, *_ in page.get_images(full=True):
        image = doc.extract_image(xref)
        images += [box(r) | {"xref": xref, "w": image["width"], "h": image["height"], "data": image["image"]} for r in page.get_image_rects(xref)]
    return {
        "doc_id": path, "page": number + 1, "height": page.rect.y1, "text": page.get_text(), "blocks": blocks,
        "words": [{"x0": w[0], "y0": w[1], "x1": w[2], "y1": w[3], "text": w[4], "ord": i} for i, w in enumerate(page.get_text("words"))],
        "rects": [box(item[1]) for d in page.get_drawings() for item in d["items"] if item[0] == "re"], "images": images,
    }


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """PAGES of the PDF files at the path. Fails in the task that finds no decoder."""
    schema = spark.createDataFrame([], PAGES).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pymupdf

        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with pymupdf.open(stream=data, filetype="pdf") as doc:
                    for number in range(doc.page_count):
                        yield pa.RecordBatch.from_pylist([_page(doc, name, number)], schema=arrow)

    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "content").mapInArrow(work, schema)


def words(pages: DataFrame) -> DataFrame:
    return pages.select("doc_id", "page", F.inline("words"))


def rects(pages: DataFrame) -> DataFrame:
    return pages.select("doc_id", "page", F.inline("rects"))


def placements(pages: DataFrame) -> DataFrame:
    return pages.select("doc_id", "page", F.inline("images"))
