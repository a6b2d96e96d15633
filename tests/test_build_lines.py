"""From pages to the line stream, and to published collections."""

from foliograph.plans.build_lines import build_from_pages, build_lines, contents_lines
from foliograph.sources import pdf

CONTENTS = ["INDICE DEL CONTENIDO", "CAPITULO 1", "Disposiciones generales", "Artículo 100 Definiciones", "Artículo 110 Requisitos de las", "instalaciones", "Artículo 210 Circuitos"]
GLOSSARY = ["ARTICULO 100", "DEFINICIONES", "Alcance. Este artículo contiene términos.", "A. Definiciones generales", "Accesible: que admite acceso."]
BODY = ["ARTICULO 110", "REQUISITOS", "110-1. Alcance. Este artículo cubre todo lo dicho en la Tabla 110-5.", "a) Uno. Según 110-2.", "110-2. Otra cosa. Texto de la sección."]


def page(number, texts, top=20.0, words=(), rects=(), images=()):
    lines = [{"y0": top + 12 * i, "y1": top + 12 * i + 8, "spans": [{"text": t, "size": 9.0}]} for i, t in enumerate(texts)]
    return ("d", number, 792.0, "\n".join(texts), [{"lines": [x]} for x in lines], list(words), list(rects), list(images))


def test_contents_end_at_the_introduction(spark):
    filler = ["x" * 99] * 25
    texts = ["antes", *CONTENTS, *filler, "INTRODUCCION", "Artículo 310 Fuera"]
    pages = spark.createDataFrame([("d", 3, "\n".join(texts)), ("e", 3, "Artículo 110 Sin\nINTRODUCCION\nArtículo 210 Con")], "doc_id string, page int, text string")
    got = contents_lines(pages).orderBy("doc_id", "line_no").collect()
    assert [r.text for r in got if r.doc_id == "d"] == [*CONTENTS, *filler]
    assert [r.text for r in got if r.doc_id == "e"] == ["Artículo 110 Sin", "INTRODUCCION", "Artículo 210 Con"]


def test_lines_without_positions(spark, tmp_path):
    pages = spark.createDataFrame([("d", 3, "\n".join(CONTENTS)), ("d", 12, "\n".join(["suelto", *GLOSSARY])), ("d", 13, "\n".join([*BODY, "ARTICULO 999", "ARTICULO 110"]))], "doc_id string, page int, text string")
    lines, toc = build_lines(pages, str(tmp_path))
    got = [(r.article, r.text) for r in lines.orderBy("line_no").collect()]
    assert got == [(100, t) for t in GLOSSARY] + [(110, t) for t in [*BODY, "ARTICULO 999", "ARTICULO 110"]]
    assert [tuple(r) for r in toc.orderBy("num").collect()] == [(100, "Definiciones", 1, 12), (110, "Requisitos de las instalaciones", 1, 13)]
    assert [tuple(r)[1:] for r in spark.read.parquet(f"{tmp_path}/chapters").collect()] == [(1, "Disposiciones generales")]


def test_pages_to_collections(spark, tmp_path):
    top, rows = 400.0, [("Tipo", "Valor"), ("alto", "5"), ("bajo", "7")]
    box = lambda x0, y0, x1, y1: {"x0": x0, "y0": y0, "x1": x1, "y1": y1}
    words = [box(60.0 + 100 * j, top + 25 * k + 8, 90.0 + 100 * j, top + 25 * k + 16) | {"text": t, "ord": 2 * k + j} for k, r in enumerate(rows) for j, t in enumerate(r)]
    rects = [box(x - 0.5, top, x + 0.5, top + 75) for x in (50.0, 150.0, 250.0)] + [box(50.0, y - 0.5, 250.0, y + 0.5) for y in (top + 25.0 * k for k in range(4))]
    image = box(0.0, 70.0, 9.0, 90.0) | {"xref": 7, "w": 9, "h": 20, "data": bytearray(b"x")}
    body = page(13, BODY, images=[image])
    body[4].extend({"lines": [{"y0": y, "y1": y + 8, "spans": [{"text": t, "size": 9.0}]}]} for y, t in ((385.0, "Tabla 110-5.- Valores"), (408.0, "Tipo Valor"), (433.0, "alto 5"), (600.0, "Después de la tabla.")))
    pages = spark.createDataFrame([page(3, CONTENTS), page(12, GLOSSARY), (*body[:5], words, rects, [image])], pdf.PAGES)
    low = {"articles": 2, "sections": 2, "items": 1, "definitions": 1, "tables": 1, "reliable_tables": 1}
    report = build_from_pages(pages, str(tmp_path), floors=low)
    assert report.where("ok").count() == report.count()
    lines = spark.read.parquet(f"{tmp_path}/source/lines").orderBy("line_no").collect()
    assert [(r.kind, r.ref) for r in lines if r.kind != "text"] == [("img", "7"), ("tbl", "110|110-5")]
    assert "alto 5" not in [r.text for r in lines] and lines[-1].text == "Después de la tabla."
    assert [(r.term, r.definition) for r in spark.read.parquet(f"{tmp_path}/definitions").collect()] == [("Accesible", "que admite acceso.")]
    assert ("110-1", "tabla:110-5", "tabla") in {(r.src, r.dst, r.type) for r in spark.read.parquet(f"{tmp_path}/edges").collect()}
