"""Sources, sinks, the stream of windows, the registered queries' shape and a whole small build."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from foliograph.operators import quality as Q
from foliograph.plans import catalog
from foliograph.plans.build import build
from foliograph.sources import collections as C
from foliograph.streaming.windows import windowed_counts, write_windows


def test_lines_and_words(spark):
    blocks = "array<struct<lines:array<struct<y0:double,y1:double,spans:array<struct<text:string,size:double>>>>>>"
    pages = spark.createDataFrame([("d", 1, [([(5.0, 9.0, [("165 ", 9.0), ("೦C", 9.0)]), (10.0, 14.0, [("12/780", 9.0)])],)])], f"doc_id string, page int, blocks {blocks}")
    assert [(r.text, r.y) for r in C.positioned_lines(pages).collect()] == [("165 °C", 5.0)]
    plain = C.plain_lines(spark.createDataFrame([("d", 1, "uno\nSENER\n31/12/2012\ndos")], "doc_id string, page int, text string"))
    assert [r.text for r in plain.orderBy("ord").collect()] == ["uno", "dos"]
    words = spark.createDataFrame([(1.0, "a"), (5.0, "at the bound"), (9.0, "SENER"), (9.0, "b")], "y0 double, text string")
    assert [r.text for r in C.words(words, 5.0).collect()] == ["b"]


def test_collections(spark, tmp_path):
    path = str(tmp_path)
    assert C.read_optional(spark, f"{path}/none.json", "a int").count() == 0
    (tmp_path / "some.json").write_text('[{"a": 1}, {"a": null}]')
    assert [r.a for r in C.with_defaults(C.read_optional(spark, f"{path}/some.json", "a int"), a=7).collect()] == [1, 7]
    df = spark.createDataFrame([(1, "ñ", None)], "a int, b string, c string")
    C.write_compact(df, f"{path}/compact")
    assert spark.read.text(f"{path}/compact").first()[0] == '{"a":1,"b":"ñ"}'
    C.write_articles(spark.createDataFrame([(100, "x"), (110, "y")], "article int, id string"), f"{path}/articles")
    assert [r.id for r in spark.read.parquet(f"{path}/articles").collect()] == ["y"]
    stored, placed = C.images(spark.createDataFrame([(1, bytearray(b"x"), 1), (1, bytearray(b"x"), 2)], "xref int, data binary, page int"))
    assert (stored.count(), placed.count(), placed.columns) == (1, 2, ["xref", "page"])
    report = C.index_report(spark.createDataFrame([(110, "Reglas"), (210, "Más")], "num int, title string"), spark.createDataFrame([(110, ["A"], [1, 2])], "article int, parts array<string>, sections array<int>"))
    C.write_report(report, ["ord"], f"{path}/index")
    assert [r[0].split() for r in spark.read.text(f"{path}/index").collect()] == [["110", "Reglas", "A", "2"], ["210", "Más", "0"], ["discrepancies:", "1"]]


def test_windows_on_a_stream_equal_the_batch(spark, tmp_path):
    rows = [(f"2024-01-01 {h:02d}:{m:02d}:00", "a" if m % 2 else "b", float(m)) for h in range(4) for m in range(0, 60, 7)]
    df = spark.createDataFrame(rows, "t string, kind string, value double").select(F.to_timestamp("t").alias("ts"), "kind", "value")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    write_windows(windowed_counts(stream, "ts", "kind", "value"), f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination(120)
    got = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {tuple(r) for r in windowed_counts(df, "ts", "kind", "value").collect()}
    assert got and got <= want and len(want - got) <= 2  # the last hour stays open


def test_every_query_has_its_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())
    assert set(catalog.queries()) <= set(entry.queries())


def test_build(spark, tmp_path):
    source, target = f"{tmp_path}/in", f"{tmp_path}/out"
    texts = ["110-1. Alcance. Este artículo cubre todo lo dicho en la Tabla 8.", "a) Uno. Según 110-2 y el Artículo 110.", "NOTA: una nota.", "110-2. Otra cosa. Texto de la sección."]
    lines = spark.createDataFrame([("d", 110, i, 12, "text", t, None, 0, 0) for i, t in enumerate(texts)], "doc_id string, article int, line_no long, page int, kind string, text string, ref string, w int, h int")
    lines.write.parquet(f"{source}/lines")
    spark.createDataFrame([(110, "Requisitos", 1, 12)], "num int, title string, chapter int, page int").write.parquet(f"{source}/toc")
    rows = [[("Tipo", 1, 1), ("VA", 1, 1)], [("x", 1, 1), ("5", 1, 1)]]
    spark.createDataFrame([("8", "Valores", None, [300], 300, 2, 1, "", rows, "rejilla", [], 1.0, None, False, False, False)], "id string, title string, article int, pages array<int>, page int, cols int, header_rows int, intro string, rows array<array<struct<t:string,cs:int,rs:int>>>, grid string, notes array<string>, quality double, verificada string, encabezado_dudoso boolean, sin_numero boolean, informativa boolean").write.parquet(f"{source}/tables")
    low = {"articles": 1, "sections": 2, "items": 1, "definitions": 0, "tables": 1, "reliable_tables": 1}
    report = build(spark, source, target, floors=low)
    assert report.where("ok").count() == report.count() == 15
    edges = {(r.src, r.dst, r.type) for r in spark.read.parquet(f"{target}/edges").collect()}
    assert edges == {("110-1", "tabla:8", "tabla"), ("110-1(a)", "110-2", "seccion"), ("110-1(a)", "art:110", "articulo")}
    assert spark.read.json(f"{target}/search").count() == 3
    with pytest.raises(Q.GateFailed, match="articles: 1 against 151"):
        build(spark, source, target)
