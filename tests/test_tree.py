"""Hand-made articles with the expected nodes, annotations and anchors."""

import pytest
from pyspark.sql import functions as F

from foliograph.operators import lines as L
from foliograph.operators import quality as Q
from foliograph.operators import tree as T

SCHEMA = "doc_id string, article int, line_no long, page int, kind string, text string, ref string, w int, h int"


def records(spark, texts, article=110):
    rows = []
    for i, t in enumerate(texts):
        kind, text, ref = ("text", t, None) if isinstance(t, str) else (t[0], "", t[1])
        rows.append(("d", article, i, 12, kind, text, ref, 10, 20))
    return T.parse(spark.createDataFrame(rows, SCHEMA)).cache()


def nodes(out):
    return [(r.id, r.title, r.text) for r in T.nodes(out).orderBy("ord").collect()]


def test_headings_with_accents(spark):
    df = spark.createDataFrame([("ARTÍCULO 250",), ("ARTICULO 240",), ("el Artículo 250",)], "text string")
    assert [r[0] for r in df.select(L.line_class(F.col("text"))).collect()] == ["article", "article", "text"]


@pytest.mark.parametrize("article,line,title", [(384, "384-1 Alcance.", "Alcance"), (701, "701-1.Alcance.", "Alcance"), (513, "513-10.- Equipo", "Equipo"), (210, "210-8. Protección.", "Protección")])
def test_separators(spark, article, line, title):
    assert nodes(records(spark, [line], article)) == [(line.split(".")[0].split(" ")[0], title, "")]


def test_sections_increase(spark):
    out = nodes(records(spark, ["220-14. Cargas.", "220-12. No se deben exigir."], 220))
    assert out == [("220-14", "Cargas", "220-12. No se deben exigir.")]


def test_depth_is_inferred(spark):
    out = records(spark, ["110-14. Conexiones.", "c) Temp.", "a. Uno", "(1) x", "(2) y", "b. Dos", "(1) z"])
    assert [n[0] for n in nodes(out)] == ["110-14", "110-14(c)", "110-14(c)a.", "110-14(c)a.(1)", "110-14(c)a.(2)", "110-14(c)b.", "110-14(c)b.(1)"]
    assert T.item_ids(out).first()["items"][0] == "110-14(c)"


def test_note_owns_a_list_it_announces(spark):
    out = records(spark, ["110-14. Conexiones.", "1) A", "NOTA: los factores:", "(1) f", "(2) g", "2) B"])
    assert [n[0] for n in nodes(out)] == ["110-14", "110-14(1)", "110-14(2)"]
    note = T.annotations(out).first()
    assert [(i["label"], i["text"]) for i in note["items"]] == [("1", "f"), ("2", "g")]
    assert note.node_id == "110-14(1)"


def test_note_without_colon_owns_nothing(spark):
    out = records(spark, ["110-14. Conexiones.", "1) A", "NOTA: algo.", "sigue", "2) B", "Excepción 1: salvo esto."])
    assert [n[0] for n in nodes(out)] == ["110-14", "110-14(1)", "110-14(2)"]
    rows = {r["kind"]: r for r in T.annotations(out).collect()}
    assert rows["note"]["items"] is None and rows["note"].text == "algo. sigue"
    assert rows["exception"].node_id == "110-14(2)" and rows["exception"].text == "salvo esto."


def test_figure_caption_joins_two_lines(spark):
    out = records(spark, ["110-14. Conexiones.", ("img", "fig1.png"), "Figura 310-60.- Dimensiones de cables", "para uso con tablas", "Otra frase."])
    fig = T.owned(out, "figure").first()
    assert (fig.id, fig.ref, fig.text) == ("110-14", "fig1.png", "Figura 310-60.- Dimensiones de cables para uso con tablas")
    assert nodes(out)[0][2] == "Otra frase."


def test_title_override(spark):
    out = nodes(records(spark, ["340-6. Requisitos de aprobación Los cables tipo UF deben ser aprobados."], 340))
    assert out == [("340-6", "Requisitos de aprobación", "Los cables tipo UF deben ser aprobados.")]


def test_a_title_is_mended_only_where_it_is_the_printed_one(spark):
    out = nodes(records(spark, ["340-6. Orden 13048. Pieza 19014"], 340))
    assert out == [("340-6", "Orden 13048", "Pieza 19014")]



def test_table_anchor(spark):
    out = records(spark, ["110-14. Conexiones.", "a) Uno", ("tbl", "110|110-14(a)"), ("tbl", "0|8")])
    assert [(r.id, r.ref) for r in T.owned(out, "anchor").collect()] == [("110-14(a)", "110-14(a)")]


def test_parts_definitions_and_counters(spark):
    out = records(spark, ["A. Generalidades", "110-2. Definiciones.", "Ampacidad: la corriente máxima", "en amperes.", "B. 600 volts o menos", "110-3. Uso. Texto.", "a) Circuitos de menos de 50 volts. Un conductor."])
    assert [(r.label, r.title) for r in T.owned(out, "part").orderBy("ord").collect()] == [("A", "Generalidades"), ("B", "600 volts o menos")]
    assert [(r.label, r.text) for r in T.owned(out, "definition").collect()] == [("Ampacidad", "la corriente máxima en amperes.")]
    assert nodes(out)[-1] == ("110-3(a)", "Circuitos de menos de 50 volts", "Un conductor.")
    c = Q.counters(out).first()
    assert (c.sections, c["items"], c.definitions, c.articles) == (2, 1, 1, 1)


def test_glossary(spark):
    rows = ["ARTICULO 100", "DEFINICIONES", "Alcance. Este artículo", "contiene términos.", "A. Definiciones generales", "Accesible: que admite", "acceso.", "NOTA: nada.", "B. Más de 600 V", "Fusible: pieza."]
    df = spark.createDataFrame([("d", i, 15, t) for i, t in enumerate(rows)], "doc_id string, line_no long, page int, text string")
    terms, scope = T.glossary(df)
    assert [(r.term, r.definition, r.part) for r in terms.orderBy("part").collect()] == [("Accesible", "que admite acceso. NOTA: nada.", "A"), ("Fusible", "pieza.", "B")]
    assert scope.first().text == "Alcance. Este artículo contiene términos."


def test_contents_and_article_starts(spark):
    rows = ["TITULO 5. ESPECIFICACIONES", "CAPITULO 1", "Disposiciones generales", "Artículo 110 Requisitos de las", "instalaciones", "Artículo 210 Circuitos"]
    df = spark.createDataFrame([("d", i, 3, t) for i, t in enumerate(rows)], "doc_id string, line_no long, page int, text string")
    toc = L.table_of_contents(df)
    assert [(r.num, r.title, r.chapter) for r in toc.orderBy("num").collect()] == [(110, "Requisitos de las instalaciones", 1), (210, "Circuitos", 1)]
    listed = spark.createDataFrame([("d", 1, "Tabla 8 Conductores"), ("d", 2, "Tabla 11(A) Límites"), ("d", 3, "Tabla 8 otra"), ("d", 4, "En la Tabla 9")], "doc_id string, line_no long, text string")
    assert {r.id: r.title for r in L.listed_tables(listed).collect()} == {"8": "Conductores", "11(A)": "Límites"}
    last = spark.createDataFrame([(699, 1, "APÉNDICE A Antes"), (701, 2, "APENDICE A. Resumen"), (702, 3, "APENDICE A. Otra")], "page int, line_no long, text string")
    assert [(r.letter, r.title) for r in L.appendices(last).collect()] == [("A", "Resumen")]
    assert [(r.num, r.title) for r in L.chapters(df).collect()] == [(1, "Disposiciones generales")]
    body = spark.createDataFrame([("d", 50, 5, "ARTICULO 110"), ("d", 60, 11, "ARTÍCULO 110"), ("d", 70, 12, "ARTICULO 110"), ("d", 80, 12, "ARTICULO 999")], "doc_id string, line_no long, page int, text string")
    assert [tuple(r) for r in L.find_articles(body, toc).collect()] == [("d", 110, 60)]


def test_zones_keep_marks_and_headings(spark):
    lines = spark.createDataFrame([("d", 1, 10.0, "text", "celda"), ("d", 1, 11.0, "text", "110-3. Título"), ("d", 1, 12.0, "tbl", "x"), ("d", 2, 10.0, "text", "fuera"), ("e", 1, 10.0, "text", "otro")], "doc_id string, page int, y double, kind string, text string")
    zones = spark.createDataFrame([("d", 1, 5.0, 20.0)], "doc_id string, page int, y0 double, y1 double")
    assert sorted(r.text for r in L.outside_zones(lines, zones).collect()) == ["110-3. Título", "fuera", "otro", "x"]


def test_stream_order(spark):
    text = spark.createDataFrame([("d", 1, 10.0, 0, "text", "a"), ("d", 1, 30.0, 1, "text", "b")], "doc_id string, page int, y double, ord int, kind string, text string")
    marks = spark.createDataFrame([("d", 1, 10.0, 0, "tbl", None)], "doc_id string, page int, y double, ord int, kind string, text string")
    assert [r.kind for r in L.merge_stream(text, marks).orderBy("line_no").collect()] == ["tbl", "text", "text"]


def test_ancestors_end_or_fail(spark):
    edges = spark.createDataFrame([("c", "b"), ("b", "a"), ("a", None)], "child string, parent string")
    assert {(r.child, r.ancestor, r.distance) for r in T.ancestors(edges, "child", "parent", depth=2).collect()} == {("c", "b", 1), ("b", "a", 1), ("c", "a", 2)}
    with pytest.raises(ValueError, match="deeper than 1"):
        T.ancestors(edges, "child", "parent", depth=1)
    with pytest.raises(ValueError, match="deeper"):
        T.ancestors(spark.createDataFrame([("x", "y"), ("y", "x")], "child string, parent string"), "child", "parent", depth=3)


def test_parse_gives_only_what_is_asked(spark):
    texts = ["110-14. Conexiones.", "1) A", "NOTA: los factores:", "(1) f", "(2) g", "2) B", "Excepción: salvo esto.", ("img", "fig1.png"), "a. Uno"]
    rows = [(d, 110, i, None if i == 2 else 12, t[0] if isinstance(t, tuple) else "text", "" if isinstance(t, tuple) else t, t[1] if isinstance(t, tuple) else None, 10, 20) for d in ("d", None) for i, t in enumerate(texts)]
    lines = spark.createDataFrame(rows[::-1], SCHEMA)
    whole = T.parse(lines).cache()
    assert whole.where("rec = 'figure' and w = 10").count() == 2 and whole.where("rec = 'note' and page is null").count() == 2
    for view, of in ((T.nodes, T.OF_NODES), (T.item_ids, T.OF_ITEMS), (T.annotations, T.OF_ANNOTATIONS)):
        part = T.parse(lines, **of)
        assert part.columns == ["doc_id", *of["columns"]] and {r.rec for r in part.select("rec").collect()} <= set(of["recs"])
        assert sorted(map(repr, view(part).collect())) == sorted(map(repr, view(whole).collect()))
    whole.unpersist()
