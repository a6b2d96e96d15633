"""Citations, usage, search, corrections and the gate on small frames."""

import pytest
from pyspark.sql import functions as F

from foliograph.functions import text as X
from foliograph.operators import graph as G
from foliograph.operators import overlay as O
from foliograph.operators import quality as Q
from foliograph.operators import refs as R
from foliograph.operators import review as V
from foliograph.operators import search as S
from foliograph.operators import views as W


def edges(spark, text, known=(), articles=(100, 250, 310, 500, 502, 503), chapters=(5,)):
    nodes = spark.createDataFrame([("100-1", text)] + [(k, "") for k in known], "id string, text string")
    a = spark.createDataFrame([(n,) for n in articles], "num int")
    c = spark.createDataFrame([(n,) for n in chapters], "num int")
    return {(r.dst, r.type) for r in R.edges(nodes, a, c).where("src = '100-1'").collect()}


@pytest.mark.parametrize(
    "text,known,expected",
    [
        ("según 250-32(a)(1)", ["250-32(a)(1)", "250-32"], {("250-32(a)(1)", "seccion")}),
        ("según 250-32(a)(1)", ["250-32"], {("250-32", "seccion")}),
        ("según 250-32(a)(1)", [], {("art:250", "articulo")}),
        ("según 999-1", [], set()),
        ("Artículos 500, 502 y 503", [], {("art:500", "articulo"), ("art:502", "articulo"), ("art:503", "articulo")}),
        ("Tabla 310-15(b)(16) y 310-15", ["310-15"], {("tabla:310-15(b)(16)", "tabla"), ("310-15", "seccion")}),
        ("Tabla 250-122 y 250-122(a)", ["250-122", "250-122(a)"], {("tabla:250-122", "tabla")}),
        ("Parte C del Artículo 250", [], {("parte:250:C", "parte"), ("art:250", "articulo")}),
        ("Capítulo 5 y Capítulo 9", [], {("cap:5", "capitulo")}),
        ("100-1 y 250-3, 250-3", ["250-3"], {("250-3", "seccion")}),
    ],
)
def test_edges(spark, text, known, expected):
    assert edges(spark, text, known) == expected


def test_table_usage(spark):
    texts = spark.createDataFrame([("Tabla 250-122 y Tablas 250-122, también 250-122; 310-16 dos veces 310-16. Tabla 8.",)], "text string")
    tables = spark.createDataFrame([("250-122",), ("310-16",), ("8",), ("9",)], "id string")
    nodes = spark.createDataFrame([("250-122",)], "id string")
    got = {r.id: (r.explicitas, r.usos, r.ambiguo) for r in R.table_usage(texts, tables, nodes).collect()}
    assert got == {"250-122": (2, 2, True), "310-16": (0, 2, False), "8": (1, 1, False), "9": (0, 0, False)}


def test_broken_and_rollup(spark):
    e = spark.createDataFrame([("a", "b(1)", "s"), ("c", "b(2)", "s"), ("a", "tabla:9", "t"), ("a", "zz", "s")], "src string, dst string, type string")
    index = spark.createDataFrame([("b(1)",), ("b(2)",)], "id string")
    assert [r.dst for r in G.broken(e, index).collect()] == ["zz"]
    assert {r.id: r.sources for r in G.rollup(e).collect()}["b"] == ["a", "c"]
    rolled = G.rollup(e, most=1).collect()
    assert sorted((r.id, x) for r in rolled for x in r.sources) == [("b", "a"), ("b", "c"), ("tabla:9", "a"), ("zz", "a")] and len({(r.id, r.chunk) for r in rolled}) == len(rolled)
    many = spark.createDataFrame([(f"s{i % 50}", "hot") for i in range(80)] + [("a", "b")], "src string, dst string")
    chunks = G.incoming_chunks(many, 9).collect()
    assert sorted(s for r in chunks if r.id == "hot" for s in r.sources) == sorted({f"s{i}" for i in range(50)})
    assert max(len(r.sources) for r in chunks) < 25 and sum(r.id == "hot" for r in chunks) > 3 and [r.sources for r in chunks if r.id == "b"] == [["a"]]
    assert G.dangling(e, "tabla", spark.createDataFrame([("8",)], "id string"), "id").count() == 1


def docs(spark):
    rows = [("310-15", "sec", "Ampacidades", "instalación eléctrica puesta a tierra", None), ("410-1", "sec", "Alcance", "cables y conductores", None), ("tabla:310-15(b)(16)", "tabla", "Ampacidades permisibles", "cobre aluminio", "310-15(b)(16)")]
    return spark.createDataFrame(rows, "id string, kind string, title string, text string, tid string")


def test_codes(spark):
    items = spark.createDataFrame([("310-15(b)(16)",)], "id string")
    top = S.code_matches(docs(spark), "310-15b16", items).collect()
    assert (top[0].id, top[0].score) == ("310-15(b)(16)", 1e6)
    near = S.code_matches(docs(spark), "310-15z9", items).collect()
    assert [(r.id, r.score) for r in near] == [("310-15", 1e6 - 200 - 2)]
    assert S.code_matches(docs(spark), "tierra").count() == 0


def test_search(spark):
    assert [r.id for r in S.search(docs(spark), "electrica").collect()] == ["310-15"]
    assert {r.id for r in S.search(docs(spark), "ampacid").collect()} == {"310-15", "tabla:310-15(b)(16)"}
    assert S.search(docs(spark), "a").count() == 0
    out = spark.range(1).select(X.snippet(F.lit("La puesta a  tierra & más"), "puesta a tierra")).first()[0]
    assert out == "La <mark>puesta a  tierra</mark> &amp; más"
    with pytest.raises(Exception, match="duplicate search id"):
        S.unique_ids(docs(spark).union(docs(spark))).collect()


def test_search_documents(spark):
    nodes = spark.createDataFrame([("1-1", None, "1-1", 0, "T", "uno", 110), ("1-1(a)", "1-1", "1-1", 1, "Ítem", "dos", 110)], "id string, parent_id string, root_id string, ord long, title string, text string, article int")
    notes = spark.createDataFrame([("1-1", "note", 0, "nota")], "node_id string, kind string, seq long, text string")
    arts = spark.createDataFrame([(110, "Reglas")], "num int, title string")
    defs = spark.createDataFrame([("Fusible", "pieza")], "term string, definition string")
    tabs = spark.createDataFrame([("8", None, None, "x y", False)], "id string, article int, title string, text string, sin_numero boolean")
    got = {r.id: r for r in S.documents(nodes, notes, arts, defs, tabs).collect()}
    assert got["1-1"].text == "uno nota Ítem dos" and got["1-1"].incisos == ["1-1(a)"]
    assert got["tabla:8"].artTitle == "Capítulo 10" and got["Fusible"].kind == "def"


def test_overlay(spark):
    base = spark.createDataFrame([("a", "old", 1, 0.5, None), ("b", "keep", 2, 0.7, None)], "id string, title string, cols int, quality double, verificada string")
    whole = "id string, title string, cols int, verificada string, pages array<int>, article int, header_rows int, rows array<array<int>>, regions array<int>"
    over = spark.createDataFrame([("a", "new", None, "2024-01-02", [1], None, None, None, None), ("c", "added", 3, "2024-01-03", [2], 1, 1, [[1]], [1])], whole)
    got = {r.id: tuple(r)[1:] for r in O.correct_tables(base, over).collect()}
    assert got == {"a": ("new", 1, 1.0, "2024-01-02"), "b": ("keep", 2, 0.7, None), "c": ("added", 3, 1.0, "2024-01-03")}
    bad = spark.createDataFrame([("d", "x", None, "2024-01-03", [2])], "id string, title string, cols int, verificada string, pages array<int>")
    with pytest.raises(Exception, match="missing cols"):
        O.correct_tables(base, bad.withColumns({c: F.lit(1) for c in ("article", "header_rows", "rows", "regions")})).collect()
    lacks = spark.createDataFrame([("d", "x", 1, "2024-01-03", [2])], "id string, title string, cols int, verificada string, pages array<int>")
    with pytest.raises(Exception, match="missing article, header_rows, rows, regions"):  # no columns of the overlay at all
        O.correct_tables(base, lacks).collect()
    update = lacks.withColumn("id", F.lit("b"))
    assert {r.id: r.title for r in O.correct_tables(base, update).collect()} == {"a": "old", "b": "x"}


def test_review(spark):
    t = spark.createDataFrame([("a", 1.0, True, 0, 3), ("b", 0.96, False, 30, 3), ("c", 0.7, False, 0, 3), ("d", 1.0, False, 1, 1), ("e", 1.0, False, 1, 3)], "id string, quality double, encabezado_dudoso boolean, usos int, cols int")
    got = {r.id: [k for k in ("critical", "doubtful", "control", "unflagged") if r[k]] for r in V.buckets(V.priority(t)).collect()}
    assert got == {"a": ["unflagged"], "b": ["critical", "control"], "c": ["doubtful"], "d": ["critical"], "e": ["unflagged"]}


def test_gate(spark):
    one = spark.createDataFrame([(5,)], "n int")
    Q.enforce(Q.report(Q.check("enough", one, "n", floor=5)))
    with pytest.raises(Q.GateFailed, match="too few.*none allowed"):
        Q.enforce(Q.report(Q.check("too few", one, "n", floor=6), Q.none_of("none allowed", one)))


def test_coverage(spark):
    lines = spark.createDataFrame([(1, 1, "uno dos tres cuatro cinco seis"), (1, 2, "siete ocho nueve diez once doce"), (1, 3, "corta")], "a int, line int, text string")
    vocabulary = Q.vocabulary((spark.createDataFrame([(1, "Uno dos, TRÉS cuatro")], "a int, text string"), ["a"], "text"))
    got = Q.coverage(lines, vocabulary, ["a"], ["a", "line"])
    assert [(r.line, r.covered) for r in got.orderBy("line").collect()] == [(1, True), (2, False)]
    assert tuple(Q.coverage_summary(got).first()) == (2, 1, 0.5, 50.0)


def test_views(spark):
    n = spark.createDataFrame([("1-1", None, 1, "A", 0), ("1-2", None, 1, "A", 1), ("1-3", None, 1, "B", 2), ("1-4", None, 1, "A", 3)], "id string, parent_id string, article int, part string, ord long")
    assert [r.stretch for r in W.sections_by_part(n).orderBy("ord").collect()] == [1, 1, 2, 3]
    tables = spark.createDataFrame([("t1", 1, 3), ("t2", 1, 4), ("t3", None, 9)], "id string, article int, page int")
    anchors = spark.createDataFrame([("1-1", "t1", 0), ("1-1", "zz", 1)], "id string, ref string, seq long")
    assert [r.id for r in W.loose_tables(tables, anchors).collect()] == ["t2"]
    assert [r.id for r in W.anchored_tables(anchors, tables).collect()] == ["t1"]
    assert [r.id for r in W.general_tables(tables).collect()] == ["t3"]
