"""Page queries, review lists, census and the written search index on small frames."""

import pytest
from pyspark.sql import functions as F

from foliograph.functions import text as X
from foliograph.operators import lines as L
from foliograph.operators import quality as Q
from foliograph.operators import review as V
from foliograph.operators import search as S
from foliograph.operators import views as W


def test_article_view(spark):
    nodes = spark.createDataFrame([("1-1", 1, 0), ("1-1(a)", 1, 1), ("2-1", 2, 0)], "id string, article int, ord long")
    notes = spark.createDataFrame([("1-1(a)", "note", 1, "NOTA 2", "y"), ("1-1(a)", "exception", 0, "Excepción", "x")], "node_id string, kind string, seq long, label string, text string")
    anchors = spark.createDataFrame([("1-1", "8", 2), ("1-1", "9", 1)], "id string, ref string, seq long")
    back = spark.createDataFrame([("1-1", ["2-1"])], "id string, sources array<string>")
    a, b = W.article_view(1, nodes, notes, anchors, back).collect()
    assert (a.id, [t.ref for t in a.tables], a.cited_by, a.annotations) == ("1-1", ["9", "8"], ["2-1"], None)
    assert (b.id, [n.text for n in b.annotations], b.tables) == ("1-1(a)", ["x", "y"], None)


def test_lists_of_pages(spark):
    tables = spark.createDataFrame([("8", None, 700, [[1]], "2024"), ("310-1", 310, 20, [[1], [2]], None), ("5", None, 650, [], None)], "id string, article int, page int, rows array<array<int>>, verificada string")
    assert [r.id for r in W.general_tables(tables).collect()] == ["5", "8"]
    totals, parts = W.figures_of_page(tables, spark.createDataFrame([("A",), ("B",), ("A",)], "part string"))
    assert tuple(totals.first()) == (3, 3, 1) and {tuple(r) for r in parts.collect()} == {("A", 2), ("B", 1)}
    terms = spark.createDataFrame([("B", "x"), ("A", "z"), ("A", "b")], "part string, term string")
    assert [r.term for r in W.by_part(terms).collect()] == ["b", "z", "x"]


def test_review_lists(spark):
    t = spark.createDataFrame([("a", 0.5, 2, 0, False, 3), ("b", 0.7, 2, 9, False, 2), ("c", 1.0, 2, 9, False, 1), ("d", 0.9, 2, 0, False, 5), ("e", 0.75, 2, 0, False, 4)], "id string, quality double, cols int, usos long, encabezado_dudoso boolean, page int")
    flagged = V.buckets(V.priority(t))
    got = {k: [r.id for r in df.collect()] for k, df in V.ordered_buckets(flagged).items()}
    assert got == {"critical": ["b"], "doubtful": ["a", "e"], "control": ["c"], "unflagged": ["d"]}
    full = t.withColumns({"rows": F.array(F.array(F.lit(1))), "pages": F.array("page"), "title": F.lit("t")})
    assert [r.id for r in V.to_review(full).collect()] == ["a", "b", "e"]
    cells = spark.createDataFrame([("x" * 29, 1, 0, 1), ("x", 2, 0, 1), ("x", 1, 1, 1)], "t string, cs int, row int, header_rows int")
    assert [(r.long, r.scope) for r in V.display_flags(cells).collect()] == [(True, "col"), (False, "colgroup"), (False, None)]


def test_census_and_references(spark):
    lines = spark.createDataFrame([(110, "A. Generalidades"), (110, "110-2. Dos"), (110, "110-1. Uno"), (110, "220-3. Otra")], "article int, text string")
    r = L.census(lines).first()
    assert (r.parts, r.sections) == (["A"], [1, 2])
    nodes = spark.createDataFrame([(1, "NMX-J-9 y NMX-J-1"), (1, "NMX-J-1"), (2, "NMX-J-1")], "article int, text string")
    refs, total = Q.distinct_references(nodes, r"(NMX-J-\d)")
    assert {r.article: r.refs for r in refs.collect()} == {1: ["NMX-J-1", "NMX-J-9"], 2: ["NMX-J-1"]} and total.first()[0] == 2
    arts = spark.createDataFrame([(1,), (3,)], "num int")
    assert [r.num for r in Q.articles_without_sections(arts, nodes).collect()] == [3]
    title = spark.range(1).select(L.split_title(F.lit("Uno. Dos tres"), 2, 20).alias("s")).first().s
    assert tuple(title) == ("Uno", "Dos tres")
    assert spark.range(1).select(X.grouped_number(F.lit(1234567)), X.percent(F.lit(0.995))).first()[:] == ("1,234,567", "99.5%")


def test_examples_of_a_check(spark):
    ids = spark.createDataFrame([(f"{i:03d}",) for i in range(30)], "id string")
    assert [r.text for r in Q.examples("repeated ids", ids, ["id"], "id").collect()] == [f"{i:03d}" for i in range(10)]


@pytest.mark.parametrize("query,how", [("tierra", {}), ("tier cable", {"prefix": True}), ("tirra ampacidad", {"prefix": True, "fuzzy": 0.25})])
def test_a_written_index_finds_the_same(spark, tmp_path, query, how):
    rows = [(f"{i}", "sec", t, u) for i, (t, u) in enumerate([("Puesta a tierra", "electrodo de tierra"), ("Cables", "cables y tierras de cobre"), ("Ampacidades", "cable con ampacidades"), ("", None)])]
    docs = spark.createDataFrame(rows, "id string, kind string, title string, text string")
    fields = {"title": 3.0, "text": 1.0}
    index = S.write_index(docs, str(tmp_path), fields)
    near = lambda df: {r.id: pytest.approx(r.score) for r in df.collect()}
    want = near(S.bm25(docs, query, fields, **how))
    assert want and {r.id: r.score for r in S.bm25(S.read_index(spark, str(tmp_path)), query, **how).collect()} == want
    assert index.fields == fields
