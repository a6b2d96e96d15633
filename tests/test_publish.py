"""Publication in one step, closures by doubling, and frames of several documents."""

import random

import pytest
from pyspark.sql import functions as F

from foliograph.operators import lines as L
from foliograph.operators import tree as T
from foliograph.plans import publish as P
from foliograph.sources import collections as C
from foliograph.sources.scratch import written

LOW = {"articles": 1, "sections": 2, "items": 1, "definitions": 0, "tables": 1, "reliable_tables": 1}


def source(spark, path, word):
    texts = [f"110-1. Alcance. Este artículo cubre {word} en la Tabla 8.", "a) Uno. Según 110-2 y el Artículo 110.", "NOTA: una nota.", "110-2. Otra cosa. Texto de la sección."]
    lines = spark.createDataFrame([("d", 110, i, 12, "text", t, None, 0, 0) for i, t in enumerate(texts)], "doc_id string, article int, line_no long, page int, kind string, text string, ref string, w int, h int")
    lines.write.parquet(f"{path}/lines")
    spark.createDataFrame([(110, "Requisitos", 1, 12)], "num int, title string, chapter int, page int").write.parquet(f"{path}/toc")
    rows = [[("Tipo", 1, 1), ("VA", 1, 1)], [("x", 1, 1), ("5", 1, 1)]]
    spark.createDataFrame([("8", "Valores", None, [300], 300, 2, 1, "", rows, "rejilla", [], 1.0, None, False, False, False)], "id string, title string, article int, pages array<int>, page int, cols int, header_rows int, intro string, rows array<array<struct<t:string,cs:int,rs:int>>>, grid string, notes array<string>, quality double, verificada string, encabezado_dudoso boolean, sin_numero boolean, informativa boolean").write.parquet(f"{path}/tables")


def test_readers_see_one_version(spark, tmp_path, monkeypatch):
    target = f"file://{tmp_path}/out"
    assert P.current(spark, target) is None
    with pytest.raises(ValueError):
        P.collection(spark, target, "nodes")
    for word in ("uno", "dos"):
        source(spark, f"{tmp_path}/{word}", word)
    P.publish(spark, f"{tmp_path}/uno", target, LOW)
    first = P.current(spark, target)
    said = lambda: P.collection(spark, target, "nodes").where("parent_id is null").agg(F.min("text")).first()[0]
    assert "uno" in said()

    def broken(*_):
        raise RuntimeError("half-way")

    with monkeypatch.context() as m:  # a build that fails after some collections are written
        m.setattr("foliograph.operators.graph.rollup", broken)
        with pytest.raises(RuntimeError):
            P.publish(spark, f"{tmp_path}/dos", target, LOW)
    assert P.current(spark, target) == first and "uno" in said()
    with pytest.raises(Exception, match="articles"):  # one that its gate fails
        P.publish(spark, f"{tmp_path}/dos", target, LOW | {"articles": 99})
    assert P.current(spark, target) == first and "uno" in said()
    P.publish(spark, f"{tmp_path}/dos", target, LOW)
    assert P.current(spark, target) != first and "dos" in said()


def test_closure_by_doubling(spark):
    e = spark.createDataFrame([(str(i), str(i - 1) if i % 20 else None) for i in range(60)], "child string, parent string")
    want = {(str(i), str(i - d), d) for i in range(60) for d in range(1, i % 20 + 1)}
    assert {tuple(r) for r in T.ancestors(e, "child", "parent").collect()} == want
    two = spark.createDataFrame([("c", "a"), ("c", "b"), ("a", "r"), ("b", "r")], "child string, parent string")  # two ways up count twice
    assert sorted(tuple(r) for r in T.ancestors(two, "child", "parent").collect()) == [("a", "r", 1), ("b", "r", 1), ("c", "a", 1), ("c", "b", 1), ("c", "r", 2), ("c", "r", 2)]


def test_roots_of_long_chains(spark):
    n = 10_000
    e = spark.range(n).select(F.col("id").alias("child"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"))
    r = T.roots(e, "child", "parent").agg(F.count("*"), F.min("root"), F.max("root"), F.max("depth"), F.sum("depth")).first()
    assert tuple(r) == (n - 1, 0, 0, n - 1, n * (n - 1) // 2)


@pytest.mark.parametrize("batch", [1, 7, 1000])
def test_roots_of_any_forest_in_any_order(spark, batch):
    r = random.Random(batch)
    parent = {i: None if i < 5 else r.randrange(max(0, i - 3), i) for i in range(400)}
    want = set()
    for i in range(5, 400):
        at, depth = i, 0
        while parent[at] is not None:
            at, depth = parent[at], depth + 1
        want.add((f"n{i}", f"n{at}", depth))
    rows = [(f"n{i}", None if p is None else f"n{p}") for i, p in parent.items()]
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        for order in (rows, r.sample(rows, len(rows))):
            got = [tuple(x) for x in T.roots(spark.createDataFrame(order, "child string, parent string"), "child", "parent").collect()]
            assert len(got) == len(want) and set(got) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)


def test_ordered_chains_need_no_rounds_over_all_rows(spark, monkeypatch):
    """Of chains in order only the joints between batches are doubled."""
    sizes = []
    monkeypatch.setattr(T, "written", lambda df: sizes.append((w := written(df)).count()) or w)
    e = spark.range(0, 30_000, 1, 2).select(F.col("id").alias("child"), F.when(F.col("id") % 15_000 > 0, F.col("id") - 1).alias("parent"))
    assert T.roots(e, "child", "parent").agg(F.max("depth")).first()[0] == 14_999
    assert sizes[0] == 29_998 and max(sizes[1:]) < 20


@pytest.mark.parametrize("size", [1, 2, 3, 7])
def test_cycles_are_errors(spark, size):
    e = spark.createDataFrame([(i, (i + 1) % size) for i in range(size)] + [(100, 0), (200, 300)], "child int, parent int")
    for f in (T.roots, T.ancestors):
        with pytest.raises(ValueError):
            f(e, "child", "parent")


def test_documents_with_the_same_numbers(spark):
    lines = spark.createDataFrame([(d, 110, i, 800, t) for d, own in (("d1", "Uno"), ("d2", "Dos")) for i, t in enumerate((f"Tabla 8 {own}", f"APENDICE A. {own}", f"110-{len(own)}. {own}", f"110-{1 + (own == 'Dos')}. Otra"))], "doc_id string, article int, line_no long, page int, text string")
    assert {tuple(r) for r in L.listed_tables(lines).select("doc_id", "id", "title").collect()} == {("d1", "8", "Uno"), ("d2", "8", "Dos")}
    assert {tuple(r) for r in L.appendices(lines).select("doc_id", "letter", "title").collect()} == {("d1", "A", "Uno"), ("d2", "A", "Dos")}
    census = L.census(lines)
    assert {(r.doc_id, tuple(r.sections)) for r in census.collect()} == {("d1", (1, 3)), ("d2", (2, 3))}
    toc = spark.createDataFrame([("d1", 110, "Uno"), ("d2", 110, "Dos")], "doc_id string, num int, title string")
    assert C.index_report(toc, census).count() == 3
