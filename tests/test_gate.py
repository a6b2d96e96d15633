"""The gate's one tally against a plain query for each check."""

import random

import pytest
from pyspark.sql import functions as F

from foliograph.operators import graph as G
from foliograph.operators import quality as Q
from foliograph.plans import catalog
from foliograph.plans.build import gate_report

ZERO = dict.fromkeys(Q.FLOORS, 0)


def frames(spark, n, seed):
    r = random.Random(seed)
    some = lambda *more: r.choice([f"110-{r.randrange(n + 1)}", *more])
    data = {
        "toc": ([(110,)] * min(n, 3), "num int"),
        "records": ([(110, "node", None)] * n + [(110, "node", "x"), (111, "note", None)][:n], "article int, rec string, parent_id string"),
        "nodes": ([("d", 110, i, some(None), r.choice([None, some()]), r.choice(["", None, "t"])) for i in range(n)], "doc_id string, article int, ord long, id string, parent_id string, text string"),
        "notes": ([(some(None),) for _ in range(n // 3)], "node_id string"),
        "edges": ([("s", some(None, "tabla:8", "tabla:9", "tabla:110-1", "art:999", "id:110-1"), "k") for _ in range(2 * n)], "src string, dst string, type string"),
        "index": ([(some(None, "art:110"),) for _ in range(n // 2)], "id string"),
        "terms": ([("t",)] * n, "term string"),
        "tables": ([(r.choice(["8", "8", None, "110-1"]), r.choice([1, 2, None]), r.choice([0.5, 0.95, None])) for _ in range(n // 2)], "id string, cols int, quality double"),
        "positions": ([], "id string, row int, col int, cs int, covered int, t string"),
        "covered": ([(99.6,)], "coverage_pct double"),
    }
    return {k: spark.createDataFrame(rows, schema) for k, (rows, schema) in data.items()}


@pytest.mark.parametrize("n, seed", [(0, 1), (12, 2), (40, 3)])
def test_equal_to_a_query_for_each_check(spark, n, seed):
    f = frames(spark, n, seed)
    got = {r["check"]: (r["value"], r["ok"]) for r in gate_report(**f, floors=ZERO).collect()}
    plain = {
        "articles": f["toc"].count(),
        "definitions": f["terms"].count(),
        "tables": f["tables"].count(),
        "reliable tables": f["tables"].where(F.col("quality") >= Q.RELIABLE).count(),
        "broken references": G.broken(f["edges"], f["index"]).count(),
        "references to unknown tables": G.dangling(f["edges"], "tabla", f["tables"], "id").count(),
        "repeated ids": Q.duplicates(f["nodes"], "id").count(),
        "empty sections": Q.empty_sections(f["nodes"], f["notes"]).count(),
    }
    assert {k: got[k][0] for k in plain} == plain and len(got) == 15
    for k in ("broken references", "references to unknown tables", "repeated ids", "empty sections"):
        assert got[k][1] == (plain[k] == 0)


def test_a_measure_that_is_null_fails(spark):
    empty = spark.createDataFrame([], "x double")
    assert [tuple(r) for r in Q.measured(empty, Q.Measure("most", F.max("x"), ceiling=5), Q.Measure("rows", F.count("*"), floor=0)).collect()] == [("most", None, 5.0, False), ("rows", 0.0, 0.0, True)]


def test_each_table_is_read_once(spark):
    plan = catalog.queries()["gate_report"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert [plan.count(f"{t}.parquet") for t in ("documents", "labels", "conversations")] == [1, 1, 1]
