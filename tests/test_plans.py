"""Properties of the physical plans that matter at scale."""

import re

import pytest

from foliograph.plans import catalog

FOLDER = "/root/testdata/sf0.001"
#: Those of the parse, whose depth is a fold over an article.
PYTHON = {"parsed_nodes", "parsed_in_sql", "parsed_annotations", "items_below"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_plan(spark, name):
    text = plan(catalog.queries()[name](spark, FOLDER))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert bool(re.search("Python|Arrow|Pandas", text)) == (name in PYTHON)


@pytest.mark.parametrize("name,columns", [("upper_median", {"l_suppkey", "l_quantity"}), ("backlinks", {"url", "html"}), ("keep_first", {"doc_id", "text"}), ("bands_assignment", {"event_type", "value"})])
def test_only_needed_columns_are_read(spark, name, columns):
    read = re.findall(r"ReadSchema: struct<([^>]*)>", plan(catalog.queries()[name](spark, FOLDER)))
    assert {c.split(":")[0] for r in read for c in r.split(",")} == columns


def test_filters_reach_the_scan(spark):
    assert "PushedFilters: [IsNotNull(s_acctbal), GreaterThan(s_acctbal,5000.0)" in plan(catalog.queries()["overlay_merge"](spark, FOLDER))


def test_top_lists_sort_no_more_than_they_keep(spark):
    assert "TakeOrderedAndProject" in plan(catalog.queries()["backlinks"](spark, FOLDER))


@pytest.mark.parametrize("name, most", [("parsed_annotations", 8), ("items_below", 6), ("parsed_nodes", 14)])
def test_only_what_is_asked_leaves_the_fold(spark, name, most):
    text = catalog.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    made = re.findall(r"FlatMapGroupsInArrow \[[^]]*\], fold\([^)]*\)#\d+, \[([^]]*)\]", text)
    assert made and all(len(m.split(", ")) <= most for m in made)
