"""The whole build: a line stream and reconstructed tables to published collections, then the gate.

    spark-submit -m foliograph.plans.build SOURCE TARGET [--no-gate]

SOURCE holds Parquet frames `lines` (doc_id, article, line_no, page, kind, text, ref, w, h), `toc` (num, title, chapter, page),
`tables`, and optionally `overlay` (JSON, corrections) and `glossary` (lines of the glossary; by default those of article GLOSSARY). Each
collection is written once and read back by the stages after it. `build_lines` makes lines and toc from pages.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliograph.operators import graph, grid, overlay, quality, refs, review, search, tree
from foliograph.sources.collections import exists, write_compact

GLOSSARY = 100
OVERLAY = "id string, verificada string, title string, cols int, header_rows int, intro string, rows array<array<struct<t:string,cs:int,rs:int>>>, notes array<string>, informativa boolean, article int, pages array<int>, regions array<struct<page:int,y0:double,y1:double>>"


def build(spark: SparkSession, source: str, target: str, gate: bool = True, floors: dict[str, float] | None = None) -> DataFrame:
    """Write nodes, annotations, definitions, edges, backlinks, usage, tables, review, search with its index, and examples of what is wrong; return the gate's report, enforced last."""

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{target}/{name}")
        return spark.read.parquet(f"{target}/{name}")

    lines, toc, tables = (spark.read.parquet(f"{source}/{n}") for n in ("lines", "toc", "tables"))
    if exists(spark, f"{source}/overlay"):
        tables = overlay.correct_tables(tables, spark.read.schema(OVERLAY).json(f"{source}/overlay"))
    tables = kept(tables, "tables")
    records = kept(tree.parse(lines), "records")
    nodes, notes = kept(tree.nodes(records), "nodes"), kept(tree.annotations(records), "annotations")
    entries = spark.read.parquet(f"{source}/glossary") if exists(spark, f"{source}/glossary") else lines.where((F.col("article") == GLOSSARY) & (F.col("kind") == "text"))
    terms, scope = tree.glossary(entries)
    terms = kept(terms, "definitions")

    owned = notes.groupBy(F.col("node_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), " ").alias("notes"))
    texts = nodes.join(owned, "id", "left").select("id", F.concat_ws(" ", "title", "text", "notes").alias("text"))
    chapters = toc.select(F.col("chapter").alias("num")).distinct()
    edges = kept(refs.edges(texts, toc, chapters), "edges")
    index = kept(graph.node_index(toc, nodes), "index")
    kept(graph.incoming_chunks(edges), "backlinks")
    kept(graph.rollup(edges, "(", graph.CHUNK), "backlinks_rollup")
    kept(graph.described(graph.top_cited(edges), index), "top_cited")
    usage = kept(refs.table_usage(texts, tables, nodes), "table_usage")
    kept(review.buckets(review.priority(review.with_usage(review.unverified(tables), usage))), "review")
    flat = tables.withColumn("text", F.concat_ws(" ", "intro", grid.flat_text(F.col("rows"))))
    found = kept(search.documents(nodes, notes, toc, terms, flat), "search_documents")
    write_compact(found, f"{target}/search")
    search.write_index(found, f"{target}/search_index")

    parts = records.where("rec = 'part'")
    vocabulary = quality.vocabulary((nodes, ["article"], "title"), (nodes, ["article"], "text"), (records.where("rec <> 'node'"), ["article"], "text"), (parts, ["article"], "title"), (toc.withColumnRenamed("num", "article"), ["article"], "title"), *[(df.withColumn("article", F.lit(GLOSSARY)), ["article"], c) for df, c in ((terms, "term"), (terms, "definition"), (scope, "text"))])
    line_key = ["article", "doc_id", "line_no"]
    by_line = kept(quality.coverage(lines.where("kind = 'text'"), vocabulary, ["article"], line_key), "line_coverage")
    covered = quality.coverage_summary(by_line)
    lost = by_line.where("not covered").join(lines.select(*line_key, "text"), line_key)
    broken = graph.broken(edges, index).withColumn("text", F.concat_ws(" -> ", "src", "dst"))
    shown = quality.examples("lost lines", lost, ["doc_id", "line_no"], "text").unionByName(quality.examples("broken references", broken, ["src", "dst"], "text"))
    kept(shown.unionByName(quality.examples("repeated ids", quality.duplicates(nodes, "id"), ["id"], "id")), "examples")
    positions = kept(grid.cell_positions(tables), "cells")
    report = kept(gate_report(toc, records, nodes, notes, edges, index, terms, tables, positions, covered, quality.FLOORS | (floors or {})), "gate")
    if gate:
        quality.enforce(report)
    return report


def gate_report(toc, records, nodes, notes, edges, index, terms, tables, positions, covered, floors: dict[str, float]) -> DataFrame:
    """The report of the gate. What concerns one collection is one aggregation over it; what relates nodes, notes, citations, the index and tables is one tally of their ids,
    in which targets among tables bear the prefix of their citations and all others "id:"."""
    M, count, one = quality.Measure, F.count("*"), F.lit(1)
    plain = lambda c: F.concat(F.lit("id:"), c)
    to_table = F.col("dst").startswith("tabla:")
    other = F.rlike("dst", F.lit(r"^(parte|cap|art):"))
    empty = F.col("parent_id").isNull() & (F.coalesce("text", F.lit("")) == "")
    tally = quality.tallied(
        (nodes, plain(F.col("id")), {"nodes": one, "empty": empty}),
        (nodes.where("parent_id is not null"), plain(F.col("parent_id")), {"filled": one}),
        (notes.where("node_id is not null"), plain(F.col("node_id")), {"filled": one}),
        (edges.where(F.col("dst").isNotNull() & ~other), F.when(to_table, F.col("dst")).otherwise(plain(F.col("dst"))), {"cites_table": to_table, "cites_node": ~to_table}),
        (index.where("id is not null"), plain(F.col("id")), {"indexed": one}),
        (tables.where("id is not null"), F.concat(F.lit("tabla:"), "id"), {"tables": one}),
    )
    counters = quality.counters(records)
    numbered = nodes.where("parent_id is null").withColumn("number", F.regexp_extract("id", r"-(\d+)$", 1).try_cast("int"))
    return quality.report(
        quality.measured(toc, M("articles", count, floor=floors["articles"])),
        quality.measured(counters, *[M(c, F.sum(c), floor=floors[c]) for c in ("sections", "items")]),
        quality.measured(terms, M("definitions", count, floor=floors["definitions"])),
        quality.check("coverage_pct", covered, "coverage_pct", floor=floors["coverage_pct"]),
        quality.measured(
            tables,
            M("tables", count, floor=floors["tables"]),
            M("reliable tables", F.count_if(F.col("quality") >= quality.RELIABLE), floor=floors["reliable_tables"]),
            M("single-column tables", F.count_if(F.col("cols") < 2), ceiling=quality.MOST_NARROW),
        ),
        quality.key_measures(
            tally,
            M("broken references", F.sum(F.when(F.col("indexed") == 0, F.col("cites_node")))),
            M("references to unknown tables", F.sum(F.when(F.col("tables") == 0, F.col("cites_table")))),
            M("repeated ids", F.count_if(F.col("nodes") > 1)),
            M("empty sections", F.sum(F.when(F.col("filled") == 0, F.col("empty")))),
        ),
        quality.none_of("sections out of order", quality.out_of_order(numbered, ["doc_id", "article"], ["ord"], "number")),
        quality.none_of("rows of uneven width", quality.uneven_rows(positions, tables)),
        quality.none_of("columns without data", quality.columns_without_data(positions, tables)),
    )


if __name__ == "__main__":
    build(SparkSession.builder.appName("build").getOrCreate(), sys.argv[1], sys.argv[2], gate="--no-gate" not in sys.argv[3:])
