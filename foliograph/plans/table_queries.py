"""Clusters, islands, bands, candidates, cells, corrections and review lists."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliograph.operators import grid as D
from foliograph.operators import overlay as O
from foliograph.operators import quality as Q
from foliograph.operators import review as V
from foliograph.plans.registry import query, table
from foliograph.plans.text_queries import LINES, document_lines
from foliograph.sources.collections import markdown_rows
from foliograph.streaming.windows import windowed_counts


@query("""
WITH d AS (SELECT user_id, value, CASE WHEN value - lag(value) OVER (PARTITION BY user_id ORDER BY value) > 2.0 THEN 1 ELSE 0 END AS n FROM events),
c AS (SELECT user_id, value, sum(n) OVER (PARTITION BY user_id ORDER BY value RANGE UNBOUNDED PRECEDING) AS cluster FROM d)
SELECT user_id, cluster::BIGINT AS cluster, round(avg(value), 6) AS center, count(*) AS n FROM c GROUP BY user_id, cluster""")
def tolerance_clusters(spark, sf_dir):
    return D.tolerance_clusters(table(spark, sf_dir, "events"), ["user_id"], "value", 2.0, digits=6)


SHIPS = "s AS (SELECT l_suppkey, epoch(l_shipdate) // 86400 AS a, epoch(l_shipdate) // 86400 + l_quantity AS b FROM lineitem)"


def _ships(spark, sf_dir):
    day = F.floor(F.unix_timestamp("l_shipdate") / 86400).cast("double")
    return table(spark, sf_dir, "lineitem").select("l_suppkey", day.alias("a"), (day + F.col("l_quantity")).alias("b"))


@query(f"""
WITH {SHIPS}, m AS (SELECT *, max(b) OVER (PARTITION BY l_suppkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
i AS (SELECT *, sum(CASE WHEN a - reach >= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY l_suppkey ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT l_suppkey, island::BIGINT AS island, min(a)::DOUBLE AS a, max(b)::DOUBLE AS b, count(*) AS n FROM i GROUP BY l_suppkey, island""")
def running_max_islands(spark, sf_dir):
    return D.running_islands(_ships(spark, sf_dir), ["l_suppkey"], "a", "b", 3.0).groupBy("l_suppkey", "island").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.count("*").alias("n"))


@query(f"""
WITH {SHIPS}, m AS (SELECT *, max(b) OVER (PARTITION BY l_suppkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s)
SELECT l_suppkey, sum(greatest(0, b - greatest(a, coalesce(reach, a))))::DOUBLE AS covered FROM m GROUP BY l_suppkey""")
def interval_union(spark, sf_dir):
    return D.union_length(_ships(spark, sf_dir), ["l_suppkey"], "a", "b")


@query(f"""
WITH {SHIPS}, g AS (SELECT *, CASE WHEN a - lag(b) OVER (PARTITION BY l_suppkey ORDER BY a, b) > 26 THEN 1 ELSE 0 END AS far FROM (SELECT l_suppkey, a, max(b) AS b FROM s GROUP BY l_suppkey, a))
SELECT l_suppkey, count(*) AS bands FROM (SELECT *, sum(far) OVER (PARTITION BY l_suppkey ORDER BY a) AS stop FROM g) WHERE stop = 0 GROUP BY l_suppkey""")
def prefix_until_gap(spark, sf_dir):
    days = _ships(spark, sf_dir).groupBy("l_suppkey", "a").agg(F.max("b").alias("b"))
    return D.prefix_until_gap(days, ["l_suppkey"], "a", "b").groupBy("l_suppkey").agg(F.count("*").alias("bands"))


@query("""
WITH i AS (SELECT DISTINCT user_id, floor(value) AS x FROM events), g AS (SELECT user_id, x, lag(x) OVER (PARTITION BY user_id ORDER BY x) AS p FROM i)
SELECT user_id, count(*) AS gaps, max(x - p - 1)::DOUBLE AS widest FROM g WHERE x - p - 1 >= 3 GROUP BY user_id""")
def ink_gaps(spark, sf_dir):
    from pyspark.sql import Window

    ink = table(spark, sf_dir, "events").select("user_id", F.floor("value").cast("double").alias("x")).distinct()
    gap = F.col("x") - F.lag("x").over(Window.partitionBy("user_id").orderBy("x")) - 1
    return ink.withColumn("gap", gap).where(F.col("gap") >= D.GAP_MIN).groupBy("user_id").agg(F.count("*").alias("gaps"), F.max("gap").alias("widest"))


@query("""
SELECT event_type, CASE WHEN value < 5 THEN 0 WHEN value < 15 THEN 1 WHEN value < 40 THEN 2 ELSE 3 END AS col, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1, 2""")
def bands_assignment(spark, sf_dir):
    edges = F.array(*[F.lit(x) for x in (0.0, 5.0, 15.0, 40.0, 90.0)])
    return table(spark, sf_dir, "events").where("value is not null").groupBy("event_type", D.column_of(F.col("value"), edges).alias("col")).agg(F.count("*").alias("n"))


@query("""
WITH c AS (SELECT l_partkey, l_suppkey, round(sum(l_extendedprice), 2) AS score, count(*) FILTER (WHERE l_discount = 0) AS empty, count(*) AS cols FROM lineitem GROUP BY 1, 2)
SELECT l_partkey, l_suppkey, score FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY score DESC, empty, cols DESC, l_suppkey) AS r FROM c) WHERE r = 1""")
def best_candidate(spark, sf_dir):
    from foliograph.operators.lines import keep_first

    c = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("score"), F.count_if(F.col("l_discount") == 0).alias("empty"), F.count("*").alias("cols"))
    return keep_first(c, ["l_partkey"], [F.desc("score"), "empty", F.desc("cols"), "l_suppkey"]).select("l_partkey", "l_suppkey", "score")


@query("""
WITH g AS (SELECT l_suppkey, l_orderkey, count(*) AS groups FROM lineitem GROUP BY 1, 2), c AS (SELECT l_suppkey, groups, count(*) AS n FROM g GROUP BY 1, 2)
SELECT l_suppkey, groups AS modal, n FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, groups DESC) AS r FROM c) WHERE r = 1""")
def modal_groups(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_orderkey").agg(F.count("*").alias("groups")).groupBy("l_suppkey", "groups").agg(F.count("*").alias("n"))
    return g.groupBy("l_suppkey").agg(F.max_by("groups", F.struct("n", "groups")).alias("modal"), F.max("n").alias("n"))


@query(f"""
WITH {LINES}, c AS (SELECT doc_id, len(list_filter(regexp_split_to_array(trim(text, ' '), '\\s+'), lambda w: regexp_matches(w, '^[-+]?[0-9][0-9.,]*$'))) AS numbers FROM lines)
SELECT doc_id, 1 - avg(CASE WHEN numbers > 1 THEN 1 ELSE 0 END) AS score FROM c GROUP BY doc_id""")
def grid_quality(spark, sf_dir):
    return D.grid_score(document_lines(spark, sf_dir), ["doc_id"], "text")


@query("""
WITH n AS (SELECT count(DISTINCT l_orderkey) AS rows FROM lineitem)
SELECT l_linenumber AS col, count(*) FILTER (WHERE trim(l_returnflag) <> '') / max(rows) AS fill FROM lineitem, n GROUP BY l_linenumber""")
def column_fill(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_linenumber", "l_returnflag", F.lit(1).alias("all"))
    rows = table(spark, sf_dir, "lineitem").agg(F.countDistinct("l_orderkey")).scalar()
    return D.column_fill(li, ["all"], rows, "l_linenumber", "l_returnflag").select(F.col("l_linenumber").alias("col"), "fill")


@query("""
WITH c AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INTEGER) % 3 + 1 AS cs, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS ord FROM lineitem)
SELECT l_orderkey AS id, ord, cs, (sum(cs) OVER (PARTITION BY l_orderkey ORDER BY ord) - cs)::BIGINT AS col, (sum(cs) OVER (PARTITION BY l_orderkey))::BIGINT AS covered FROM c""")
def cell_layout(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    cell = F.struct("l_linenumber", "l_partkey", "l_suppkey", (F.col("l_quantity").cast("int") % 3 + 1).alias("cs"))
    rows = li.groupBy(F.col("l_orderkey").cast("string").alias("id")).agg(F.array_sort(F.collect_list(cell)).alias("c"))
    t = rows.select("id", F.array(F.transform("c", lambda x: F.struct(x["l_linenumber"].cast("string").alias("t"), x["cs"].alias("cs"), F.lit(1).alias("rs")))).alias("rows"))
    t = t.withColumn("cols", D.row_width(F.col("rows")[0]))
    return D.cell_positions(t).select(F.col("id").cast("long").alias("id"), "ord", "cs", "col", "covered")


@query("""
WITH o AS (SELECT s_suppkey AS k, s_name AS name, s_acctbal AS bal FROM supplier WHERE s_acctbal > 5000)
SELECT coalesce(c_custkey, k) AS c_custkey, coalesce(name, c_name) AS c_name, c_nationkey, CASE WHEN k IS NOT NULL THEN 1.0 ELSE c_acctbal END AS c_acctbal,
       CASE WHEN c_custkey IS NULL THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment
FROM customer FULL OUTER JOIN o ON c_custkey = k""")
def overlay_merge(spark, sf_dir):
    over = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("c_name"), F.lit("SUPPLIER").alias("note"))
    return O.merge(table(spark, sf_dir, "customer"), over, "c_custkey", ["c_name"], {"c_acctbal": F.lit(1.0)}, {"c_mktsegment": F.lit("NEW")}, ["c_name"])


REVIEW = """
u AS (SELECT l_partkey, count(*) AS usos FROM lineitem GROUP BY l_partkey),
t AS (SELECT p_partkey, 1 - p_size / 50.0 AS quality, p_type = 'PROMO' AS encabezado_dudoso, p_size % 4 AS cols, coalesce(usos, 0) AS usos FROM part LEFT JOIN u ON p_partkey = l_partkey),
r AS (SELECT *, 1 - quality + CASE WHEN encabezado_dudoso THEN 0.6 ELSE 0 END AS risk FROM t),
p AS (SELECT *, usos * risk + risk + CASE WHEN cols < 2 THEN 3.0 ELSE 0 END AS prio FROM r)"""


def _reviewed(spark, sf_dir):
    usage = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.count("*").alias("usos"))
    t = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (1 - F.col("p_size") / 50.0).alias("quality"), (F.col("p_type") == "PROMO").alias("encabezado_dudoso"), (F.col("p_size") % 4).alias("cols"), F.col("p_name").alias("title"))
    return V.priority(V.with_usage(t, usage))


@query(f"WITH {REVIEW} SELECT p_partkey, round(risk, 6) AS risk, round(prio, 6) AS prio, usos FROM p")
def review_priority(spark, sf_dir):
    return _reviewed(spark, sf_dir).select(F.col("id").alias("p_partkey"), F.round("risk", 6).alias("risk"), F.round("prio", 6).alias("prio"), "usos")


@query(f"""
WITH {REVIEW}, q AS (SELECT p_partkey, round(quality, 6) AS quality, round(prio, 6) AS prio, encabezado_dudoso, usos FROM p),
b AS (SELECT p_partkey, prio >= 1.0 AS critical, prio < 1.0 AND quality < 0.8 AS doubtful, quality >= 0.95 AND NOT encabezado_dudoso AND usos >= 5 AS control FROM q)
SELECT *, NOT (critical OR doubtful OR control) AS unflagged FROM b""")
def review_buckets(spark, sf_dir):
    t = _reviewed(spark, sf_dir).withColumn("quality", F.round("quality", 6)).withColumn("prio", F.round("prio", 6))
    return V.buckets(t).select(F.col("id").alias("p_partkey"), "critical", "doubtful", "control", "unflagged")


@query(f"""
WITH {REVIEW} SELECT p.p_partkey AS id, '| ' || p.p_partkey || ' | ' || p_name || ' | ' || printf('%.2f', quality) || ' | ' || usos || ' | ' || printf('%.2f', round(prio, 6)) || ' |' AS value FROM p JOIN part ON p.p_partkey = part.p_partkey""")
def markdown_report(spark, sf_dir):
    return markdown_rows(_reviewed(spark, sf_dir).withColumn("prio", F.round("prio", 6)).withColumn("id", F.col("id").cast("string"))).withColumn("id", F.col("id").cast("long"))


@query(f"""
WITH {REVIEW}, q AS (SELECT round(quality, 6) AS q FROM p)
SELECT count(*) FILTER (WHERE q >= 0.95) AS reliable, count(*) FILTER (WHERE q >= 0.8 AND q < 0.95) AS fair, count(*) FILTER (WHERE q < 0.8) AS poor, round(avg(q), 6) AS mean FROM q""")
def quality_histogram(spark, sf_dir):
    return Q.histogram(_reviewed(spark, sf_dir).select(F.round("quality", 6).alias("quality"))).withColumn("mean", F.round("mean", 6))


@query(f"""
WITH {REVIEW} SELECT p_partkey AS id, list_filter([CASE WHEN cols < 2 THEN 'one column only' END, CASE WHEN usos > 0 THEN usos || ' cells with several values' END,
  CASE WHEN encabezado_dudoso THEN 'a header column too many' END], lambda x: x IS NOT NULL) AS signals FROM p""")
def review_signals(spark, sf_dir):
    t = _reviewed(spark, sf_dir).withColumns({"grid": F.lit("rejilla"), "header_rows": F.lit(1), "pages": F.array(F.lit(1))})
    return t.select("id", V.signals(F.col("usos")).alias("signals"))


@query("SELECT date_trunc('hour', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    return windowed_counts(table(spark, sf_dir, "events"), "ts", "event_type", "value").withColumn("total", F.round("total", 4))


@query("""
WITH i AS (SELECT o_custkey // 10 AS k, row_number() OVER (PARTITION BY o_custkey // 10 ORDER BY o_orderkey) - 1 AS row, o_orderkey, o_custkey FROM orders)
SELECT k::VARCHAR AS table_id, (row // 20 + 1)::INTEGER AS page, row % 20 AS row, c::INTEGER AS col, CASE c WHEN 0 THEN 'o' || o_orderkey WHEN 1 THEN o_custkey || ' n' ELSE (o_orderkey % 7)::VARCHAR END AS t, 1 AS cs, 1 AS rs
FROM i, (SELECT unnest([0, 1, 2]) AS c)""")
def tables_from_words(spark, sf_dir):
    """The orders of ten customers are a table of words in three columns without rules, twenty rows a page: the best layout of each page, and the cells that it gives back."""
    k = F.floor(F.col("o_custkey") / 10)
    order = Window.partitionBy(k).orderBy("o_orderkey")
    i = table(spark, sf_dir, "orders").select(k.cast("string").alias("table_id"), (F.row_number().over(order) - 1).alias("n"), "o_orderkey", "o_custkey")
    i = i.withColumn("page", F.floor(F.col("n") / 20 + 1).cast("int")).withColumn("row", F.col("n") % 20)
    i = i.withColumn("top", F.col("row") * 20.0 + 10)
    word = lambda x, width, t: F.struct(F.lit(float(x)).alias("x0"), F.lit(float(x + width)).alias("x1"), t.cast("string").alias("text"))
    said = F.array(word(0, 40, F.concat(F.lit("o"), F.col("o_orderkey").cast("string"))), word(100, 30, F.col("o_custkey")), word(132, 5, F.lit("n")), word(200, 20, F.col("o_orderkey") % 7))
    words = i.select("table_id", "page", "row", "top", F.posexplode(said).alias("at", "w")).select("table_id", "page", (F.col("row") * 4 + F.col("at")).alias("ord"), "w.x0", F.col("top").alias("y0"), "w.x1", (F.col("top") + 8).alias("y1"), "w.text")
    bands = i.select("table_id", "page", "row", (F.col("top") - 5).alias("y0"), (F.col("top") + 15).alias("y1"))
    rules = bands.where("false").select("table_id", "page", F.lit("h").alias("orient"), F.col("y0").alias("pos"), F.col("y0").alias("lo"), F.col("y1").alias("hi"))
    cells = D.merged_cells(words, rules, bands, D.best_layout(words, bands, rules))
    rows = cells.select("table_id", "page", F.posexplode("rows").alias("row", "cells"))
    return rows.select("table_id", "page", F.col("row").cast("long").alias("row"), F.posexplode("cells").alias("col", "c")).select("table_id", "page", "row", "col", "c.t", "c.cs", "c.rs")
