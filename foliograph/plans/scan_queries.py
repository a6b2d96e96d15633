"""Prefix scans over keys that hold all rows of a table."""

from pyspark.sql import functions as F

from foliograph.operators import intervals as I
from foliograph.operators import lines as L
from foliograph.operators import order_stats as Q
from foliograph.operators import scan as P
from foliograph.operators import tree as T
from foliograph.plans.registry import query, table


@query("""
SELECT l_orderkey, l_linenumber, l_extendedprice FROM (
  SELECT *, max(l_extendedprice) OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS most FROM lineitem)
WHERE l_extendedprice > coalesce(most, 0)""")
def price_records(spark, sf_dir):
    """Line items dearer than all shipped before."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_shipdate", "l_partkey", "l_suppkey")
    out = L.accept_increasing(li, [], ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], "l_extendedprice", even=True)
    return out.where("accepted").select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("""
SELECT event_id, last_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_error,
       coalesce(lead(event_id) OVER (ORDER BY event_id), -1) AS next_event FROM events""")
def events_carried(spark, sf_dir):
    """The last error at each event, and the event after it, over one stream."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", F.when(F.col("event_type") == "error", F.col("event_id")).alias("error"))
    carried = L.carry(e, [], ["ts", "event_id"], "error", "last_error", even=True)
    after = L.extents(e.select("event_id"), [], "event_id", F.lit(-1), even=True).select("event_id", F.col("hi").alias("next_event"))
    return carried.join(after, "event_id").select("event_id", "last_error", "next_event")


@query("""
WITH c AS (SELECT event_id, event_type, ts, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER (ORDER BY ts, event_id) AND row_number() OVER (ORDER BY ts, event_id) > 1 THEN 0 ELSE 1 END AS c FROM events),
r AS (SELECT event_type, sum(c) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM c)
SELECT CAST(run AS BIGINT) AS run, any_value(event_type) AS event_type, count(*) AS n FROM r GROUP BY run""")
def event_runs(spark, sf_dir):
    """Runs of events of one type over one stream."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    return P.contiguous_groups(e, [], ["ts", "event_id"], "event_type").groupBy("run").agg(F.any_value("event_type").alias("event_type"), F.count("*").alias("n"))


@query("""
WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(round(l_extendedprice * 100) AS BIGINT) AS a, CAST(round(l_extendedprice * 100) AS BIGINT) + CAST(l_quantity AS BIGINT) AS b, l_returnflag AS k FROM lineitem),
m AS (SELECT *, max(b) OVER (PARTITION BY k ORDER BY a, b, l_orderkey, l_linenumber, l_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS most FROM s),
i AS (SELECT *, sum(CASE WHEN a - most >= 1 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY a, b, l_orderkey, l_linenumber, l_partkey ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT k, CAST(island AS BIGINT) AS island, min(a) AS lo, max(b) AS hi, count(*) AS n FROM i GROUP BY k, island""")
def price_islands(spark, sf_dir):
    """Islands of overlapping price ranges, for three keys that hold a third of all rows each."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_returnflag").alias("k"), cents.alias("a"), (cents + F.col("l_quantity").cast("long")).alias("b"))
    out = P.running_islands(li, ["k"], "a", "b", 1, ties=("l_orderkey", "l_linenumber", "l_partkey"))
    return out.groupBy("k", "island").agg(F.min("a").alias("lo"), F.max("b").alias("hi"), F.count("*").alias("n"))


@query("""
WITH s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM documents),
n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id, p) AS line_no FROM s WHERE length(trim(line, ' ')) > 0)
SELECT doc_id, min(line_no) AS first_line, count(*) AS lines FROM n GROUP BY doc_id""")
def stream_numbers(spark, sf_dir):
    """The lines of all documents as one stream of one document, numbered over even parts."""
    split = L.split_lines(table(spark, sf_dir, "documents"), "doc_id", "text")
    stream = split.select(F.lit("all").alias("doc_id"), F.col("doc_id").alias("page"), F.col("line_no").alias("y"), F.lit(0).alias("ord"))
    return L.merge_stream(stream, even=True).groupBy(F.col("page").alias("doc_id")).agg(F.min("line_no").alias("first_line"), F.count("*").alias("lines"))


@query("""
WITH RECURSIVE i AS (SELECT l_suppkey AS s, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS k FROM lineitem),
c AS (SELECT s, k, 1 AS depth FROM i WHERE k = 2 UNION ALL SELECT i.s, i.k, depth + 1 FROM c JOIN i ON i.s = c.s AND i.k = c.k + 1)
SELECT s || ':1' AS root, count(*) AS below, CAST(max(depth) AS BIGINT) AS deepest, CAST(sum(depth) AS BIGINT) AS depths FROM c GROUP BY s""")
def supply_chains(spark, sf_dir):
    """Every line item hangs on the one before it of its supplier: chains of hundreds, thousands on larger tables."""
    li = L.merge_stream(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("doc_id"), F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("y"), F.col("l_partkey").alias("ord")), even=True)
    at = lambda k: F.concat("doc_id", F.lit(":"), k.cast("string"))
    edges = li.select(at(F.col("line_no")).alias("child"), F.when(F.col("line_no") > 1, at(F.col("line_no") - 1)).alias("parent"))
    return T.roots(edges, "child", "parent").groupBy("root").agg(F.count("*").alias("below"), F.max("depth").alias("deepest"), F.sum("depth").alias("depths"))


@query("""
WITH p AS (SELECT CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, l_quantity FROM lineitem),
z AS (SELECT o_orderkey, CAST(round(o_totalprice * 20) AS BIGINT) AS lo, CAST(round(o_totalprice * 20) AS BIGINT) + o_orderkey % 700 AS hi FROM orders)
SELECT o_orderkey, count(*) AS words, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM p JOIN z ON cents BETWEEN lo AND hi GROUP BY o_orderkey""")
def zones_of_one_page(spark, sf_dir):
    """Every line item is a word, every order a zone, all of one page: the words in each zone."""
    cents = lambda c: F.round(c).cast("long")
    words = table(spark, sf_dir, "lineitem").select(F.lit(1).alias("page"), cents(F.col("l_extendedprice") * 100).alias("at"), "l_quantity")
    # words of one place are in the same zones, so pairs don't grow with how many these are
    words = words.groupBy("page", "at").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))
    lo = cents(F.col("o_totalprice") * 20)
    zones = table(spark, sf_dir, "orders").select(F.lit(1).alias("page"), "o_orderkey", lo.alias("lo"), (lo + F.col("o_orderkey") % 700).alias("hi"))
    pairs = I.interval_join(words, zones, ["page"], ("at", "at"), ("lo", "hi"), unit=64)
    return pairs.groupBy("o_orderkey").agg(F.sum("n").alias("words"), F.sum("quantity").cast("long").alias("quantity"))


@query("""
WITH s AS (SELECT l_returnflag, l_extendedprice, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS r, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem WHERE l_extendedprice IS NOT NULL),
q AS (SELECT unnest([0.0::DOUBLE, 0.01::DOUBLE, 0.25::DOUBLE, 0.5::DOUBLE, 0.9::DOUBLE, 1.0::DOUBLE]) AS share)
SELECT l_returnflag, share, n, l_extendedprice FROM s, q WHERE r = least(CAST(floor(share * n) AS BIGINT), n - 1)""")
def price_quantiles(spark, sf_dir):
    """Exact order statistics of three keys that hold all rows: only the values about each rank are ordered."""
    return Q.order_statistics(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", (0.0, 0.01, 0.25, 0.5, 0.9, 1.0))


@query("""
WITH s AS (SELECT l_partkey, l_extendedprice, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice) - 1 AS r, count(*) OVER (PARTITION BY l_partkey) AS n FROM lineitem WHERE l_extendedprice IS NOT NULL)
SELECT l_partkey, 0.5::DOUBLE AS share, n, l_extendedprice FROM s WHERE r = n // 2""")
def part_medians(spark, sf_dir):
    """The upper median price of each part, large parts narrowed down and small ones ordered whole."""
    return Q.order_statistics(table(spark, sf_dir, "lineitem"), ["l_partkey"], "l_extendedprice", (0.5,), hot=500)
