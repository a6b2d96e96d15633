"""The document pipeline on lines, citations and geometry made from the driver's tables. The SQL twins derive what must come out from
the tables themselves, not by parsing."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliograph.functions import tables
from foliograph.functions import text as X
from foliograph.operators import grid as D
from foliograph.operators import lines as L
from foliograph.operators import refs as R
from foliograph.operators import search as S
from foliograph.operators import tree as T
from foliograph.plans.registry import SQL, query, table
from foliograph.plans.search_queries import UNION, every_text

# A supplier is an article. Its line items, in order, are ten kinds of lines: a section, a note, three letters, two numbers below the
# last of these, a text that goes on, a fourth letter and an exception. After 999 sections the article goes on in a further document.
MADE = """
i AS (SELECT l_suppkey, l_partkey, l_orderkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS i FROM lineitem),
m AS (SELECT 'd' || (l_suppkey // 900) || '.' || (i // 9990) AS doc_id, (100 + l_suppkey % 900)::INTEGER AS article, i % 9990 AS i, i % 10 AS k, l_suppkey, l_partkey, l_orderkey,
      (100 + l_suppkey % 900) || '-' || (i % 9990 // 10 + 1) AS sec FROM i)"""


def made_lines(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber")
    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey")
    li = li.withColumn("i", F.row_number().over(order) - 1).withColumn("more", F.floor(F.col("i") / 9990)).withColumn("i", F.col("i") % 9990).withColumn("k", F.col("i") % 10)
    article = (F.lit(100) + F.col("l_suppkey") % 900).cast("int")
    part, head = F.col("l_partkey").cast("string"), F.concat(article.cast("string"), F.lit("-"), F.floor(F.col("i") / 10 + 1).cast("string"))
    said = {0: F.concat(head, F.lit(". Orden "), F.col("l_orderkey").cast("string"), F.lit(". Pieza "), part), 1: F.concat(F.lit("NOTA 1: Aviso "), part), 7: F.concat(F.lit("sigue  "), part), 9: F.concat(F.lit("Excepción: Salvo "), part)}
    for k, mark in ((2, "a) "), (3, "b) "), (4, "c) "), (5, "(1) "), (6, "(2) "), (8, "d) ")):
        said[k] = F.concat(F.lit(mark), F.lit("Pieza "), part)
    text = F.lit(None)
    for k, t in said.items():
        text = F.when(F.col("k") == k, t).otherwise(text)
    none = F.lit(None).cast("int")
    return li.select(F.concat(F.lit("d"), F.floor(F.col("l_suppkey") / 900).cast("string"), F.lit("."), F.col("more").cast("string")).alias("doc_id"), article.alias("article"), F.col("i").cast("long").alias("line_no"), F.lit(12).alias("page"), F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("ref"), none.alias("w"), none.alias("h"))


@query(f"""
WITH {MADE}, n AS (SELECT *, CASE k WHEN 2 THEN 'a' WHEN 3 THEN 'b' WHEN 4 THEN 'c' WHEN 5 THEN '1' WHEN 6 THEN '2' WHEN 8 THEN 'd' ELSE sec END AS label, lead(l_partkey) OVER (PARTITION BY l_suppkey, doc_id ORDER BY i) AS next FROM m)
SELECT doc_id, sec || CASE WHEN k = 0 THEN '' WHEN k IN (5, 6) THEN '(c)(' || label || ')' ELSE '(' || label || ')' END AS id,
  CASE WHEN k = 0 THEN NULL WHEN k IN (5, 6) THEN sec || '(c)' ELSE sec END AS parent_id, sec AS root_id, article, CASE WHEN k = 0 THEN 'section' WHEN k IN (5, 6) THEN 'paren' ELSE 'alpha' END AS kind,
  label, CASE WHEN k = 0 THEN 0 WHEN k IN (5, 6) THEN 2 ELSE 1 END::INTEGER AS level, CASE WHEN k = 0 THEN 'Orden ' || l_orderkey END AS title,
  'Pieza ' || l_partkey || CASE WHEN k = 6 AND next IS NOT NULL THEN ' sigue ' || next ELSE '' END AS text
FROM n WHERE k IN (0, 2, 3, 4, 5, 6, 8)""")
def parsed_nodes(spark, sf_dir):
    return T.nodes(T.parse(made_lines(spark, sf_dir), **T.OF_NODES)).select("doc_id", "id", "parent_id", "root_id", "article", "kind", "label", "level", "title", "text")


@query(SQL["parsed_nodes"])
def parsed_in_sql(spark, sf_dir):
    """The same nodes by the table function, called from SQL."""
    tables.register(spark)
    lines = T.classified(made_lines(spark, sf_dir))
    return spark.sql("SELECT doc_id, id, parent_id, root_id, article, kind, label, level, title, text FROM parse_lines(TABLE({lines})) WHERE rec = 'node'", lines=lines)


@query(f"""
WITH {MADE}
SELECT doc_id, sec || CASE WHEN k = 1 THEN '' ELSE '(d)' END AS node_id, CASE WHEN k = 1 THEN 'note' ELSE 'exception' END AS kind, CASE WHEN k = 1 THEN 'NOTA 1' ELSE 'Excepción' END AS label,
  CASE WHEN k = 1 THEN 'Aviso ' ELSE 'Salvo ' END || l_partkey AS text, article FROM m WHERE k IN (1, 9)""")
def parsed_annotations(spark, sf_dir):
    return T.annotations(T.parse(made_lines(spark, sf_dir), **T.OF_ANNOTATIONS)).select("doc_id", "node_id", "kind", "label", "text", "article")


@query(f"""
WITH {MADE} SELECT doc_id, article, []::VARCHAR[] AS parts, list_sort(list(DISTINCT (i // 10 + 1)::INTEGER)) AS sections FROM m WHERE k = 0 GROUP BY doc_id, article""")
def section_census(spark, sf_dir):
    return L.census(made_lines(spark, sf_dir))


@query(f"""
WITH {MADE}, c AS (SELECT doc_id, sec, 'alpha' AS kind, count(*) AS n FROM m WHERE k IN (2, 3, 4, 8) GROUP BY 1, 2 UNION ALL SELECT doc_id, sec, 'paren', count(*) FROM m WHERE k IN (5, 6) GROUP BY 1, 2)
SELECT doc_id, sec AS root_id, sum(n)::BIGINT AS items FROM c GROUP BY doc_id, sec""")
def items_below(spark, sf_dir):
    return T.item_ids(T.parse(made_lines(spark, sf_dir), **T.OF_ITEMS)).select("doc_id", "root_id", F.size("items").cast("long").alias("items"))


# Each customer's text cites a section, maybe one that isn't there, a table, an article and a chapter.
CITING = """
c AS (SELECT c_custkey AS k, (100 + c_custkey % 500) || '-' || (c_custkey // 500 + 1) AS id, (100 + c_custkey * 7 % 600) AS a, c_custkey * 3 % 5 + 1 AS s, c_custkey * 11 % 40 + 1 AS t, (100 + c_custkey * 13 % 700) AS b, c_custkey % 12 + 1 AS cap FROM customer),
ids AS (SELECT DISTINCT id FROM c), arts AS (SELECT DISTINCT (100 + c_custkey % 500) AS num FROM customer)"""


def citing(spark, sf_dir):
    k = F.col("c_custkey")
    s = lambda c: c.cast("string")
    id_ = F.concat_ws("-", s(F.lit(100) + k % 500), s(F.floor(k / 500) + 1))
    text = F.concat(F.lit("Véase "), s(F.lit(100) + k * 7 % 600), F.lit("-"), s(k * 3 % 5 + 1), F.lit("(a) y la Tabla 310-"), s(k * 11 % 40 + 1), F.lit(", el Artículo "), s(F.lit(100) + k * 13 % 700), F.lit(" y el Capítulo "), s(k % 12 + 1), F.lit("."))
    nodes = table(spark, sf_dir, "customer").select(id_.alias("id"), text.alias("text"))
    articles = table(spark, sf_dir, "customer").select((F.lit(100) + k % 500).cast("int").alias("num")).distinct()
    return nodes, articles, spark.range(1, 11).select(F.col("id").cast("int").alias("num"))


@query(f"""
WITH {CITING}, e AS (
  SELECT c.id AS src, coalesce(ids.id, 'art:' || a) AS dst, CASE WHEN ids.id IS NOT NULL THEN 'seccion' ELSE 'articulo' END AS type
  FROM c LEFT JOIN ids ON ids.id = a || '-' || s WHERE a IN (SELECT num FROM arts) AND NOT (a = 310 AND s = t)
  UNION ALL SELECT id, 'tabla:310-' || t, 'tabla' FROM c
  UNION ALL SELECT id, 'art:' || b, 'articulo' FROM c WHERE b IN (SELECT num FROM arts)
  UNION ALL SELECT id, 'cap:' || cap, 'capitulo' FROM c WHERE cap <= 10)
SELECT DISTINCT src, dst, type FROM e WHERE src <> dst""")
def citation_edges(spark, sf_dir):
    return R.edges(*citing(spark, sf_dir))


@query(f"""
WITH {CITING}, n AS (SELECT '310-' || t AS id, count(*) AS explicitas FROM c GROUP BY t), tabs AS (SELECT '310-' || unnest(range(1, 51)) AS id)
SELECT tabs.id, coalesce(explicitas, 0) AS explicitas, coalesce(explicitas, 0) AS usos, ids.id IS NOT NULL AS ambiguo
FROM tabs LEFT JOIN n ON n.id = tabs.id LEFT JOIN ids ON ids.id = tabs.id""")
def table_mentions(spark, sf_dir):
    nodes, *_ = citing(spark, sf_dir)
    tables = spark.range(1, 51).select(F.concat(F.lit("310-"), F.col("id").cast("string")).alias("id"))
    return R.table_usage(nodes, tables, nodes)


# Words of a page: the line items of a part, a band for each order's last digit; drawn rules at some columns.
INK = """
w AS (SELECT l_suppkey::VARCHAR AS table_id, 1 AS page, (l_orderkey % 8)::INTEGER AS r, l_linenumber * 60.0 + l_quantity % 20 AS x0, l_linenumber * 60.0 + l_quantity % 20 + 20 + l_partkey % 10 AS x1 FROM lineitem)"""
ROWS = "rows8 AS (SELECT DISTINCT table_id, r FROM w)"


def ink(spark, sf_dir):
    x0 = (F.col("l_linenumber") * 60.0 + F.col("l_quantity") % 20).cast("double")
    row = (F.col("l_orderkey") % 8).cast("int")
    words = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("table_id"), F.lit(1).alias("page"), x0.alias("x0"), (row * 20.0 + 4).alias("y0"), (x0 + 20 + F.col("l_partkey") % 10).alias("x1"), (row * 20.0 + 14).alias("y1"), F.col("l_partkey").cast("string").alias("text"), F.col("l_orderkey").alias("ord"))
    bands = words.select("table_id", "page").distinct().withColumn("row", F.explode(F.sequence(F.lit(1), F.lit(8))))
    return words, bands.select("table_id", "page", "row", ((F.col("row") - 1) * 20.0).alias("y0"), (F.col("row") * 20.0).alias("y1"))


@query(f"""
WITH {INK}, p AS (SELECT table_id, min(x0) AS a, max(x1) AS b FROM w GROUP BY table_id HAVING max(x1) - min(x0) >= 20),
s AS (SELECT table_id, r, max(x1) - min(x0) AS span, count(*) AS n FROM w GROUP BY 1, 2),
m AS (SELECT w.*, a, b, span > 0.9 * (b - a) AND n > 6 AS wide FROM w JOIN p USING (table_id) JOIN s USING (table_id, r)),
o AS (SELECT *, bool_and(wide) OVER (PARTITION BY table_id) AS only_wide FROM m),
i AS (SELECT DISTINCT table_id, a, unnest(range(greatest(0, floor(x0 - a))::BIGINT, least(floor(b - a) + 1, floor(x1 - a) + 1)::BIGINT + 1)) AS x FROM o WHERE NOT wide OR only_wide),
g AS (SELECT table_id, a, x, lag(x) OVER (PARTITION BY table_id ORDER BY x) AS before FROM i),
e AS (SELECT table_id, round(a + (before + 1 + x) / 2.0, 2) AS e FROM g WHERE x - before - 1 >= 3 UNION SELECT table_id, round(a - 1, 2) FROM p UNION SELECT table_id, round(b + 1, 2) FROM p)
SELECT table_id, count(*) AS n, round(sum(e), 2) AS total, min(e) AS first, max(e) AS last FROM e GROUP BY table_id""")
def gap_columns(spark, sf_dir):
    e = D.gap_edges(*ink(spark, sf_dir))
    total = F.aggregate("edges", F.lit(0.0), lambda a, x: a + x)
    return e.select("table_id", F.size("edges").cast("long").alias("n"), F.round(total, 2).alias("total"), F.array_min("edges").alias("first"), F.array_max("edges").alias("last"))


@query(f"""
WITH {INK.replace('FROM lineitem', 'FROM lineitem WHERE l_linenumber <> 7 OR l_orderkey % 8 > 5')}, m AS (SELECT *, max(x1) OVER (PARTITION BY table_id, r ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM w),
i AS (SELECT *, sum(CASE WHEN x0 - reach >= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY table_id, r ORDER BY x0, x1 ROWS UNBOUNDED PRECEDING) AS island FROM m),
g AS (SELECT table_id, r, max(island) + 1 AS groups FROM i GROUP BY 1, 2), c AS (SELECT table_id, groups, count(*) AS n FROM g GROUP BY 1, 2),
b AS (SELECT table_id, arg_max(groups, n * 1000 + groups) AS modal, max(n) AS n, sum(n) AS whole FROM c GROUP BY table_id HAVING arg_max(groups, n * 1000 + groups) >= 2 AND max(n) >= 3 AND sum(n) >= 4),
x AS (SELECT i.table_id, island, min(x0) AS a, max(x1) AS b FROM i JOIN g USING (table_id, r) JOIN b ON b.table_id = i.table_id AND groups = modal GROUP BY 1, 2),
y AS (SELECT *, lag(b) OVER (PARTITION BY table_id ORDER BY island) AS before FROM x),
e AS (SELECT table_id, bool_or(coalesce(a <= before, false)) AS bad, count(*) + 1 AS n, round(sum(round(coalesce((before + a) / 2, a - 2), 2)) + round(max(b) + 2, 2), 2) AS total FROM y GROUP BY table_id)
SELECT table_id, n, total FROM e WHERE NOT bad""")
def body_columns(spark, sf_dir):
    words, bands = ink(spark, sf_dir)
    words = words.where((F.col("x0") < 420) | (F.col("ord") % 8 > 5))
    e = D.body_edges(words, bands)
    return e.select("table_id", F.size("edges").cast("long").alias("n"), F.round(F.aggregate("edges", F.lit(0.0), lambda a, x: a + x), 2).alias("total"))


@query("""
WITH l AS (SELECT l_suppkey::VARCHAR AS table_id, l_linenumber AS c, count(*) AS n, round(least(160.0, sum(l_quantity % 4 * 10)), 2) AS len FROM lineitem GROUP BY 1, 2),
k AS (SELECT * FROM l WHERE len > 0 AND len >= 0.30 * 160)
SELECT table_id, list_sort(list((c * 60)::DOUBLE)) AS edges FROM k GROUP BY table_id HAVING count(*) >= 3""")
def drawn_columns(spark, sf_dir):
    words, bands = ink(spark, sf_dir)
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("table_id"), "l_linenumber").agg(F.least(F.lit(160.0), F.sum(F.col("l_quantity") % 4 * 10).cast("double")).alias("len"))
    rules = li.select("table_id", F.lit(1).alias("page"), F.lit("v").alias("orient"), (F.col("l_linenumber") * 60.0).alias("pos"), F.lit(0.0).alias("lo"), F.col("len").alias("hi"))
    return D.drawn_edges(rules, bands).select("table_id", "edges")


# A caption for each order, grids below it and on the pages after.
@query("""
WITH o AS (SELECT 'd' || (o_custkey % 3) AS doc_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey % 3 ORDER BY o_orderkey) - 1 AS n, o_custkey % 4 AS more, o_totalprice > 100000 AS far FROM orders),
q AS (SELECT doc_id || '.' || (n // 87120) AS doc_id, n % 87120 AS n, more, far FROM o),
h AS (SELECT doc_id, n, (110 + n // 99) || '-' || (n % 99 + 1) AS id, 20 + n * 6 AS page, more, far FROM q),
p AS (SELECT *, unnest(range(0, more + 1)) AS j FROM h)
SELECT doc_id, id, (page + j)::INTEGER AS page, CASE WHEN j = 0 THEN 400.0 ELSE 30.0 END AS y0, CASE WHEN j < more OR far THEN 770.0 ELSE 500.0 END AS y1 FROM p""")
def table_regions(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("doc", F.col("o_custkey") % 3)
    n = F.row_number().over(Window.partitionBy("doc").orderBy("o_orderkey")) - 1
    # after 880 articles of 99 tables a further document begins
    o = o.withColumn("n", n).withColumn("more_docs", F.floor(F.col("n") / 87120)).withColumn("n", F.col("n") % 87120)
    doc, page = F.concat(F.lit("d"), F.col("doc").cast("string"), F.lit("."), F.col("more_docs").cast("string")), (F.lit(20) + F.col("n") * 6).cast("int")
    text = F.concat(F.lit("Tabla "), (F.lit(110) + F.floor(F.col("n") / 99)).cast("string"), F.lit("-"), (F.col("n") % 99 + 1).cast("string"), F.lit(".- Titulo"))
    lines = o.select(doc.alias("doc_id"), page.alias("page"), F.lit(400.0).alias("y"), text.alias("text"))
    heads = D.captions(lines, L.CAPTION_TITLE)
    more = (F.col("o_custkey") % 4).cast("int")
    j = o.select(doc.alias("doc_id"), page.alias("p"), more.alias("more"), (F.col("o_totalprice") > 100000).alias("far"), F.explode(F.sequence(F.lit(0), more)).alias("j"))
    low = F.when((F.col("j") < F.col("more")) | F.col("far"), 770.0).otherwise(500.0)
    bands = j.select("doc_id", (F.col("p") + F.col("j")).alias("page"), F.when(F.col("j") == 0, 410.0).otherwise(30.0).alias("y0"), low.alias("y1"))
    pages = D.table_pages(bands, heads, 792.0)
    none = spark.createDataFrame([], "doc_id string, id string, note long, text string, bottom double")
    return D.regions(pages, heads, none).select("doc_id", "id", "page", "y0", "y1")


@query("""
WITH c AS (SELECT l_orderkey AS id, l_linenumber - 1 AS k, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS i FROM lineitem),
n AS (SELECT id, count(*) AS rows FROM c GROUP BY id),
s AS (SELECT c.id, i, CASE WHEN i % 2 = 0 THEN 0 ELSE 1 END AS col, l_partkey::VARCHAR AS t, rows FROM c JOIN n ON c.id = n.id)
SELECT id, i AS row, 0 AS ord, col::INTEGER AS col, t, 3::INTEGER AS covered FROM s
UNION ALL SELECT id, i, 1, CASE WHEN i % 2 = 0 THEN 1 ELSE 2 END, 'b', 3 FROM s""")
def row_span_layout(spark, sf_dir):
    """Every other row starts with a cell of two rows; the row after it has two cells beside it."""
    li = table(spark, sf_dir, "lineitem")
    cells = li.groupBy(F.col("l_orderkey").cast("string").alias("id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("c"))
    cell = lambda t, cs, rs: F.struct(t.alias("t"), cs.alias("cs"), rs.alias("rs"))
    even = lambda i: i % 2 == 0
    row = lambda x, i: F.array(cell(x["l_partkey"].cast("string"), F.lit(1), F.when(even(i), 2).otherwise(1)), cell(F.lit("b"), F.when(even(i), 2).otherwise(1), F.lit(1)))
    t = cells.select("id", F.lit(3).alias("cols"), F.transform("c", row).alias("rows"))
    return D.cell_positions(t).select(F.col("id").cast("long").alias("id"), F.col("row").cast("long").alias("row"), "ord", "col", "t", "covered")


@query("""
WITH c AS (SELECT l_orderkey AS id, list(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS p, count(*) AS n FROM lineitem GROUP BY l_orderkey)
SELECT id, 2::INTEGER AS cols, CASE WHEN id % 3 = 0 THEN 'una frase que presenta la tabla entera' ELSE '' END AS intro, 1::INTEGER AS header_rows, n AS body, '*Ver ' || id AS note, 1.0::DOUBLE AS quality FROM c""")
def finished_tables(spark, sf_dir):
    """Rows of an order: maybe a sentence over all columns, titles, its parts with an empty column between, the last one short, and a note."""
    li = table(spark, sf_dir, "lineitem")
    c = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("c"))
    cell = lambda t, cs=1: F.struct(t.cast("string").alias("t"), F.lit(cs).alias("cs"), F.lit(1).alias("rs"))
    empty = cell(F.lit(""))
    lead = F.when(F.col("l_orderkey") % 3 == 0, F.array(F.array(cell(F.lit("una frase que presenta la tabla entera"), 2)))).otherwise(F.array().cast(f"array<array<{D.CELL}>>"))
    wide = F.col("l_orderkey") % 3 == 0
    titles = F.when(wide, F.array(cell(F.lit("60 °C")), cell(F.lit("Valor")))).otherwise(F.array(cell(F.lit("60 °C")), empty, cell(F.lit("Valor"))))
    body = F.transform("c", lambda x: F.when(wide, F.array(cell(x["l_partkey"]), cell(F.lit("a b")))).otherwise(F.array(cell(x["l_partkey"]), empty, cell(F.lit("a b")))))
    note = F.array(cell(F.concat(F.lit("*Ver "), F.col("l_orderkey").cast("string"))))
    pages = c.select(F.col("l_orderkey").cast("string").alias("table_id"), F.lit(1).alias("page"), F.concat(lead, F.array(titles), body, F.array(note)).alias("rows"))
    info = c.select(F.col("l_orderkey").cast("string").alias("id"), F.lit("t").alias("title"), F.lit(1).alias("article"))
    t = D.assemble(pages, info)
    return t.select(F.col("id").cast("long").alias("id"), "cols", "intro", "header_rows", (F.size("rows") - F.col("header_rows")).cast("long").alias("body"), F.col("notes")[0].alias("note"), "quality")


@query(f"""
WITH {UNION}, w AS (SELECT id, unnest(regexp_extract_all(lower(strip_accents(text)), '[\\p{{L}}\\p{{N}}_]+')) AS term FROM d),
n AS (SELECT count(*) AS docs FROM d), l AS (SELECT d.id, coalesce(c, 0) AS len FROM d LEFT JOIN (SELECT id, count(*) AS c FROM w GROUP BY id) x ON d.id = x.id), k AS (SELECT avg(len) AS mean FROM l),
v AS (SELECT DISTINCT term FROM w),
q AS (SELECT term, sum(weight) AS weight FROM (
  SELECT term, q, CASE WHEN term = q THEN 1.0 WHEN starts_with(term, q) THEN 0.9 * length(q) / length(term) WHEN round(length(q) * 0.15) > 0 AND levenshtein(term, q) <= round(length(q) * 0.15) THEN 0.45 END AS weight
  FROM v, (SELECT unnest(['ander', 'tion']) AS q)) WHERE weight IS NOT NULL GROUP BY term),
t AS (SELECT w.id, w.term, any_value(weight) AS weight, count(*) AS tf FROM w JOIN q ON w.term = q.term GROUP BY w.id, w.term),
f AS (SELECT term, count(*) AS df FROM t GROUP BY term)
SELECT t.id, round(sum(weight * ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / mean))), 6) AS score FROM t JOIN f ON t.term = f.term JOIN l ON t.id = l.id, n, k GROUP BY t.id""")
def prefix_and_fuzzy_search(spark, sf_dir):
    return S.bm25(every_text(spark, sf_dir), "ander tion", {"text": 1.0}, prefix=True, fuzzy=S.FUZZY).select("id", F.round("score", 6).alias("score"))


# Lines of every class, with what each must be.
CLASSES = [
    ("ARTÍCULO 310", "article"), ("Figura 310-2.- Zanja", "figure_caption"), ("Tabla 310-15(b)(16).- Ampacidades", "table_caption"), ("310-2. Definiciones", "section"), ("B. Instalación", "part"),
    ("NOTA 2: Véase", "note"), ("Excepción a (b): No se exige", "exception"), ("a) Cobre", "alpha"), ("(12) Aluminio", "paren"), ("3) Otros", "num"), ("c. Último", "letter"), ("una línea de texto", "text"), ("Tabla 1 del Capítulo 10", "text"),
]


@query(f"""
WITH c(k, cls) AS (VALUES {", ".join(f"({k}, '{cls}')" for k, (_, cls) in enumerate(CLASSES))}) SELECT o_orderkey, cls FROM orders JOIN c ON o_orderkey % 13 = k""")
def line_class_hits(spark, sf_dir):
    made = F.get(F.array(*[F.lit(line) for line, _ in CLASSES]), (F.col("o_orderkey") % 13).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", L.line_class(made).alias("cls"))


@query("""
SELECT o_orderkey, o_orderkey % 6 = 5 AS kept, CASE WHEN o_orderkey % 6 = 5 THEN 'a 60 °C y Φ' || o_custkey END AS text FROM orders""")
def furniture_hits(spark, sf_dir):
    """Lines that every page repeats, and a text with broken glyphs."""
    k, cust = F.col("o_orderkey") % 6, F.col("o_custkey").cast("string")
    line = F.when(k == 0, "SENER").when(k == 1, "31/12/2012").when(k == 2, "12/780").when(k == 3, F.concat(F.lit("www.dof.gob.mx/"), cust)).when(k == 4, "  SENER ").otherwise(F.concat(F.lit("a 60 ೦C y Ф"), cust))
    lines = table(spark, sf_dir, "orders").select("o_orderkey", line.alias("line"))
    kept = L.without_furniture(lines, "line").select(F.col("o_orderkey").alias("k"), X.fix_glyphs(F.col("line")).alias("text"))
    return lines.join(kept, F.col("o_orderkey") == F.col("k"), "left").select("o_orderkey", F.col("k").isNotNull().alias("kept"), "text")


@query("""
WITH l AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN (o_custkey % 50) || ' ' || (o_custkey % 7) WHEN o_orderkey % 3 = 1 THEN 'texto' ELSE '' END AS t, o_custkey % 9 AS c FROM orders),
p AS (SELECT *, o_orderkey % 3 = 0 AS merged FROM l)
SELECT c::VARCHAR AS table_id, CASE WHEN avg(CASE WHEN t <> '' THEN merged::INTEGER END) <= 0.02 + 0.5 THEN 'rejilla' ELSE 'huecos' END AS grid FROM p GROUP BY c""")
def chosen_models(spark, sf_dir):
    """The drawn grid of one score for each table, against gaps of score 0.5 with a slack of 0.02."""
    k = F.col("o_orderkey") % 3
    t = F.when(k == 0, F.concat_ws(" ", (F.col("o_custkey") % 50).cast("string"), (F.col("o_custkey") % 7).cast("string"))).when(k == 1, "texto").otherwise("")
    cells = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 9).cast("string").alias("table_id"), t.alias("t"))
    scores = D.grid_score(cells, ["table_id"]).withColumnRenamed("score", "grid_score").withColumn("gap_score", F.lit(0.5))
    return D.choose_model(scores).select("table_id", "grid")
