"""Line streams, folding, classes, order-dependent acceptance, slugs."""

from pyspark.sql import functions as F

from foliograph.functions import text as X
from foliograph.operators import lines as L
from foliograph.operators import quality as Q
from foliograph.operators import tree as T
from foliograph.operators import views as V
from foliograph.plans.registry import query, table

LINES = """
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw,
             generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
lines AS (SELECT doc_id, line_no, trim(raw, ' ') AS text FROM l WHERE length(trim(raw, ' ')) > 0)"""


def document_lines(spark, sf_dir):
    return L.split_lines(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"WITH {LINES} SELECT doc_id, count(*) AS n_lines, max(line_no) AS last_line, sum(length(text))::BIGINT AS chars FROM lines GROUP BY doc_id")
def lines_exploded(spark, sf_dir):
    return document_lines(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.max("line_no").alias("last_line"), F.sum(F.char_length("text")).alias("chars"))


@query(
    f"WITH {LINES} SELECT doc_id, count(*) AS kept FROM lines WHERE NOT regexp_matches(text, '^[ \\t]*(?:\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}|SENER|www\\.dof\\.gob\\.mx\\S*|\\d+/780)[ \\t]*$') GROUP BY doc_id"
)
def furniture_filtered(spark, sf_dir):
    return L.without_furniture(document_lines(spark, sf_dir)).groupBy("doc_id").agg(F.count("*").alias("kept"))


@query(
    "SELECT doc_id, md5(trim(regexp_replace(strip_accents(translate(text, '೦Ф', '°Φ')), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'))) AS folded, length(text) AS chars FROM documents"
)
def glyph_and_accent_fold(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(X.collapse(X.unaccent(X.fix_glyphs(F.col("text"))))).alias("folded"), F.char_length("text").cast("long").alias("chars"))


@query(f"""
WITH {LINES}, u AS (SELECT doc_id, strip_accents(trim(text)) AS u FROM lines),
c AS (SELECT doc_id, CASE
  WHEN regexp_matches(u, '^ARTICULO\\s+(\\d{{3}})\\s*$') THEN 'article'
  WHEN regexp_matches(u, '^Figura\\s+\\d{{3}}-\\d{{1,3}}\\s*[.\\-]') THEN 'figure_caption'
  WHEN length(u) <= 260 AND regexp_matches(u, '^Tabla\\s+(\\d{{3}}-\\d{{1,3}}(?:\\s*\\([a-z0-9]{{1,4}}\\))*|\\d{{1,2}}[A-Z]?(?:\\([A-Z]\\))?)\\s*(?:\\.-|\\.|-|—)?\\s+([0-9A-Z].*)$') THEN 'table_caption'
  WHEN regexp_matches(u, '^(\\d{{3}})-(\\d{{1,3}})(?:\\.-\\s*|\\.\\s*|\\s+)([0-9A-Z].*)$') THEN 'section'
  WHEN length(u) < 120 AND regexp_matches(u, '^([A-M])\\.\\s+([0-9A-Z].{{0,110}})$') THEN 'part'
  WHEN regexp_matches(u, '^(NOTA[^:]{{0,40}}):\\s*(.*)$') THEN 'note'
  WHEN regexp_matches(u, '^(Excepcion[^:]{{0,60}}):\\s*(.*)$') THEN 'exception'
  WHEN regexp_matches(u, '^([a-z])\\)\\s+(.*)$') THEN 'alpha'
  WHEN regexp_matches(u, '^\\((\\d{{1,2}})\\)\\s+(.*)$') THEN 'paren'
  WHEN regexp_matches(u, '^(\\d{{1,2}})\\)\\s+(.*)$') THEN 'num'
  WHEN regexp_matches(u, '^([a-z])\\.\\s+(.*)$') THEN 'letter'
  ELSE 'text' END AS cls FROM u)
SELECT doc_id, cls, count(*) AS n FROM c GROUP BY doc_id, cls""")
def line_classes(spark, sf_dir):
    return document_lines(spark, sf_dir).groupBy("doc_id", L.line_class(F.col("text")).alias("cls")).agg(F.count("*").alias("n"))


@query("""
WITH o AS (SELECT *, max(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_partkey, l_suppkey, l_linenumber
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM lineitem)
SELECT l_orderkey, count(*) FILTER (WHERE l_linenumber > coalesce(before, 0)) AS accepted, count(*) AS seen FROM o GROUP BY l_orderkey""")
def monotonic_accept(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey", "l_suppkey")
    out = L.accept_increasing(li, ["l_orderkey"], ["l_extendedprice", "l_partkey", "l_suppkey", "l_linenumber"], "l_linenumber")
    return out.groupBy("l_orderkey").agg(F.count_if("accepted").alias("accepted"), F.count("*").alias("seen"))


@query("""
SELECT conv_id, turn AS lo, coalesce(lead(turn) OVER (PARTITION BY conv_id ORDER BY turn), 1000000) AS hi FROM conversations""")
def extents_by_lead(spark, sf_dir):
    return L.extents(table(spark, sf_dir, "conversations").select("conv_id", "turn"), ["conv_id"], "turn", F.lit(1_000_000)).select("conv_id", "lo", "hi")


@query("""
SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS asked FROM conversations""")
def carried_forward(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", F.col("turn")).alias("user_turn"))
    return L.carry(c, ["conv_id"], ["turn"], "user_turn", "asked").select("conv_id", "turn", "asked")


@query("""
SELECT c_custkey, r_name || '(' || n_nationkey || ')' || chr(97 + CAST(c_custkey % 26 AS INTEGER)) || '.' AS id, r_name || '(' || n_nationkey || ')' AS parent_id,
       ascii(chr(97 + CAST(c_custkey % 26 AS INTEGER))) AS rank
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def canonical_ids(spark, sf_dir):
    r, n, c = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    kind_n, kind_c = F.lit("paren"), F.lit("letter")
    j = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    parent = X.canonical_id(F.col("r_name"), kind_n, F.col("n_nationkey").cast("string"))
    label = F.char(F.lit(97) + F.col("c_custkey") % 26)
    return j.select("c_custkey", X.canonical_id(parent, kind_c, label).alias("id"), parent.alias("parent_id"), X.marker_rank(kind_c, label).alias("rank"))


@query("""
WITH RECURSIVE e AS (
  SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer
  UNION ALL SELECT 'r' || r_regionkey, 'world' FROM region),
a AS (SELECT child, parent AS ancestor, 1 AS distance FROM e UNION ALL SELECT a.child, e.parent, a.distance + 1 FROM a JOIN e ON a.ancestor = e.child)
SELECT ancestor, distance, count(*) AS descendants FROM a GROUP BY ancestor, distance""")
def ancestor_counts(spark, sf_dir):
    edge = lambda t, a, b, pa, pb: table(spark, sf_dir, t).select(F.concat(F.lit(a), F.col(pa).cast("string")).alias("child"), F.concat(F.lit(b), F.col(pb).cast("string")).alias("parent"))
    world = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("child"), F.lit("world").alias("parent"))
    e = edge("nation", "n", "r", "n_nationkey", "n_regionkey").unionByName(edge("customer", "c", "n", "c_custkey", "c_nationkey")).unionByName(world)
    return T.ancestors(e, "child", "parent", depth=4).groupBy("ancestor", "distance").agg(F.count("*").alias("descendants"))


@query("""
SELECT conv_id, md5(trim(regexp_replace(string_agg(text, ' ' ORDER BY turn), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'))) AS whole, count(*) AS turns FROM conversations GROUP BY conv_id""")
def ordered_text_concat(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    n = c.groupBy("conv_id").agg(F.count("*").alias("turns"))
    return L.ordered_text(c, ["conv_id"], "turn", "text").select("conv_id", F.md5("text").alias("whole")).join(n, "conv_id")


@query("SELECT text, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text")
def keep_first(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    n = d.groupBy("text").agg(F.count("*").alias("copies"))
    return L.keep_first(d, ["text"], ["doc_id"]).join(n, "text").select("text", "doc_id", "copies")


@query("""
WITH t AS (SELECT conv_id, turn, role, CASE WHEN role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 1 ELSE 0 END AS c FROM conversations)
SELECT conv_id, turn, role, (sum(c) OVER (PARTITION BY conv_id ORDER BY turn))::BIGINT AS run FROM t""")
def contiguous_groups(spark, sf_dir):
    return V.contiguous_groups(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id"], ["turn"], "role")


@query("""
SELECT o_custkey, o_orderkey, lag(o_orderkey) OVER w AS previous, lead(o_orderkey) OVER w AS next FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def prev_next(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return V.prev_next(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderkey").drop("o_orderdate")


@query("""
SELECT p_partkey, regexp_replace(regexp_replace(lower(strip_accents(p_name || ' ' || p_type)), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug,
  'tabla-' || regexp_replace(regexp_replace(p_brand || '(' || p_size || ')', '[^A-Za-z0-9_-]+', '-', 'g'), '-+$', '') AS table_slug,
  regexp_replace(lower(strip_accents(p_brand || '-' || p_size)), '[^a-z0-9]', '', 'g') AS code,
  CASE WHEN length(p_name || p_type) > 14 THEN rtrim(left(p_name || p_type, 13), ' ') || '…' ELSE p_name || p_type END AS short
FROM part""")
def slugify(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    size = F.col("p_size").cast("string")
    return p.select("p_partkey", X.term_slug(F.concat_ws(" ", "p_name", "p_type")).alias("slug"), X.table_slug(F.concat("p_brand", F.lit("("), size, F.lit(")"))).alias("table_slug"), X.norm_code(F.concat_ws("-", "p_brand", size)).alias("code"), X.truncate(F.concat("p_name", "p_type"), 14).alias("short"))


@query("""
SELECT doc_id, md5(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) AS escaped FROM documents""")
def html_escaped(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.escape_html(F.col("text"))).alias("escaped"))


WORDS = "regexp_extract_all(lower(strip_accents({0})), '[\\p{{L}}\\p{{N}}_]+')"


@query(f"""
WITH {LINES},
v AS (SELECT DISTINCT unnest({WORDS.format('text')}) AS term FROM benchmark),
w AS (SELECT doc_id, line_no, unnest({WORDS.format('text')}) AS term FROM lines WHERE length(trim(text, ' ')) >= 25),
s AS (SELECT w.doc_id, w.line_no, count(*) AS words, count(v.term) AS found FROM w LEFT JOIN v ON w.term = v.term GROUP BY w.doc_id, w.line_no)
SELECT doc_id, count(*) AS lines, count(*) FILTER (WHERE found >= 0.6 * words) AS covered, sum(words)::BIGINT AS words, sum(found)::BIGINT AS found FROM s GROUP BY doc_id""")
def coverage_ratio(spark, sf_dir):
    lines = document_lines(spark, sf_dir).withColumn("all", F.lit(1))
    vocabulary = Q.vocabulary((table(spark, sf_dir, "benchmark").withColumn("all", F.lit(1)), ["all"], "text"))
    covered = Q.coverage(lines, vocabulary, ["all"], ["all", "doc_id", "line_no"])
    return covered.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if("covered").alias("covered"), F.sum("words").alias("words"), F.sum("found").alias("found"))


@query(f"""
WITH v AS (SELECT DISTINCT unnest({WORDS.format('text')}) AS term FROM benchmark),
w AS (SELECT unnest({WORDS.format('text')}) AS term FROM documents)
SELECT v.term AS term, count(w.term) AS uses FROM v LEFT JOIN w ON v.term = w.term GROUP BY v.term""")
def term_usage(spark, sf_dir):
    terms = Q.vocabulary((table(spark, sf_dir, "benchmark").withColumn("all", F.lit(1)), ["all"], "text")).select("term")
    used = table(spark, sf_dir, "documents").select(F.explode(X.tokens(F.col("text"))).alias("t")).groupBy("t").agg(F.count("*").alias("n"))
    return terms.join(used, F.col("term") == F.col("t"), "left").select("term", F.coalesce("n", F.lit(0)).alias("uses"))


@query("""
SELECT l_suppkey, list_sort(list(l_quantity))[1] AS low, list_sort(list(l_quantity))[count(*) // 2 + 1] AS middle, max(l_quantity) AS high FROM lineitem GROUP BY l_suppkey""")
def upper_median(spark, sf_dir):
    return Q.upper_median(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_quantity")


@query("""
WITH q AS (SELECT count(*) FILTER (WHERE text IS NULL) AS a, count(*) - count(DISTINCT doc_id) AS b, count(*) AS c FROM documents),
o AS (SELECT count(*) AS d FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)),
s AS (SELECT count(*) AS e FROM (SELECT turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations) WHERE turn <= p)
SELECT 'documents' AS "check", c::DOUBLE AS value, 200.0::DOUBLE AS bound, c >= 200 AS ok FROM q
UNION ALL SELECT 'null texts', a::DOUBLE, 0.0, a <= 0 FROM q
UNION ALL SELECT 'repeated ids', b::DOUBLE, 0.0, b <= 0 FROM q
UNION ALL SELECT 'labels without document', d::DOUBLE, 0.0, d <= 0 FROM o
UNION ALL SELECT 'turns out of order', e::DOUBLE, 0.0, e <= 0 FROM s""")
def gate_report(spark, sf_dir):
    """Each table is read once: what concerns documents and labels comes from one tally of their ids."""
    docs, labels, conv = (table(spark, sf_dir, t) for t in ("documents", "labels", "conversations"))
    one = F.lit(1)
    ids = Q.tallied((docs, F.col("doc_id"), {"docs": one, "null_texts": F.col("text").isNull()}), (labels, F.col("doc_id"), {"labels": one}))
    repeated = F.sum("docs") - F.count_if((F.col("docs") > 0) & F.col("_key").isNotNull())
    return Q.report(
        Q.key_measures(
            ids,
            Q.Measure("documents", F.sum("docs"), floor=200),
            Q.Measure("null texts", F.sum("null_texts")),
            Q.Measure("repeated ids", repeated),
            Q.Measure("labels without document", F.sum(F.when((F.col("docs") == 0) | F.col("_key").isNull(), F.col("labels")))),
        ),
        Q.none_of("turns out of order", Q.out_of_order(conv, ["conv_id"], ["turn"], "turn")),
    )


@query("SELECT text, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return Q.duplicates(table(spark, sf_dir, "documents"), "text")


@query("""
SELECT 'http://x/art/' || (doc_id % 900 + 100) || '#' || doc_id AS sec_url, '/glosario/#' || regexp_replace(regexp_replace(lower(strip_accents(lang || ' ' || source)), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS def_url, doc_id FROM documents""")
def result_urls(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    art = F.col("doc_id") % 900 + 100
    sid = F.col("doc_id").cast("string")
    return d.select(X.result_url(F.lit("sec"), sid, sid, art, "http://x").alias("sec_url"), X.result_url(F.lit("def"), F.concat_ws(" ", "lang", "source"), sid, art).alias("def_url"), "doc_id")
