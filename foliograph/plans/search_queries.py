"""Search documents, codes, BM25, grouping and snippets."""

from pyspark.sql import functions as F

from foliograph.functions import text as X
from foliograph.operators import retrieval as R
from foliograph.operators import search as S
from foliograph.plans.registry import query, table
from foliograph.sources.scratch import scratch_folder, written

UNION = """
d AS (SELECT 'doc:' || doc_id AS id, 'sec' AS kind, text FROM documents
  UNION ALL SELECT 'item:' || item_id, 'def', text FROM benchmark
  UNION ALL SELECT 'turn:' || conv_id || ':' || turn, 'tabla', text FROM conversations)"""


def every_text(spark, sf_dir):
    s = lambda c: F.col(c).cast("string")
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc:"), s("doc_id")).alias("id"), F.lit("sec").alias("kind"), "text")
    b = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("item:"), s("item_id")).alias("id"), F.lit("def").alias("kind"), "text")
    c = table(spark, sf_dir, "conversations").select(F.concat_ws(":", F.lit("turn"), s("conv_id"), s("turn")).alias("id"), F.lit("tabla").alias("kind"), "text")
    return d.unionByName(b).unionByName(c)


@query(f"WITH {UNION} SELECT id, kind, length(text) AS chars FROM d")
def union_documents(spark, sf_dir):
    return S.unique_ids(every_text(spark, sf_dir)).select("id", "kind", F.char_length("text").cast("long").alias("chars"))


@query("""
WITH c AS (SELECT c_name AS id, regexp_replace(lower(strip_accents(c_name)), '[^a-z0-9]', '', 'g') AS cn FROM customer), q AS (SELECT 'customer00000001234' AS qn)
SELECT id, 'sec' AS kind, CASE WHEN cn = qn THEN 1e6 ELSE 1e6 - 200 - (length(qn) - length(cn)) END AS score FROM c, q
WHERE length(cn) >= 4 AND (cn = qn OR (starts_with(qn, cn) AND length(qn) - length(cn) BETWEEN 1 AND 3)) ORDER BY score DESC, id LIMIT 10""")
def code_lookup(spark, sf_dir):
    docs = table(spark, sf_dir, "customer").select(F.col("c_name").alias("id"), F.lit("sec").alias("kind"))
    return S.code_matches(docs, "Customer 000000012-34")


BM25 = """
w AS (SELECT id, unnest(regexp_extract_all(lower(strip_accents(text)), '[\\p{L}\\p{N}_]+')) AS term FROM d),
n AS (SELECT count(*) AS docs FROM d), l AS (SELECT d.id, coalesce(c, 0) AS len FROM d LEFT JOIN (SELECT id, count(*) AS c FROM w GROUP BY id) x ON d.id = x.id), m AS (SELECT avg(len) AS mean FROM l),
t AS (SELECT id, term, count(*) AS tf FROM w WHERE term IN ('the', 'que', 'ander') GROUP BY id, term),
f AS (SELECT term, count(*) AS df FROM t GROUP BY term),
s AS (SELECT t.id, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / mean))) AS score FROM t JOIN f ON t.term = f.term JOIN l ON t.id = l.id, n, m GROUP BY t.id)"""


def _ranked(spark, sf_dir):
    return S.bm25(every_text(spark, sf_dir), "the que ander", {"text": 1.0})


@query(f"WITH {UNION}, {BM25} SELECT id, round(score, 6) AS score FROM s")
def bm25_search(spark, sf_dir):
    return _ranked(spark, sf_dir).select("id", F.round("score", 6).alias("score"))


@query(f"""
WITH {UNION}, {BM25}, k AS (SELECT s.id, kind, round(score, 6) AS score FROM s JOIN d ON s.id = d.id),
g AS (SELECT *, max(score) OVER (PARTITION BY kind) AS best, row_number() OVER (PARTITION BY kind ORDER BY score DESC, id) AS rank_in_kind FROM k),
h AS (SELECT kind, row_number() OVER (ORDER BY max(score) DESC, kind) AS group_order FROM k GROUP BY kind)
SELECT g.*, group_order FROM g JOIN h ON g.kind = h.kind""")
def grouped_results(spark, sf_dir):
    scored = _ranked(spark, sf_dir).join(every_text(spark, sf_dir).select("id", "kind"), "id").select("id", "kind", F.round("score", 6).alias("score"))
    return S.grouped(scored)


@query(f"""
WITH {UNION}, {BM25}, k AS (SELECT s.id, kind, round(score, 6) AS score FROM s JOIN d ON s.id = d.id),
a AS (SELECT id, kind, 1e6 AS score FROM d WHERE kind = 'def'),
u AS (SELECT *, 0 AS f FROM a UNION ALL SELECT *, 1 FROM k),
o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY f, score DESC) AS r FROM u)
SELECT id, kind, score FROM o WHERE r = 1 ORDER BY f, score DESC, id LIMIT 25""")
def merged_results(spark, sf_dir):
    texts = every_text(spark, sf_dir)
    first = texts.where("kind = 'def'").select("id", "kind", F.lit(1e6).alias("score"))
    second = _ranked(spark, sf_dir).join(texts.select("id", "kind"), "id").select("id", "kind", F.round("score", 6).alias("score"))
    return S.merged(first, second)


PHRASE, ONE = "d[eèéêëEÈÉÊË]\\s+l[aàáâãAÀÁÂÃ]", "d[eèéêëEÈÉÊË]|l[aàáâãAÀÁÂÃ]"


@query(f"""
WITH p AS (SELECT doc_id, text, CASE WHEN regexp_matches(text, '(?i)({PHRASE})') THEN '(?i)({PHRASE})' WHEN regexp_matches(text, '(?i)({ONE})') THEN '(?i)({ONE})' END AS pat FROM documents),
m AS (SELECT doc_id, text, pat, CASE WHEN pat = '(?i)({PHRASE})' THEN regexp_extract(text, '(?i)({PHRASE})', 1) ELSE regexp_extract(text, '(?i)({ONE})', 1) END AS hit FROM p),
a AS (SELECT *, instr(text, hit) AS pos FROM m),
b AS (SELECT *, greatest(1, pos - 40) AS s, least(length(text), pos - 1 + length(hit) + 90) AS e FROM a),
c AS (SELECT *, replace(replace(replace(replace(substring(text, s, e - s + 1), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS cut FROM b)
SELECT doc_id, CASE WHEN pat IS NULL THEN '' ELSE (CASE WHEN s > 1 THEN '…' ELSE '' END)
  || CASE WHEN pat = '(?i)({PHRASE})' THEN regexp_replace(cut, '(?i)({PHRASE})', '<mark>\\1</mark>', 'g') ELSE regexp_replace(cut, '(?i)({ONE})', '<mark>\\1</mark>', 'g') END
  || (CASE WHEN e < length(text) THEN '…' ELSE '' END) END AS snippet FROM c""")
def snippets(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.snippet(F.col("text"), "de la").alias("snippet"))


RARE = BM25.replace("'the', 'que', 'ander'", "'the', 'ander', 'haonnt', 'ciondeque'")


@query(f"WITH {UNION}, {RARE} SELECT id, round(score, 6) AS score FROM s ORDER BY round(score, 9) DESC, id LIMIT 25")
def block_max_search(spark, sf_dir):
    """The 25 best of all texts, from blocks that can reach them."""
    index = R.write_block_index(every_text(spark, sf_dir), scratch_folder(spark), {"text": 1.0}, fuzzy=False)
    return R.top_k(index, "the ander haonnt ciondeque", 25).select("id", F.round("score", 6).alias("score"))


@query(r"""
WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}_]+')) AS term FROM documents),
w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}_]+')) AS word FROM benchmark),
a AS (SELECT word, CAST(floor(length(word) * 0.15 + 0.5) AS INTEGER) AS most FROM w),
m AS (SELECT word, term, levenshtein(replace(word, 'ß', 'S'), replace(term, 'ß', 'S')) AS d FROM a JOIN t ON most > 0 AND abs(length(word) - length(term)) <= most AND word <> term WHERE levenshtein(replace(word, 'ß', 'S'), replace(term, 'ß', 'S')) <= most)
SELECT word, count(*) AS near, CAST(sum(d) AS BIGINT) AS edits, min(term) AS first FROM m GROUP BY word""")
def fuzzy_dictionary(spark, sf_dir):
    """For every word of the benchmark the terms of the documents that a fuzzy search takes it for."""
    words = lambda t: table(spark, sf_dir, t).select(F.explode(X.tokens(F.col("text"))).alias("term")).distinct()
    filed = written(words("documents").select(F.explode(R.deletion_keys(F.col("term"))).alias("key"), "term"))
    found = R.fuzzy_terms(words("benchmark").withColumnRenamed("term", "word"), filed, S.FUZZY)
    return found.groupBy("word").agg(F.count("*").alias("near"), F.sum(F.col("distance").cast("long")).alias("edits"), F.min("term").alias("first"))
