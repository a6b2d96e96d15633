"""Links, backlinks, roll-up, resolution and broken targets."""

from pyspark.sql import functions as F

from foliograph.operators import graph as G
from foliograph.operators import refs as R
from foliograph.plans.registry import query, table
from foliograph.sources.scratch import scratch_folder
from foliograph.streaming import citations as C

HREF = r'href="([^"]*)"'
EDGES = """
e AS (SELECT DISTINCT url AS src, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS dst FROM pages),
edges AS (SELECT src, dst, CASE WHEN starts_with(dst, '/') THEN 'local' WHEN starts_with(dst, '#') THEN 'anchor' ELSE 'absolute' END AS type FROM e WHERE src <> dst)"""


def typed_links(pages):
    found = R.mentions(pages, HREF, "dst", id_="url", text="html")
    kind = F.when(F.col("dst").startswith("/"), "local").when(F.col("dst").startswith("#"), "anchor").otherwise("absolute")
    return found.withColumn("type", kind)


def page_edges(spark, sf_dir):
    return R.clean(typed_links(table(spark, sf_dir, "pages")))


@query(f"WITH {EDGES} SELECT * FROM edges")
def link_edges(spark, sf_dir):
    return page_edges(spark, sf_dir)


@query(f"WITH {EDGES} SELECT dst AS id, count(DISTINCT src) AS citations FROM edges GROUP BY dst ORDER BY citations DESC, id LIMIT 30")
def backlinks(spark, sf_dir):
    return G.top_cited(page_edges(spark, sf_dir))


@query(f"""
WITH {EDGES}, t AS (SELECT dst AS id, count(DISTINCT src) AS citations FROM edges GROUP BY dst ORDER BY citations DESC, id LIMIT 30)
SELECT id, citations, row_number() OVER (ORDER BY citations DESC, id) AS rank, citations / max(citations) OVER () AS share FROM t""")
def rank_share(spark, sf_dir):
    return G.ranked_share(G.top_cited(page_edges(spark, sf_dir)))


@query(f"WITH {EDGES} SELECT dst AS id, list_sort(list(DISTINCT src)) AS sources FROM edges GROUP BY dst")
def incoming_adjacency(spark, sf_dir):
    return G.incoming(page_edges(spark, sf_dir))


@query(f"WITH {EDGES} SELECT src AS id, list_sort(list(DISTINCT dst)) AS targets FROM edges GROUP BY src")
def outgoing_adjacency(spark, sf_dir):
    return G.outgoing(page_edges(spark, sf_dir))


@query(f"WITH {EDGES} SELECT split_part(dst, ',', 1) AS id, list_sort(list(DISTINCT src)) AS sources FROM edges GROUP BY 1")
def backlinks_rollup(spark, sf_dir):
    return G.rollup(page_edges(spark, sf_dir), ",")


@query(f"WITH {EDGES} SELECT DISTINCT split_part(dst, ',', 1) AS id, src FROM edges")
def published_rollup(spark, sf_dir):
    """The sources in all chunks of a published roll-up, the chunks of hot targets small enough here that there are many."""
    return G.rollup(page_edges(spark, sf_dir), ",", most=50).select("id", F.explode("sources").alias("src"))


@query(f"WITH {EDGES} SELECT type, count(*) AS edges FROM edges GROUP BY type")
def edges_by_type(spark, sf_dir):
    return G.by_type(page_edges(spark, sf_dir))


@query(f"WITH {EDGES} SELECT count(*) AS edges, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets FROM edges")
def graph_summary(spark, sf_dir):
    return G.summary(page_edges(spark, sf_dir))


@query("""
WITH p AS (SELECT page_id, url AS ref, regexp_replace(url, '[?#].*$', '') AS base, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages),
plain AS (SELECT DISTINCT url AS k FROM pages WHERE NOT regexp_matches(url, '[?#]')),
hosts AS (SELECT DISTINCT host AS k FROM p WHERE starts_with(host, 'www.'))
SELECT p.page_id, coalesce(a.k, b.k, h.k) AS target FROM p LEFT JOIN plain a ON p.ref = a.k LEFT JOIN plain b ON p.base = b.k LEFT JOIN hosts h ON p.host = h.k""")
def resolve_most_specific(spark, sf_dir):
    url = F.col("url")
    p = table(spark, sf_dir, "pages").select("page_id", url.alias("ref"), F.regexp_replace(url, "[?#].*$", "").alias("base"), F.regexp_extract(url, "^https?://([^/?#]+)", 1).alias("host"))
    plain = p.where(~F.rlike("ref", F.lit("[?#]"))).select(F.col("ref").alias("k"))
    hosts = p.where(F.col("host").startswith("www.")).select(F.col("host").alias("k"))
    return R.most_specific(p, ("ref", plain, "k"), ("base", plain, "k"), ("host", hosts, "k")).select("page_id", "target")


@query("SELECT d.doc_id FROM documents d ANTI JOIN labels l ON d.doc_id = l.doc_id")
def dangling_targets(spark, sf_dir):
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    edges = d.select(F.col("source").alias("src"), F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("dst"))
    return G.dangling(edges, "doc", labels, "doc_id").select(F.substring("dst", 5, 30).cast("long").alias("doc_id"))


@query(f"""
WITH {EDGES}, t AS (SELECT dst AS id, count(DISTINCT src) AS citations FROM edges GROUP BY dst ORDER BY citations DESC, id LIMIT 30)
SELECT t.id, citations, coalesce(p_name, '') AS title, p_size AS article FROM t LEFT JOIN (SELECT '/' || split_part(p_name, ' ', 1) AS k, min(p_name) AS p_name, min(p_size) AS p_size FROM part GROUP BY 1) p ON t.id = p.k""")
def described_ranking(spark, sf_dir):
    first = F.concat(F.lit("/"), F.split_part("p_name", F.lit(" "), F.lit(1)))
    index = table(spark, sf_dir, "part").groupBy(first.alias("id")).agg(F.min("p_name").alias("title"), F.min("p_size").alias("article"))
    return G.described(G.top_cited(page_edges(spark, sf_dir)), index)


@query(f"WITH {EDGES} SELECT dst AS id, count(DISTINCT src) AS citations, count(*) AS edges FROM edges GROUP BY dst")
def citations_in_batches(spark, sf_dir):
    """The counts of all link targets, after the pages have come in three batches, the second of them twice."""
    pages, target = table(spark, sf_dir, "pages"), scratch_folder(spark)
    for batch in (0, 1, 1, 2):
        C.merge_batch(typed_links(pages.where(F.pmod(F.xxhash64("page_id"), F.lit(3)) == batch)), target, batch)
    return C.counts(spark, target)
