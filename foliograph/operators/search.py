"""Search: documents, exact codes, ranked terms with prefix and fuzzy expansion, merging and grouping."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliograph.functions.text import collapse, looks_like_code, norm_code, tokens, unaccent

# Field boosts, fuzziness, list sizes and the score of an exact code.
BOOST = {"id": 6.0, "title": 3.0, "text": 1.0}
FUZZY, MAX_RESULTS, MAX_CODES, MIN_QUERY, CODE_SCORE = 0.15, 25, 10, 2, 1e6
K1, B, BUCKETS = 1.2, 0.75, 64
LABELS = {"sec": "Secciones", "tabla": "Tablas", "def": "Definiciones"}


def documents(nodes: DataFrame, annotations: DataFrame, articles: DataFrame, definitions: DataFrame, tables: DataFrame) -> DataFrame:
    """(id, kind, title, art, artTitle, text, incisos, tid, sinNumero): one row for each section, glossary term and table. A section
    holds the text of all below it. Fails if an id repeats."""
    notes = annotations.groupBy(F.col("node_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind", "seq", "text"))), lambda x: x["text"]), " ").alias("notes"))
    whole = nodes.join(notes, "id", "left").withColumn("own", collapse(F.concat_ws(" ", F.when(F.col("parent_id").isNotNull(), F.col("title")), "text", "notes")))
    text = whole.groupBy("root_id").agg(F.array_sort(F.collect_list(F.struct("ord", "id", "parent_id", "own"))).alias("p"))
    below = F.filter("p", lambda x: x["parent_id"].isNotNull())
    text = text.select("root_id", collapse(F.array_join(F.transform("p", lambda x: x["own"]), " ")).alias("text"), F.transform(below, lambda x: x["id"]).alias("incisos"))
    sections = nodes.where("parent_id is null").select("id", F.col("title"), F.col("article").alias("art")).join(text, F.col("id") == F.col("root_id")).join(articles.select(F.col("num").alias("art"), F.col("title").alias("artTitle")), "art", "left")
    s = sections.select("id", F.lit("sec").alias("kind"), "title", "art", "artTitle", "text", "incisos")
    d = definitions.select(F.col("term").alias("id"), F.lit("def").alias("kind"), F.col("term").alias("title"), F.lit(100).alias("art"), F.lit("Definiciones").alias("artTitle"), F.col("definition").alias("text"))
    t = tables.join(articles.select(F.col("num").alias("article"), F.col("title").alias("a_title")), "article", "left")
    t = t.select(F.concat(F.lit("tabla:"), "id").alias("id"), F.lit("tabla").alias("kind"), F.coalesce("title", F.lit("")).alias("title"), F.col("article").alias("art"), F.coalesce("a_title", F.lit("Capítulo 10")).alias("artTitle"), "text", F.col("id").alias("tid"), F.col("sin_numero").alias("sinNumero"))
    return unique_ids(s.unionByName(d, allowMissingColumns=True).unionByName(t, allowMissingColumns=True))


def unique_ids(docs: DataFrame) -> DataFrame:
    """docs, failing at run time on an id that repeats. Only ids are shuffled: the check is a scalar beside the rows."""
    again = docs.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").agg(F.min("id")).scalar()
    fail = F.raise_error(F.concat(F.lit("duplicate search id "), again))
    return docs.withColumn("id", F.when(again.isNotNull(), fail.cast("string")).otherwise(F.col("id")))


def code_matches(docs: DataFrame, query: str, items: DataFrame | None = None) -> DataFrame:
    """(id, kind, score) of exact code hits, ten at most: an item, a section or table with the query's code, and if no item
    has it the sections and tables whose code the query extends by three characters or fewer."""
    qn = norm_code(F.lit(query))
    coded = docs.withColumn("cn", norm_code(F.col("tid") if "tid" in docs.columns else F.col("id")) if "tid" not in docs.columns else norm_code(F.coalesce("tid", "id")))
    coded = coded.where(looks_like_code(qn) & (F.char_length("cn") >= 4))
    exact = coded.where(F.col("cn") == qn).select("id", "kind", F.lit(CODE_SCORE).alias("score"))
    extra = F.char_length(qn) - F.char_length("cn")
    near = coded.where(F.startswith(qn, F.col("cn")) & extra.between(1, 3)).select("id", "kind", (F.lit(CODE_SCORE - 200) - extra).alias("score"))
    if items is not None:
        hit = items.where(looks_like_code(qn) & (norm_code(F.col("id")) == qn)).select("id", F.lit("sec").alias("kind"), F.lit(CODE_SCORE).alias("score"))
        near = near.where(hit.agg(F.count("*")).scalar() == 0)
        exact = exact.unionByName(hit)
    return exact.unionByName(near).orderBy(F.desc("score"), "id").limit(MAX_CODES)


def postings(docs: DataFrame, fields: dict[str, float]) -> tuple[DataFrame, DataFrame]:
    """(id, field, term, tf, len) and (field, docs, mean): an inverted index over folded lower-case terms."""
    parts = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), tokens(F.coalesce(F.col(f).cast("string"), F.lit(""))).alias("terms")) for f in fields])).alias("p")
    split = docs.select(F.col("id").alias("doc"), parts).select("doc", "p.field", "p.terms", F.size("p.terms").alias("len"))
    size = split.groupBy("field").agg(F.count("*").alias("docs"), F.avg("len").alias("mean"))
    terms = split.select("doc", "field", "len", F.explode("terms").alias("term")).groupBy("doc", "field", "len", "term").agg(F.count("*").alias("tf"))
    return terms, size


@dataclass
class Index:
    """A written inverted index: postings by bucket of the term, the terms with their document frequencies, and the sizes of the fields."""

    postings: DataFrame
    terms: DataFrame
    size: DataFrame
    fields: dict[str, float]


def write_index(docs: DataFrame, path: str, fields: dict[str, float] | None = None, buckets: int = BUCKETS) -> Index:
    """Index docs once below path; a frequent term is spread over the files of its bucket by document."""
    fields = fields or BOOST
    index, size = postings(docs, fields)
    bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")
    spread = index.withColumn("bucket", bucket).repartitionByRange("bucket", "term", "doc").sortWithinPartitions("bucket", "term", "doc")
    spread.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    written = docs.sparkSession.read.parquet(f"{path}/postings")
    written.groupBy("bucket", "field", "term").agg(F.count("*").alias("df")).write.mode("overwrite").parquet(f"{path}/terms")
    size.withColumn("boost", _by_field(fields)).write.mode("overwrite").parquet(f"{path}/size")
    return read_index(docs.sparkSession, path)


def read_index(spark: SparkSession, path: str) -> Index:
    postings_, terms, size = (spark.read.parquet(f"{path}/{n}") for n in ("postings", "terms", "size"))
    return Index(postings_, terms, size.drop("boost"), {r["field"]: r["boost"] for r in size.select("field", "boost").collect()})  # a row for each field


def _by_field(fields: dict[str, float]) -> Column:
    boost = F.lit(0.0)
    for f, b in fields.items():
        boost = F.when(F.col("field") == f, b).otherwise(boost)
    return boost


def bm25(docs: DataFrame | Index, query: str, fields: dict[str, float] | None = None, prefix: bool = False, fuzzy: float = 0.0) -> DataFrame:
    """(id, score): BM25 of each field times its boost, summed over the query's terms. With prefix or fuzzy, an index term that
    extends a query term, or is within fuzzy * length edits, counts with a weight below 1. Query terms are few and fixed, so
    the index is filtered before anything is joined. In a written index the list of terms is searched, and only the buckets of those
    that count are read."""
    words = list(dict.fromkeys(query.split()))
    weight = F.lit(0.0)
    for w in words:
        q = F.lower(unaccent(F.lit(w)))
        own = F.when(F.col("term") == q, 1.0)
        if prefix:
            own = own.when(F.startswith("term", q), 0.9 * F.char_length(q) / F.char_length("term"))
        if fuzzy:
            most = F.round(F.char_length(q) * fuzzy).cast("int")
            own = own.when((most > 0) & (F.levenshtein(F.col("term"), q) <= most), 0.45)
        weight = weight + F.coalesce(own, F.lit(0.0))
    if isinstance(docs, Index):
        fields, size = fields or docs.fields, docs.size
        scored = docs.postings.join(docs.terms.withColumn("weight", weight).where("weight > 0"), ["bucket", "field", "term"])
    else:
        fields = fields or BOOST
        index, size = postings(docs, fields)
        hits = index.withColumn("weight", weight).where("weight > 0")
        scored = hits.join(hits.groupBy("field", "term").agg(F.countDistinct("doc").alias("df")), ["field", "term"])
    boost = _by_field(fields)
    scored = scored.join(F.broadcast(size), "field")
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = boost * F.col("weight") * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    return scored.groupBy(F.col("doc").alias("id")).agg(F.sum(part).alias("score"))


def merged(first: DataFrame, second: DataFrame, n: int = MAX_RESULTS) -> DataFrame:
    """Results of both, each id once with the first's score, best first, n at most."""
    every = first.withColumn("_from", F.lit(0)).unionByName(second.withColumn("_from", F.lit(1)))
    once = every.withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy("_from", F.desc("score")))).where("_r = 1")
    return once.orderBy("_from", F.desc("score"), "id").limit(n).drop("_r", "_from")


def grouped(results: DataFrame, kind: str = "kind", score: str = "score", id_: str = "id") -> DataFrame:
    """Results with the rank in their kind, the kind's best score and the kinds' order by it."""
    best = F.max(score).over(Window.partitionBy(kind))
    out = results.withColumn("best", best).withColumn("rank_in_kind", F.row_number().over(Window.partitionBy(kind).orderBy(F.desc(score), id_)))
    heads = out.where("rank_in_kind = 1").select(F.col(kind).alias("_k"), F.row_number().over(Window.orderBy(F.desc("best"), kind)).alias("group_order"))
    return out.join(F.broadcast(heads), F.col(kind) == F.col("_k")).drop("_k")


def label_of(kind: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv]), kind)


def search(docs: DataFrame, query: str, items: DataFrame | None = None, index: Index | None = None) -> DataFrame:
    """Grouped results for a query of two characters or more: exact codes first, then ranked terms, from a written index if there is one."""
    if len(query.strip()) < MIN_QUERY:
        return docs.where(F.lit(False)).select("id", "kind", F.lit(0.0).alias("score"))
    ranked = bm25(index or docs, query, prefix=True, fuzzy=FUZZY).join(docs.select("id", "kind"), "id").select("id", "kind", "score")
    return grouped(merged(code_matches(docs, query, items), ranked))
