"""Cross-references: extraction and resolution to the most specific target that exists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The forms of a citation.
SECTION_REF = r"\b(\d{3}-\d{1,3}(?:\([a-z0-9]{1,3}\))*)"
TABLE_REF = r"Tabla\s+(\d{3}-\d{1,3}(?:\([a-z0-9]{1,3}\))*|\d{1,2}[A-Z]?(?:\([A-Z]\))?)"
ARTICLE_REF = r"Art\S*culos?\s+((?:\d{3})(?:\s*(?:,|y|o|ó|a)\s*\d{3})*)"
CHAPTER_REF = r"Cap\S*tulo\s+(\d{1,2})"
PART_REF = r"Parte\s+([A-M]\s+del\s+Art\S*culo\s+\d{3})"
ANY_TABLE = r"Tablas?\s+(\d{3}-\d{1,3}(?:\([a-z0-9]{1,3}\))*|\d{1,2}[A-Z]?(?:\([A-Z]\))?)"
LOOSE_TABLE = r"^\d{1,2}[A-Z]?(?:\([A-Z]\))?$"


def mentions(nodes: DataFrame, pattern: str, name: str = "ref", id_: str = "id", text: str = "text") -> DataFrame:
    """(src, name): one row for each match of the pattern's first group in a node's text."""
    return nodes.select(F.col(id_).alias("src"), F.explode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1))).alias(name))


def edges(nodes: DataFrame, articles: DataFrame, chapters: DataFrame) -> DataFrame:
    """(src, dst, type) without repeats or self-citations, over nodes(id, text).

    Section references go to the node itself, else to its section, else to its article; those whose own or base id the
    same node cites as a table are left out.
    """
    tables = mentions(nodes, TABLE_REF).distinct()
    known = nodes.select(F.col("id").alias("k")).distinct()
    arts = articles.select(F.col("num").cast("string").alias("a")).distinct()
    refs = mentions(nodes, SECTION_REF).distinct().withColumn("base", F.split_part("ref", F.lit("("), F.lit(1)))
    cited = tables.select(F.col("src").alias("t_src"), F.col("ref").alias("t_ref"))
    for c in ("ref", "base"):
        refs = refs.join(cited, (F.col("src") == F.col("t_src")) & (F.col(c) == F.col("t_ref")), "left_anti")
    refs = refs.withColumn("art", F.split_part("ref", F.lit("-"), F.lit(1))).join(arts, F.col("art") == F.col("a"), "left_semi")
    full, short = known.withColumnRenamed("k", "k_full"), known.withColumnRenamed("k", "k_base")
    hit = refs.join(full, F.col("ref") == F.col("k_full"), "left").join(short, F.col("base") == F.col("k_base"), "left")
    node = F.coalesce("k_full", "k_base")
    sections = hit.select("src", F.coalesce(node, F.concat(F.lit("art:"), "art")).alias("dst"), F.when(node.isNotNull(), "seccion").otherwise("articulo").alias("type"))
    numbers = mentions(nodes, ARTICLE_REF, "list").select("src", F.explode(F.regexp_extract_all("list", F.lit(r"(\d{3})"), F.lit(1))).alias("art"))
    whole = numbers.join(arts, F.col("art") == F.col("a"), "left_semi").select("src", F.concat(F.lit("art:"), "art").alias("dst"), F.lit("articulo").alias("type"))
    parts = mentions(nodes, PART_REF, "part").select("src", F.substring("part", 1, 1).alias("letter"), F.substring("part", -3, 3).alias("art"))
    parts = parts.join(arts, F.col("art") == F.col("a"), "left_semi").select("src", F.concat_ws(":", F.lit("parte"), "art", "letter").alias("dst"), F.lit("parte").alias("type"))
    chaps = mentions(nodes, CHAPTER_REF, "cap").withColumn("cap", F.col("cap").cast("int").cast("string"))
    chaps = chaps.join(chapters.select(F.col("num").cast("string").alias("c")), F.col("cap") == F.col("c"), "left_semi").select("src", F.concat(F.lit("cap:"), "cap").alias("dst"), F.lit("capitulo").alias("type"))
    tabs = tables.select("src", F.concat(F.lit("tabla:"), "ref").alias("dst"), F.lit("tabla").alias("type"))
    return clean(tabs.unionByName(sections).unionByName(whole).unionByName(parts).unionByName(chaps))


def clean(found: DataFrame) -> DataFrame:
    return found.where("src <> dst").distinct()


def most_specific(refs: DataFrame, *targets: tuple[str, DataFrame, str], default: Column | None = None) -> DataFrame:
    """refs with `target`: the first of the given columns whose value is a key of its frame, else default."""
    out, found = refs, []
    for i, (column, frame, key) in enumerate(targets):
        keys = frame.select(F.col(key).alias(f"_k{i}")).distinct()
        out = out.join(keys, F.col(column) == F.col(f"_k{i}"), "left")
        found.append(F.col(f"_k{i}"))
    if default is not None:
        found.append(default)
    return out.withColumn("target", F.coalesce(*found)).drop(*[f"_k{i}" for i in range(len(targets))])


def table_usage(texts: DataFrame, tables: DataFrame, nodes: DataFrame, text: str = "text") -> DataFrame:
    """(id, explicitas, usos, ambiguo) of every table: mentions after the word, and bare ones where no node has the same id.
    One pass over the texts extracts all mentions; nothing is searched table by table."""
    def counted(pattern: str, name: str) -> DataFrame:
        return texts.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1))).alias("m")).groupBy("m").agg(F.count("*").alias(name)).withColumnRenamed("m", f"m_{name}")

    bare = counted(r"(?<![\p{L}\p{N}_(-])(\d{3}-\d{1,3}(?:\([a-z0-9]{1,3}\))*)(?![\p{L}\p{N}_(-])", "bare")
    explicit = counted(ANY_TABLE + r"(?![\p{L}\p{N}_(-])", "explicit")
    same = nodes.select(F.col("id").alias("n_id")).distinct()
    t = tables.select("id").distinct().join(explicit, F.col("id") == F.col("m_explicit"), "left").join(bare, F.col("id") == F.col("m_bare"), "left").join(same, F.col("id") == F.col("n_id"), "left")
    named, ambiguous = F.coalesce("explicit", F.lit(0)), F.col("n_id").isNotNull()
    uses = F.when(ambiguous | F.rlike("id", F.lit(LOOSE_TABLE)), named).otherwise(F.greatest(named, F.coalesce("bare", F.lit(0))))
    return t.select("id", named.alias("explicitas"), uses.alias("usos"), ambiguous.alias("ambiguo"))
