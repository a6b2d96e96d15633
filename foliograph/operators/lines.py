"""The ordered line stream: splitting, merging, exclusion, classification, order-dependent acceptance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliograph.functions.text import collapse, is_furniture, unaccent
from foliograph.operators import scan

# The headings and markers of a line, on folded text.
ARTICLE = r"^ARTICULO\s+(\d{3})\s*$"
SECTION = r"^(\d{3})-(\d{1,3})(?:\.-\s*|\.\s*|\s+)([0-9A-Z].*)$"
PART = r"^([A-M])\.\s+([0-9A-Z].{0,110})$"
NOTE = r"^(NOTA[^:]{0,40}):\s*(.*)$"
EXCEPTION = r"^(Excepcion[^:]{0,60}):\s*(.*)$"
ALPHA = r"^([a-z])\)\s+(.*)$"
PAREN = r"^\((\d{1,2})\)\s+(.*)$"
NUM = r"^(\d{1,2})\)\s+(.*)$"
LETTER = r"^([a-z])\.\s+(.*)$"
FIGURE = r"^Figura\s+\d{3}-\d{1,3}\s*[.\-]"
CAPTION = r"^Tabla\s+(\d{3}-\d{1,3}(?:\s*\([a-z0-9]{1,4}\))*|\d{1,2}[A-Z]?(?:\([A-Z]\))?)\s*(?:\.-|\.|-|—)?\s+([0-9A-Z].*)$"
#: The same on text with its accents.
CAPTION_TITLE = CAPTION.replace("[0-9A-Z].*", "[0-9A-ZÁÉÍÓÚÑ].*")
TERM = r"^([0-9A-ZÁÉÍÓÚÑ][^.:]{2,95})[.:]\s+(\S.*)$"
GLOSSARY_TERM = r"^([A-ZÁÉÍÓÚÑ][^:]{1,90}):\s+(.+)$"
#: What opens a foot note; the lookaheads are the word boundary for all scripts.
FOOTNOTE = r"^\s*(?:\*+|NOTA(?![\p{L}\p{N}_])|Nota(?![\p{L}\p{N}_])|\d+\s*[).])"
TOC_TITLE, TOC_CHAPTER, TOC_ARTICLE = r"^TITULO\s+(\d+)\.?\s*(.*)$", r"^CAPITULO\s+(\d+)\.?\s*$", r"^\s*Art\S*culo\s+(\d{3})\s+(.*)$"
TOC_START = r"^(Art\S*culo|CAPITULO|TITULO|Tabla|APENDICE)"
INFORMATIVE = r"(?i)\s*Esta\s+tabla\s+no\s+es\s+parte\s+de\s+los\s+requerimientos\s+y\s+especificaciones\s+de\s+la\s+NOM,?\s*se\s+incluye\s+[uú]nicamente\s+con\s+prop[oó]sitos\s+informativos\.?\s*"
#: Section titles whose full stop is missing in print: id -> (title, text).
TITLE_OVERRIDES = {"340-6": ("Requisitos de aprobación", "Los cables tipo UF deben ser aprobados.")}


def split_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no from 0, text) of every line that isn't blank; a line keeps its number."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line"))
    return lines.select(key, F.col("line_no").cast("long").alias("line_no"), F.trim("line").alias("text")).where(F.char_length("text") > 0)


def without_furniture(lines: DataFrame, text: str = "text") -> DataFrame:
    return lines.where(~is_furniture(F.col(text)))


def after_page(lines: DataFrame, page: int) -> DataFrame:
    """Lines of the body, which starts after the given page."""
    return lines.where(F.col("page") > page)


def merge_stream(text: DataFrame, *marks: DataFrame, even: bool = False) -> DataFrame:
    """One stream of text lines and image or table marks, numbered by document, page, height and then source. Here and below, `even` scans
    even parts of the rows instead of one task for each document or key: for documents of any length, at the price of one more written table."""
    every = text.withColumn("source", F.lit(len(marks)))
    for i, m in enumerate(marks):
        every = every.unionByName(m.withColumn("source", F.lit(i)), allowMissingColumns=True)
    if even:
        return scan.numbered(every, ["doc_id"], ["page", "y", "source", "ord"]).drop("source", "ord")
    order = Window.partitionBy("doc_id").orderBy("page", "y", "source", "ord")
    return every.withColumn("line_no", F.row_number().over(order).cast("long")).drop("source", "ord")


def keep_heading(text: Column) -> Column:
    """Lines that stay even inside a table zone."""
    u = unaccent(F.trim(text))
    return F.rlike(u, F.lit(SECTION)) | F.rlike(u, F.lit(ARTICLE))


def outside_zones(lines: DataFrame, zones: DataFrame) -> DataFrame:
    """Lines that no zone of their document's page covers, and marks and headings wherever they are."""
    free = (F.col("kind") != "text") | keep_heading(F.col("text"))
    z = zones.select(F.col("doc_id").alias("z_doc"), F.col("page").alias("z_page"), F.col("y0").alias("z0"), F.col("y1").alias("z1"))
    hit = (F.col("doc_id") == F.col("z_doc")) & (F.col("page") == F.col("z_page")) & F.col("y").between(F.col("z0"), F.col("z1")) & ~free
    return lines.join(z, hit, "left_anti")


def line_class(text: Column) -> Column:
    """What a line is, in fixed precedence."""
    u = unaccent(F.trim(text))
    is_a = lambda p: F.rlike(u, F.lit(p))
    return (
        F.when(F.char_length(u) == 0, "blank")
        .when(is_a(ARTICLE), "article")
        .when(is_a(FIGURE), "figure_caption")
        .when(is_a(CAPTION) & (F.char_length(u) <= 260), "table_caption")
        .when(is_a(SECTION), "section")
        .when(is_a(PART) & (F.char_length(u) < 120), "part")
        .when(is_a(NOTE), "note")
        .when(is_a(EXCEPTION), "exception")
        .when(is_a(ALPHA), "alpha")
        .when(is_a(PAREN), "paren")
        .when(is_a(NUM), "num")
        .when(is_a(LETTER), "letter")
        .otherwise("text")
    )


def split_title(text: Column, low: int, high: int) -> Column:
    """struct(title, text) at the first full stop within low to high characters, else the whole as title."""
    pattern = rf"(?s)^([^.]{{{low},{high}}})\.\s*(.*)$"
    has = F.rlike(text, F.lit(pattern))
    return F.struct(F.when(has, F.trim(F.regexp_extract(text, pattern, 1))).otherwise(F.trim(text)).alias("title"), F.when(has, F.trim(F.regexp_extract(text, pattern, 2))).otherwise(F.lit("")).alias("text"))


def informative(title: Column) -> tuple[Column, Column]:
    """Whether a table's title says that it only informs, and the title without that."""
    return F.rlike(title, F.lit(INFORMATIVE)), F.trim(F.regexp_replace(title, INFORMATIVE, " "))


def accept_increasing(df: DataFrame, key: list[str], order: list[str], value: str, name: str = "accepted", even: bool = False) -> DataFrame:
    """Whether a value exceeds all before it: a rejected value never raises the maximum, so no state is needed."""
    if even:
        return scan.accept_increasing(df, key, order, value, name)
    before = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.col(value) > F.coalesce(F.max(value).over(before), F.lit(0)))


def carry(df: DataFrame, key: list[str], order: list[str], value: str, name: str, even: bool = False) -> DataFrame:
    """The last non-null value so far."""
    if even:
        return scan.carry(df, key, order, value, name)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(Window.partitionBy(*key).orderBy(*order)))


def extents(df: DataFrame, key: list[str], order: str, end: Column, even: bool = False) -> DataFrame:
    """lo and hi of half-open stretches from each row to the next of its group, the last to `end`."""
    if even:
        return scan.extents(df, key, order, end)
    return df.withColumn("lo", F.col(order)).withColumn("hi", F.coalesce(F.lead(order).over(Window.partitionBy(*key).orderBy(order)), end))


def table_of_contents(lines: DataFrame) -> DataFrame:
    """(num, title, chapter) of the articles listed; a title may go on in the next line."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    u = unaccent(F.trim("text"))
    step = lines.withColumn("u", u).withColumn("chapter", F.last(F.when(F.rlike("u", F.lit(TOC_CHAPTER)), F.regexp_extract("u", TOC_CHAPTER, 1).try_cast("int")), ignorenulls=True).over(order))
    step = step.withColumn("next", F.lead(F.trim("text")).over(order))
    goes_on = F.col("next").isNotNull() & (F.col("next") != "") & ~F.rlike(unaccent(F.col("next")), F.lit(TOC_START))
    found = step.where(F.rlike("text", F.lit(TOC_ARTICLE)))
    title = F.concat_ws(" ", F.regexp_extract("text", TOC_ARTICLE, 2), F.when(goes_on, F.col("next")))
    listed = found.select("doc_id", "line_no", F.regexp_extract("text", TOC_ARTICLE, 1).cast("int").alias("num"), collapse(title).alias("title"), "chapter")
    return keep_last(listed, ["doc_id", "num"], ["line_no"]).drop("line_no")


def chapters(lines: DataFrame, pattern: str = TOC_CHAPTER) -> DataFrame:
    """(num, title): headings of chapters or titles; the title is on the line or on the next that isn't blank."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    step = lines.where(F.trim("text") != "").withColumn("next", F.lead(F.trim("text")).over(order)).withColumn("u", unaccent(F.trim("text")))
    rest = F.nullif(F.regexp_extract("u", pattern, 2), F.lit("")) if pattern == TOC_TITLE else F.lit(None)
    return step.where(F.rlike("u", F.lit(pattern))).select("doc_id", F.regexp_extract("u", pattern, 1).cast("int").alias("num"), F.coalesce(rest, "next", F.lit("")).alias("title"))


def _document(lines: DataFrame) -> list[str]:
    """The key of a document, where lines are of several."""
    return ["doc_id"] if "doc_id" in lines.columns else []


def listed_tables(lines: DataFrame) -> DataFrame:
    """(doc_id, id, title) of the general tables that the contents list, the first of each id in its document."""
    pattern = r"^Tabla\s+(\d{1,2}[A-Z]?(?:\([A-Z]\))?)\.?\s*[-.]?\s*(.*)$"
    found = lines.where(F.rlike(F.trim("text"), F.lit(pattern))).select(*_document(lines), F.regexp_extract(F.trim("text"), pattern, 1).alias("id"), F.regexp_extract(F.trim("text"), pattern, 2).alias("title"), "line_no")
    return found.groupBy(*_document(lines), "id").agg(F.min_by("title", "line_no").alias("title"))


def find_articles(lines: DataFrame, toc: DataFrame, body_page: int = 9) -> DataFrame:
    """(doc_id, num, line_no): the first body heading of every listed article."""
    heads = after_page(lines, body_page).withColumn("num", F.regexp_extract(unaccent(F.trim("text")), ARTICLE, 1).try_cast("int")).where("num is not null")
    first = heads.groupBy("doc_id", "num").agg(F.min("line_no").alias("line_no"))
    return first.join(toc.select("doc_id", "num"), ["doc_id", "num"], "left_semi")


def census(lines: DataFrame) -> DataFrame:
    """(doc_id, article, parts, sections): letters of the parts and numbers of the sections that head a line."""
    u = unaccent(F.trim("text"))
    part = F.when(F.rlike(u, F.lit(PART)), F.regexp_extract(u, PART, 1))
    section = F.when(F.rlike(u, F.lit(SECTION)) & (F.regexp_extract(u, SECTION, 1) == F.col("article").cast("string")), F.regexp_extract(u, SECTION, 2).try_cast("int"))
    return lines.groupBy(*_document(lines), "article").agg(F.array_sort(F.collect_set(part)).alias("parts"), F.array_sort(F.collect_set(section)).alias("sections"))


def keep_first(df: DataFrame, key: list[str], order: list) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")


def keep_last(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    return keep_first(df, key, [F.col(c).desc() for c in order])


def appendices(lines: DataFrame, page: int = 700) -> DataFrame:
    """(doc_id, letter, title) of the appendices that start on the given page or later, the first of each letter in its document."""
    pattern = r"^APENDICE\s+([A-Z])\.?\s*(.*)$"
    u = unaccent(F.trim("text"))
    found = lines.where((F.col("page") >= page) & F.rlike(u, F.lit(pattern))).select(*_document(lines), "page", "line_no", F.regexp_extract(u, pattern, 1).alias("letter"), F.regexp_extract(u, pattern, 2).alias("title"))
    return found.groupBy(*_document(lines), "letter").agg(F.min_by("title", F.struct("page", "line_no")).alias("title"), F.min("page").alias("page"))


def ordered_text(df: DataFrame, key: list[str], order: str, text: str, name: str = "text") -> DataFrame:
    """The texts of each group joined by a blank in their order, white space collapsed."""
    parts = df.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.col(order), F.col(text)))).alias("_p"))
    return parts.select(*key, collapse(F.array_join(F.transform("_p", lambda p: p[text]), " ")).alias(name))
