"""The hierarchical parse of articles: window functions find what each line is, one grouped fold infers depth.

Depth depends on all markers before a line, so the fold is sequential within an article and runs as
`applyInArrow` with one group for each (doc_id, article). Everything else is columns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliograph.functions.text import collapse, unaccent
from foliograph.operators import lines as L
from foliograph.sources.scratch import written

RECORD = "rec string, id string, parent_id string, root_id string, article int, kind string, label string, level int, ord long, part string, page int, title string, text string, seq long, ref string, w int, h int"
RECS = ("node", "part", "note", "exception", "item", "definition", "figure", "anchor")
#: What the views below take of the records.
OF_NODES = {"recs": ("node",), "columns": ("rec", "id", "parent_id", "root_id", "article", "kind", "label", "level", "ord", "part", "page", "title", "text")}
OF_ITEMS = {"recs": ("node",), "columns": ("rec", "id", "parent_id", "root_id", "ord")}
OF_ANNOTATIONS = {"recs": ("note", "exception", "item"), "columns": ("rec", "id", "article", "label", "ord", "text", "seq")}
MARKERS = ("alpha", "paren", "num", "letter")


def _classes(lines: DataFrame) -> DataFrame:
    """Lines with cls, what each is by itself, and number, that of a section's heading."""
    u = unaccent(F.trim("text"))
    cls = F.when(F.col("kind") == "img", "img").when(F.col("kind") == "tbl", "tbl").otherwise(L.line_class(F.col("text")))
    own = F.regexp_extract(u, L.SECTION, 1) == F.col("article").cast("string")
    step = lines.withColumn("cls", cls).withColumn("cls", F.when((F.col("cls") == "section") & ~own, "text").when(F.col("cls").isin("article", "table_caption"), "text").otherwise(F.col("cls")))
    return step.withColumn("number", F.when(F.col("cls") == "section", F.regexp_extract(u, L.SECTION, 2).try_cast("int")))


def _labels(step: DataFrame, *more: str) -> DataFrame:
    """Lines that aren't blank with what their class makes of them."""
    step = step.where("cls <> 'blank'")
    text = F.trim("text")
    u = unaccent(text)
    label = F.when(F.col("cls") == "section", F.concat_ws("-", F.regexp_extract(u, L.SECTION, 1), F.regexp_extract(u, L.SECTION, 2)))
    label = label.when(F.col("cls").isin("note", "exception"), F.trim(F.split_part(text, F.lit(":"), F.lit(1))))
    for c, p in (("part", L.PART), ("alpha", L.ALPHA), ("paren", L.PAREN), ("num", L.NUM), ("letter", L.LETTER)):
        label = label.when(F.col("cls") == c, F.regexp_extract(u, p, 1))
    after_label = F.when(F.col("cls") == "section", F.regexp_replace(text, r"^\d{3}-\d{1,3}(?:\.-|\.)?\s*", "")).when(F.col("cls").isin("note", "exception"), F.regexp_replace(text, r"^[^:]*:\s*", ""))
    after_label = after_label.when(F.col("cls") == "paren", F.regexp_replace(text, r"^\(\d{1,2}\)\s*", "")).when(F.col("cls").isin("alpha", "letter", "num", "part"), F.regexp_replace(text, r"^[^.)]*[.)]\s*", ""))
    term, definition = F.regexp_extract(text, L.TERM, 1), F.regexp_extract(text, L.TERM, 2)
    return step.select("doc_id", "article", "line_no", "page", "cls", label.alias("label"), after_label.alias("rest"), text.alias("line"), F.nullif(term, F.lit("")).alias("term"), definition.alias("definition"), "ref", "w", "h", *more)


def prepared(lines: DataFrame) -> DataFrame:
    """Lines (doc_id, article, line_no, page, kind, text, ref, w, h) with their class, label and rest; sections out of order are text."""
    step = L.accept_increasing(_classes(lines), ["doc_id", "article"], ["line_no"], "number", "in_order")
    return _labels(step.withColumn("cls", F.when((F.col("cls") == "section") & ~F.col("in_order"), "text").otherwise(F.col("cls"))))


def classified(lines: DataFrame, *more: str) -> DataFrame:
    """As `prepared`, line by line: each with its number, so that whoever reads them in order (`Fold.read_next`) finds the sections out of order. Runs on streams too."""
    return _labels(_classes(lines), "number", *more)


class Fold:
    """Reads the classified lines of one article and yields its records."""

    def __init__(self, article: int) -> None:
        self.article, self.out, self.seq, self.count, self.most = article, [], 0, 0, 0
        self.section: dict | None = None
        self.open: list[dict] = []  # nested items, outermost first
        self.target: dict | None = None
        self.part: str | None = None
        self.parts: set[str] = set()
        self.note: dict | None = None
        self.note_kind: str | None = None
        self.figure: dict | None = None

    @property
    def owner(self) -> dict | None:
        return self.open[-1] if self.open else self.section

    def add(self, rec: str, **fields) -> dict:
        row = {"rec": rec, "article": self.article, "ord": self.count, "texts": [], "part": self.part} | fields
        self.out.append(row)
        self.count += 1
        return row

    def read_next(self, line) -> None:
        """As read, for lines of `classified`: a section whose number isn't above all before it is text."""
        if line.number is not None:
            if line.number <= self.most:
                line.cls = "text"
            self.most = max(self.most, line.number)
        self.read(line)

    def done(self, all_: bool = False) -> list[dict]:
        """The records that no later line can change, all at the end; they are given out once and forgotten."""
        live = [] if all_ else [r for r in self.out if r is self.target or r is self.figure]
        ready, self.out = [r for r in self.out if not any(r is x for x in live)], live
        return [r | {"text": " ".join(" ".join(r["texts"]).split())} for r in ready]

    def attach(self, rec: str, line, **fields) -> dict | None:
        """A numbered record on the innermost open node, if there is one."""
        if self.owner is None:
            return None
        self.seq += 1
        return self.add(rec, id=self.owner["id"], root_id=self.section["id"] if self.section else None, seq=self.seq - 1, page=line.page, **fields)

    def read(self, line) -> None:
        if line.cls in ("img", "tbl"):
            if line.cls == "img":
                self.figure = self.attach("figure", line, ref=line.ref, w=line.w, h=line.h) or self.figure
            elif str(line.ref).split("|")[0] == str(self.article):
                self.attach("anchor", line, ref=line.ref.split("|", 1)[1])
            return
        if self.figure is not None:
            if line.cls == "figure_caption":
                self.figure["texts"] = [line.line]
                return
            if self.figure["texts"]:
                if line.line[:1].islower():
                    self.figure["texts"].append(line.line)
                    return
                self.figure = None
        handler = getattr(self, "on_" + line.cls, None) or (self.on_marker if line.cls in MARKERS else self.on_text)
        handler(line)

    def on_section(self, line) -> None:
        self.note = self.note_kind = None
        title, text = L.TITLE_OVERRIDES.get(line.label, (None, None))
        if title is None or not (line.rest or "").startswith(title + " "):  # another document may have a section of this number
            title, text = _split(line.rest, 2, 120, False)
        self.section = self.target = self.add("node", id=line.label, root_id=line.label, kind="section", label=line.label, level=0, page=line.page, title=title)
        self.section["texts"] += [text] if text else []
        self.open = []

    def on_part(self, line) -> None:
        self.part, self.open = line.label, []
        if line.label not in self.parts:
            self.parts.add(line.label)
            self.add("part", label=line.label, title=line.rest, page=line.page)

    def on_note(self, line) -> None:
        row = self.attach(line.cls, line, label=line.label)
        if row is not None:
            row["texts"].append(line.rest)
            self.target, self.note, self.note_kind = row, row, None

    on_exception = on_note

    def on_marker(self, line) -> None:
        if self.in_definitions() and line.term:
            self.on_text(line)
            return
        if self.section is None:
            self.on_text(line)
            return
        if self.note is not None and " ".join(self.note["texts"]).rstrip().endswith(":") and self.note_kind in (None, line.cls):
            self.note_kind = line.cls
            self.target = self.add("item", id=self.note["id"], root_id=self.section["id"], seq=self.note["seq"], kind=line.cls, label=line.label, page=line.page)
            self.target["texts"].append(line.rest)
            return
        self.note = self.note_kind = None
        rank = int(line.label) if line.cls in ("num", "paren") else ord(line.label)
        for i in range(len(self.open) - 1, -1, -1):  # the nearest open list of this kind
            if self.open[i]["kind"] == line.cls:
                if rank > self.open[i]["rank"]:
                    del self.open[i:]
                break
        parent = self.owner
        title, text = _split(line.rest, 3, 90, True)
        node = self.add("node", id=parent["id"] + (f"{line.label}." if line.cls == "letter" else f"({line.label})"), parent_id=parent["id"], root_id=self.section["id"], kind=line.cls, label=line.label, level=len(self.open) + 1, page=line.page, title=title, rank=rank)
        node["texts"] += [text] if text else []
        self.open.append(node)
        self.target = node

    def in_definitions(self) -> bool:
        return self.section is not None and not self.open and (self.section["title"] or "").lower().startswith("definicion")

    def on_text(self, line) -> None:
        if self.in_definitions() and line.term:
            self.target = self.add("definition", id=self.section["id"], root_id=self.section["id"], label=line.term, page=line.page)
            self.target["texts"].append(line.definition)
        elif self.target is not None:
            self.target["texts"].append(line.line)


def _split(text: str, low: int, high: int, upper: bool) -> tuple[str | None, str]:
    """Title and text at the first full stop; items have a title only if it starts in upper case."""
    head, dot, tail = (text or "").partition(".")
    if dot and low <= len(head) <= high and (not upper or (head[:1].isupper() and tail[:1].isspace() and tail.strip())):
        return head.strip(), tail.strip()
    return (None, (text or "").strip()) if upper else ((text or "").strip(), "")


KINDS = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
COLUMNS = {c.split()[0]: KINDS[c.split()[1]] for c in RECORD.split(", ")}


LINE = ("page", "cls", "label", "rest", "line", "term", "definition", "ref", "w", "h")


class _Line:
    __slots__ = LINE

    def __init__(self, *values) -> None:
        self.page, self.cls, self.label, self.rest, self.line, self.term, self.definition, self.ref, self.w, self.h = values


def _values(column: pa.ChunkedArray):
    """The column's values. Arrow makes an object of each on the way to Python; numpy does so for none, but knows no null integer."""
    if column.null_count == len(column):
        return [None] * len(column)
    return column.to_pylist() if column.null_count and pa.types.is_integer(column.type) else column.to_numpy().tolist()


def _fold(lines: pa.Table, recs: tuple[str, ...] = RECS, columns: tuple[str, ...] = tuple(COLUMNS)) -> pa.Table:
    lines = lines.take(pc.sort_indices(lines.column("line_no")))
    doc, article = lines.column("doc_id")[0], lines.column("article")[0].as_py()
    fold = Fold(article)
    for line in map(_Line, *[_values(lines.column(c)) for c in LINE]):
        fold.read(line)
    kept = [r for r in fold.out if r["rec"] in recs]
    if "text" in columns:
        for r in kept:
            r["text"] = " ".join(" ".join(r["texts"]).split())
    made = [pa.array([r.get(c) for r in kept], COLUMNS[c]) for c in columns]
    return pa.table([pa.repeat(doc, len(kept)), *made], names=["doc_id", *columns])


def parse(lines: DataFrame, recs: tuple[str, ...] = RECS, columns: tuple[str, ...] = tuple(COLUMNS)) -> DataFrame:
    """RECORDs of all articles: rec is node, part, note, exception, item, definition, figure or anchor; the last six carry the id
    of the node they belong to, and seq keeps the order of what a node owns. All lines are read whatever is asked; of the records only those of `recs`, with `columns`, leave Python."""
    ready = prepared(lines)
    types = {c.split()[0]: c for c in RECORD.split(", ")}
    schema = ", ".join([f"doc_id {dict(ready.dtypes)['doc_id']}", *[types[c] for c in columns]])

    def fold(table: pa.Table) -> pa.Table:
        return _fold(table, recs, columns)

    return ready.groupBy("doc_id", "article").applyInArrow(fold, schema)


def nodes(records: DataFrame) -> DataFrame:
    return records.where("rec = 'node'").select("doc_id", "id", "parent_id", "root_id", "article", "kind", "label", "level", "ord", "part", "page", "title", "text")


def annotations(records: DataFrame) -> DataFrame:
    """Notes and exceptions in document order, with the list items that a note owns."""
    heads = records.where("rec in ('note', 'exception')").select("doc_id", F.col("id").alias("node_id"), F.col("rec").alias("kind"), "seq", "label", "text", "article")
    items = records.where("rec = 'item'").groupBy("doc_id", F.col("id").alias("node_id"), "seq").agg(F.array_sort(F.collect_list(F.struct("ord", "label", "text"))).alias("i"))
    items = items.select("doc_id", "node_id", "seq", F.transform("i", lambda x: F.struct(x["label"].alias("label"), x["text"].alias("text"))).alias("items"))
    return heads.join(items, ["doc_id", "node_id", "seq"], "left")


def owned(records: DataFrame, rec: str) -> DataFrame:
    """Figures, anchors, definitions or parts."""
    return records.where(F.col("rec") == rec)


def item_ids(records: DataFrame) -> DataFrame:
    """The ids of all items below each section, in document order."""
    below = records.where("rec = 'node' and parent_id is not null").groupBy("doc_id", "root_id").agg(F.array_sort(F.collect_list(F.struct("ord", "id"))).alias("i"))
    return below.select("doc_id", "root_id", F.col("i.id").alias("items"))


def ancestors(edges: DataFrame, child: str, parent: str, depth: int | None = None) -> DataFrame:
    """(child, ancestor, distance) over a parent column, by path doubling: after k rounds all distances up to 2 ** k are there, so a chain of n takes
    log2(n) rounds, each over written tables. A cycle is an error, as is nesting beyond `depth` levels if that is given."""
    pairs = edges.where(F.col(parent).isNotNull()).select(F.col(child).alias("child"), F.col(parent).alias("ancestor"))
    known = jump = written(pairs.withColumn("distance", F.lit(1)))
    while True:
        _check_nesting(known, depth)
        up = jump.select("child", F.col("ancestor").alias("middle"), F.col("distance").alias("d1"))
        above = lambda df: df.select(F.col("child").alias("m"), F.col("ancestor").alias("top"), F.col("distance").alias("d2"))
        through = lambda df: up.join(above(df), F.col("middle") == F.col("m")).select("child", F.col("top").alias("ancestor"), (F.col("d1") + F.col("d2")).alias("distance"))
        longer = written(through(known))
        if longer.isEmpty():
            return known
        known, jump = written(known.unionByName(longer)), written(through(jump))


def _check_nesting(known: DataFrame, depth: int | None) -> None:
    if not known.where(F.col("child") == F.col("ancestor")).isEmpty():
        raise ValueError("nested deeper than any level: the parents of a node lead back to it")
    if depth is not None and not known.where(F.col("distance") > depth).isEmpty():
        raise ValueError(f"nested deeper than {depth} levels")


def _out_of_batch(batches):
    """Each row of (child, root, depth) moved up to the first ancestor that is no child of its batch. Rows of a cycle, and those below one, stay as they are."""
    for b in batches:
        parent = pc.index_in(b.column(1), value_set=b.column(0).cast(b.column(1).type)).fill_null(-1).to_numpy()
        top, far = np.where(parent < 0, np.arange(len(parent)), parent), (parent >= 0).astype(np.int64)
        for _ in range(len(parent).bit_length()):
            far, top = far + far[top], top[top]
        out = parent[top] < 0
        top, far = np.where(out, top, np.arange(len(top))), np.where(out, far, 0)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).take(pa.array(top)), pa.array(far + 1)], names=["child", "root", "depth"])


def roots(edges: DataFrame, child: str, parent: str) -> DataFrame:
    """(child, root, depth) of every child with one parent: its topmost ancestor and how far up that is. Rows that come together are contracted together, batch by batch and
    without a shuffle; only children that another batch points to, the joints, go into the rounds of pointer doubling. In rows ordered along their chains these are one
    for a batch; in rows of no order they may be all, and each round holds one row for each. Chains of any length do; a cycle is an error."""
    own = edges.where(F.col(parent).isNotNull()).select(F.col(child).alias("child"), F.col(parent).alias("root"), F.lit(1).cast("long").alias("depth"))
    rows = written(own.mapInArrow(_out_of_batch, own.schema))
    n = rows.count()
    pointed = written(rows.select(F.col("root").alias("p")).distinct())
    at = written(rows.join(pointed, F.col("child") == F.col("p"), "left_semi"))
    while not at.isEmpty():
        up = at.select(F.col("child").alias("u"), F.col("root").alias("u_root"), F.col("depth").alias("u_depth"))
        joined = at.join(up, F.col("root") == F.col("u"), "left")
        at = written(joined.select("child", F.coalesce("u_root", "root").alias("root"), (F.col("depth") + F.coalesce("u_depth", F.lit(0))).alias("depth"), F.col("u").isNotNull().alias("moved")))
        if not at.where((F.col("child") == F.col("root")) | (F.col("depth") > n)).isEmpty():
            raise ValueError("nested deeper than any level: the parents of a node lead back to it")
        if at.where("moved").isEmpty():
            break
        at = at.drop("moved")
    above = at.select(F.col("child").alias("u"), F.col("root").alias("u_root"), F.col("depth").alias("u_depth"))
    joined = rows.join(above, F.col("root") == F.col("u"), "left")
    return joined.select("child", F.coalesce("u_root", "root").alias("root"), (F.col("depth") + F.coalesce("u_depth", F.lit(0))).alias("depth"))


def glossary(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Definitions (term, definition, part, page) and the scope paragraph of a glossary article."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    text = F.trim("text")
    u = unaccent(text)
    kept = lines.where((text != "") & ~F.rlike(u, F.lit(L.ARTICLE))).withColumn("nth", F.row_number().over(order)).where("nth > 1")  # the first line is the title
    part = F.when(F.rlike(u, F.lit(L.PART)) & (F.char_length(u) < 120), F.regexp_extract(u, L.PART, 1))
    is_term = F.rlike(text, F.lit(L.GLOSSARY_TERM)) & ~u.startswith("NOTA") & part.isNull()
    step = kept.withColumn("own_part", part).withColumn("is_term", is_term)
    step = step.withColumn("part", F.last("own_part", ignorenulls=True).over(order))
    step = step.withColumn("group", F.sum((F.col("is_term") | F.col("own_part").isNotNull()).cast("int")).over(order))
    step = step.where("own_part is null").withColumn("head", F.max("is_term").over(Window.partitionBy("doc_id", "group")))
    body = F.when(F.col("is_term"), F.regexp_extract(text, L.GLOSSARY_TERM, 2)).otherwise(text)
    term = F.when(F.col("is_term"), F.trim(F.regexp_extract(text, L.GLOSSARY_TERM, 1)))
    terms = step.where("head").groupBy("doc_id", "group").agg(F.max(term).alias("term"), F.array_sort(F.collect_list(F.struct("line_no", body.alias("b")))).alias("p"), F.first("part").alias("part"), F.min("page").alias("page"))
    terms = terms.select("doc_id", "term", collapse(F.array_join(F.transform("p", lambda x: x["b"]), " ")).alias("definition"), "part", "page")
    scope = L.ordered_text(step.where("not head and part is null").select("doc_id", "line_no", text.alias("text")), ["doc_id"], "line_no", "text")
    return terms, scope
