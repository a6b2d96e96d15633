"""Table functions for SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from foliograph.operators.tree import COLUMNS, RECORD, Fold

NEEDS = ("doc_id", "article", "line_no", "page", "cls", "label", "rest", "line", "term", "definition", "ref", "w", "h", "number")
TYPES = {"string": StringType(), "int": IntegerType(), "long": LongType()}  # an analysis has no session to parse names of types


class ParseLines:
    """SELECT * FROM parse_lines(TABLE(lines)): the records of `tree.parse` out of lines of `tree.classified`.

    The function asks for its own partitioning, (doc_id, article), and order, line_no, so callers can't get these wrong. Records are given out as they are finished; a task holds no article whole.
    Missing columns are an error of the analysis; further ones are passed over; an empty table has no records."""

    def __init__(self) -> None:
        self.fold, self.doc = None, None

    @staticmethod
    def analyze(lines: AnalyzeArgument) -> AnalyzeResult:
        if not lines.isTable:
            raise ValueError("parse_lines takes a table")
        missing = [c for c in NEEDS if c not in lines.dataType.names]
        if missing:
            raise ValueError(f"parse_lines misses the columns {', '.join(missing)}")
        schema = StructType([lines.dataType["doc_id"], *[StructField(c.split()[0], TYPES[c.split()[1]]) for c in RECORD.split(", ")]])
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn("doc_id"), PartitioningColumn("article")], orderBy=[OrderingColumn("line_no")])

    def _given(self, all_: bool):
        for r in self.fold.done(all_):
            yield (self.doc, *(r.get(c) for c in COLUMNS))

    def eval(self, lines):
        if self.fold is None:
            self.fold, self.doc = Fold(lines["article"]), lines["doc_id"]
        self.fold.read_next(_Line(lines))
        yield from self._given(False)

    def terminate(self):
        if self.fold is not None:
            yield from self._given(True)


class _Line:
    """A row whose class may change."""

    def __init__(self, row) -> None:
        self.__dict__.update({c: row[c] for c in NEEDS})


def register(spark: SparkSession) -> None:
    spark.udtf.register("parse_lines", udtf(ParseLines))
