"""The corpus pipeline: quality rules, line dedup, near-duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir). All but the last return rows with the columns of documents; n_chars is set anew
where a text has changed. A text that loses all its lines becomes empty and stays a document.

Edge cases: rejected documents are gone for all later stages. Null and empty texts fail the base rules of the first stage; where a
stage meets them all the same, line dedup keeps them, near-dedup holds them for copies of one another, decontamination keeps
them and packing gives their end token. Very long texts are worked on whole. Rows that repeat or share a doc_id count as one document for
line dedup and are judged by their own text elsewhere; of a group of near duplicates the smallest doc_id stays, a null one only where
there is no other. Extra columns are carried to the last stage, whatever their names. Empty tables give an empty result.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliograph.llm import decontamination, line_dedup, packing, quality, simhash
from foliograph.llm.common import materialize, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the trees reject go."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that line dedup drops."""
    out = line_dedup.dedup_lines(docs)
    text = F.when(F.col("n_dropped") > 0, F.col("kept")).otherwise(F.col("_row.text"))
    changed = {"text": text}
    if "n_chars" in docs.columns:
        chars = F.when(F.col("n_dropped") > 0, F.char_length("kept")).otherwise(F.col("_row.n_chars"))
        changed["n_chars"] = chars.cast(docs.schema["n_chars"].dataType)
    return out.select(*[changed.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each near-duplicate group."""
    return simhash.keep_one_of_each_group(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontamination.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.pack(docs).drop("ids")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", packing_stage),
]

#: Boosted trees, XXH64 of shingles and byte-pair ids are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}


if __name__ == "__main__":
    run(SparkSession.builder.getOrCreate(), sys.argv[1]).write.parquet(sys.argv[2])
