"""The citation graph kept up to date from a stream of texts, without reading earlier texts again.

Every batch of edges is merged into two written tables, in folders of its own number: the edges that are new, and by how much they raise the counts of their targets. Folders of a batch are
written anew when the batch is run again after a failure, and a batch only looks at those of earlier numbers, so every edge counts once. `fold` gathers all folders into one once they are many.
Repeats within the watermark are dropped in state before they reach the merge; later ones meet the written edges.

Null sources or targets make no edge; self-citations are left out; an empty batch writes empty folders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliograph.operators import refs
from foliograph.sources.collections import exists

EDGE = "src string, dst string, type string"
COUNT = "id string, citations long, edges long"


def _before(spark: SparkSession, path: str, schema: str, batch: int | None) -> DataFrame:
    """The rows of the batches below a number, of all if None."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    kept = spark.read.schema(f"{schema}, batch long").parquet(path)
    return (kept if batch is None else kept.where(F.col("batch") < batch)).drop("batch")


def merge_batch(found: DataFrame, target: str, batch: int) -> None:
    """Add a batch of edges (src, dst, type). Batches come in the order of their numbers; the last may come again."""
    spark = found.sparkSession
    once = refs.clean(found.select("src", "dst", "type"))
    old = _before(spark, f"{target}/edges", EDGE, batch)
    once.join(old, ["src", "dst", "type"], "left_anti").write.mode("overwrite").parquet(f"{target}/edges/batch={batch}")
    new = spark.read.schema(EDGE).parquet(f"{target}/edges/batch={batch}")
    # a source that already cites a target under another type raises its edges, but not its citations
    citing = old.select("src", "dst").join(new.select("src", "dst").distinct(), ["src", "dst"], "left_semi").distinct().withColumn("known", F.lit(1))
    pairs = new.groupBy("src", "dst").agg(F.count("*").alias("n")).join(citing, ["src", "dst"], "left")
    raised = pairs.groupBy(F.col("dst").alias("id")).agg(F.count_if(F.col("known").isNull()).alias("citations"), F.sum("n").alias("edges"))
    raised.write.mode("overwrite").parquet(f"{target}/counts/batch={batch}")


def edges(spark: SparkSession, target: str) -> DataFrame:
    """(src, dst, type) of all batches so far."""
    return _before(spark, f"{target}/edges", EDGE, None)


def counts(spark: SparkSession, target: str) -> DataFrame:
    """(id, citations, edges): of each target, the sources that cite it and the edges to it."""
    return _before(spark, f"{target}/counts", COUNT, None).groupBy("id").agg(F.sum("citations").alias("citations"), F.sum("edges").alias("edges"))


def fold(spark: SparkSession, source: str, target: str, batch: int) -> None:
    """Gather the batches of source into those of target, all under the number of the last, with which a stream goes on there."""
    edges(spark, source).write.mode("overwrite").parquet(f"{target}/edges/batch={batch}")
    counts(spark, source).write.mode("overwrite").parquet(f"{target}/counts/batch={batch}")


def follow(texts: DataFrame, find: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, ts: str | None = None, late: str = "10 minutes"):
    """Keep the graph in `target` up to date with a stream. `find` makes edges (src, dst, type, and ts if given) of texts, row by row.
    With ts, edges that come later than `late` are left out, as Spark does behind a watermark; without it none are, and all repeats meet the written edges."""
    found = find(texts)
    if ts:
        found = found.withWatermark(ts, late).dropDuplicatesWithinWatermark(["src", "dst", "type"])
    merge = lambda df, batch: merge_batch(df, target, batch)
    return found.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
