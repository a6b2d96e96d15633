"""Line dedup in DataFrame functions alone.

Lines become (hash of the key, document, position). The hashes are range-partitioned and within each range sorted by document and
position; streaming over it yields the first occurrences of every key. Their counts give the keys that lose lines, and each document
gets a run-length bitmap of the lines it keeps. The bitmaps are written, so Spark knows their size: small ones are broadcast to the
texts, which then stay where they are; else both are joined by document. Texts never travel with the hashes.

Skew: a range is cut by (hash, salt of the document), so a key in a third of all documents spreads over
SALTS ranges, and what leaves a range is at most MIN_DOCS rows for a key. The verdicts go back by
(hash, salt) as well, so no task holds a key.

Edge cases: a null or empty text is one empty line; a very long text is a document like others, its bitmap is as long as its runs. Rows
with the same doc_id, repeated rows among them, count as one document for a key; a null doc_id is one document and the smallest, so
there are no ties for the largest. All columns are carried in `_row`, whatever their names. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, carried, lower_ascii, materialize

MIN_CHARS, MIN_DOCS, SALTS = 20, 3, 256


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hashes(rows: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(_id, _tid, pos, h, salt) of every line of `carried` rows whose key is long enough."""
    lines = rows.select("_id", F.xxhash64("_text").alias("_tid"), F.posexplode(_lines(F.col("_text"))).alias("pos", "line"))
    key = lower_ascii(F.btrim("line", F.lit(SPACES)))
    return lines.select("_id", "_tid", "pos", key.alias("key")).where(F.char_length("key") >= min_chars).select("_id", "_tid", "pos", F.unhex(F.md5("key")).alias("h"), F.pmod(F.xxhash64("_id"), F.lit(SALTS)).cast("short").alias("salt"))


def repeated_keys(hashes: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(h, salt, keeper): keys in at least min_docs documents, with the largest doc_id that holds each, for every salt that they occur with."""
    ranged = hashes.select("h", "salt", "_id", "pos").repartitionByRange("h", "salt").sortWithinPartitions("h", "salt", F.col("_id").desc_nulls_last(), "pos")
    stream = Window.partitionBy("h", "salt").orderBy(F.col("_id").desc_nulls_last())
    # a document that repeats its line counts once, in the same partitioning
    firsts = ranged.withColumn("r", F.dense_rank().over(stream)).where(F.col("r") <= min_docs).select("h", "salt", "_id").distinct()
    key = Window.partitionBy("h")  # at most min_docs * SALTS documents
    found = firsts.select("h", "salt", F.size(F.collect_set(F.struct("_id")).over(key)).alias("n"), F.max("_id").over(key).alias("keeper"))
    return found.where(F.col("n") >= min_docs).select("h", "salt", "keeper").distinct()


def keep_bitmaps(hashes: DataFrame, keys: DataFrame) -> DataFrame:
    """(_id, _tid, drop_runs) of documents that lose lines: sorted [start, end) runs, a run-length-compressed bitmap."""
    lost = hashes.join(keys, ["h", "salt"]).where(~F.col("_id").eqNullSafe(F.col("keeper")))
    drops = lost.groupBy("_id", "_tid").agg(F.array_sort(F.collect_set("pos")).alias("d"))
    d = F.col("d")
    starts = F.filter(d, lambda x, i: (i == 0) | (F.get(d, i - 1) != x - 1))
    ends = F.filter(d, lambda x, i: F.get(d, i + 1).isNull() | (F.get(d, i + 1) != x + 1))
    return drops.select("_id", "_tid", F.arrays_zip(starts.alias("start"), F.transform(ends, lambda x: x + 1).alias("end")).alias("drop_runs"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """_row, n_lines, n_dropped, keep_runs, kept: per document the lines that stay, as runs and as text."""
    rows = carried(docs)
    hashes = materialize(line_hashes(rows, min_chars), "line-hashes")
    maps = materialize(keep_bitmaps(hashes, repeated_keys(hashes, min_docs)), "bitmaps").select(F.col("_id").alias("b_id"), F.col("_tid").alias("b_tid"), "drop_runs")
    joined = rows.withColumn("_tid", F.xxhash64("_text")).join(maps, F.col("_id").eqNullSafe(F.col("b_id")) & (F.col("_tid") == F.col("b_tid")), "left")
    lines = _lines(F.col("_text"))
    out = joined.select("_row", lines.alias("lines"), F.coalesce("drop_runs", F.array().cast("array<struct<start:int,end:int>>")).alias("runs"))
    n = F.size("lines")
    begin = F.concat(F.array(F.lit(0)), F.col("runs.end"))
    end = F.concat(F.col("runs.start"), F.array(n))
    out = out.withColumn("keep_runs", F.filter(F.arrays_zip(begin.alias("start"), end.alias("end")), lambda r: r["start"] < r["end"]))
    kept = F.flatten(F.transform("keep_runs", lambda r: F.slice("lines", r["start"] + 1, r["end"] - r["start"])))
    stay = F.aggregate("keep_runs", F.lit(0), lambda a, r: a + r["end"] - r["start"])
    return out.select("_row", n.cast("long").alias("n_lines"), (n - stay).cast("long").alias("n_dropped"), "keep_runs", F.array_join(kept, "\n").alias("kept"))


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("_row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = {
    "op1_line_dedup": """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (
  SELECT *, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
f AS (
  SELECT k.doc_id, k.pos, k.line, r.key IS NOT NULL AND k.doc_id <> r.keeper AS lost
  FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""
}
