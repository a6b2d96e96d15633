"""Beyond the document pipeline: windowed counts that run alike on a table and on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, ts: str, kind: str, value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, kind, n, total) of each window; on a stream, events later than `late` are left out and a window is final once the watermark passes it."""
    marked = events.withWatermark(ts, late) if events.isStreaming else events
    out = marked.groupBy(F.window(ts, width).alias("w"), kind).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), kind, "n", "total")


def write_windows(counts: DataFrame, path: str, checkpoint: str):
    """Append final windows as Parquet, exactly once, over whatever input is available."""
    return counts.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
