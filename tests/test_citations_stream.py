"""The incremental citation graph against the batch query on all rows so far."""

import random

import pytest
from pyspark.sql import functions as F

from foliograph.operators import refs as R
from foliograph.streaming import citations as C


def some_edges(n, seed):
    r = random.Random(seed)
    return [(r.choice(["hot", f"s{r.randrange(9)}", None]), r.choice(["hot"] * 4 + [f"t{r.randrange(9)}", None]), r.choice(["a", "b"])) for _ in range(n)]


def plain(rows):
    good = {(s, d, t) for s, d, t in rows if s is not None and d is not None and s != d}
    return {(d, len({s for s, x, _ in good if x == d}), sum(x == d for _, x, _ in good)) for _, d, _ in good}


def test_every_batch_equals_the_whole(spark, tmp_path):
    """Repeats within and across batches, an empty batch, and batches that are run again after a loss of their counts."""
    target, so_far = f"{tmp_path}/graph", []
    assert C.counts(spark, target).count() == 0
    for batch, n in enumerate((40, 0, 60, 25)):
        rows = some_edges(n, batch)
        df = spark.createDataFrame(rows, C.EDGE)
        C.merge_batch(df, target, batch)
        if batch == 2:  # it fails half-way and comes again, with a row fewer and one row more
            rows = rows[1:] + [("late", "hot", "a")]
            C.merge_batch(spark.createDataFrame(rows, C.EDGE), target, batch)
        so_far += rows
        assert {tuple(r) for r in C.counts(spark, target).collect()} == plain(so_far)
        assert {tuple(r) for r in C.edges(spark, target).collect()} == {(s, d, t) for s, d, t in so_far if s is not None and d is not None and s != d}
    C.fold(spark, target, f"{tmp_path}/folded", 3)
    C.merge_batch(spark.createDataFrame(some_edges(30, 9) + so_far, C.EDGE), f"{tmp_path}/folded", 4)
    assert {tuple(r) for r in C.counts(spark, f"{tmp_path}/folded").collect()} == plain(so_far + some_edges(30, 9))


@pytest.mark.parametrize("ts", [None, "ts"])
def test_stream(spark, tmp_path, ts):
    """Texts come in files; the stream stops and goes on from its checkpoint."""
    texts = [(f"100-{i}", f"véase 250-{i % 3} y 250-{i % 4}", 1_700_000_000 + 60 * (i % 7)) for i in range(30)]
    find = lambda t: R.mentions(t, R.SECTION_REF, "dst").withColumn("type", F.lit("seccion")) if ts is None else t.select(F.col("id").alias("src"), "ts", F.explode(F.regexp_extract_all("text", F.lit(R.SECTION_REF), F.lit(1))).alias("dst")).withColumn("type", F.lit("seccion"))
    schema, source, target = "id string, text string, ts timestamp", f"{tmp_path}/in", f"{tmp_path}/graph"
    want = []
    for step in range(2):
        part = texts[step * 15 : step * 15 + 15] + texts[:2]
        df = spark.createDataFrame(part, "id string, text string, ts long").withColumn("ts", F.timestamp_seconds("ts"))
        df.repartition(3).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        C.follow(stream, find, target, f"{tmp_path}/checkpoint", ts).awaitTermination(240)
        want += [(i, d, "seccion") for i, t, _ in part for d in t.replace("véase ", "").split(" y ")]
        assert {tuple(r) for r in C.counts(spark, target).collect()} == plain(want)
