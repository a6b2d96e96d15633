"""The parse as state of a stream and as a table function, against the parse of a table."""

import random

import pytest
from pyspark.sql import functions as F

from foliograph.functions import tables
from foliograph.operators import tree as T
from foliograph.streaming.parse import parse_stream

SCHEMA = "doc_id string, article int, line_no long, page int, kind string, text string, ref string, w int, h int"
TEXTS = [
    "{a}-1. Definiciones.", "Acometida: parte de la red.", "que sigue aquí", "{a}-2. Alcance. Uno.", "", "a) Uno", "(1) dos", "(2) tres", "NOTA: los factores:", "(1) f", "(2) g", "b) Otro", "sigue b", "{a}-1. Fuera de orden.",
    "Parte B. Métodos", "{a}-5. Más. Texto", ("img", "x.png"), "Figura 1. Un dibujo", "con su rótulo", "{a}-4. Atrás", ("tbl", "{a}|9"), "Excepción 1: salvo esto.", "al fin",
]


def made(spark, articles=(110, 220, 330)):
    rows = []
    for doc in ("d", None):
        for a in articles:
            for i, t in enumerate(TEXTS):
                kind, text, ref = ("text", t.format(a=a), None) if isinstance(t, str) else (t[0], "", t[1].format(a=a))
                rows.append((doc, a, i, 12 if i % 5 else None, kind, text, ref, None if i % 2 else 7, 20))
    return rows


def plain(df):
    return sorted(map(repr, df.select("doc_id", *[c for c in T.COLUMNS]).collect()))


@pytest.mark.parametrize("seed, cuts", [(1, 1), (2, 3), (3, 6)])
def test_a_stream_cut_into_batches(spark, tmp_path, seed, cuts):
    """Lines come in batches, shuffled by up to ten minutes; the state goes on from the checkpoint in a second run."""
    rows, r = made(spark), random.Random(seed)
    want = plain(T.parse(spark.createDataFrame(rows, SCHEMA)))
    dated = [(1_700_000_000 + 60 * x[2], x) for x in rows]
    dated.sort(key=lambda p: p[0] + r.randrange(540))
    end = [(1_700_100_000 + 100_000 * i, ("end", 999, i, 1, "text", "x", None, None, None)) for i in range(2)]
    batches = [dated[i * len(dated) // cuts : (i + 1) * len(dated) // cuts] for i in range(cuts)] + [[e] for e in end]
    source, schema = f"{tmp_path}/in", f"{SCHEMA}, ts timestamp"
    for some in (batches[: cuts // 2], batches[cuts // 2 :]):
        for b in some:
            df = spark.createDataFrame([(*x, t) for t, x in b], f"{SCHEMA}, ts long").withColumn("ts", F.timestamp_seconds("ts"))
            df.coalesce(1).write.mode("append").parquet(source)
        if some:
            lines = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
            out = parse_stream(lines).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True)
            out.start().awaitTermination(240)
    assert plain(spark.read.parquet(f"{tmp_path}/out").where("doc_id is null or doc_id <> 'end'")) == want


def test_table_function(spark):
    tables.register(spark)
    lines = spark.createDataFrame(made(spark), SCHEMA).orderBy(F.rand(3))
    ready = T.classified(lines.withColumn("more", F.lit(1)), "more")
    assert plain(spark.sql("SELECT * FROM parse_lines(TABLE({x}))", x=ready)) == plain(T.parse(lines))
    assert spark.sql("SELECT * FROM parse_lines(TABLE({x}))", x=ready.limit(0)).count() == 0
    with pytest.raises(Exception, match="misses the columns cls"):
        spark.sql("SELECT * FROM parse_lines(TABLE({x}))", x=ready.drop("cls")).collect()
