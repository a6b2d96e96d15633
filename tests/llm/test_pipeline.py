"""The stages of the pipeline against plain versions, on a small corpus and on awkward tables."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from foliograph.llm import decontamination

from .test_dedup_and_shards import AWKWARD, brute_groups, brute_lines, brute_print, check_pieces, long_line, make
from .test_text_models import brute_quality


def corpus():
    r = random.Random(11)
    word = lambda: "".join(r.choices("aeioulnrst", k=r.randrange(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [prose(20) for _ in range(5)]
    texts = [prose(r.randrange(30, 90)) + "\n" + long_line(r.randrange(3)) + "\n" + prose(30) for _ in range(40)]
    texts += texts[:5] + [prose(30) + " " + x + " " + prose(30) for x in items] + [prose(20) + "\n" + "spam spam spam spam spam " * 20] + AWKWARD
    return texts, items


def test_stages(spark, tmp_path):
    texts, items = corpus()
    folder = str(tmp_path)
    make(spark, texts).withColumn("kept", F.lit("clash")).withColumn("h", F.lit(3)).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    held = dict(enumerate(texts))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name == "packing":
            check_pieces(out.collect(), held)
            break
        rows = out.collect()
        assert out.columns == columns and all(r["kept"] == "clash" for r in rows)
        got = {r.doc_id: r.text for r in rows}
        if name == "quality_rules":
            stats = {i: brute_quality(t) for i, t in held.items()}
            held = {i: t for i, t in held.items() if stats[i][0] >= 10 and 100 * stats[i][4] <= 20 * stats[i][0]}
        elif name == "line_dedup":
            want = brute_lines(held.items())
            import hashlib

            assert {i: hashlib.sha256(t.encode()).hexdigest() for i, t in got.items()} == {i: w[2] for i, w in want.items()}
            assert all(r.n_chars == len(r.text) for r in rows)
            held = got
        elif name == "simhash_near_dedup":
            groups = brute_groups({i: brute_print(t) for i, t in held.items()})
            held = {i: t for i, t in held.items() if groups[i] == i}
        else:
            normal = {i: decontamination.normal(t) for i, t in held.items()}
            held = {i: t for i, t in held.items() if not any(x in normal[i] for x in map(decontamination.normal, items))}
        assert got == held
        docs = spark.createDataFrame(rows, out.schema)
    assert 30 < len(held) < 46


def test_run_on_an_empty_table(spark, tmp_path):
    folder = str(tmp_path)
    make(spark, []).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
