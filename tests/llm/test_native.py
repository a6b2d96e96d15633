"""The native operators run no Python on the executors."""

import re

from foliograph.llm import line_dedup, sharding

from .test_dedup_and_shards import line_texts, make


def test_no_python_nodes(spark):
    for out in (line_dedup.dedup_lines(make(spark, line_texts()[:20])), sharding.shard_rows(make(spark, ["a", None, "b"]))):
        text = out._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Arrow|Pandas", text) and "CartesianProduct" not in text
