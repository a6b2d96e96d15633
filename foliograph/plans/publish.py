"""Publication of a build: a reader sees the former version whole or the new one whole.

Every build goes to a folder of its own below `versions`. Once it and its gate have passed, a manifest naming that folder takes the place of the former one by a
rename, which the file system does in one step. A build that fails at any point leaves the manifest as it was.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from foliograph.plans.build import build

MANIFEST = "CURRENT"


def _files(spark: SparkSession, path: str):
    """The Java classes of paths, and the file context of a path."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    return hadoop, hadoop.FileContext.getFileContext(hadoop.Path(path).toUri(), spark._jsparkSession.sessionState().newHadoopConf())


def current(spark: SparkSession, target: str) -> str | None:
    """The folder of the published version, None before the first."""
    hadoop, files = _files(spark, target)
    path = hadoop.Path(f"{target}/{MANIFEST}")
    if not files.util().exists(path):
        return None
    return f"{target}/versions/{json.loads(spark.read.text(str(path.toString())).first()[0])['version']}"


def collection(spark: SparkSession, target: str, name: str) -> DataFrame:
    """A collection of the published version."""
    at = current(spark, target)
    if at is None:
        raise ValueError(f"nothing is published in {target}")
    return spark.read.parquet(f"{at}/{name}")


def point_to(spark: SparkSession, target: str, version: str) -> None:
    """Let the manifest name a version, in one step."""
    hadoop, files = _files(spark, target)
    fresh = f"{target}/.{MANIFEST}-{uuid.uuid4().hex}"
    spark.createDataFrame([(json.dumps({"version": version}),)], "value string").coalesce(1).write.text(fresh)
    part = next(f for f in _listed(files, hadoop.Path(fresh)) if f.getName().startswith("part-"))
    options = spark.sparkContext._gateway.new_array(getattr(spark._jvm, "org.apache.hadoop.fs.Options$Rename"), 1)
    options[0] = getattr(spark._jvm, "org.apache.hadoop.fs.Options$Rename").OVERWRITE
    files.rename(part, hadoop.Path(f"{target}/{MANIFEST}"), options)
    files.delete(hadoop.Path(fresh), True)


def _listed(files, folder):
    found = files.listStatus(folder)
    while found.hasNext():
        yield found.next().getPath()


def publish(spark: SparkSession, source: str, target: str, floors: dict[str, float] | None = None, keep: int = 2) -> DataFrame:
    """Build source into a new version, publish it if its gate passes, and delete all but the last `keep` versions; the gate's report."""
    version = uuid.uuid4().hex
    report = build(spark, source, f"{target}/versions/{version}", gate=True, floors=floors)
    point_to(spark, target, version)
    hadoop, files = _files(spark, target)
    found = files.listStatus(hadoop.Path(f"{target}/versions"))
    aged = []
    while found.hasNext():
        status = found.next()
        aged.append((status.getModificationTime(), status.getPath()))
    for _, path in sorted(((t, p) for t, p in aged if p.getName() != version), key=lambda x: -x[0])[max(keep - 1, 0) :]:
        files.delete(path, True)
    return report
