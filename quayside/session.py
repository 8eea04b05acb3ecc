"""Where jobs may keep intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


# Folders of local sessions that name none, by application.
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only where a local session names none."""
    configured = (
        spark.conf.get("spark.checkpoint.dir", None)
        or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        or spark.sparkContext.getCheckpointDir()
    )
    if configured:
        return configured.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("Set spark.checkpoint.dir to a folder that every executor can reach.")
    application = spark.sparkContext.applicationId
    if application not in _LOCAL:
        _LOCAL[application] = tempfile.mkdtemp(prefix="quayside-")
    return _LOCAL[application]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh, never reused folder below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(
    frame: DataFrame, path: str, partition_by: list[str] | None = None, **counters: Column
) -> tuple[DataFrame, dict[str, int]]:
    """Write ``frame`` to ``path`` and read it back, which cuts the lineage durably.

    ``counters`` are aggregates taken in the same job, so a loop needs no second pass for its exit test.
    """
    seen = Observation()
    measures = counters or {"rows": F.count(F.lit(1))}
    observed = frame.observe(seen, *[measure.alias(name) for name, measure in measures.items()])
    writer = observed.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    back = frame.sparkSession.read.schema(frame.schema).parquet(path)
    return back, {name: int(value or 0) for name, value in seen.get.items()}


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder that this library wrote and that no plan reads any more."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def discard(spark: SparkSession, path: str) -> None:
    """Removes a scratch folder. Anything outside the shared folder stays."""
    if not path.startswith(f"{shared_dir(spark)}/"):
        raise ValueError("Only folders below the shared one are removed.")
    remove(spark, path)


def discard_files(spark: SparkSession, path: str, files: list[str]) -> None:
    """Removes files of a table of this library that newer ones have taken the place of; only ones below ``path``."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    root = system.makeQualified(folder).toUri().getPath().rstrip("/") + "/"
    for name in files:
        file = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        if not file.toUri().getPath().startswith(root):
            raise ValueError("Only files of the table are removed.")
        system.delete(file, False)
