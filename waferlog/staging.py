"""Cutting lineage through reliable shared storage.

Numbering and lag need a sorted order that stays fixed when an executor is lost. The sorted rows are written
once, as parquet, under the folder the cluster names in `spark.checkpoint.dir`, and are read back from there.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []
_generation = 0


def generation() -> int:
    """Rises whenever staged tables are deleted; what was kept of an earlier one must be made anew."""
    return _generation


def staging_root(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one only for an unset setting on a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="waferlog-")
    spark.sparkContext.setCheckpointDir(root)
    return root


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder; `drop_staged` deletes it."""
    path = f"{staging_root(spark)}/waferlog/{label}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def stage(df: DataFrame, label: str = "table") -> DataFrame:
    """Write `df` to the shared folder and return it read back, with its lineage cut."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession) -> int:
    """Delete what this session staged; call it when the results have been consumed."""
    global _generation
    _generation += 1
    count = 0
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        count += bool(path.getFileSystem(conf).delete(path, True))
    return count
