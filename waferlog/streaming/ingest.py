"""Finished log files picked up as a stream; each micro-batch runs the incremental load."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.load import load_incremental
from ..sources.raw import SUPPORTED


def follow_folder(
    spark: SparkSession, folder: str, store: str, checkpoint: str, trigger: dict | None = None,
    files_per_batch: int = 10_000, **options
) -> StreamingQuery:
    """Keep `store` up to date with the log files under `folder`.

    The stream carries only the names of new files and says when to look. What is parsed is decided by the store's manifest, as in any
    incremental load: files that are new, changed since they were parsed, or gone. A batch that is run again finds nothing to do.
    """
    names = (
        spark.readStream.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_per_batch)
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .load(folder)
        .select("path")
        .filter(F.col("path").rlike(SUPPORTED))
    )

    def look(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            load_incremental(batch.sparkSession, folder, store, **options)

    writer = names.writeStream.foreachBatch(look).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
