"""Counts over a filtered timeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import all_sxfy
from ..schema import MMI, SECS, first_seen


def statistics(entries: DataFrame, bookmarks: DataFrame | None = None) -> DataFrame:
    """One row: total, MMI, SECS, bookmarked and alarm counts. Bookmarks count by (file, line)."""
    rows = entries
    marked = F.lit(False)
    if bookmarks is not None:
        # The key ends in |line|time; the file name itself may hold a bar.
        parts = r"^(.*)\|(\d+)\|[^|]*$"
        spots = bookmarks.select(
            F.regexp_extract("entry_key", parts, 1).alias("source_file"),
            F.regexp_extract("entry_key", parts, 2).try_cast("long").alias("line_no"),
        ).distinct()
        rows = rows.join(spots.withColumn("_marked", F.lit(True)), ["source_file", "line_no"], "left")
        marked = F.coalesce(F.col("_marked"), F.lit(False))
    return rows.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("log_type") == MMI).alias("mmi"),
        F.count_if(F.col("log_type") == SECS).alias("secs"),
        F.count_if(marked).alias("bookmarked"),
        F.count_if("is_alarm").alias("alarms"),
    )


def top_values(entries: DataFrame, value: Column, limit: int = 10) -> DataFrame:
    """(value, entries) of the most frequent non-blank values; ties keep the first-seen order."""
    counts = (
        entries.select(value.cast("string").alias("value"), first_seen(entries).alias("_key"))
        .filter("value IS NOT NULL AND value <> ''")
        .groupBy("value")
        .agg(F.count("*").alias("entries"), F.min("_key").alias("_first"))
    )
    return counts.orderBy(F.desc("entries"), "_first").limit(limit).drop("_first")


def top_sxfy(entries: DataFrame, limit: int = 10) -> DataFrame:
    return top_values(entries, F.col("sxfy_type"), limit)


def top_ceids(entries: DataFrame, limit: int = 10) -> DataFrame:
    return top_values(entries, F.col("ceid"), limit)


def top_event_names(named: DataFrame, limit: int = 10) -> DataFrame:
    return top_values(named, F.col("event_name"), limit)


def sxfy_catalogue(entries: DataFrame) -> DataFrame:
    """All message types that occur anywhere in the messages, sorted."""
    return (
        entries.select(F.explode(F.array_distinct(all_sxfy(F.col("message")))).alias("sxfy_type"))
        .distinct()
        .orderBy("sxfy_type")
    )


def file_inventory(raw_lines: DataFrame, entries: DataFrame) -> DataFrame:
    """Type (UNKNOWN without entries), name, path and line count of each analysed file."""
    lines = raw_lines.groupBy("source_path", "source_file").agg(F.count("*").alias("line_count"))
    types = entries.groupBy("source_path").agg(F.max("log_type").alias("type"), F.count("*").alias("entries"))
    return lines.join(types, "source_path", "left").select(
        F.coalesce("type", F.lit("UNKNOWN")).alias("type"),
        "source_file",
        "source_path",
        "line_count",
        F.coalesce("entries", F.lit(0).cast("long")).alias("entries"),
    )
