"""Alarms and their summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import extract, strip
from ..schema import first_seen
from .search import time_range

_CODE = r"(?iuU)Alarm Code \[(\d+)\]"
_TAG = r"(?iuU)\[ALARM\]\s*([^\n]+)"


def extract_alarms(entries: DataFrame, start=None, end=None) -> DataFrame:
    """(timestamp, alarm_code, message, source, line_no, repeat_count, level_name) of all alarm entries."""
    tagged = F.col("message").rlike(_TAG)
    text = F.when(tagged, strip(F.regexp_extract("message", _TAG, 1))).otherwise(strip(F.col("message")))
    return time_range(entries.filter("is_alarm"), start, end).select(
        "timestamp",
        "log_type",
        extract(F.col("message"), _CODE).alias("alarm_code"),
        text.alias("message"),
        "source_path",
        "source_file",
        "line_no",
        "repeat_count",
        F.coalesce(F.nullif("level_name", F.lit("")), F.lit("Alarm")).alias("level_name"),
        *[c for c in ("timeline_index",) if c in entries.columns],
    )


def summarize_alarms(alarms: DataFrame, label_chars: int | None = None, limit: int | None = None) -> DataFrame:
    """(alarm, occurrences) by code or whole message, most first; `label_chars` cuts only the shown text. Ties keep the order of first occurrence. A count of 0 counts as 1."""
    key = F.coalesce(F.nullif("alarm_code", F.lit("")), F.col("message"))
    times = F.coalesce(F.nullif("repeat_count", F.lit(0).cast("long")), F.lit(1).cast("long"))
    totals = alarms.groupBy(key.alias("alarm")).agg(
        F.sum(times).alias("occurrences"), F.min(first_seen(alarms)).alias("_first")
    )
    ranked = totals.orderBy(F.desc("occurrences"), "_first")
    ranked = (ranked.limit(limit) if limit else ranked).drop("_first")
    return ranked if label_chars is None else ranked.withColumn("alarm", F.substring("alarm", 1, label_chars))
