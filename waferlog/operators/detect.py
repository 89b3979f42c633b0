"""Which dialect a file speaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..schema import MMI, SECS, UNKNOWN

# Fixed patterns of the two header lines and of the two file-name forms.
MMI_HEADER = r"(?s)^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}:\d{3}\|\d+\|\d+\|.*$"
SECS_HEADER = r"(?s)^(\d{2}:\d{2}:\d{2}:\d{3}):\s+\[(\d+)\]\s*(.*)$"
MMI_NAME = r"(?i)\d{4}_\d{2}_\d{2}\.(?:log|tslog)$"
SECS_NAME = r"(?i)\d{4}-\d{2}-\d{2} \d{1,2}\.(?:log|tslog)$"


def is_mmi_header(value: Column) -> Column:
    return value.rlike(MMI_HEADER)


def is_secs_header(value: Column) -> Column:
    return value.rlike(SECS_HEADER)


def file_heads(raw_lines: DataFrame) -> DataFrame:
    """(source_path, line_count, opens_mmi, opens_secs) per file, one aggregation without any text."""
    opening = F.col("line_no") == 1
    return raw_lines.groupBy("source_path").agg(
        F.max("line_no").alias("line_count"),
        F.bool_or(opening & is_mmi_header(F.col("value"))).alias("opens_mmi"),
        F.bool_or(opening & is_secs_header(F.col("value"))).alias("opens_secs"),
    )


def dialect_of(heads: DataFrame) -> Column:
    """The dialect of a file from its name, or from its only line; a file that passes both tests is MMI.

    Content of more lines doesn't decide here: such a file is tried as both when it is assembled.
    """
    name = F.element_at(F.split(heads["source_path"], "/"), -1)
    single = heads["line_count"] == 1
    mmi = name.rlike(MMI_NAME) | (single & heads["opens_mmi"])
    secs = name.rlike(SECS_NAME) | (single & heads["opens_secs"])
    return F.when(mmi, MMI).when(secs, SECS).otherwise(UNKNOWN)


def detect_dialects(raw_lines: DataFrame) -> DataFrame:
    heads = file_heads(raw_lines)
    return heads.select("source_path", dialect_of(heads).alias("dialect"))


def strict_dialects(raw_lines: DataFrame) -> DataFrame:
    """Option: the headers decide. Mixed headers, or none, give an `error` instead of a dialect."""
    per_file = raw_lines.groupBy("source_path", "source_file").agg(
        F.count_if(is_mmi_header(F.col("value"))).alias("mmi_headers"),
        F.count_if(is_secs_header(F.col("value"))).alias("secs_headers"),
    )
    mmi, secs = F.col("mmi_headers") > 0, F.col("secs_headers") > 0
    return per_file.select(
        "*",
        F.when(mmi & ~secs, MMI).when(secs & ~mmi, SECS).alias("dialect"),
        F.when(mmi & secs, "mixed dialects").when(~mmi & ~secs, "no header").alias("error"),
    )
