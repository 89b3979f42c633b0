"""Physical log lines: from files and from in-memory text."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.ordered import BLOCK_ROWS, running_offset
from ..staging import stage

SUPPORTED = r"(?i)\.(log|txt|tslog)$"


def _decode(name):
    # File metadata is percent-encoded; a literal plus must not turn into a blank.
    return F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))


def literal_path(path: str) -> str:
    """A path whose characters stand for themselves, where Hadoop would read a pattern."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def read_log_files(spark: SparkSession, paths: list[str] | str, recursive: bool = True, literal: bool = False) -> DataFrame:
    """Numbered lines of all supported log files under the given paths, which may be patterns unless `literal`.

    Files are read as splits, and each scanned line gets an id that rises inside its split. The scan is staged once,
    without a shuffle, so that the splits stay as they are; a line's number is then the line count of the file's
    earlier splits plus its distance from the first id of its own split. Bad UTF-8 turns into U+FFFD.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    paths = [literal_path(p) for p in paths] if literal else paths
    scan = (
        spark.read.option("recursiveFileLookup", str(recursive).lower())
        .text(paths)
        .select(
            _decode(F.col("_metadata.file_path")).alias("source_path"),
            F.col("_metadata.file_block_start").alias("block_no"),
            F.make_valid_utf8("value").alias("value"),
        )
        .filter(F.col("source_path").rlike(SUPPORTED))
        .withColumn("_id", F.monotonically_increasing_id())
    )
    return number_scan(stage(scan, "lines"))


def number_scan(scan: DataFrame) -> DataFrame:
    """(source_path, block_no, value, _id) to numbered raw lines."""
    totals = scan.groupBy("source_path", "block_no").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    starts = running_offset(totals, ["source_path"], "block_no", "_n", "_start").drop("_n")
    # One row per split, written once: its size is then known, and Spark broadcasts it only while that is small.
    starts = stage(starts, "splits")
    return scan.join(starts, ["source_path", "block_no"]).select(
        "source_path",
        F.element_at(F.split("source_path", "/"), -1).alias("source_file"),
        "block_no",
        (F.col("_start") + F.col("_id") - F.col("_first") + 1).alias("line_no"),
        "value",
    )


def lines_from_texts(texts: DataFrame) -> DataFrame:
    """Numbered lines of (source_file, content) rows, content being text or bytes; any line ending."""
    content = F.col("content")
    if dict(texts.dtypes)["content"] == "binary":
        content = F.make_valid_utf8(F.decode(content, "UTF-8"))
    path = F.col("source_path") if "source_path" in texts.columns else F.col("source_file")
    # A final line ending closes the last line and opens no new one.
    body = F.regexp_replace(content, r"(\r\n|\r|\n)\z", "")
    lines = F.when(content == "", F.array().cast("array<string>")).otherwise(F.split(body, r"\r\n|\r|\n"))
    return texts.select(path.alias("source_path"), "source_file", F.posexplode(lines).alias("_pos", "value")).select(
        "source_path",
        "source_file",
        F.floor(F.col("_pos") / BLOCK_ROWS).alias("block_no"),
        (F.col("_pos") + 1).cast("long").alias("line_no"),
        "value",
    )


def line_counts(raw_lines: DataFrame) -> DataFrame:
    """Physical lines per file."""
    return raw_lines.groupBy("source_path", "source_file").agg(F.count("*").alias("line_count"))
