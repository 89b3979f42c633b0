"""Row windows over an indexed timeline: context, pages, centred windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import display_time
from ..schema import order_columns


def context(indexed: DataFrame, anchors: DataFrame, n: int, index: str = "timeline_index") -> DataFrame:
    """The n rows before and after each anchor position (`anchors(anchor)`), with `marker` and `offset`.

    Every anchor names its 2n+1 positions; they meet the rows in an equi join.
    """
    wanted = anchors.select("anchor", F.explode(F.sequence(F.lit(-n), F.lit(n))).alias("offset")).withColumn(
        index, F.col("anchor") + F.col("offset")
    )
    marker = F.when(F.col("offset") == 0, "CENTER").when(F.col("offset") < 0, "before").otherwise("after")
    return indexed.join(wanted, index).withColumn("marker", marker)


def page(indexed: DataFrame, number: int, size: int, index: str = "timeline_index") -> DataFrame:
    """Page `number` (0-based) of a numbered result, of at least one row."""
    size = max(1, size)
    return indexed.filter(F.col(index).between(number * size, number * size + size - 1))


def centred(indexed: DataFrame, focus: int, size: int, index: str = "timeline_index") -> DataFrame:
    """A window of `size` rows around a position, moved inwards at both ends."""
    total = indexed.agg(F.count("*").alias("n")).scalar()
    width = F.least(F.lit(max(1, size)).cast("long"), total)
    start = F.greatest(F.lit(0), F.least(F.lit(focus) - F.floor(width / 2), total - width))
    return indexed.filter((F.col(index) >= start) & (F.col(index) < start + width))


def first_rows(entries: DataFrame, n: int) -> DataFrame:
    """The first n rows in timeline order."""
    return entries.orderBy(*order_columns()).limit(n)


def bookmark_timeline(indexed: DataFrame) -> DataFrame:
    """Time, type with SxFy and memo of the bookmarked rows, for rows that carry `bookmarked` and `memo`."""
    kind = F.concat_ws(" ", "log_type", "sxfy_type")
    return indexed.filter("bookmarked").select(
        display_time(F.col("timestamp")).alias("time"), kind.alias("type"), "memo", *_position(indexed)
    )


def _position(df: DataFrame) -> list[str]:
    return [c for c in ("position", "timeline_index") if c in df.columns][:1]
