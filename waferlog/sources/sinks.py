"""Writing results: CSV of the display rows, log text, report text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


# Labels of the display columns.
LABELS = {
    "bookmark": "북마크",
    "memo": "메모",
    "time": "시간",
    "time_delta": "간격",
    "type": "로그타입",
    "matched_keywords": "매칭 키워드",
    "level_channel": "레벨/채널",
    "ceid": "CEID",
    "event_name": "이벤트명",
    "file": "파일",
    "line": "라인",
    "message": "메시지",
}


def write_csv(rows: DataFrame, path: str, order: str | None = None) -> None:
    """Display rows as labelled CSV part files; with `order`, the parts follow that column. No byte-order mark."""
    if order:
        rows = rows.orderBy(order)
    labelled = rows.select(*[F.col(name).alias(label) for name, label in LABELS.items()])
    labelled.write.option("header", True).option("encoding", "UTF-8").option("escape", '"').mode("overwrite").csv(path)


def log_text(message: Column, raw_line: Column) -> Column:
    """An entry as log text: the header's original prefix, then the (annotated) message."""
    raw_first = F.get(F.split(raw_line, "\n"), F.lit(0))
    first = F.get(F.split(message, "\n"), F.lit(0))
    prefix = F.substring(raw_first, F.lit(1), F.length(raw_first) - F.length(first))
    return (
        F.when(F.coalesce(raw_line, F.lit("")) == "", message)
        .when(message == "", raw_line)
        .when(F.endswith(raw_first, first), F.concat(prefix, message))
        .otherwise(raw_line)
    )


def as_log_text(entries: DataFrame) -> DataFrame:
    message = F.col("display_message") if "display_message" in entries.columns else F.col("message")
    return entries.withColumn("text", log_text(message, F.col("raw_line")))


def write_log_text(entries: DataFrame, path: str, order: list[Column]) -> None:
    """Entries as text, a blank line between them."""
    as_log_text(entries).orderBy(*order).select("text").write.option("lineSep", "\n\n").mode("overwrite").text(path)


def write_report(report: DataFrame, path: str) -> None:
    """A report is bounded (see plans.report), so one file holds it."""
    lines = report.orderBy("section", "ord").select("text")
    lines.coalesce(1).write.mode("overwrite").text(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, text) of a written report, numbered from 1; its one bounded file is one row of text."""
    whole = spark.read.text(path, wholetext=True)
    lines = F.posexplode(F.split(F.regexp_replace("value", "\\n$", ""), "\n")).alias("_no", "text")
    return whole.select(lines).select((F.col("_no") + 1).cast("long").alias("line_no"), "text")


def write_bookmarks(bookmarks: DataFrame, path: str) -> None:
    """`bookmarks(entry_key, memo)` as JSON lines; an entry that is marked twice keeps one memo, the larger text."""
    marks = bookmarks.filter("entry_key IS NOT NULL").groupBy("entry_key").agg(F.max(F.coalesce("memo", F.lit(""))).alias("memo"))
    marks.write.mode("overwrite").json(path)


def read_bookmarks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("entry_key string, memo string").json(path)


__all__ = ["LABELS", "as_log_text", "log_text", "read_bookmarks", "read_report", "write_bookmarks", "write_csv", "write_log_text", "write_report"]
