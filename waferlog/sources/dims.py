"""Reference dimensions: event names, report variables, level names."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.text import strip

# Level names used when no level map can be read.
DEFAULT_LEVELS = {0: "Normal", 1: "Info", 3: "Fail", 6: "User", 11: "SEQ", 21: "CMS/GEM300", 31: "Alarm"}


def event_names(events: DataFrame, used: DataFrame | None = None) -> DataFrame:
    """(ceid, name) from `events(CEId, Name)`; only ids in `used(ceid)` if that is given. Names are trimmed."""
    ids = events.select(F.col("CEId").cast("long").alias("ceid"), F.coalesce(strip(F.col("Name")), F.lit("")).alias("name"))
    ids = ids.filter(F.col("ceid").isNotNull()).groupBy("ceid").agg(F.max("name").alias("name"))
    return ids if used is None else ids.join(used.select("ceid").distinct(), "ceid", "left_semi")


def report_variables(reports: DataFrame, variables: DataFrame, used: DataFrame | None = None) -> DataFrame:
    """(rptid, position, index_no, vid, name); positions count from 1 in Index_No order inside a report."""
    rv = reports.select(
        F.col("RepId").cast("long").alias("rptid"),
        F.col("Index_No").cast("int").alias("index_no"),
        F.col("VId").cast("long").alias("vid"),
    ).filter(F.col("rptid").isNotNull())
    if used is not None:
        rv = rv.join(used.select("rptid").distinct(), "rptid", "left_semi")
    names = variables.select(F.col("VId").cast("long").alias("vid"), F.col("Name").alias("name"))
    # A report lists the values of one message, so this window stays as small as a message body.
    place = Window.partitionBy("rptid").orderBy("index_no", "vid")
    return rv.join(names, "vid", "left").select(
        "rptid",
        F.row_number().over(place).alias("position"),
        "index_no",
        "vid",
        F.coalesce(strip(F.col("name")), F.lit("")).alias("name"),
    )


def search_events(events: DataFrame, term: str, limit: int | None = None) -> DataFrame:
    """Ids or names that contain the term (`%` and `_` act as wildcards), by id, all of them or the first `limit`; a blank term finds none."""
    term = term.strip()
    found = event_names(events)
    if not term:
        return found.limit(0)
    like = "%" + term.replace("\\", "\\\\") + "%"
    found = found.filter(F.col("ceid").cast("string").like(like) | F.col("name").ilike(like)).orderBy("ceid")
    return found if limit is None else found.limit(max(1, int(limit)))


def read_reference(spark: SparkSession, url: str, table: str, **options) -> DataFrame:
    """A reference table over JDBC; the driver class comes with the cluster."""
    return spark.read.jdbc(url, table, properties={k: str(v) for k, v in options.items()})


def load_levels(path: str | None = None) -> dict[int, str]:
    """Level names from a file in any store Spark reads: `index: name` lines, indented under a heading. No path gives the built-in names,
    an unreadable one the short default."""
    from ..operators.entries import LEVELS

    if path is None:
        return dict(LEVELS)
    spark = SparkSession.getActiveSession()
    pattern = r"^\s+(\d+)\s*:\s*[\"']?(.*?)[\"']?\s*(?:#.*)?$"
    try:
        lines = spark.read.text(path)
    except AnalysisException:
        return dict(DEFAULT_LEVELS)
    found = lines.filter(F.col("value").rlike(pattern)).select(
        F.regexp_extract("value", pattern, 1).cast("int").alias("level"), F.regexp_extract("value", pattern, 2).alias("name"))
    return {row["level"]: row["name"] for row in found.collect()}
