"""Column contracts shared by every operator."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

MMI = "MMI"
SECS = "SECS"
UNKNOWN = "UNKNOWN"

# One physical line. `block_no` rises with `line_no` inside a file and bounds every per-file
# window: no window is ever keyed by the file alone.
RAW_LINES = T.StructType(
    [
        T.StructField("source_path", T.StringType(), False),
        T.StructField("source_file", T.StringType(), False),
        T.StructField("block_no", T.LongType(), False),
        T.StructField("line_no", T.LongType(), False),
        T.StructField("value", T.StringType(), False),
    ]
)

ENTRIES = T.StructType(
    [
        T.StructField("source_path", T.StringType(), False),
        T.StructField("source_file", T.StringType(), False),
        T.StructField("line_no", T.LongType(), False),
        T.StructField("timestamp", T.TimestampNTZType()),
        T.StructField("log_type", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("raw_line", T.StringType()),
        T.StructField("color_index", T.IntegerType()),
        T.StructField("seq_index", T.LongType()),
        T.StructField("level_name", T.StringType()),
        T.StructField("channel", T.IntegerType()),
        T.StructField("secs_message", T.StringType()),
        T.StructField("ceid", T.LongType()),
        T.StructField("event_name", T.StringType()),
        T.StructField("is_setup_dump", T.BooleanType()),
        T.StructField("repeat_count", T.LongType()),
        T.StructField("sxfy_type", T.StringType()),
        T.StructField("s6f11_rptids", T.ArrayType(T.LongType())),
        T.StructField("is_alarm", T.BooleanType()),
        T.StructField("is_object_event", T.BooleanType()),
    ]
)

ENTRY_KEY = ["source_path", "line_no"]


def entry_frame(spark, rows) -> "DataFrame":  # noqa: F821
    """Entries from dict rows; columns that a row does not name become NULL (tests, small inputs)."""
    names = ENTRIES.fieldNames()
    data = []
    for row in rows:
        full = dict(row)
        full.setdefault("source_path", full["source_file"])
        data.append(tuple(full.get(name) for name in names))
    return spark.createDataFrame(data, ENTRIES)


def shown(entries) -> Column:
    """The text that users see and search: the annotated message where there is one."""
    return F.col("display_message") if "display_message" in entries.columns else F.col("message")


def type_order() -> Column:
    """MMI sorts before every other dialect on an equal timestamp."""
    return F.when(F.col("log_type") == MMI, 0).otherwise(1)


def order_columns() -> list[Column]:
    """Total timeline order."""
    return [F.col("timestamp"), type_order(), F.col("source_file"), F.col("line_no"), F.col("source_path")]


def order_key() -> Column:
    """The same order as one comparable value, so `min(order_key())` means "first seen"."""
    return F.struct(
        F.col("timestamp"),
        type_order().alias("type_order"),
        F.col("source_file"),
        F.col("line_no"),
        F.col("source_path"),
    )


def first_seen(df) -> Column:
    """What to take the minimum of for "first seen": the timeline index if the rows have one, else the order key.

    The index is a plain number, which hash aggregation can keep; the key is not, and makes Spark sort.
    """
    return F.col("timeline_index") if "timeline_index" in df.columns else order_key()


def entry_key() -> Column:
    """Bookmark key: file|line|displayed time."""
    from .functions.text import display_time

    return F.concat_ws("|", F.col("source_file"), F.col("line_no").cast("string"), display_time(F.col("timestamp")))


def text_once(entries) -> "DataFrame":  # noqa: F821
    """Entries whose text is held once, for shuffles and staged tables; `text_whole` gives back the same rows.

    A raw line that ends with its message keeps what comes before it, and a SECS message that is the row's own message goes.
    """
    ends, own = F.endswith("raw_line", "message"), F.when(F.col("log_type") != MMI, F.col("message"))
    before = F.substring("raw_line", F.lit(1), F.length("raw_line") - F.length("message"))
    return entries.withColumns({
        "_ends": F.coalesce(ends, F.lit(False)),
        "_own": F.col("secs_message").eqNullSafe(own),
        "raw_line": F.when(ends, before).otherwise(F.col("raw_line")),
        "secs_message": F.when(~F.col("secs_message").eqNullSafe(own), F.col("secs_message")),
    })


def text_whole(packed) -> "DataFrame":  # noqa: F821
    own = F.when(F.col("log_type") != MMI, F.col("message"))
    return packed.withColumns({
        "raw_line": F.when(F.col("_ends"), F.concat("raw_line", "message")).otherwise(F.col("raw_line")),
        "secs_message": F.when(F.col("_own"), own).otherwise(F.col("secs_message")),
    }).drop("_ends", "_own")
