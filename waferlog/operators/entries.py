"""Typed entries from assembled lines, their order, and the load counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import secs
from ..functions.text import extract, parse_time, rstrip, strip, sxfy_type
from ..schema import ENTRIES, MMI, SECS, order_columns, text_once, text_whole
from .assemble import assemble
from .detect import SECS_HEADER
from .ordered import dense_index

# Level names by colour index.
LEVELS = {
    0: "Normal", 1: "Info", 2: "Warning", 3: "Fail", 4: "Debug", 5: "Trace", 6: "User", 7: "System",
    8: "Network", 9: "IO", 10: "Motion", 11: "SEQ", 12: "Vision", 13: "Recipe", 14: "Host", 15: "Remote",
    16: "Database", 17: "Script", 18: "Safety", 19: "Maintenance", 20: "Calibration", 21: "CMS/GEM300",
    22: "Material", 23: "Process", 24: "Quality", 25: "Statistics", 26: "Report", 27: "Custom",
    28: "Reserved", 29: "Reserved2", 30: "Reserved3", 31: "Alarm",
}

_COUNT_SUFFIX = r"-->\[Count:(\d+)\]\s*$"

# Text that marks an object event, lower case.
OBJECT_HINTS = (
    "carrierobject::statechange",
    "carrierobject::clearcarrierinfo",
    "loadportobject::statechange",
    "substrateobject::initialize",
    "[cms]",
    "deletejoblist",
)


def level_name(color: Column, levels: dict[int, str] | None = None) -> Column:
    pairs = [F.lit(x) for item in (levels or LEVELS).items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), color), F.concat(F.lit("Level"), color.cast("string")))


def alarm_predicate(message: Column, color: Column, level: Column) -> Column:
    """Colour 31, level `alarm`, or `[alarm]` / `alarm code` in the text, in any case."""
    lowered = F.lower(message)
    hit = (
        (color == 31)
        | (F.lower(level) == "alarm")
        | F.contains(lowered, F.lit("[alarm]"))
        | F.contains(lowered, F.lit("alarm code"))
    )
    return F.coalesce(hit, F.contains(lowered, F.lit("[alarm]")) | F.contains(lowered, F.lit("alarm code")))


def object_hint(message: Column) -> Column:
    lowered = F.lower(message)
    hit = F.lit(False)
    for text in OBJECT_HINTS:
        hit = hit | F.contains(lowered, F.lit(text))
    return hit


def in_ranges(value: Column, ranges) -> Column:
    """Is the value inside any inclusive (start, end) range? NULL is in none."""
    hit = F.lit(False)
    for start, end in ranges:
        hit = hit | value.between(start, end)
    return F.coalesce(hit, F.lit(False))


def dated_rows(
    raw_lines: DataFrame,
    dialects: DataFrame | None = None,
    *,
    skip_setup_dump: bool = True,
    default_date: str | None = None,
    fallback: bool = True,
) -> DataFrame:
    """Assembled rows with their timestamp, still without the typed columns."""
    rows = assemble(raw_lines, dialects, skip_setup_dump, fallback)
    day = F.coalesce(extract(F.col("source_file"), r"(\d{4}-\d{2}-\d{2})", 1), F.lit(default_date).cast("string"))
    clock = F.substring("head", 1, 12)
    written = F.when(F.col("dialect") == MMI, F.substring("head", 1, 23)).otherwise(F.concat(day, F.lit(" "), clock))
    return rows.withColumn("timestamp", parse_time(written))


def typed_columns(rows: DataFrame, levels: dict[int, str] | None = None) -> DataFrame:
    """The columns of an entry from `dialect`, `head` and `tail`; other columns are kept."""
    mmi = F.col("dialect") == MMI
    fields = F.split("head", r"\|", 4)
    text = F.get(fields, F.lit(3))
    counted = F.contains("head", F.lit("-->[Count:")) & text.rlike(_COUNT_SUFFIX)
    rows = rows.withColumns(
        {
            "first": F.when(
                mmi, F.when(counted, rstrip(F.regexp_replace(text, _COUNT_SUFFIX, ""))).otherwise(text)
            ).otherwise(strip(F.regexp_extract("head", SECS_HEADER, 3))),
            "repeat_count": F.when(mmi & counted, F.regexp_extract(text, _COUNT_SUFFIX, 1).try_cast("long")),
            "color_index": F.when(mmi, F.get(fields, F.lit(1)).try_cast("int")),
            "seq_index": F.when(mmi, F.get(fields, F.lit(2)).try_cast("long")),
            "channel": F.when(~mmi, F.regexp_extract("head", SECS_HEADER, 2).try_cast("int")),
        }
    )
    rows = rows.withColumns(
        {
            "message": F.concat_ws("\n", "first", "tail"),
            "raw_line": F.concat_ws("\n", "head", "tail"),
            "level_name": F.when(mmi, level_name(F.col("color_index"), levels)),
        }
    )
    message = F.col("message")
    return rows.withColumns(
        {
            "log_type": F.col("dialect"),
            "secs_message": F.when(~mmi, message),
            "ceid": F.when(~mmi, secs.message_ceid(message)),
            "event_name": F.lit(None).cast("string"),
            "is_setup_dump": F.col("in_dump"),
            "sxfy_type": sxfy_type(message),
            "s6f11_rptids": F.when(~mmi, secs.message_rptids(message)).otherwise(F.array().cast("array<bigint>")),
            "is_alarm": alarm_predicate(message, F.col("color_index"), F.col("level_name")),
            "is_object_event": mmi & object_hint(message),
        }
    )


def _excluded(ranges) -> Column:
    """The three points at which an id drops an entry: in the header, as second number of the tail, at the end."""
    if not ranges:
        return F.lit(False)
    early = F.coalesce(
        secs.inline_ceid(F.col("first")),
        F.when(F.contains(F.col("first"), F.lit("S6F11")), secs.second_number(F.col("tail"))),
    )
    return (F.col("dialect") != MMI) & (in_ranges(early, ranges) | in_ranges(F.col("ceid"), ranges))


def parse_entries(
    raw_lines: DataFrame,
    dialects: DataFrame | None = None,
    *,
    skip_setup_dump: bool = True,
    excluded_ceids=(),
    levels: dict[int, str] | None = None,
    default_date: str | None = None,
    fallback: bool = True,
    keep_all: bool = False,
) -> DataFrame:
    """Entries of all files, unordered. `keep_all` also returns dropped rows, with a `dropped` reason column."""
    rows = dated_rows(
        raw_lines, dialects, skip_setup_dump=skip_setup_dump, default_date=default_date, fallback=fallback
    )
    typed = typed_columns(rows, levels).withColumn("dropped", _dropped(skip_setup_dump, excluded_ceids))
    if keep_all:
        return typed.select(*ENTRY_COLUMNS, "dropped")
    return typed.filter(F.col("dropped").isNull()).select(*ENTRY_COLUMNS)


def _dropped(skip_setup_dump: bool, excluded_ceids) -> Column:
    return (
        F.when(F.col("timestamp").isNull(), "bad timestamp")
        .when(F.col("in_dump") if skip_setup_dump else F.lit(False), "setup dump")
        .when(_excluded(excluded_ceids), "excluded ceid")
    )


def parse_timeline(raw_lines: DataFrame, dialects: DataFrame | None = None, **options) -> DataFrame:
    """`timeline(parse_entries(...))`, with the typed columns made only once, after the sort.

    The sorted rows are stored with the text once: `raw_line` and `secs_message` are put together from the header line and the message
    when they are read.
    """
    if options.get("excluded_ceids"):
        return timeline(parse_entries(raw_lines, dialects, **options))
    levels = options.pop("levels", None)
    options.pop("excluded_ceids", None)
    skip = options.get("skip_setup_dump", True)
    rows = dated_rows(raw_lines, dialects, **options).filter(F.col("timestamp").isNotNull())
    rows = (rows.filter(~F.col("in_dump")) if skip else rows).withColumn("log_type", F.col("dialect"))
    stored = [c for c in ENTRY_COLUMNS if c not in ("raw_line", "secs_message")]
    indexed = dense_index(
        rows,
        order_columns(),
        "timeline_index",
        "timeline",
        lambda sorted_rows: typed_columns(sorted_rows, levels).select(*stored, "head", "_pos"),
    )
    line_end = F.instr("message", "\n")
    rest = F.when(line_end > 0, F.substring("message", line_end, F.length("message"))).otherwise("")
    whole = indexed.withColumns({"raw_line": F.concat("head", rest), "secs_message": F.when(F.col("log_type") != MMI, F.col("message"))})
    return whole.select(*ENTRY_COLUMNS, "timeline_index")


def rejected_lines(raw_lines: DataFrame, dialects: DataFrame | None = None, **options) -> DataFrame:
    """Headers with an impossible date or time, which are kept out of the timeline."""
    everything = parse_entries(raw_lines, dialects, keep_all=True, **options)
    return everything.filter(F.col("dropped") == "bad timestamp").select(
        "source_path", "source_file", "line_no", "raw_line"
    )


def merge(*entry_frames: DataFrame) -> DataFrame:
    """All entries of all files, as a bag."""
    merged = entry_frames[0]
    for frame in entry_frames[1:]:
        merged = merged.unionByName(frame)
    return merged


def timeline(entries: DataFrame) -> DataFrame:
    """Add the dense 0-based `timeline_index` in (timestamp, MMI first, file, line) order."""
    return text_whole(dense_index(text_once(entries), order_columns(), "timeline_index", "timeline"))


def position_of(timeline_df: DataFrame, keys: DataFrame) -> DataFrame:
    """Timeline positions of (source_path, line_no) keys."""
    return timeline_df.join(keys, ["source_path", "line_no"]).select("source_path", "line_no", "timeline_index")


def load_counters(parsed_all: DataFrame) -> DataFrame:
    """One row of totals over `parse_entries(..., keep_all=True)`."""
    kept = F.col("dropped").isNull()
    return parsed_all.agg(
        F.count_if(kept).alias("entries"),
        F.count_if(kept & (F.col("log_type") == MMI)).alias("mmi_entries"),
        F.count_if(kept & (F.col("log_type") == SECS)).alias("secs_entries"),
        F.count_if(F.col("dropped") == "setup dump").alias("skipped_setup_entries"),
        F.count_if(kept & F.col("ceid").isNotNull()).alias("entries_with_ceid"),
    )


ENTRY_COLUMNS = ENTRIES.fieldNames()
