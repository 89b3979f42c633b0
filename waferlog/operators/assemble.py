"""Physical lines to multi-line entries, for both dialects in one pass.

Two things run along a file: which header a line belongs to, and whether a setup dump is open. Both are carried
over blocks instead of over files: a slim first pass reduces each block to its last header and last dump event, a
window over these few rows per file hands them to the next block, and the line pass then works inside blocks only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import is_blank, parse_time, rstrip
from ..schema import MMI, SECS, UNKNOWN
from .detect import dialect_of, is_mmi_header, is_secs_header

BLOCK = ["source_path", "block_no"]

# Fixed patterns of the lines that open and close a setup dump.
SETUP_START = r"(?iu)\[.+?\.ini\] LOGGING"
SETUP_FINISH = r"(?iu)\[.+?\.ini\] FINISH"

# A dump event whose effect depends on the entry that was open when the block began.
_ASK_HEADER = 2
_ASK_START = 3
_ASK_ENTRY = 4


def _flags(raw_lines: DataFrame) -> DataFrame:
    value = F.col("value")
    marked = F.contains(F.lower(value), F.lit(".ini] "))
    return raw_lines.withColumns(
        {
            "m_head": is_mmi_header(value),
            "start": marked & value.rlike(SETUP_START),
            "finish": marked & value.rlike(SETUP_FINISH) & ~value.rlike(SETUP_START),
        }
    )


def _plain_color(value: Column) -> Column:
    return F.get(F.split(value, r"\|", 3), F.lit(1)).try_cast("int") == 1


def _secs_mark() -> Column:
    """TRUE on a SECS header, FALSE on a line that closes the open entry, NULL otherwise."""
    value = F.col("value")
    loose = ~F.startswith(value, F.lit(" ")) & ~F.startswith(value, F.lit("\t")) & ~is_blank(value)
    return F.when(is_secs_header(value), True).when(loose, False)


def _dump_event(header: Column, start_line: Column, flag_only: bool) -> Column:
    """1 opens, 0 closes, NULL leaves the dump state; 2 to 4 wait for the previous block.

    `header` is the last MMI header of the block so far, `start_line` the block's last start marker so far.
    """
    at_header = (
        F.when(F.col("start"), 1).when(F.col("finish"), 0).when(~F.coalesce(F.col("plain"), F.lit(False)), 0)
    )
    if flag_only:
        # A start anywhere in an entry outweighs its finish.
        closing = F.when(
            header.isNotNull(), F.when(F.coalesce(start_line >= header["line_no"], F.lit(False)), 1).otherwise(0)
        ).otherwise(F.when(start_line.isNotNull(), _ASK_ENTRY).otherwise(_ASK_START))
        opening = F.when(header.isNull(), _ASK_ENTRY).otherwise(1)
        inside = F.when(F.col("start"), opening).when(F.col("finish"), closing)
    else:
        # Lines under a dropped header are not looked at: after a finish header the dump stays closed.
        opening = F.when(header.isNull(), _ASK_HEADER).when(header["finish"], 0).otherwise(1)
        inside = F.when(F.col("start"), opening)
    return F.when(F.col("m_head"), at_header).otherwise(inside)


def _settle(event: Column, header: Column, start_line: Column) -> Column:
    """Replace a waiting event by its value, given what the earlier blocks carried in."""
    by_header = F.when(header.isNull() | header["finish"], 0).otherwise(1)
    by_start = F.when(F.coalesce(start_line >= header["line_no"], F.lit(False)), 1).otherwise(0)
    by_entry = F.when(header.isNull(), 0).otherwise(1)
    return (
        F.when(event == _ASK_HEADER, by_header)
        .when(event == _ASK_START, by_start)
        .when(event == _ASK_ENTRY, by_entry)
        .otherwise(event)
    )


def _running_marks(lines: DataFrame, keys: list[str], flag_only: bool) -> DataFrame:
    """Add the last MMI header and, where flags need it, the last start marker of the block up to each line."""
    inside = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    header = F.when(F.col("m_head"), F.struct("line_no", "finish"))
    start_line = F.when(F.col("start"), F.col("line_no"))
    last_start = F.max(start_line).over(inside) if flag_only else F.lit(None).cast("long")
    return lines.withColumns({"header": F.last(header, ignorenulls=True).over(inside), "start_line": last_start})


def _block_carries(raw_lines: DataFrame, flag_only: bool) -> DataFrame:
    """Per block: what the file's earlier blocks leave open, whether the file keeps an MMI entry (`keeps_mmi`), and what its
    length and first line say about its dialect. Only marker lines are shuffled for it."""
    value = F.col("value")
    marks = (
        _flags(raw_lines)
        .withColumn("s_mark", _secs_mark())
        .filter("m_head OR start OR finish OR s_mark IS NOT NULL")
        .withColumns({"plain": F.col("m_head") & _plain_color(value), "timed": F.col("m_head") & parse_time(F.substring(value, 1, 23)).isNotNull()})
        .select(*BLOCK, "line_no", "m_head", "start", "finish", "plain", "timed", "s_mark")
    )
    marks = _running_marks(marks, BLOCK, flag_only)
    marks = marks.withColumn("event", _dump_event(F.col("header"), F.col("start_line"), flag_only))
    # TRUE on a header, FALSE on another dump marker: an entry is closed by a header, and marked by the latter.
    kind = F.when(F.col("m_head"), True).when(F.col("start") | F.col("finish"), False)
    # What follows a line is looked up from the other end: a frame that starts at the line is gone through anew for each one.
    ordered, reversed_ = Window.partitionBy(*BLOCK).orderBy("line_no"), Window.partitionBy(*BLOCK).orderBy(F.desc("line_no"))
    marks = marks.withColumn("kind", kind).withColumns({
        "state": F.last("event", ignorenulls=True).over(ordered.rowsBetween(Window.unboundedPreceding, 0)),
        "next_kind": F.last("kind", ignorenulls=True).over(reversed_.rowsBetween(Window.unboundedPreceding, -1)),
    })
    candidate = F.col("timed") & (F.lit(flag_only) | ~(F.col("start") | F.col("finish")))
    last = marks.groupBy(*BLOCK).agg(
        F.max(F.when(F.col("m_head"), F.struct("line_no", "finish"))).alias("header"),
        F.max(F.when(F.col("start"), F.col("line_no"))).alias("start_line"),
        F.max(F.when(F.col("event").isNotNull(), F.struct("line_no", "event")))["event"].alias("event"),
        F.max(F.when(F.col("s_mark").isNotNull(), F.struct("line_no", "s_mark"))).alias("s_mark"),
        F.min(F.when(F.col("kind").isNotNull(), F.struct("line_no", "kind")))["kind"].alias("first_kind"),
        # Four states and three kinds at most.
        F.collect_set(F.when(candidate, F.struct("state", "next_kind"))).alias("candidates"),
    )
    opening = F.col("line_no") == 1
    blocks = raw_lines.groupBy(*BLOCK).agg(
        F.max("line_no").alias("last_line"),
        F.bool_or(opening & is_mmi_header(value)).alias("opens_mmi"),
        F.bool_or(opening & is_secs_header(value)).alias("opens_secs"),
    )
    file = Window.partitionBy("source_path")
    earlier = file.orderBy("block_no").rowsBetween(Window.unboundedPreceding, -1)
    later = file.orderBy(F.desc("block_no")).rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.join(last, BLOCK, "left").select(
        *BLOCK,
        "event",
        "candidates",
        F.max("last_line").over(file).alias("line_count"),
        F.max("opens_mmi").over(file).alias("opens_mmi"),
        F.max("opens_secs").over(file).alias("opens_secs"),
        F.last("first_kind", ignorenulls=True).over(later).alias("next_first"),
        F.last("header", ignorenulls=True).over(earlier).alias("c_header"),
        F.max("start_line").over(earlier).alias("c_start"),
        F.last("s_mark", ignorenulls=True).over(earlier).alias("c_s_mark"),
    )
    settled = _settle(F.col("event"), F.col("c_header"), F.col("c_start"))
    carried = carried.withColumn("event", settled).withColumn("c_dump", F.last("event", ignorenulls=True).over(earlier))

    def kept(entry: Column) -> Column:
        state = F.coalesce(_settle(entry["state"], F.col("c_header"), F.col("c_start")), F.col("c_dump"), F.lit(0))
        return F.lit(flag_only) | ((state == 0) & F.coalesce(entry["next_kind"], F.col("next_first"), F.lit(True)))

    keeps = F.coalesce(F.exists("candidates", kept), F.lit(False))
    return carried.select(
        *BLOCK, "c_header", "c_start", "c_s_mark", "c_dump", "line_count", "opens_mmi", "opens_secs", F.max(keeps).over(file).alias("keeps_mmi"))


def assemble(
    raw_lines: DataFrame,
    dialects: DataFrame | None = None,
    skip_setup_dump: bool = True,
    fallback: bool = True,
) -> DataFrame:
    """One row per header line: (source_path, source_file, dialect, line_no, head, tail, in_dump).

    `head` is the header line, `tail` its continuation lines joined by a line feed (NULL without any). `in_dump`
    says that the entry belongs to a setup dump. A file of unknown dialect is read as MMI if that keeps at least one
    entry, else as SECS; the block pass already knows which, so its lines are read once. `fallback=False` leaves such
    files as they are. A `dialect` column of `raw_lines` is used as it is; else `dialects`, else the detected ones.
    """
    named = "dialect" in raw_lines.columns
    blocks = _block_carries(raw_lines, not skip_setup_dump)
    if not named:
        # The dialect is settled per block, so that lines never meet on a (maybe huge) file.
        blocks = blocks.join(dialects, "source_path") if dialects is not None else blocks.withColumn("dialect", dialect_of(blocks))
    # One row per block is the build side; the lines move once, and stay in place for the block windows.
    lines = _flags(raw_lines).join(blocks.drop("line_count", "opens_mmi", "opens_secs").hint("shuffle_hash"), BLOCK)
    if fallback:
        settled = F.when(F.col("dialect") != UNKNOWN, F.col("dialect")).when(F.col("keeps_mmi"), MMI).otherwise(SECS)
        lines = lines.withColumn("dialect", settled)

    mmi = F.col("dialect") == MMI
    lines = lines.withColumns(
        {
            "s_mark": F.when(~mmi, _secs_mark()),
            "plain": F.col("m_head") & _plain_color(F.col("value")),
            "m_head": mmi & F.col("m_head"),
            "start": mmi & F.col("start"),
            "finish": mmi & F.col("finish"),
        }
    )
    inside = (
        Window.partitionBy(*BLOCK, "dialect").orderBy("line_no")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    mark = F.last(F.when(F.col("s_mark").isNotNull(), F.struct("line_no", "s_mark")), ignorenulls=True).over(inside)
    lines = _running_marks(lines, [*BLOCK, "dialect"], not skip_setup_dump).withColumn("mark", mark)
    lines = lines.withColumn(
        "event", F.when(mmi, _dump_event(F.col("header"), F.col("start_line"), not skip_setup_dump))
    )
    event = _settle(F.last("event", ignorenulls=True).over(inside), F.col("c_header"), F.col("c_start"))
    mark = F.coalesce("mark", "c_s_mark")
    owner = F.when(mmi, F.coalesce("header", "c_header")["line_no"]).when(mark["s_mark"], mark["line_no"])
    is_head = F.col("line_no") == F.col("owner")
    lines = (
        lines.withColumns({"owner": owner, "dump": F.coalesce(event, "c_dump", F.lit(0))})
        .filter(F.col("owner").isNotNull() & (is_head | ~is_blank(F.col("value"))))
        .select("source_path", "source_file", "dialect", "owner", "line_no", "value", "dump",
                (F.col("start") | F.col("finish")).alias("marked"))
    )
    piece = F.when(mmi, F.col("value")).otherwise(rstrip(F.col("value")))
    grouped = lines.groupBy("source_path", "source_file", "dialect", "owner").agg(
        F.max(F.when(is_head, F.col("value"))).alias("head"),
        F.collect_list(F.when(~is_head, F.struct("line_no", piece.alias("piece")))).alias("tail"),
        F.max(F.when(is_head, F.col("dump"))).alias("dump_before"),
        F.max(F.struct("line_no", "dump"))["dump"].alias("dump_after"),
        F.bool_or("marked").alias("marked"),
    )
    in_dump = (
        F.col("marked") | (F.col("dump_before") == 1) if skip_setup_dump else F.col("dump_after") == 1
    ) & (F.col("dialect") == MMI)
    return grouped.select(
        "source_path",
        "source_file",
        "dialect",
        F.col("owner").alias("line_no"),
        "head",
        F.when(
            F.size("tail") > 0, F.array_join(F.transform(F.array_sort("tail"), lambda p: p["piece"]), "\n")
        ).alias("tail"),
        in_dump.alias("in_dump"),
    )

