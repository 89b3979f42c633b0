"""Row filters, bookmark rules and the composed filter of a search specification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import clean_keywords, display_time, gap_text, keyword_predicate, moment, strip, to_millis
from ..schema import ENTRY_KEY, SECS, entry_key, order_columns, shown
from ..spec import FilterSpec
from .ordered import dense_index, gaps_on_index, with_previous
from .search import combine, joined


def by_log_type(entries: DataFrame, log_types) -> DataFrame:
    """Keep the chosen types; an empty choice keeps nothing."""
    return entries.filter(F.col("log_type").isin(*log_types) if log_types else F.lit(False))


def sxfy_predicate(chosen) -> Column:
    """SECS rows must carry one of the chosen types; other rows pass."""
    return (F.col("log_type") != SECS) | F.coalesce(F.col("sxfy_type").isin(*chosen) if chosen else F.lit(False), F.lit(False))


def by_sxfy(entries: DataFrame, chosen) -> DataFrame:
    return entries if chosen is None else entries.filter(sxfy_predicate(chosen))


def within(entries: DataFrame, anchors: DataFrame, seconds: int) -> DataFrame:
    """Entries at most `seconds` before or after any row of `anchors(timestamp)`.

    Time is cut into buckets as wide as the window. A bucket only needs its first and last anchor: an anchor in the
    entry's own bucket always matches, the bucket before matters through its last anchor, the one after through its
    first. So every entry meets at most one row, however many anchors there are.
    """
    span = seconds * 1000
    width = max(span, 1)
    bucket = lambda ms: F.floor(ms / width)
    own = anchors.select(to_millis(F.col("timestamp")).alias("_a")).groupBy(bucket(F.col("_a")).alias("_b")).agg(
        F.min("_a").alias("_lo"), F.max("_a").alias("_hi")
    )
    around = own.select(
        F.explode(F.array(*[F.struct((F.col("_b") + step).alias("_bucket"), F.lit(step).alias("_step")) for step in (-1, 0, 1)])).alias("_x"),
        "_lo",
        "_hi",
    ).select("_x.*", "_lo", "_hi")
    reach = around.groupBy("_bucket").agg(
        F.bool_or(F.col("_step") == 0).alias("_own"),
        F.max(F.when(F.col("_step") == 1, F.col("_hi"))).alias("_last"),
        F.min(F.when(F.col("_step") == -1, F.col("_lo"))).alias("_next"),
    )
    ms = to_millis(F.col("timestamp"))
    near = F.col("_own") | (ms - F.col("_last") <= span) | (F.col("_next") - ms <= span)
    return (
        entries.withColumn("_bucket", bucket(ms))
        .join(reach, "_bucket")
        .filter(F.coalesce(near, F.lit(False)))
        .drop("_bucket", "_own", "_last", "_next")
    )


def around_time(entries: DataFrame, anchor, seconds: int) -> DataFrame:
    """The window of one anchor, given as a moment."""
    at = moment(anchor)
    wide = F.make_dt_interval(secs=F.lit(seconds))
    return entries.filter(F.col("timestamp").between(at - wide, at + wide))


def from_anchor(entries: DataFrame, anchor, direction: str) -> DataFrame:
    """Everything at or after, or at or before, the anchor."""
    at = moment(anchor)
    return entries.filter(F.col("timestamp") >= at if direction == "after" else F.col("timestamp") <= at)


def roll_time_range(specs: DataFrame, default_date: str) -> DataFrame:
    """Clock texts (`start_text`, `end_text`, HH:mm[:ss[.SSS]]) to a range; an earlier end means the next day."""
    def moment(text: Column) -> Column:
        dated = F.concat(F.lit(default_date + " "), strip(text))
        forms = ("yyyy-MM-dd HH:mm:ss.SSS", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm")
        return F.coalesce(*[F.try_to_timestamp(dated, F.lit(f)) for f in forms]).cast("timestamp_ntz")

    start, end = moment(F.col("start_text")), moment(F.col("end_text"))
    day = F.make_dt_interval(days=F.lit(1))
    return specs.withColumns({"start": start, "end": F.when(end < start, end + day).otherwise(end)})


def with_bookmarks(entries: DataFrame, bookmarks: DataFrame) -> DataFrame:
    """Add `bookmarked` and `memo` from `bookmarks(entry_key, memo)`."""
    marks = bookmarks.groupBy("entry_key").agg(F.max("memo").alias("memo"))
    return (
        entries.withColumn("entry_key", entry_key())
        .join(marks.withColumn("bookmarked", F.lit(True)), "entry_key", "left")
        .withColumns({"bookmarked": F.coalesce("bookmarked", F.lit(False)), "memo": F.coalesce("memo", F.lit(""))})
    )


def bookmark_only(entries: DataFrame, bookmarks: DataFrame) -> DataFrame:
    return (
        entries.withColumn("entry_key", entry_key())
        .join(bookmarks.select("entry_key").distinct(), "entry_key", "left_semi")
        .drop("entry_key")
    )


def apply_spec(
    entries: DataFrame,
    spec: FilterSpec,
    bookmarks: DataFrame | None = None,
    named: dict[str, DataFrame] | None = None,
) -> DataFrame:
    """Entries that pass the specification, with `matched_keywords` ('' where no keyword decided).

    `named` maps a keyword to the entry keys that its reference names hit (see `reference_matches`); these count as
    keyword hits. A specification without any keyword keeps all rows that pass the other filters.
    """
    rows = entries
    keep = F.col("log_type").isin(*spec.log_types) if spec.log_types else F.lit(False)
    if spec.sxfy is not None:
        keep = keep & sxfy_predicate(spec.sxfy)
    if spec.start is not None:
        keep = keep & (F.col("timestamp") >= moment(spec.start))
    if spec.end is not None:
        keep = keep & (F.col("timestamp") <= moment(spec.end))
    rows = rows.filter(keep)

    marked = F.lit(False)
    if bookmarks is not None and (spec.bookmark_only or spec.always_include_bookmarks):
        rows = with_bookmarks(rows, bookmarks)
        marked = F.col("bookmarked")
        if spec.bookmark_only:
            rows = rows.filter(marked)
    elif spec.bookmark_only:
        rows = rows.filter(F.lit(False))

    extra: dict[str, Column] = {}
    if named:
        # All words' hits become one row per entry, so that entries are joined once.
        hits = None
        for word, keys in named.items():
            part = keys.select(*ENTRY_KEY, F.lit(word).alias("_word"))
            hits = part if hits is None else hits.unionByName(part)
        rows = rows.join(hits.groupBy(*ENTRY_KEY).agg(F.collect_set("_word").alias("_named")), ENTRY_KEY, "left")
        extra = {word: F.coalesce(F.array_contains("_named", word), F.lit(False)) for word in named}
    text = shown(entries)

    def hit(word: str) -> Column:
        clean = clean_keywords([word])
        own = keyword_predicate(text, clean[0], spec.case_sensitive, spec.use_regex) if clean else F.lit(False)
        return own | extra[word] if word in extra else own

    must, may, never = spec.mode("AND"), spec.mode("OR"), spec.exclude_keywords
    if not (must or may or never):
        rows = rows.withColumn("matched_keywords", F.lit(""))
    else:
        decided = combine([hit(w) for w in must], [hit(w) for w in may], [hit(w) for w in never])
        words = must + may
        label = F.when(decided, joined([hit(w) for w in words], [F.lit(w) for w in words])).otherwise("")
        excused = marked if spec.always_include_bookmarks else F.lit(False)
        rows = rows.filter(decided | excused).withColumn("matched_keywords", label)
    return rows.drop("_named")


def matches_of(filtered: DataFrame) -> DataFrame:
    """The rows of a filter result that a keyword decided."""
    return filtered.filter("matched_keywords <> ''").withColumns(
        {"matched_text": F.col("matched_keywords"), "keyword": F.col("matched_keywords")}
    )


# ---------------------------------------------------------------- display


def gap_table(entries: DataFrame) -> DataFrame:
    """(source_path, line_no, source_file, timestamp, position, gap_ms, gap) of the given rows in timeline order: `position` from 0,
    and the gap to the row before. Only keys and times are moved; rows that carry the timeline's index aren't sorted anew."""
    ms = to_millis(F.col("timestamp"))
    slim = entries.select(*ENTRY_KEY, "source_file", "timestamp", "log_type", *[c for c in ("timeline_index",) if c in entries.columns])
    if "timeline_index" in entries.columns:
        placed = gaps_on_index(slim, "timeline_index", ms)
    else:
        placed = with_previous(dense_index(slim, order_columns(), "position", "filtered"), "position", {"_before": ms})
    placed = placed.withColumn("gap_ms", ms - F.col("_before"))
    return placed.select(*ENTRY_KEY, "source_file", "timestamp", "position", "gap_ms", gap_text(F.col("gap_ms")).alias("gap"))


def with_gap(entries: DataFrame) -> DataFrame:
    """The rows themselves with `position`, `gap_ms` and `gap`."""
    return entries.drop("position", "gap_ms", "gap").join(gap_table(entries).drop("source_file", "timestamp"), ENTRY_KEY)


def display_rows(rows: DataFrame, message_limit: int | None = None, memo_limit: int | None = None) -> DataFrame:
    """The twelve display columns, texts whole unless a limit of characters is given. Optional inputs (bookmark, memo, gap, keywords, names) default to blank."""
    def column(name: str, default="") -> Column:
        return F.col(name) if name in rows.columns else F.lit(default)

    def cut(text: Column, limit: int | None) -> Column:
        return text if limit is None else F.substring(text, 1, limit)

    message = shown(rows)
    level = F.coalesce(
        F.nullif(F.col("level_name"), F.lit("")), F.concat(F.lit("CH "), F.col("channel").cast("string")), F.lit("")
    )
    return rows.select(
        F.when(column("bookmarked", False), "★").otherwise("").alias("bookmark"),
        cut(F.replace(column("memo"), F.lit("\n"), F.lit(" ")), memo_limit).alias("memo"),
        display_time(F.col("timestamp")).alias("time"),
        column("gap").alias("time_delta"),
        F.col("log_type").alias("type"),
        column("matched_keywords").alias("matched_keywords"),
        level.alias("level_channel"),
        F.coalesce(F.col("ceid").cast("string"), F.lit("")).alias("ceid"),
        F.coalesce("event_name", F.lit("")).alias("event_name"),
        F.col("source_file").alias("file"),
        F.col("line_no").cast("string").alias("line"),
        cut(F.replace(message, F.lit("\n"), F.lit(" | ")), message_limit).alias("message"),
    )


