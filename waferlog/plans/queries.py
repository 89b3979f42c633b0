"""The registered queries: each operator over the driver tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import display_time, normalize_sxfy, report_gap_text
from ..operators import (
    alarms as al, align, bitmaps, compare, detect, enrich, entries as en, filters, objects, ordered, related, roundtrip, rowwin, search, stats, xml,
)
from ..schema import order_columns, text_once, text_whole
from ..sources import dims, sinks, synth
from ..sources.ordered_store import OrderedStore, open_order, order_entries
from ..sources.manifest import drop_superseded, file_manifest, stale_files, stored_entries
from ..sources.raw import line_counts, lines_from_texts
from ..spec import FilterSpec, parse_ceid_ranges
from ..staging import generation, new_path, stage
from ..streaming.ingest import follow_folder
from . import report as rp
from .load import load_files, load_incremental, load_ordered

_parsed: dict[tuple, DataFrame] = {}
_folders: dict[tuple, str] = {}


def _once(name: str, spark: SparkSession, sf_dir: str, build) -> DataFrame:
    """A parse result is stored once per session and read by the queries, as a user stores it after loading."""
    key = (spark.sparkContext.applicationId, generation(), name, sf_dir)
    if key not in _parsed:
        _parsed[key] = stage(build(), name)
    return _parsed[key]


def _entries_once(name: str, spark: SparkSession, sf_dir: str, build) -> DataFrame:
    return text_whole(_once(name, spark, sf_dir, lambda: text_once(build())))


def event_raw(spark, d) -> DataFrame:
    return _once("event_raw", spark, d, lambda: synth.event_lines(spark, d).withColumn(
        "dialect", F.when(F.col("source_file").rlike(detect.SECS_NAME), "SECS").otherwise("MMI")))


def event_entries(spark, d) -> DataFrame:
    return _entries_once("event_entries", spark, d, lambda: en.parse_entries(event_raw(spark, d), fallback=False))


def event_timeline(spark, d) -> DataFrame:
    key = (spark.sparkContext.applicationId, generation(), "timeline", d)
    if key not in _parsed:
        _parsed[key] = en.timeline(event_entries(spark, d))
    return _parsed[key]


def event_order(spark, d) -> OrderedStore:
    """The event log as an ordered store, a range a day."""
    key = (spark.sparkContext.applicationId, generation(), "order", d)
    if key not in _folders:
        store, rows = new_path(spark, "order"), event_entries(spark, d)
        order_entries(rows, rows.select("source_path", F.lit(1).alias("run")).distinct(), store)
        _folders[key] = store
    return open_order(spark, _folders[key])


def doc_entries(spark, d) -> DataFrame:
    return _entries_once("doc_entries", spark, d, lambda: en.parse_entries(synth.staged_lines(synth.document_lines(spark, d)), fallback=False))


def conv_entries(spark, d) -> DataFrame:
    return _entries_once("conv_entries", spark, d, lambda: en.parse_entries(synth.staged_lines(synth.conversation_lines(spark, d)), fallback=False))


def names(spark, d) -> DataFrame:
    return dims.event_names(synth.event_table(spark, d))


def variables(spark, d) -> DataFrame:
    return dims.report_variables(synth.report_table(spark, d), synth.variable_table(spark, d))


def events_of(spark, d) -> DataFrame:
    return objects.extract_object_events(event_entries(spark, d))


def alarms_of(spark, d) -> DataFrame:
    return al.extract_alarms(event_entries(spark, d))


def bookmarks(spark, d) -> DataFrame:
    return synth.bookmark_table(spark, d, doc_entries(spark, d))


KEY = ["source_file", "line_no"]


def at():
    return display_time(F.col("timestamp")).alias("time")


# ---------------------------------------------------------------- sources and parsing


def text_lines(spark, d):
    texts = spark.read.parquet(f"{d}/documents.parquet").select(
        F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("source_file"),
        F.col("text").cast("binary").alias("content"),
    )
    return lines_from_texts(texts).select("source_file", "line_no", "value")


def file_line_counts(spark, d):
    return line_counts(event_raw(spark, d)).select("source_file", "line_count")


def line_numbers(spark, d):
    """Header lines with their numbers."""
    raw = event_raw(spark, d)
    head = detect.is_mmi_header(F.col("value")) | detect.is_secs_header(F.col("value"))
    return raw.filter(head).select("source_file", "line_no", "value")


def file_inventory(spark, d):
    return stats.file_inventory(event_raw(spark, d), event_entries(spark, d)).select("type", "source_file", "line_count", "entries")


def mmi_entries(spark, d):
    rows = en.parse_entries(event_raw(spark, d), fallback=False).filter("log_type = 'MMI'")
    return rows.select(
        *KEY, at(), F.col("color_index").cast("long").alias("color_index"), "seq_index", "level_name", "message",
        "raw_line", "repeat_count", "is_alarm", "is_object_event",
    )


def secs_entries(spark, d):
    rows = en.parse_entries(event_raw(spark, d), fallback=False).filter("log_type = 'SECS'")
    return rows.select(
        *KEY, at(), F.col("channel").cast("long").alias("channel"), "message", "ceid", "sxfy_type",
        F.array_join(F.transform("s6f11_rptids", lambda r: r.cast("string")), ",").alias("rptids"),
    )


def conversation_entries(spark, d):
    return conv_entries(spark, d).select(*KEY, at(), F.col("channel").cast("long").alias("channel"), "message")


def document_entries(spark, d):
    return doc_entries(spark, d).select(*KEY, at(), "seq_index", "message")


def dialects(spark, d):
    return detect.detect_dialects(lines_from_texts(synth.document_files(spark, d))).select("source_path", "dialect")


def dialects_strict(spark, d):
    found = detect.strict_dialects(lines_from_texts(synth.document_files(spark, d)))
    return found.select("source_path", "mmi_headers", "secs_headers", F.coalesce("dialect", "error").alias("verdict"))


def dialect_fallback(spark, d):
    """Entries per file of the document files, those of unknown dialect tried as both."""
    raw = stage(lines_from_texts(synth.document_files(spark, d)), "lines")
    rows = en.parse_entries(raw, default_date="2024-03-05")
    return rows.groupBy("source_path", "log_type").agg(F.count("*").alias("entries"), F.max(F.length("message")).cast("long").alias("longest"))


def setup_dump_skip(spark, d):
    rows = en.parse_entries(synth.staged_lines(synth.setup_lines(spark, d)), fallback=False)
    return rows.select(*KEY, "seq_index", "message")


def setup_dump_flag(spark, d):
    rows = en.parse_entries(synth.staged_lines(synth.setup_lines(spark, d)), fallback=False, skip_setup_dump=False)
    return rows.select(*KEY, "seq_index", "is_setup_dump")


def load_counters(spark, d):
    raw = synth.staged_lines(synth.setup_lines(spark, d))
    return en.load_counters(en.parse_entries(raw, fallback=False, keep_all=True))


def ceid_exclusion(spark, d):
    ranges = parse_ceid_ranges("1000-1020, 1050; 1090-1095")
    rows = en.parse_entries(event_raw(spark, d), fallback=False, excluded_ceids=ranges)
    return rows.filter("log_type = 'SECS'").select(*KEY, "ceid")


def ceid_in_ranges(spark, d):
    hit = en.in_ranges(F.col("ceid"), [(1010, 1019), (1080, 1085)])
    return event_entries(spark, d).filter(hit).select(*KEY, "ceid")


def sxfy_catalogue(spark, d):
    return stats.sxfy_catalogue(event_entries(spark, d))


def level_names(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_size").cast("int").alias("color")).distinct()
    return part.select(F.col("color").cast("long").alias("color"), en.level_name(F.col("color")).alias("level_name"))


def secs_items(spark, d):
    rows = event_entries(spark, d).filter("log_type = 'SECS'")
    items = enrich.item_table(rows).join(rows.select("source_path", *KEY), ["source_path", "line_no"])
    return items.select(
        *KEY, F.col("item_line").cast("long").alias("item_line"), "item_type", "item_count", "value",
        F.col("parent_line").cast("long").alias("parent_line"), F.col("ordinal").cast("long").alias("ordinal"),
    )


def _write_logs(spark, d) -> str:
    folder = new_path(spark, "logs")
    synth.write_named_files(event_raw(spark, d), folder)
    return folder


def _log_folder(spark, d) -> str:
    """The event log as text files, both dialects; their names tell the dialect and, for SECS, the day."""
    key = (spark.sparkContext.applicationId, generation(), "folder", d)
    if key not in _folders:
        _folders[key] = _write_logs(spark, d)
    return _folders[key]


def file_scan(spark, d):
    rows = load_files(spark, _log_folder(spark, d))
    return rows.select("timeline_index", "log_type", "source_file", "seq_index", at(), "message")


def incremental_ingest(spark, d):
    """Five runs over the same files: all are parsed; none; all under another option; one that was replaced; none, one being gone."""
    folder, store = _write_logs(spark, d), new_path(spark, "store")
    first = event_raw(spark, d).filter("dialect = 'MMI' AND block_no = 0").agg(F.min("source_file")).first()[0]
    file = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/block 0/{first}")
    system = file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = None
    for run in range(1, 6):
        if run == 4:
            stream = system.create(file, True)
            stream.write(bytearray(b"2024-02-01 00:00:00:000|1|7|replaced\n"))
            stream.close()
        elif run == 5:
            system.delete(file, False)
        rows, stats_ = load_incremental(spark, folder, store, skip_setup_dump=run < 3)
        # Each run's rows are counted now: the next one publishes another version.
        found = rows.agg(F.count("*").alias("entries"), F.sum("seq_index").alias("seq_sum"), F.sum("ceid").alias("ceid_sum")).first()
        row = (run, stats_["hits"], stats_["misses"], found["entries"], found["seq_sum"], found["ceid_sum"])
        one = spark.createDataFrame([row], "run long, hits long, misses long, entries long, seq_sum long, ceid_sum long")
        out = one if out is None else out.unionByName(one)
    # The runs that no file is read from any more go; the rest reads as before.
    gone = drop_superseded(spark, store)
    found = stored_entries(spark, store).agg(F.count("*").alias("entries"), F.sum("seq_index").alias("seq_sum"), F.sum("ceid").alias("ceid_sum")).first()
    last = spark.createDataFrame([(6, 0, len(gone), found["entries"], found["seq_sum"], found["ceid_sum"])], out.schema)
    return out.unionByName(last)


def ordered_ingest(spark, d):
    """Three runs: without the oldest file and with another one cut short; with that one whole; with the oldest, which sorts before all."""
    folder, store = _write_logs(spark, d), new_path(spark, "store")
    # The oldest file and the next one: a dense log's first block has but one file. A log of one file has that one cut short.
    files = event_raw(spark, d).filter("dialect = 'MMI'").select("block_no", "source_file").distinct()
    held_back = [f"block {r['block_no']}/{r['source_file']}" for r in files.orderBy("block_no", "source_file").limit(2).collect()]
    path = spark._jvm.org.apache.hadoop.fs.Path
    system = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    aside = new_path(spark, "aside")
    for name in held_back:
        system.mkdirs(path(f"{aside}/{name}").getParent())
        system.rename(path(f"{folder}/{name}"), path(f"{aside}/{name}"))
    for name in held_back[-1:]:
        short = system.create(path(f"{folder}/{name}"), True)
        short.write(bytearray(b"2024-01-09 00:00:00:000|1|7|cut short\n"))
        short.close()
    rows, _ = load_ordered(spark, folder, store)
    for name in reversed(held_back):
        system.delete(path(f"{folder}/{name}"), False)
        system.rename(path(f"{aside}/{name}"), path(f"{folder}/{name}"))
        rows, _ = load_ordered(spark, folder, store)
    return rows.select("timeline_index", "log_type", "source_file", "seq_index", at(), "message")


def stale_sources(spark, d):
    """Files whose text may not be served any more: one is replaced, one is gone."""
    folder = _write_logs(spark, d)
    before = stage(file_manifest(spark, folder), "manifest")
    edges = event_raw(spark, d).filter("dialect = 'MMI' AND block_no = 0").agg(F.min("source_file").alias("a"), F.max("source_file").alias("b")).first()
    file, gone = (spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/block 0/{edges[c]}") for c in "ab")
    system = file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.create(file, True).close()
    system.delete(gone, False)
    stale = stale_files(before, file_manifest(spark, folder))
    return stale.select(F.substring_index("source_path", "/", -1).alias("source_file"))


def stream_ingest(spark, d):
    """The same files picked up as a stream."""
    store = new_path(spark, "stream")
    query = follow_folder(spark, _log_folder(spark, d), store, new_path(spark, "offsets"))
    query.awaitTermination()
    return stored_entries(spark, store).select(at(), "log_type", "source_file", "message")


def mixed_raw(spark, d) -> DataFrame:
    return _once("mixed_raw", spark, d, lambda: synth.mixed_lines(spark, d))


def mixed_of(spark, d) -> DataFrame:
    return _entries_once("mixed_entries", spark, d, lambda: en.parse_entries(mixed_raw(spark, d)))


def mixed_entries(spark, d):
    """The log of the rarer forms: dialects by name, event ids in headers and bodies."""
    return mixed_of(spark, d).select(*KEY, at(), "log_type", "message", "ceid", "sxfy_type", "is_object_event")


def header_exclusion(spark, d):
    rows = en.parse_entries(mixed_raw(spark, d), excluded_ceids=parse_ceid_ranges("10-40; 1000-1050"))
    return rows.filter("log_type = 'SECS'").select(*KEY, "ceid", "sxfy_type")


def object_events_mixed(spark, d):
    return objects.extract_object_events(mixed_of(spark, d)).select(*KEY, at(), "event_type", "object_name", "details")


def sxfy_catalogue_mixed(spark, d):
    return stats.sxfy_catalogue(mixed_of(spark, d))


def sxfy_filter_mixed(spark, d):
    return filters.by_sxfy(mixed_of(spark, d), ["S1F3", "S6F12"]).select(*KEY, "log_type", "sxfy_type")


def top_sxfy_mixed(spark, d):
    return stats.top_sxfy(mixed_of(spark, d))


# ---------------------------------------------------------------- timeline


def timeline_index(spark, d):
    return event_timeline(spark, d).select(*KEY, "log_type", "timeline_index")


def position_lookup(spark, d):
    keys = event_entries(spark, d).filter("is_alarm").select("source_path", "line_no")
    found = event_order(spark, d).positions(keys)
    return found.select(F.substring_index("source_path", "/", -1).alias("source_file"), "line_no", "timeline_index")


def gaps(spark, d):
    """Gap to the previous row among SECS rows."""
    rows = filters.gap_table(event_timeline(spark, d).filter("log_type = 'SECS'"))
    return rows.select(*KEY, "position", "gap_ms", "gap")


def gaps_unindexed(spark, d):
    """The same for all entries, before they have an index."""
    return filters.gap_table(event_entries(spark, d)).select(*KEY, "position", "gap_ms", "gap")


def report_gaps(spark, d):
    rows = filters.gap_table(event_timeline(spark, d))
    return rows.select(*KEY, report_gap_text(F.col("gap_ms")).alias("gap"))


def context_rows(spark, d):
    """Three rows around every alarm that was repeated four times."""
    t = event_timeline(spark, d)
    anchors = t.filter("is_alarm AND repeat_count = 3").select(F.col("timeline_index").alias("anchor"))
    return rowwin.context(t, anchors, 3).select("anchor", F.col("offset").cast("long").alias("offset"), "marker", *KEY)


def page(spark, d):
    return event_order(spark, d).page(3, 250).select("timeline_index", *KEY)


def centred_window(spark, d):
    return event_order(spark, d).centred(60, 500).select("timeline_index", *KEY)


def first_rows(spark, d):
    return rowwin.first_rows(event_entries(spark, d), 300).select(*KEY, at())


def order_check(spark, d):
    return compare.order_violations(event_timeline(spark, d))


def digests(spark, d):
    rows = event_entries(spark, d)
    return compare.entry_digests(rows).select(F.substring_index("source_path", "/", -1).alias("source_file"), "line_no", "sha256")


def timeline_digest(spark, d):
    return compare.timeline_digest(event_timeline(spark, d))


def changed_ranges(spark, d):
    """Where the timeline differs from one in which a few alarms read otherwise, by two digest trees."""
    rows = event_timeline(spark, d)
    other = rows.withColumn("message", F.when(F.col("message").startswith("[ALARM] Alarm Code [3007] unit 1"), "changed").otherwise(F.col("message")))
    trees = [stage(compare.digest_tree(t, 64, 4), "tree") for t in (rows, other)]
    return compare.differing_ranges(*trees, 64, 4)


# ---------------------------------------------------------------- filters


def type_filter(spark, d):
    return filters.by_log_type(event_entries(spark, d), ["SECS"]).select(*KEY, "log_type")


def sxfy_filter(spark, d):
    """S6F12 only: no SECS row passes, every MMI row does."""
    return filters.by_sxfy(event_entries(spark, d), ["S6F12"]).groupBy("log_type").agg(F.count("*").alias("entries"))


def time_range(spark, d):
    rows = search.time_range(event_entries(spark, d), datetime(2024, 1, 5, 6), datetime(2024, 1, 9, 18, 30))
    return rows.select(*KEY, at())


def time_inputs(spark, d):
    """Clock texts of each event's own time and of its value as a later or earlier clock."""
    ts = spark.read.parquet(f"{d}/events.parquet").select(
        "event_id", F.date_format("ts", "HH:mm").alias("start_text"), F.date_format(
            F.col("ts") + F.make_dt_interval(hours=(F.col("user_id") % 24).cast("int")), "HH:mm:ss").alias("end_text"))
    out = filters.roll_time_range(ts, "2026-07-02")
    return out.select("event_id", display_time(F.col("start")).alias("start"), display_time(F.col("end")).alias("end"))


def time_windows(spark, d):
    """Everything within five minutes of an alarm with code 3010, 3020 or 3030."""
    anchors = alarms_of(spark, d).filter(F.col("alarm_code").isin("3010", "3020", "3030")).select("timestamp")
    return filters.within(event_entries(spark, d), anchors, 300).select(*KEY, at())


def time_window_one(spark, d):
    return filters.around_time(event_entries(spark, d), datetime(2024, 1, 10, 12), 3600).select(*KEY, at())


def after_anchor(spark, d):
    return filters.from_anchor(event_entries(spark, d), datetime(2024, 1, 28), "after").select(*KEY, at())


def before_anchor(spark, d):
    return filters.from_anchor(event_entries(spark, d), datetime(2024, 1, 4), "before").select(*KEY, at())


def bookmark_only(spark, d):
    return filters.bookmark_only(doc_entries(spark, d), bookmarks(spark, d)).select("seq_index")


def bookmark_exception(spark, d):
    spec = FilterSpec(keywords=[("AND", "tion")], exclude_keywords=["que"], always_include_bookmarks=True)
    rows = filters.apply_spec(doc_entries(spark, d), spec, bookmarks(spark, d))
    return rows.select("seq_index", "matched_keywords")


def bookmark_decoration(spark, d):
    rows = filters.with_bookmarks(doc_entries(spark, d), bookmarks(spark, d))
    return rows.select("seq_index", "bookmarked", "memo")


def bookmark_store(spark, d):
    """Bookmarks written and read back, each on its entry."""
    path = new_path(spark, "bookmarks")
    sinks.write_bookmarks(bookmarks(spark, d), path)
    rows = filters.with_bookmarks(doc_entries(spark, d), sinks.read_bookmarks(spark, path))
    return rows.filter("bookmarked").select("seq_index", "memo")


def csv_round_trip(spark, d):
    """The display rows as CSV, read back: line feeds, quotes and commas of whole messages survive."""
    path = new_path(spark, "csv")
    rows = filters.with_bookmarks(doc_entries(spark, d), bookmarks(spark, d))
    sinks.write_csv(filters.display_rows(rows), path)
    back = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    label = sinks.LABELS
    return back.select(*[F.col(label[c]).alias(c) for c in ("time", "type", "file", "line", "message")])


def level_file(spark, d):
    """Level names read from a file that holds one line per region and a comment."""
    path = new_path(spark, "levels")
    lines = spark.read.parquet(f"{d}/region.parquet").select(F.concat(F.lit("  "), F.col("r_regionkey").cast("string"), F.lit(': "'), F.col("r_name"), F.lit('"  # name')))
    lines.write.text(path)
    part = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_size").cast("int").alias("color")).distinct()
    return part.select(F.col("color").cast("long").alias("color"), en.level_name(F.col("color"), dims.load_levels(path)).alias("level_name"))


def context_all_alarms(spark, d):
    t = event_timeline(spark, d)
    anchors = t.filter("is_alarm").select(F.col("timeline_index").alias("anchor"))
    return rowwin.context(t, anchors, 3).select("anchor", F.col("offset").cast("long").alias("offset"), "marker", *KEY)


def time_windows_all_alarms(spark, d):
    return filters.within(event_entries(spark, d), alarms_of(spark, d).select("timestamp"), 60).select(*KEY, at())


def bookmark_timeline(spark, d):
    indexed = ordered.dense_index(doc_entries(spark, d), order_columns(), "position")
    return rowwin.bookmark_timeline(filters.with_bookmarks(indexed, bookmarks(spark, d)))


def display_rows(spark, d):
    rows = filters.with_bookmarks(doc_entries(spark, d), bookmarks(spark, d)).withColumn("gap", F.lit(""))
    shown = filters.display_rows(rows)
    # The bookmark sign is compared as a word: result files differ in how they carry it.
    return shown.withColumn("bookmark", F.when(F.col("bookmark") != "", "yes").otherwise(""))


def log_text(spark, d):
    return sinks.as_log_text(event_entries(spark, d)).select(*KEY, "text")


_SPEC = """{"keywords": [{"mode": "AND", "keyword": "carrierobject"}, {"mode": "and", "keyword": "slotmap_read: yes"},
 {"mode": "OR", "keyword": "S6F11W"}, {"mode": "XOR", "keyword": "x"}], "exclude_keywords": ["note", " "],
 "start": "2024-01-03T00:00:00", "end": "2024-01-20T00:00:00", "sxfy": ["S6F11"]}"""


def composed_filter(spark, d):
    rows = filters.apply_spec(event_entries(spark, d), FilterSpec.from_json(_SPEC))
    return rows.select(*KEY, "log_type", "matched_keywords")


def composed_without_keywords(spark, d):
    spec = FilterSpec(log_types=["MMI"], start=datetime(2024, 1, 30))
    return filters.apply_spec(event_entries(spark, d), spec).select(*KEY, "matched_keywords")


# ---------------------------------------------------------------- search


def sxfy_normalised(spark, d):
    rows = event_entries(spark, d)
    return rows.select(*KEY, normalize_sxfy(F.col("message")).alias("message"))


def keyword_literal(spark, d):
    return search.search(doc_entries(spark, d), ["der "]).select("seq_index", "matched_text", "keyword")


def keyword_case_sensitive(spark, d):
    return search.search(doc_entries(spark, d), ["The"], case_sensitive=True).select("seq_index", "keyword")


def keyword_accented(spark, d):
    return search.search(doc_entries(spark, d), ["ÉTION"]).select("seq_index", "keyword")


def keyword_regex(spark, d):
    return search.search(event_entries(spark, d), [r"LOT1[0-4]+\b"], use_regex=True).select(*KEY, "matched_text")


def keyword_named_group(spark, d):
    """A named group, whose name Java would refuse, and its back-reference: carriers of two equal digits."""
    pattern = r"LOT(?P<first_digit>\d)(?P=first_digit)\b"
    return search.search(event_entries(spark, d), [pattern], use_regex=True).select(*KEY, "matched_text")


def keyword_annotated(spark, d):
    """A word that only the names beside the values hold."""
    rows = enrich.annotate(event_entries(spark, d), names(spark, d), variables(spark, d))
    return search.search(rows, ["nation_7"]).select(*KEY, "matched_text")


def keyword_bad_regex(spark, d):
    """An invalid pattern is searched as text."""
    return search.search(event_entries(spark, d), ["[ALARM"], use_regex=True).select(*KEY, "matched_text")


def keyword_sxfy(spark, d):
    return search.search(event_entries(spark, d), ["s6f11"]).select(*KEY, "matched_text", "keyword")


def keyword_and_or_exclude(spark, d):
    rows = search.search(doc_entries(spark, d), ["tion", "and"], ["sch", "leaux"], ["querb", "xy"])
    return rows.select("seq_index", "matched_text", "keyword")


def keyword_any_of(spark, d):
    rows = search.search(doc_entries(spark, d), ["schen", "ellex"], match_all=False)
    return rows.select("seq_index", "keyword")


def keyword_exclude_only(spark, d):
    return search.search(doc_entries(spark, d), exclude_keywords=["and"]).select("seq_index", "matched_text", "keyword")


def _benchmark_words(spark, d) -> DataFrame:
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)))
    return spark.read.parquet(f"{d}/benchmark.parquet").select(words.alias("keyword")).distinct()


def keyword_matrix(spark, d):
    """Every word of the benchmark texts against every document."""
    rows = doc_entries(spark, d)
    hits = search.match_keyword_table(rows, _benchmark_words(spark, d))
    return hits.groupBy("keyword").agg(F.count("*").alias("documents"))


def keyword_matrix_list(spark, d):
    rows = event_entries(spark, d)
    words = ["LOT7", "alarm code", "slotmap_read: no", "s6f11w", "<u4 [1] 0>"]
    hits = search.match_matrix(rows, words).join(rows.select("source_path", *KEY), ["source_path", "line_no"])
    return hits.select(*KEY, "keyword")


COMBINATIONS = [
    ("all of two", dict(keywords=["slotmap_read: NO", "lot7"])),
    ("any of two", dict(keywords=["alarm code", "LOT7"], match_all=False)),
    ("one or another, without a third", dict(keywords=["S6F11W"], or_keywords=["Alarm Code"], exclude_keywords=["note"])),
    ("without one", dict(exclude_keywords=["statechange"])),
    ("nowhere", dict(keywords=["lot7"], exclude_keywords=["o"])),
]


def keyword_combinations(spark, d):
    """Five combinations from one stored table of bitmaps; it is built for some of the words and then extended by the others."""
    rows, path = event_timeline(spark, d), new_path(spark, "bitmaps")
    words = lambda *ws: spark.createDataFrame([(w,) for w in ws], "keyword string")
    bitmaps.write(bitmaps.build(rows, words("slotmap_read: NO", "LOT7", "S6F11W")), path)
    bitmaps.write(bitmaps.extend(spark.read.parquet(path), rows, words("lot7", "alarm code", "note", "StateChange", "O")), path)
    stored, out = spark.read.parquet(path), None
    for name, spec in COMBINATIONS:
        one = bitmaps.positions(bitmaps.combine(stored, **spec)).select(F.lit(name).alias("combination"), "timeline_index")
        out = one if out is None else out.unionByName(one)
    return out


def keyword_hits(spark, d):
    matches = search.search(doc_entries(spark, d), or_keywords=["tion", "the", "und", "les", "sch", "zz"])
    return search.keyword_counts(matches)


def reference_name_search(spark, d):
    rows = event_entries(spark, d)
    hits = search.reference_matches(rows, "WIDGET", names(spark, d), variables(spark, d))
    return hits.join(rows.select("source_path", *KEY), ["source_path", "line_no"]).select(*KEY)


def reference_variable_search(spark, d):
    rows = search.search_with_references(event_entries(spark, d), "nation_7", names(spark, d), variables(spark, d))
    return rows.select(*KEY)


def find_in_results(spark, d):
    indexed = ordered.dense_index(event_entries(spark, d).filter("log_type = 'SECS'"), order_columns(), "position")
    return search.search_with_references(indexed, "LOT11", names(spark, d), variables(spark, d)).select("position")


def find_next(spark, d):
    hits = event_timeline(spark, d).filter("is_alarm AND repeat_count = 1").select(F.col("timeline_index").alias("position"))
    steps = [(None, True), (None, False), (500, True), (500, False), (10**12, True), (-1, False)]
    out = None
    for number, (current, forward) in enumerate(steps):
        row = search.find_next(hits, current, forward).select(F.lit(number).cast("long").alias("step"), "position")
        out = row if out is None else out.unionByName(row)
    return out


def highlight(spark, d):
    spans = search.span_table(doc_entries(spark, d), ["tion"])
    return spans.join(doc_entries(spark, d).select("source_path", "line_no", "seq_index"), ["source_path", "line_no"]).select(
        "seq_index", "term", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


def highlight_terms(spark, d):
    """Three patterns at once, with matches of different lengths."""
    patterns = ["tion", "[aeiou]{2,}", r"\b(?:the|and)\b"]
    spans = search.span_table(doc_entries(spark, d), patterns, keep=["seq_index"], use_regex=True)
    return spans.select("seq_index", "term", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


def gram_postings(spark, d):
    """In how many blocks of 256 lines of the event log each run of three characters occurs."""
    text = F.lower(normalize_sxfy(F.col("message")))
    return search.gram_blocks(event_entries(spark, d), text, ["source_path", F.floor(F.col("line_no") / 256)], 3)


def indexed_search(spark, d):
    return search.search(doc_entries(spark, d), ["theswh"]).select("seq_index")


def indexed_search_trigram(spark, d):
    return search.search(doc_entries(spark, d), ["Thent"], case_sensitive=True).select("seq_index")


def indexed_search_short(spark, d):
    return search.search(doc_entries(spark, d), ["xr"]).select("seq_index")


def indexed_search_accented(spark, d):
    return search.search(doc_entries(spark, d), ["éaux"]).select("seq_index")


# ---------------------------------------------------------------- enrichment


def used_ceids(spark, d):
    return enrich.used_ceids(event_entries(spark, d))


def used_rptids(spark, d):
    return enrich.used_rptids(event_entries(spark, d))


def event_name_dimension(spark, d):
    return dims.event_names(synth.event_table(spark, d), enrich.used_ceids(event_entries(spark, d)))


def report_variable_dimension(spark, d):
    out = dims.report_variables(
        synth.report_table(spark, d), synth.variable_table(spark, d), enrich.used_rptids(event_entries(spark, d)))
    return out.select("rptid", F.col("position").cast("long").alias("position"), F.col("index_no").cast("long").alias("index_no"), "vid", "name")


def event_lookup(spark, d):
    return dims.search_events(synth.event_table(spark, d), "RING")


def event_lookup_wildcard(spark, d):
    return dims.search_events(synth.event_table(spark, d), "1_5")


def attach_names(spark, d):
    rows = enrich.attach_event_names(event_entries(spark, d).filter("ceid IS NOT NULL"), names(spark, d))
    return rows.select(*KEY, "ceid", "event_name")


def annotated_messages(spark, d):
    rows = enrich.annotate(event_entries(spark, d), names(spark, d), variables(spark, d))
    return rows.filter("log_type = 'SECS'").select(*KEY, "display_message")


def annotated_extended(spark, d):
    rows = enrich.annotate(event_entries(spark, d), names(spark, d), variables(spark, d), "extended")
    return rows.filter("log_type = 'SECS'").select(*KEY, "display_message")


def annotated_without_variables(spark, d):
    rows = enrich.annotate(event_entries(spark, d), names(spark, d), None)
    return rows.filter("log_type = 'SECS'").select(*KEY, "display_message")


# ---------------------------------------------------------------- extraction


def alarms(spark, d):
    return alarms_of(spark, d).select(*KEY, at(), "alarm_code", "message", "repeat_count", "level_name")


def alarm_summary(spark, d):
    return al.summarize_alarms(al.extract_alarms(event_timeline(spark, d)))


def object_events(spark, d):
    return events_of(spark, d).select(
        *KEY, at(), "event_type", "object_name", "details", "model", "carrier_idx", "carrier_id", "id_read",
        "slotmap_read", "port_no", "seq_port_no", "mmi_port_no", "loc_id", "substrate_no")


def object_event_filter(spark, d):
    kinds = ["LoadPortObject::StateChange", "SubstrateObject::Initialize"]
    rows = objects.filter_object_events(events_of(spark, d), kinds, datetime(2024, 1, 10), datetime(2024, 1, 11))
    return rows.select(*KEY, "event_type")


def events_per_type(spark, d):
    return objects.events_per_type(events_of(spark, d))


def _roundtrip_columns(rows):
    return rows.select("carrier", at(), "gap_ms", "port_no", "level", "state", "detail", "source", *KEY)


def carrier_roundtrip(spark, d):
    rows = roundtrip.carrier_roundtrip(
        " LOT12 ", event_entries(spark, d), events_of(spark, d), alarms_of(spark, d), event_names=names(spark, d))
    return _roundtrip_columns(rows)


def carrier_roundtrips(spark, d):
    """The roundtrips of all carriers, counted per carrier, state and level."""
    events = events_of(spark, d)
    rows = roundtrip.carrier_roundtrips(
        roundtrip.carriers_of(events), event_entries(spark, d), events, alarms_of(spark, d))
    state = F.when(F.col("state").startswith("CEID"), "CEID").otherwise(F.col("state"))
    return rows.groupBy("carrier", state.alias("state"), "level").agg(
        F.count("*").alias("rows"), F.sum("gap_ms").alias("gap_ms"))


def related_candidates(spark, d):
    rows = enrich.attach_event_names(event_entries(spark, d), names(spark, d))
    found = related.related_candidates(rows).join(rows.select("source_path", *KEY), ["source_path", "line_no"])
    label = F.when(F.col("label") == related.EVENT_NAME_LABEL, "event name").when(
        F.col("label") == related.OBJECT_LABEL, "object").otherwise(F.col("label"))
    return found.select(*KEY, F.col("rank").cast("long").alias("rank"), label.alias("label"), "value")


def flow_terms(spark, d):
    rows = enrich.attach_event_names(event_entries(spark, d), names(spark, d))
    found = related.flow_terms(rows).join(rows.select("source_path", *KEY), ["source_path", "line_no"])
    return found.select(*KEY, F.col("rank").cast("long").alias("rank"), "term")


def related_search(spark, d):
    """All values that entries name, searched as keywords over all entries."""
    rows = event_entries(spark, d)
    found = related.related_candidates(rows)
    hits = search.match_keyword_table(rows, found.select(F.col("value").alias("keyword")))
    return hits.groupBy("keyword").agg(F.count("*").alias("entries"))


# ---------------------------------------------------------------- statistics and report


def statistics(spark, d):
    return stats.statistics(event_entries(spark, d))


def statistics_bookmarked(spark, d):
    return stats.statistics(doc_entries(spark, d), bookmarks(spark, d))


def top_sxfy(spark, d):
    return stats.top_sxfy(event_timeline(spark, d))


def top_ceids(spark, d):
    return stats.top_ceids(event_timeline(spark, d))


def top_event_names(spark, d):
    return stats.top_event_names(enrich.attach_event_names(event_timeline(spark, d), names(spark, d)))


def top_ceid_hints(spark, d):
    return rp.top_ceid_hints(event_timeline(spark, d), names(spark, d)).select("ceid", "event_name", "entries")


def log_span(spark, d):
    span = rp.log_span(event_entries(spark, d))
    return span.select(display_time(F.col("first")).alias("first"), display_time(F.col("last")).alias("last"), "duration_ms")


def first_alarm(spark, d):
    return rp.first_alarm(alarms_of(spark, d)).select(*KEY, at(), "alarm_code", "message")


def _late(spark, d) -> DataFrame:
    """Entries from the second day on, which leaves earlier rows out of the report's scope."""
    return search.time_range(event_entries(spark, d), datetime(2024, 1, 2))


def problem_entry(spark, d):
    return rp.problem_entry(_late(spark, d), rp.scoped(alarms_of(spark, d), _late(spark, d))).select(*KEY, at(), "message")


def _problem_context(spark, d):
    """The rows around the first problem entry of the second day and later."""
    late = _late(spark, d)
    return rp.problem_context(event_entries(spark, d), stage(rp.problem_entry(late, rp.scoped(alarms_of(spark, d), late)), "problem"))


def problem_context(spark, d):
    return _problem_context(spark, d).select("marker", F.col("step").cast("long").alias("step"), *KEY, "gap_ms")


def pre_problem_signals(spark, d):
    return rp.signals(_problem_context(spark, d), names(spark, d))


def largest_gap(spark, d):
    return rp.largest_gap(_problem_context(spark, d)).select(*KEY, F.abs("gap_ms").alias("gap_ms"))


def report_scope(spark, d):
    scope = _late(spark, d)
    parts = {"alarms": alarms_of(spark, d), "events": events_of(spark, d)}
    out = None
    for name, df in parts.items():
        row = rp.scoped(df, scope).agg(F.count("*").alias("rows")).select(F.lit(name).alias("part"), "rows")
        out = row if out is None else out.unionByName(row)
    return out


def investigation_report(spark, d):
    rows = event_entries(spark, d)
    matches = search.search(rows, or_keywords=["LOT12", "alarm"])
    return rp.report(
        rows, events_of(spark, d), alarms_of(spark, d), matches, keyword="OR: LOT12, alarm",
        event_names=names(spark, d), generated=datetime(2024, 2, 1)).select("section", "ord", "text")


def report_files(spark, d):
    """The report as Markdown and as plain text, written to files and read back line by line."""
    rows = event_entries(spark, d)
    matches = search.search(rows, or_keywords=["LOT12", "alarm"])
    out = None
    for form in ("markdown", "text"):
        lines = rp.report(
            rows, events_of(spark, d), alarms_of(spark, d), matches, keyword="OR: LOT12, alarm", markdown=form == "markdown",
            event_names=names(spark, d), generated=datetime(2024, 2, 1))
        path = new_path(spark, f"report-{form}")
        sinks.write_report(lines, path)
        back = sinks.read_report(spark, path).select(F.lit(form).alias("form"), "line_no", "text")
        out = back if out is None else out.unionByName(back)
    return out


def filter_descriptions(spark, d):
    """What specifications over the log's own span describe, and how many entries pass each."""
    rows = event_entries(spark, d)
    span = rp.log_span(rows).first()
    # The span of a log without entries is empty, and so is the time part of its descriptions.
    span = {"start": span and span["first"], "end": span and span["last"]}
    words = {"keywords": [("AND", "carrierobject"), ("OR", "LOT12"), ("OR", "LOT13"), ("AND", "slotmap_read: yes")]}
    specs = {
        "all": FilterSpec(**words, **span, exclude_keywords=["note", "alarm"], always_include_bookmarks=True),
        "from": FilterSpec(start=span["start"], exclude_keywords=["note"]),
        "words": FilterSpec(**words),
        "none": FilterSpec(),
    }
    out = None
    for name, spec in specs.items():
        part = filters.apply_spec(rows, spec).agg(F.count("*").alias("entries"))
        part = part.select(F.lit(name).alias("spec"), F.lit(spec.describe()).alias("description"), "entries")
        out = part if out is None else out.unionByName(part)
    return out


def xml_pieces(spark, d):
    """The outermost complete XML pieces of all pages, taken as messages."""
    pages = spark.read.parquet(f"{d}/pages.parquet").select("page_id", "html")
    found = xml.with_texts(xml.xml_pieces(pages, ["page_id"], "html"), pages, ["page_id"], "html")
    return found.select("page_id", "start", "end", "name", "tags", F.md5("piece").alias("piece_md5"))


# ---------------------------------------------------------------- comparison


def _pairs(spark, d) -> DataFrame:
    """Neighbouring turns of a conversation."""
    turns = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "text")
    later = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("right"))
    return turns.join(later, ["conv_id", "turn"]).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("pair_id"), F.col("text").alias("left"), "right")


def line_diff(spark, d):
    out = compare.line_diff(_pairs(spark, d))
    return out.select("pair_id", "mark", "line", F.col("occurrence").cast("long").alias("occurrence"), "left_no", "right_no")


def aligned_diff(spark, d):
    """Every document against the first one that starts with the same line, aligned line by line; equal texts have no differences."""
    line = F.substring_index("text", "\n", 1)
    docs = spark.read.parquet(f"{d}/documents.parquet").filter("text IS NOT NULL").select("doc_id", "text", line.alias("line"))
    heads = docs.groupBy("line").agg(F.min("doc_id").alias("first_id"))
    firsts = heads.join(docs.select(F.col("doc_id").alias("first_id"), F.col("text").alias("left")), "first_id")
    pairs = stage(docs.join(firsts, "line").filter("text <> left").select(F.col("doc_id").alias("pair_id"), "left", F.col("text").alias("right")), "pairs")
    return align.aligned_diff(align.lines_of(pairs, "left"), align.lines_of(pairs, "right"))


QUERIES = [
    file_scan, incremental_ingest, ordered_ingest, stale_sources, stream_ingest, mixed_entries, header_exclusion, object_events_mixed, sxfy_catalogue_mixed,
    sxfy_filter_mixed, top_sxfy_mixed, bookmark_store, csv_round_trip, level_file, context_all_alarms, time_windows_all_alarms,
    text_lines, file_line_counts, line_numbers, file_inventory, mmi_entries, secs_entries, conversation_entries,
    document_entries, dialects, dialects_strict, dialect_fallback, setup_dump_skip, setup_dump_flag, load_counters,
    ceid_exclusion, ceid_in_ranges, sxfy_catalogue, level_names, secs_items, timeline_index, position_lookup, gaps, gaps_unindexed,
    report_gaps, context_rows, page, centred_window, first_rows, order_check, digests, timeline_digest, changed_ranges, type_filter,
    sxfy_filter, time_range, time_inputs, time_windows, time_window_one, after_anchor, before_anchor, bookmark_only,
    bookmark_exception, bookmark_decoration, bookmark_timeline, display_rows, log_text, composed_filter,
    composed_without_keywords, sxfy_normalised, keyword_literal, keyword_case_sensitive, keyword_accented,
    keyword_regex, keyword_named_group, keyword_annotated, keyword_bad_regex, keyword_sxfy, keyword_and_or_exclude, keyword_any_of, keyword_exclude_only,
    keyword_matrix, keyword_matrix_list, keyword_combinations, keyword_hits, reference_name_search, reference_variable_search,
    find_in_results, find_next, highlight, highlight_terms, gram_postings, indexed_search, indexed_search_trigram,
    indexed_search_short, indexed_search_accented, used_ceids, used_rptids, event_name_dimension,
    report_variable_dimension, event_lookup, event_lookup_wildcard, attach_names, annotated_messages,
    annotated_extended, annotated_without_variables, alarms, alarm_summary, object_events, object_event_filter,
    events_per_type, carrier_roundtrip, carrier_roundtrips, related_candidates, flow_terms, related_search,
    statistics, statistics_bookmarked, top_sxfy, top_ceids, top_event_names, top_ceid_hints, log_span,
    first_alarm, problem_entry, problem_context, pre_problem_signals, largest_gap, report_scope,
    investigation_report, report_files, filter_descriptions, xml_pieces, line_diff, aligned_diff,
]


def registered() -> dict:
    return {q.__name__: q for q in QUERIES}



