"""The investigation report, as bounded DataFrames of text lines."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import display_time, report_gap_text, short_message, to_millis
from ..operators.alarms import summarize_alarms
from ..operators.search import keyword_counts
from ..staging import stage
from ..operators.ordered import looked_up
from ..schema import MMI, SECS, first_seen, order_key, shown

# Defaults of the report's own limits; each is a parameter of the functions below.
CONTEXT_ROWS = 5
MAX_SIGNALS = 8

# Fixed patterns of the values that hint at what led to a problem.
SIGNALS = (
    ("SxFy", r"(?iuU)\bS\d+F\d+W?\b", 0),
    ("Carrier", r"(?iuU)\b(?:CARRIER_ID|CarrierID|CARRIERID)\s*[:=]\s*([^,\s]+)", 1),
    ("Substrate", r"(?iuU)\b(?:SubstrateID|SubstID)\s*[:=]\s*([^,\s]+)", 1),
    ("Acquired", r"(?iuU)\bAcquiredID\s*[:=]\s*([^,\s]+)", 1),
    ("Port", r"(?iuU)\b(?:Port No|PortNo|PorNo|LocID)\s*[:=]\s*([^,\s]+)", 1),
)


def named(entries: DataFrame, event_names: DataFrame | None) -> DataFrame:
    """Fill missing event names from the dimension."""
    if event_names is None:
        return entries
    names = event_names.select("ceid", F.col("name").alias("_name"))
    own = F.nullif("event_name", F.lit(""))
    return looked_up(entries, names, "ceid").withColumn("event_name", F.coalesce(own, "_name")).drop("_name")


def scoped(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """Only the rows that belong to a reported entry, by (timestamp, file, line)."""
    return rows.join(entries.select("timestamp", "source_file", "line_no"), ["timestamp", "source_file", "line_no"], "left_semi")


def problem_predicate(entries: DataFrame) -> Column:
    text = F.lower(shown(entries))
    level = F.lower(F.coalesce("level_name", F.lit("")))
    return level.isin("alarm", "fail") | F.contains(text, F.lit("alarm")) | text.rlike(r"(?U)\b(?:fail|failed)\b")


def problem_entry(entries: DataFrame, alarms: DataFrame) -> DataFrame:
    """The first problem entry (zero or one row): by level or text, else the entry of the first alarm."""
    direct = entries.filter(problem_predicate(entries)).agg(F.min(order_key()).alias("key"))
    first_alarm = alarms.agg(F.min(order_key()).alias("key"))
    key = F.coalesce(direct.scalar(), first_alarm.scalar())
    return entries.filter(order_key() == key)


def problem_context(entries: DataFrame, problem: DataFrame, before: int = CONTEXT_ROWS, after: int = CONTEXT_ROWS) -> DataFrame:
    """The rows around the problem entry with `marker`, `step` (0 at the centre) and `gap_ms` to the row before.

    Neighbours are top-k selections on either side of the key: no sort of the whole timeline, no global window.
    """
    key = problem.select(order_key().alias("key")).scalar()
    earlier = entries.filter(order_key() < key).orderBy(order_key().desc()).limit(before + 1)
    later = entries.filter(order_key() > key).orderBy(order_key()).limit(after)
    near = earlier.unionByName(problem).unionByName(later).withColumn("_key", order_key())
    # At most before + after + 2 rows from here on.
    by_key = Window.orderBy("_key")
    centre = F.max(F.when(F.col("_key") == key, F.col("_n"))).over(Window.partitionBy())
    rows = near.withColumn("_n", F.row_number().over(by_key)).withColumn("step", F.col("_n") - centre)
    rows = rows.withColumn("gap_ms", to_millis(F.col("timestamp")) - to_millis(F.lag("timestamp").over(by_key)))
    marker = F.when(F.col("step") == 0, "CENTER").when(F.col("step") < 0, "before").otherwise("after")
    return rows.filter(F.col("step") >= -before).withColumn("marker", marker).drop("_key", "_n")


def _labels(title: str, values: Column) -> Column:
    return F.transform(
        values, lambda v: F.struct(F.concat(F.lit(title + " "), v).alias("label"), F.lit(True).alias("closes"))
    )


def signals(context: DataFrame, event_names: DataFrame | None = None, most: int = MAX_SIGNALS) -> DataFrame:
    """One row `signals`: labelled values of the rows before the problem, in order of appearance; NULL without any.

    The list is closed by the first pattern match at which it has `most` entries.
    """
    rows = named(context.filter("step < 0"), event_names)
    name = F.nullif("event_name", F.lit(""))
    label = F.concat(F.lit("CEID "), F.col("ceid").cast("string"), F.coalesce(F.concat(F.lit(" ("), name, F.lit(")")), F.lit("")))
    groups = [
        F.when(F.col("ceid").isNotNull(), F.array(F.struct(label.alias("label"), F.lit(False).alias("closes")))).otherwise(
            F.array().cast("array<struct<label:string,closes:boolean>>")
        )
    ]
    for title, pattern, group in SIGNALS:
        values = F.regexp_extract_all(shown(rows), F.lit(pattern), F.lit(group))
        groups.append(_labels(title, F.transform(values, F.upper) if title == "SxFy" else values))
    # Five rows at most are gathered here.
    per_row = rows.select("step", F.concat(*groups).alias("found"))
    ordered = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("step", "found"))), lambda r: r["found"]))

    def add(acc: Column, item: Column) -> Column:
        fresh = F.array_distinct(F.concat(acc["labels"], F.array(item["label"])))
        labels = F.when(acc["done"], acc["labels"]).otherwise(fresh)
        done = acc["done"] | (item["closes"] & (F.size(labels) >= most))
        return F.struct(labels.alias("labels"), done.alias("done"))

    start = F.struct(F.array().cast("array<string>").alias("labels"), F.lit(False).alias("done"))
    listed = F.aggregate("all", start, add, lambda acc: acc["labels"])
    return per_row.agg(ordered.alias("all")).select(F.nullif(F.array_join(listed, "; "), F.lit("")).alias("signals"))


def largest_gap(context: DataFrame) -> DataFrame:
    """The row before which the largest gap lies among the five steps up to the problem; the first one on a tie."""
    steps = context.filter(f"step <= 0 AND step > -{CONTEXT_ROWS} AND gap_ms IS NOT NULL")
    return steps.orderBy(F.abs("gap_ms").desc(), "step").limit(1)


def log_span(entries: DataFrame) -> DataFrame:
    return entries.agg(F.min("timestamp").alias("first"), F.max("timestamp").alias("last")).withColumn(
        "duration_ms", to_millis(F.col("last")) - to_millis(F.col("first"))
    )


def duration_text(ms: Column) -> Column:
    """`[D day[s], ]H:MM:SS[.ffffff]`."""
    days, rest = F.floor(ms / 86_400_000), ms % 86_400_000
    secs = F.floor(rest / 1000)
    clock = F.format_string("%d:%02d:%02d", F.floor(secs / 3600), F.floor(secs / 60) % 60, secs % 60)
    micros = F.when(rest % 1000 != 0, F.format_string(".%03d000", rest % 1000)).otherwise("")
    plural = F.when(days == 1, " day, ").otherwise(" days, ")
    return F.concat(F.when(days != 0, F.concat(days.cast("string"), plural)).otherwise(""), clock, micros)


def first_alarm(alarms: DataFrame) -> DataFrame:
    """The earliest alarm, the first one on a tie."""
    return alarms.orderBy(order_key()).limit(1)


def top_ceid_hints(entries: DataFrame, event_names: DataFrame | None = None, limit: int = 5) -> DataFrame:
    """(ceid, event_name, entries) of the most frequent pairs; ties keep the first-seen order."""
    rows = named(entries, event_names).filter("ceid IS NOT NULL")
    counts = rows.groupBy("ceid", F.coalesce("event_name", F.lit("")).alias("event_name")).agg(
        F.count("*").alias("entries"), F.min(first_seen(entries)).alias("_first")
    )
    return counts.orderBy(F.desc("entries"), "_first").limit(limit)


def _spot() -> Column:
    return F.concat(F.lit("["), F.col("log_type"), F.lit("] "), F.col("source_file"), F.lit(":"), F.col("line_no").cast("string"))


def around_problem(entries: DataFrame, alarms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The problem entry and the rows around it, a dozen rows, written once for all that reads them."""
    problem = stage(problem_entry(entries, alarms), "problem")
    return problem, stage(problem_context(entries, problem), "context")


def hints(
    entries: DataFrame, alarms: DataFrame, matches: DataFrame, event_names: DataFrame | None = None,
    around: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """(ord, text): the investigation hints that apply."""
    around = around or around_problem(entries, alarms)
    span = log_span(entries).filter("first IS NOT NULL").select(
        F.lit(1).alias("ord"),
        F.concat(
            F.lit("Log span: "), display_time(F.col("first")), F.lit(" -> "), display_time(F.col("last")), F.lit(" ("),
            duration_text(F.col("duration_ms")), F.lit(")"),
        ).alias("text"),
    )
    code = F.coalesce(F.concat(F.lit(" code="), F.nullif("alarm_code", F.lit(""))), F.lit(""))
    alarm = first_alarm(alarms).select(
        F.lit(2).alias("ord"),
        F.concat(F.lit("First alarm: "), display_time(F.col("timestamp")), code, F.lit(" | "), short_message(F.col("message"))).alias("text"),
    )
    problem, context = around
    first = problem.select(
        F.lit(3).alias("ord"),
        F.concat(
            F.lit("First Fail/Alarm log: "), display_time(F.col("timestamp")), F.lit(" "), _spot(), F.lit(" | "),
            F.coalesce("level_name", F.lit("")), F.lit(" | "), short_message(shown(entries)),
        ).alias("text"),
    )
    before = signals(context, event_names).filter("signals IS NOT NULL").select(
        F.lit(4).alias("ord"), F.concat(F.lit("Pre-problem signals: "), F.col("signals")).alias("text")
    )
    gap = largest_gap(context).select(
        F.lit(5).alias("ord"),
        F.concat(
            F.lit("Largest pre-problem gap: "), report_gap_text(F.col("gap_ms")), F.lit(" before "),
            display_time(F.col("timestamp")), F.lit(" "), _spot(),
        ).alias("text"),
    )
    label = F.concat(
        F.lit("CEID "), F.col("ceid").cast("string"),
        F.when(F.col("event_name") != "", F.concat(F.lit(" ("), F.col("event_name"), F.lit(")"))).otherwise(""),
        F.lit(": "), F.col("entries").cast("string"), F.lit("x"),
    )
    ceids = _joined(top_ceid_hints(entries, event_names), F.struct((-F.col("entries")).alias("n"), "_first"), label, 6, "Top CEID/Event: ")
    counts = keyword_counts(matches).withColumn("_rank", F.monotonically_increasing_id())
    word = F.concat(F.col("keyword"), F.lit(": "), F.col("hits").cast("string"), F.lit("x"))
    words = _joined(counts, F.struct((-F.col("hits")).alias("n"), "_rank"), word, 7, "Top matched keywords: ")
    found = span.unionByName(alarm).unionByName(first).unionByName(before).unionByName(gap).unionByName(ceids).unionByName(words)
    none = entries.agg(F.count("*").alias("n")).select(
        F.lit(8).alias("ord"), F.lit("No entries available for investigation hints.").alias("text"), "n"
    )
    # Without entries every scoped table is empty, so no other hint applies.
    return found.unionByName(none.filter("n = 0").drop("n"))


def _joined(top: DataFrame, order: Column, text: Column, ord_: int, prefix: str) -> DataFrame:
    # `top` has at most five rows.
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("t")))), lambda r: r["t"]), "; ")
    return top.agg(listed.alias("t")).filter("t <> ''").select(F.lit(ord_).alias("ord"), F.concat(F.lit(prefix), F.col("t")).alias("text"))


def report(
    entries: DataFrame,
    events: DataFrame,
    alarms: DataFrame,
    matches: DataFrame,
    *,
    keyword: str = "",
    skipped_setup: int = 0,
    files: list[tuple[str, str]] | None = None,
    markdown: bool = True,
    event_names: DataFrame | None = None,
    generated: datetime | None = None,
    max_alarms: int = 20,
    max_events: int = 200,
    max_matches: int = 100,
    message_chars: int = 160,
    match_chars: int = 120,
) -> DataFrame:
    """(section, ord, text): the report's lines. Everything is restricted to the reported entries.

    A report shows the most frequent alarms, the first events and the first matches, as many as its limits say, and counts the rest.
    """
    spark = entries.sparkSession
    # Read by every section: the scoped rows are written once.
    alarms, events, matches = (stage(scoped(df, entries), "report") for df in (alarms, events, matches))
    bullet = "- " if markdown else "  * "

    def fixed(section: int, start: float, lines: list[str]) -> DataFrame:
        return spark.createDataFrame([(section, float(start + i), t) for i, t in enumerate(lines)], "section int, ord double, text string")

    def heading(text: str, level: int = 2) -> list[str]:
        return [f"{'#' * level} {text}"] if markdown else [text, ("=" if level == 1 else "-") * len(text)]

    def bullets(section: int, df: DataFrame, ord_: Column, text: Column) -> DataFrame:
        return df.select(F.lit(section).alias("section"), ord_.cast("double").alias("ord"), F.concat(F.lit(bullet), text).alias("text"))

    def counted(section: int, df: DataFrame, cases) -> DataFrame:
        """`cases`: (ord, predicate on n, text from n)."""
        n = df.agg(F.count("*").alias("n"))
        out = None
        for ord_, when, text in cases:
            part = bullets(section, n.filter(when), F.lit(ord_), text)
            out = part if out is None else out.unionByName(part)
        return out

    stamp = (generated or datetime.now()).strftime("%Y-%m-%d %H:%M:%S")
    totals = entries.agg(
        F.count("*").alias("all"),
        F.count_if(F.col("log_type") == MMI).alias("mmi"),
        F.count_if(F.col("log_type") == SECS).alias("secs"),
    ).select(
        F.posexplode(
            F.array(
                F.concat(F.lit("Total parsed entries: "), F.col("all")),
                F.concat(F.lit("MMI entries: "), F.col("mmi")),
                F.concat(F.lit("SECS entries: "), F.col("secs")),
            )
        ).alias("i", "t")
    )
    extra = [bullet + f"Skipped Setup.ini dump lines: {skipped_setup}"] if skipped_setup else []
    extra += [bullet + f"Search keyword: {keyword}"] if keyword else []
    parts = [
        fixed(1, 0, heading("Log Analysis Report", 1) + ["", bullet + f"Generated: {stamp}"]),
        bullets(1, totals, F.col("i") + 10, F.col("t")),
        fixed(1, 20, extra + [""]),
    ]
    if files:
        parts.append(fixed(2, 0, heading("Uploaded Files") + [f"{bullet}{name} ({kind})" for name, kind in files] + [""]))
    around = around_problem(entries, alarms)
    parts.append(fixed(3, 0, heading("Investigation Hints")))
    parts.append(bullets(3, hints(entries, alarms, matches, event_names, around), F.col("ord") + 10, F.col("text")))
    parts.append(fixed(3, 100, [""]))

    problem, context = around
    has_problem = problem.agg(F.count("*").alias("n")).filter("n > 0")
    for i, line in enumerate(heading("Problem Context")):
        parts.append(has_problem.select(F.lit(4).alias("section"), F.lit(float(i) - 100).alias("ord"), F.lit(line).alias("text")))
    gap = report_gap_text(F.col("gap_ms"))
    line = F.concat(
        F.col("marker"), F.lit(": "), display_time(F.col("timestamp")), F.lit(" "),
        F.when(gap != "", F.concat(gap, F.lit(" | "))).otherwise(""), _spot(), F.lit(" | "),
        F.coalesce("level_name", F.lit("")), F.lit(" | "), short_message(shown(entries), message_chars),
    )
    parts.append(bullets(4, context, F.col("step"), line))
    parts.append(has_problem.select(F.lit(4).alias("section"), F.lit(100.0).alias("ord"), F.lit("").alias("text")))

    parts.append(fixed(5, -10, heading("Alarm Summary")))
    parts.append(
        counted(5, alarms, [
            (0, "n = 0", F.lit("No alarms detected in the reported entries.")),
            (0, "n > 0", F.concat(F.lit("Total alarm events: "), F.col("n"))),
        ])
    )
    ranked = summarize_alarms(alarms, 60, max_alarms).withColumn("_rank", F.monotonically_increasing_id())
    parts.append(bullets(5, ranked, F.col("_rank") + 1, F.concat(F.lit("["), F.col("occurrences"), F.lit("x] "), F.col("alarm"))))
    parts.append(fixed(5, 1e18, [""]))

    parts.append(fixed(6, -10, heading("Object State Timeline")))
    parts.append(
        counted(6, events, [
            (0, "n = 0", F.lit("No object events detected in the reported entries.")),
            (0, "n > 0", F.concat(F.lit("Total object events: "), F.col("n"))),
            (1e17, f"n > {max_events}", F.concat(F.lit("... and "), F.col("n") - max_events, F.lit(" more events"))),
        ])
    )
    top_events = events.orderBy(order_key()).limit(max_events).withColumn("_rank", F.monotonically_increasing_id())
    parts.append(
        bullets(6, top_events, F.col("_rank") + 1,
                F.concat(display_time(F.col("timestamp")), F.lit(" | "), F.col("event_type"), F.lit(" | "), F.col("details")))
    )
    parts.append(fixed(6, 1e18, [""]))

    parts.append(fixed(7, -10, heading("Keyword Search Results")))
    if not keyword:
        parts.append(fixed(7, 0, [bullet + "No keyword specified."]))
    else:
        parts.append(
            counted(7, matches, [
                (0, "n = 0", F.lit(f"No matches for: {keyword}")),
                (0, "n > 0", F.concat(F.lit("Matches: "), F.col("n"))),
                (1e17, f"n > {max_matches}", F.concat(F.lit("... and "), F.col("n") - max_matches, F.lit(" more matches"))),
            ])
        )
        top = matches.orderBy(order_key()).limit(max_matches).withColumn("_rank", F.monotonically_increasing_id())
        text = F.concat(display_time(F.col("timestamp")), F.lit(" "), _spot(), F.lit(" - "), F.substring(shown(matches), 1, match_chars))
        parts.append(bullets(7, top, F.col("_rank") + 1, text))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
