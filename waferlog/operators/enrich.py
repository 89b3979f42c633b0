"""Joining event and variable names into entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import secs
from ..functions.text import rstrip
from ..schema import ENTRY_KEY
from .ordered import looked_up

_TARGETS = "array<struct<kind:string,line:int,id:bigint,ord:int>>"


def used_ceids(entries: DataFrame) -> DataFrame:
    return entries.select("ceid").filter(F.col("ceid").isNotNull()).distinct()


def used_rptids(entries: DataFrame) -> DataFrame:
    return entries.select(F.explode("s6f11_rptids").alias("rptid")).distinct()


def attach_event_names(entries: DataFrame, event_names: DataFrame | None) -> DataFrame:
    """Entries with `event_name` looked up by CEID; NULL where no name is known."""
    if event_names is None:
        return entries
    names = event_names.select("ceid", F.col("name").alias("event_name"))
    return looked_up(entries.drop("event_name"), names, "ceid")


def item_table(entries: DataFrame) -> DataFrame:
    """One row per `<TYPE [n] value>` line, with its parent line and its place among the siblings."""
    nodes = secs.item_nodes(F.col("message"))
    return entries.select(*ENTRY_KEY, F.explode(nodes).alias("n")).select(
        *ENTRY_KEY,
        F.col("n.line").alias("item_line"),
        F.col("n.indent").alias("indent"),
        F.col("n.type").alias("item_type"),
        F.col("n.count").try_cast("long").alias("item_count"),
        F.trim(F.col("n.value")).alias("value"),
        F.col("n.up1").alias("parent_line"),
        F.col("n.ord").alias("ordinal"),
    )


def _targets(message: Column, extended: bool) -> Column:
    """Lines of an S6F11 message that take a suffix: the event id, each report id, each reported value."""

    def ceid_target(nodes: Column, body: Column) -> Column:
        spot = F.get(F.filter(nodes, lambda n: (n["up1"] == body) & (n["ord"] == 2)), F.lit(0))
        ceid, line = secs.int_value(spot), spot["line"]
        if extended:
            ceid, line = F.coalesce(ceid, secs.inline_ceid(message)), F.coalesce(line, F.lit(0))
        one = F.array(F.struct(F.lit("ceid").alias("kind"), line.alias("line"), ceid.alias("id"), F.lit(0).alias("ord")))
        return F.when(ceid.isNotNull() & line.isNotNull(), one.cast(_TARGETS)).otherwise(F.array().cast(_TARGETS))

    def value_targets(nodes: Column, reports: Column) -> Column:
        rptid_of = F.map_from_arrays(
            F.transform(reports, lambda r: r["report"]), F.transform(reports, lambda r: r["rptid"])
        )
        values = secs.bind(
            rptid_of,
            lambda known: F.transform(
                F.filter(
                    nodes,
                    lambda n: (n["up1_ord"] == 2) & F.map_contains_key(known, n["up2"]),
                ),
                lambda n: F.struct(
                    F.lit("value").alias("kind"),
                    n["line"].alias("line"),
                    F.try_element_at(known, n["up2"]).alias("id"),
                    n["ord"].alias("ord"),
                ),
            ),
        ).cast(_TARGETS)
        if not extended:
            return values
        ids = F.transform(
            reports,
            lambda r: F.struct(F.lit("rptid").alias("kind"), r["id_line"].alias("line"), r["rptid"].alias("id"), F.lit(0).alias("ord")),
        ).cast(_TARGETS)
        return F.concat(ids, values)

    def all_targets(nodes: Column, body: Column) -> Column:
        reports = F.coalesce(
            secs.report_ids(nodes, body), F.array().cast("array<struct<report:int,rptid:bigint,id_line:int>>")
        )
        return secs.bind(reports, lambda rs: F.concat(ceid_target(nodes, body), value_targets(nodes, rs)))

    return secs.bind(secs.item_nodes(message), lambda nodes: secs.bind(secs.body_line(nodes), lambda b: all_targets(nodes, b)))


def reports() -> Column:
    """Rows whose lines can take a name at all."""
    return F.coalesce((F.col("sxfy_type") == "S6F11") & F.contains("message", F.lit("S6F11")), F.lit(False))


def line_suffixes(
    entries: DataFrame, event_names: DataFrame | None, report_variables: DataFrame | None, style: str = "plain"
) -> DataFrame:
    """(source_path, line_no, item_line, suffix). One dimension may be missing; the other still applies."""
    extended = style == "extended"
    rows = entries.filter(reports())
    targets = rows.select(*ENTRY_KEY, F.explode(_targets(F.col("message"), extended)).alias("t")).select(*ENTRY_KEY, "t.*")
    # Both dimensions become one lookup by (kind, id, ord), so that the item trees are built once.
    parts = []
    if event_names is not None:
        label = F.concat(F.lit(" // (CEID "), F.col("ceid").cast("string"), F.lit(") "), F.col("name"))
        parts.append(
            event_names.filter("name <> ''").select(
                F.lit("ceid").alias("kind"), F.col("ceid").alias("id"), F.lit(0).alias("ord"), label.alias("suffix")
            )
        )
    if report_variables is not None:
        label = F.concat(F.lit(" // (VID " if extended else " // ("), F.col("vid").cast("string"), F.lit(") "), F.col("name"))
        parts.append(
            report_variables.select(
                F.lit("value").alias("kind"),
                F.col("rptid").alias("id"),
                F.col("position").cast("int").alias("ord"),
                (label if extended else rstrip(label)).alias("suffix"),
            )
        )
    lookup = parts[0].unionByName(parts[1]) if len(parts) == 2 else parts[0]
    # A dimension may name an id twice; a line takes one suffix.
    lookup = lookup.groupBy("kind", "id", "ord").agg(F.max("suffix").alias("suffix"))
    own = F.when(F.col("kind") == "rptid", F.concat(F.lit(" // (RPTID "), F.col("id").cast("string"), F.lit(")")))
    return (
        targets.join(lookup, ["kind", "id", "ord"], "left")
        .withColumn("suffix", F.coalesce("suffix", own))
        .filter("suffix IS NOT NULL")
        .select(*ENTRY_KEY, F.col("line").alias("item_line"), "suffix")
    )


def annotate(
    entries: DataFrame,
    event_names: DataFrame | None = None,
    report_variables: DataFrame | None = None,
    style: str = "plain",
) -> DataFrame:
    """Add `display_message`: the message with name suffixes on its lines. The message itself never changes."""
    if event_names is None and report_variables is None:
        return entries.withColumn("display_message", F.col("message"))
    suffixes = line_suffixes(entries, event_names, report_variables, style)
    per_entry = suffixes.groupBy(*ENTRY_KEY).agg(
        F.map_from_entries(F.collect_list(F.struct("item_line", "suffix"))).alias("_suffix")
    )
    shown = F.array_join(
        F.transform(
            F.split("message", "\n"),
            lambda line, i: F.concat(line, F.coalesce(F.try_element_at(F.col("_suffix"), i), F.lit(""))),
        ),
        "\n",
    )
    # Only report messages change; the rest of the log is passed on without a shuffle.
    changed = (
        entries.filter(reports())
        .join(per_entry, ENTRY_KEY, "left")
        .withColumn("display_message", F.when(F.col("_suffix").isNull(), F.col("message")).otherwise(shown))
        .drop("_suffix")
    )
    return changed.unionByName(entries.filter(~reports()).withColumn("display_message", F.col("message")))
