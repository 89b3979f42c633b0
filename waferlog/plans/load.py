"""End to end: files or texts to an ordered timeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.entries import parse_entries, parse_timeline
from ..sources.manifest import ingest, stored_entries
from ..sources.ordered_store import ordered_timeline, update_order
from ..sources.raw import lines_from_texts, read_log_files


def load_files(spark: SparkSession, paths, **options) -> DataFrame:
    """Entries of all log files under the paths, with their timeline index."""
    return parse_timeline(read_log_files(spark, paths), **options)


def load_texts(texts: DataFrame, **options) -> DataFrame:
    """The same over rows (source_file, content)."""
    return parse_timeline(lines_from_texts(texts), **options)


def load_incremental(spark: SparkSession, paths, store: str, **options) -> tuple[DataFrame, dict]:
    """(entries, {hits, misses}): only new or changed files are parsed, the others come from the store."""

    def parse(changed):
        return parse_entries(read_log_files(spark, changed), **options)

    keyed = {k: v for k, v in options.items() if k in ("skip_setup_dump", "excluded_ceids")}
    stats = ingest(spark, paths, store, parse, **keyed)
    return stored_entries(spark, store), stats


def load_ordered(spark: SparkSession, paths, store: str, **options) -> tuple[DataFrame, dict]:
    """(timeline, {hits, misses, ranges, rewritten}): as `load_incremental`, and the store's order follows, range by range."""
    _, stats = load_incremental(spark, paths, store, **options)
    stats = stats | update_order(spark, store)
    return ordered_timeline(spark, store), stats
