"""Removal of repeated passages by overlapping windows of three lines."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..staging import stage
from .common import ROW, packed, unpacked

WINDOW_LINES = 3
OUTPUTS = ["text", "n_lines", "n_removed"]
#: White space around a line, which comparisons leave out; a line of nothing else is blank.
BLANKS = " \t\n\x0b\x0c\r"


def filled_lines(text: Column) -> Column:
    """The trimmed lines that aren't blank."""
    lines = F.transform(F.split(text, "\n", -1), lambda line: F.btrim(line, F.lit(BLANKS)))
    return F.filter(lines, lambda line: line != "")


def _windows(docs: DataFrame, width: int) -> DataFrame:
    """A row per window: 128 bits of its lines, its document (key and hash of the text) and its first line's place."""
    lines = docs.select("k", "t", filled_lines(F.col("text")).alias("lines")).where(F.size("lines") >= width)

    def window(at: Column) -> Column:
        text = F.array_join(F.slice("lines", at, width), "\n")
        return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit("second"), text).alias("b"), at.alias("at"))

    places = F.sequence(F.lit(1), F.size("lines") - (width - 1))
    return lines.select("k", "t", F.inline(F.transform(places, window)))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WINDOW_LINES, carry: list[str] | None = None) -> DataFrame:
    """Replaces `text` by the text without repeated passages; adds `n_lines` (lines that aren't blank) and `n_removed` of them.

    Every `width` consecutive lines that aren't blank, trimmed, are a window. Of windows with the same lines, in all documents, the first
    by (key, place) stays; the lines that any later one covers are removed, overlaps merged. A blank line goes with the line before it.
    A text that loses nothing stays as it is, to the byte. A document may lose all its lines: its text is then empty.

    Null and blank texts, and texts of fewer than `width` lines, have no windows and stay. A null key sorts first. Of documents with
    equal keys, the one with the smaller text hash comes first; rows equal in key and text are one document and are all left with the
    same text. A carried column with the name of an output is replaced.

    Windows meet as counts and minima per hash, combined before the shuffle; a very common window is joined back in split partitions.
    """
    source = docs.select(F.col(f"`{key}`").alias("k"), F.xxhash64(F.col(f"`{text}`")).alias("t"), F.col(f"`{text}`").alias("text"))
    windows = _windows(source, width)
    place = F.struct("k", "t", "at")
    first = stage(windows.groupBy("a", "b").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").drop("n"), "windows")
    # Joined by sorting at every size, so that plans and costs of small inputs tell those of large ones.
    later = windows.join(first.hint("merge"), ["a", "b"]).where(~place.eqNullSafe(F.col("first")))
    covered = stage(later.groupBy("k", "t").agg(F.sort_array(F.collect_set("at")).alias("starts")), "covered")

    def rebuild(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, starts in batches:
            yield pd.DataFrame([without_lines(t, s, width) for t, s in zip(texts, starts)], columns=["cleaned", "removed"])

    mine = docs.select(packed(docs, carry), F.col(f"`{text}`").alias("text"), F.col(f"`{key}`").alias("k"), F.xxhash64(F.col(f"`{text}`")).alias("t"))
    hit = F.col("starts").isNotNull()
    joined = mine.join(covered.hint("merge"), mine.k.eqNullSafe(covered.k) & (mine.t == covered.t), "left").select(
        ROW, mine.text, "starts", F.when(hit, mine.text).alias("touched"))
    # not deterministic for the planner only: a filter on the result must not make it run twice
    cleaned = F.pandas_udf(rebuild, "cleaned string, removed int").asNondeterministic()("touched", "starts")
    rebuilt = joined.withColumn("c", cleaned)
    return unpacked(rebuilt.select(
        ROW, F.when(hit, F.col("c.cleaned")).otherwise(F.col("text")).alias("text"),
        F.coalesce(F.size(filled_lines(F.col("text"))), F.lit(0)).alias("n_lines"), F.when(hit, F.col("c.removed")).otherwise(F.lit(0)).alias("n_removed"),
    ), OUTPUTS)


def without_lines(text: str | None, starts, width: int = WINDOW_LINES) -> tuple[str | None, int]:
    """The text without the filled lines that windows starting at the given places (from 1, sorted) cover, and how many those are."""
    if text is None or starts is None:
        return text, 0
    covered: set[int] = set()
    for start in starts:
        covered.update(range(start, start + width))
    kept, number, keep = [], 0, True
    for line in text.split("\n"):
        if line.strip(BLANKS):
            number += 1
            keep = number not in covered
        if keep:
            kept.append(line)
    return "\n".join(kept), len(covered)
