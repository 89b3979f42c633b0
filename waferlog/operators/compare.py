"""Comparing messages and timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.text import display_time, normalize_sxfy
from ..schema import type_order
from ..staging import stage
from .ordered import with_previous


def line_diff(pairs: DataFrame) -> DataFrame:
    """Line differences of `pairs(pair_id, left, right)`: (pair_id, mark, line, occurrence, left_no, right_no).

    The n-th occurrence of a line on one side meets the n-th on the other: equal; else it is deleted or inserted.
    """
    # A group is the repeats of one line inside one message.
    repeats = Window.partitionBy("pair_id", "line").orderBy("_no")

    def side(name: str) -> DataFrame:
        lines = pairs.select("pair_id", F.posexplode(F.split(name, "\n")).alias("_no", "line"))
        return lines.select(
            "pair_id",
            "line",
            F.row_number().over(repeats).alias("occurrence"),
            (F.col("_no") + 1).cast("long").alias(f"{name}_no"),
        )

    mark = F.when(F.col("right_no").isNull(), "delete").when(F.col("left_no").isNull(), "insert").otherwise("equal")
    return side("left").join(side("right"), ["pair_id", "line", "occurrence"], "full_outer").withColumn("mark", mark)


def digest_line():
    """The text of an entry that a digest covers."""
    kind = F.initcap(F.lower("log_type"))
    return F.concat_ws(
        "|",
        display_time(F.col("timestamp")),
        kind,
        F.col("source_file"),
        F.col("line_no").cast("string"),
        normalize_sxfy(F.col("message")),
    )


def entry_digests(entries: DataFrame) -> DataFrame:
    return entries.select("source_path", "line_no", F.sha2(F.concat(digest_line(), F.lit("\n")), 256).alias("sha256"))


def timeline_digest(indexed: DataFrame) -> DataFrame:
    """(entries, digest) of an indexed timeline: a count, and the sums of the eight words of the rows' SHA-256.

    The digested line starts with the row's place in the timeline, so two timelines of the same rows in another order differ.
    """
    placed = _placed_digest()
    words = [F.conv(F.substring("sha256", 8 * i + 1, 8), 16, 10).cast("decimal(38,0)") for i in range(8)]
    sums = F.concat_ws("-", *[F.sum(w).cast("string") for w in words])
    return indexed.select(placed.alias("sha256")).agg(F.count("*").alias("entries"), sums.alias("digest"))


def _placed_digest():
    """The digest of an entry at its place in the timeline."""
    return F.sha2(F.concat(F.col("timeline_index").cast("string"), F.lit("|"), digest_line(), F.lit("\n")), 256)


#: Entries under a leaf of a digest tree, and children of a node.
LEAF_ROWS = 4096
FANOUT = 16


def digest_tree(indexed: DataFrame, leaf_rows: int = LEAF_ROWS, fanout: int = FANOUT) -> DataFrame:
    """(level, node, rows, sha256): a Merkle tree over ranges of the index; the one node of the highest level is the root.

    Node n of level 0 covers `leaf_rows` positions from n * leaf_rows on, each level above `fanout` nodes of the one below. A node hashes
    its children's digests in order, so two timelines have the same root if and only if they agree entry by entry. Groups are bounded:
    a leaf joins `leaf_rows` digests, a node `fanout`. A timeline without entries has no node.
    """

    def joined(rows: DataFrame, place: str, size: int, level: int) -> DataFrame:
        digests = F.array_sort(F.collect_list(F.struct(place, "sha256")))
        return rows.groupBy(F.floor(F.col(place) / size).cast("long").alias("node")).agg(
            F.sum("rows").alias("rows"), F.sha2(F.array_join(digests["sha256"], ""), 256).alias("sha256")
        ).select(F.lit(level).alias("level"), "node", "rows", "sha256")

    placed = indexed.select("timeline_index", F.lit(1).cast("long").alias("rows"), _placed_digest().alias("sha256"))
    tree = top = stage(joined(placed, "timeline_index", leaf_rows, 0), "leaves")
    last, level = top.agg(F.max("node")).first()[0] or 0, 0
    while last:
        level, last = level + 1, last // fanout
        top = joined(top, "node", fanout, level)
        tree = tree.unionByName(top)
    return tree


def differing_ranges(left: DataFrame, right: DataFrame, leaf_rows: int = LEAF_ROWS, fanout: int = FANOUT) -> DataFrame:
    """(first, last, left_rows, right_rows): the leaf ranges in which two stored digest trees of the same shape differ, from the root down.

    Below a node whose digests agree nothing is compared. Ranges that only one timeline reaches have 0 rows on the other side.
    """
    height = max(t.agg(F.max("level")).first()[0] or 0 for t in (left, right))
    parents = None
    for level in range(height, -1, -1):
        sides = [t.filter(F.col("level") == level).select("node", F.col("rows").alias(f"{n}_rows"), F.col("sha256").alias(f"{n}_sha")) for n, t in (("left", left), ("right", right))]
        if parents is not None:
            sides = [s.withColumn("parent", F.floor(F.col("node") / fanout)).join(parents, "parent", "left_semi").drop("parent") for s in sides]
        found = sides[0].join(sides[1], "node", "full_outer").filter(~F.col("left_sha").eqNullSafe(F.col("right_sha")))
        parents = found.select(F.col("node").alias("parent"))
    rows = {f"{n}_rows": F.coalesce(f"{n}_rows", F.lit(0).cast("long")) for n in ("left", "right")}
    return found.select(
        (F.col("node") * leaf_rows).alias("first"), ((F.col("node") + 1) * leaf_rows - 1).alias("last"), *[c.alias(n) for n, c in rows.items()])


def order_violations(indexed: DataFrame) -> DataFrame:
    """One row: how many entries of an indexed timeline sort before their predecessor."""
    key = F.struct("timestamp", type_order().alias("t"), "source_file", "line_no")
    return with_previous(indexed, "timeline_index", {"_before": key}).agg(
        F.count("*").alias("entries"), F.count_if(key < F.col("_before")).alias("violations")
    )
