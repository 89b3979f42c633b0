"""Comparing texts line by line in their order: equal, replaced, deleted and inserted lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..staging import stage
from .ordered import BLOCK_ROWS, running_max

# A gap is what lies after a match (left_no gl, right_no gr) and before the next; gl names it.
_GAP = ["pair_id", "gl"]


def _left():
    return F.col("side") == 0


def lines_of(texts: DataFrame, text: str) -> DataFrame:
    """(pair_id, no, line) of texts, numbered from 1; a NULL text has no lines."""
    lines = texts.select("pair_id", F.posexplode(F.split(text, "\n")).alias("_no", "line"))
    return lines.select("pair_id", (F.col("_no") + 1).cast("long").alias("no"), "line")


def aligned_diff(left: DataFrame, right: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(pair_id, mark, left_no, right_no): the alignment of two tables (pair_id, no, line), numbered from 1 without holes, per pair.

    Round by round, each gap first matches equal lines from its start and from its end. Of the rest, lines that occur once on either side
    are anchors (where there are none, the first occurrences of lines that both sides have). Anchors that no other crosses match; of anchors
    that cross, the longest run that is consecutive on both sides matches first (then the one that starts first), and what crosses it
    is dropped. Matches cut their gap, until no gap has a line that both sides have. The lines left in a gap are replaced one by one from
    its start, what one side has more is deleted or inserted. So matches keep the order of both sides: a moved line is deleted and inserted.

    No window is keyed by a pair alone, so texts of any length spread over tasks. NULL lines are equal to each other; rows without a
    pair_id are left out.
    """
    def side(rows: DataFrame, number: int) -> DataFrame:
        key = F.unhex(F.sha2(F.coalesce(F.concat(F.lit("x"), "line"), F.lit("")), 256))
        zero = F.lit(0).cast("long")
        return rows.filter("pair_id IS NOT NULL").select(
            "pair_id", F.lit(number).alias("side"), F.col("no").cast("long").alias("no"), key.alias("key"), zero.alias("gl"), zero.alias("gr"))

    active = every = stage(side(left, 0).unionByName(side(right, 1)), "lines")
    rounds = []
    while True:
        found = stage(_matches(active, block_rows), "matches")
        if found.isEmpty():
            break
        rounds.append(found.select("pair_id", "l", "r"))
        moved = active.join(found.select(*_GAP).distinct(), _GAP, "left_semi")
        active = stage(_between(moved, found, block_rows), "lines")
    matched = reduce(DataFrame.unionByName, rounds) if rounds else found.select("pair_id", "l", "r")
    # Lines of a gap are consecutive on both sides, so the n-th stands beside the n-th.
    rest = _between(every, matched, block_rows).select("pair_id", "side", "gl", "no", _offset().alias("k"))
    beside = rest.groupBy(*_GAP, "k").agg(
        F.max(F.when(_left(), F.col("no"))).alias("left_no"), F.max(F.when(~_left(), F.col("no"))).alias("right_no"))
    mark = F.when(F.col("right_no").isNull(), "delete").when(F.col("left_no").isNull(), "insert").otherwise("replace")
    equal = matched.select("pair_id", F.lit("equal").alias("mark"), F.col("l").alias("left_no"), F.col("r").alias("right_no"))
    return equal.unionByName(beside.select("pair_id", mark.alias("mark"), "left_no", "right_no"))


def _offset():
    """The place of a line in its gap, from 1."""
    return F.col("no") - F.when(_left(), F.col("gl")).otherwise(F.col("gr"))


def _between(lines: DataFrame, matches: DataFrame, block_rows: int) -> DataFrame:
    """The lines that no match holds, each with the match before it; matches of one gap rise on both sides."""
    sides = [matches.select("pair_id", F.lit(n).alias("side"), F.col(c).alias("no"), "l", "r") for n, c in ((0, "l"), (1, "r"))]
    marked = lines.join(sides[0].unionByName(sides[1]), ["pair_id", "side", "no"], "left")
    before = running_max(marked, [*_GAP, "side"], "no", {"_l": F.col("l"), "_r": F.col("r")}, block_rows=block_rows)
    return before.filter("l IS NULL").select(
        "pair_id", "side", "no", "key", F.coalesce("_l", "gl").alias("gl"), F.coalesce("_r", "gr").alias("gr"))


def _matches(lines: DataFrame, block_rows: int) -> DataFrame:
    """(pair_id, gl, l, r): matches inside the gaps of `lines`."""
    sizes = lines.groupBy(*_GAP).agg(F.count_if(_left()).alias("nl"), F.count_if(~_left()).alias("nr")).filter("nl > 0 AND nr > 0")
    back = F.when(_left(), F.col("nl")).otherwise(F.col("nr")) - F.col("k") + 1
    placed = lines.join(sizes, _GAP).withColumn("k", _offset()).withColumn("back", back)

    def agreeing(place: str, out: str) -> DataFrame:
        """How many lines agree before the first that does not."""
        beside = placed.groupBy(*_GAP, "nl", "nr", place).agg(
            F.max(F.when(_left(), F.col("key"))).alias("a"), F.max(F.when(~_left(), F.col("key"))).alias("b"))
        differs = F.min(F.when(~F.col("a").eqNullSafe(F.col("b")), F.col(place)))
        return beside.groupBy(*_GAP).agg((F.coalesce(differs, F.max(place) + 1) - 1).alias(out))

    ends = placed.join(agreeing("k", "head"), _GAP).join(agreeing("back", "tail"), _GAP)
    ends = ends.withColumn("tail", F.least("tail", F.least("nl", "nr") - F.col("head")))
    at_start, at_end = F.col("k") <= F.col("head"), F.col("back") <= F.col("tail")
    partner = F.col("gr") + F.when(at_start, F.col("k")).otherwise(F.col("nr") - F.col("back") + 1)
    trimmed = ends.filter(_left() & (at_start | at_end)).select(*_GAP, F.col("no").alias("l"), partner.alias("r"))

    keys = ends.filter(~at_start & ~at_end).groupBy(*_GAP, "key").agg(
        F.min(F.when(_left(), F.col("no"))).alias("l"), F.min(F.when(~_left(), F.col("no"))).alias("r"),
        (F.count("*") == 2).alias("once")).filter("l IS NOT NULL AND r IS NOT NULL")
    some = keys.groupBy(*_GAP).agg(F.max("once").alias("any_once"))
    # Anchors are read many times below; the lines they come from, once.
    anchors = stage(keys.join(some, _GAP).filter("once = any_once").select(*_GAP, "l", "r"), "anchors")
    return trimmed if anchors.isEmpty() else trimmed.unionByName(_chain(anchors, block_rows))


def _chain(anchors: DataFrame, block_rows: int) -> DataFrame:
    """Those of the anchors (pair_id, gl, l, r) that rise on both sides, by the rule of `aligned_diff`."""
    def seen(rows, order, values, descending=False):
        return running_max(rows, _GAP, order, values, descending, block_rows)

    near = seen(anchors, "l", {"_before_l": F.col("l"), "_top": F.col("r")})
    near = seen(near, "r", {"_before_r": F.struct("r", "l")})
    near = seen(near, "l", {"_low": -F.col("r")}, descending=True)
    crossed = (F.coalesce("_top", F.lit(0)) > F.col("r")) | F.coalesce(-F.col("_low") < F.col("r"), F.lit(False))
    # A run goes on where the anchor before is the same one on either side.
    starts = ~F.col("_before_l").eqNullSafe(F.col("_before_r")["l"])
    near = stage(near.select(*_GAP, "l", "r", crossed.alias("crossed"), starts.alias("starts")), "crossings")
    kept = near.filter("NOT crossed").select(*_GAP, "l", "r")
    # What crosses anything crosses nothing beyond the next anchor that is not crossed.
    tangled = seen(near, "l", {"_safe": F.when(~F.col("crossed"), F.col("l")), "_start": F.when(F.col("starts"), F.col("l"))}).filter("crossed").select(
        *_GAP, F.coalesce("_safe", F.lit(0).cast("long")).alias("area"), F.when(F.col("starts"), F.col("l")).otherwise(F.col("_start")).alias("run"), "l", "r")
    tangled = stage(tangled, "tangled")
    runs = stage(tangled.groupBy(*_GAP, "area", "run").agg(F.min("r").alias("run_r"), F.count("*").alias("size")), "runs")
    chosen = None
    while not runs.isEmpty():
        best = runs.groupBy(*_GAP, "area").agg(F.max(F.struct("size", (-F.col("run")).alias("first"), "run", "run_r")).alias("best"))
        best = stage(best, "best")
        own = best.select(*_GAP, F.col("best.run").alias("run"))
        chosen = own if chosen is None else chosen.unionByName(own)
        after = (F.col("run") > F.col("best.run")) & (F.col("run_r") > F.col("best.run_r"))
        ahead = (F.col("run") < F.col("best.run")) & (F.col("run_r") < F.col("best.run_r"))
        # What lies ahead keeps the area's number, what lies after takes the chosen run's.
        area = F.when(after, F.col("best.run")).otherwise(F.col("area")).alias("area")
        runs = stage(runs.join(best, [*_GAP, "area"]).filter(after | ahead).select(*_GAP, area, "run", "run_r", "size"), "runs")
    return kept if chosen is None else kept.unionByName(tangled.join(chosen, [*_GAP, "run"]).select(*_GAP, "l", "r"))
