"""Ordered computations that never put one file, key or timeline into a single task.

* `running_offset`  - prefix sums over blocks of a file (two levels: block totals, then rows)
* `dense_index`     - global dense row numbers through a range-partitioned sort
* `with_previous`   - the preceding row's values on a dense index, through overlapping blocks
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..staging import stage

BLOCK_ROWS = 65_536


def running_offset(totals: DataFrame, group: list[str], block: str, total: str, out: str) -> DataFrame:
    """`totals` has one row per (group, block); adds the sum of all earlier blocks of the group."""
    before = Window.partitionBy(*group).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumn(out, F.coalesce(F.sum(total).over(before), F.lit(0).cast("long")))


def dense_index(df: DataFrame, order: list[Column], out: str, label: str = "sorted", finish=None) -> DataFrame:
    """Add a 0-based dense position in the given total order.

    The sort is a range partitioning on the full (unique) key, so equal timestamps still split over tasks. Each
    sorted row keeps (partition, position in partition); it is staged once, and the position becomes global by
    adding the row counts of the earlier partitions - a table with one row per partition, hence the broadcast.

    `finish` adds columns row by row after the sort: range partitioning evaluates its input twice (once to sample),
    so costly columns belong there.
    """
    names = [f"_order{i}" for i in range(len(order))]
    keyed = df.select("*", *[c.alias(n) for c, n in zip(order, names)])
    ranged = keyed.repartitionByRange(*names).sortWithinPartitions(*names).drop(*names)
    placed = ranged.withColumn("_pos", F.monotonically_increasing_id())
    staged = stage(finish(placed) if finish else placed, label)
    part = F.shiftright("_pos", 33)
    counts = staged.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    offsets = stage(offsets.coalesce(1), f"{label}-offsets")
    return (
        staged.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(out, F.col("_start") + F.col("_pos").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_part", "_start", "_pos")
    )


def with_previous(df: DataFrame, index: str, values: dict[str, Column], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add `values` of the row at `index - 1` (NULL on the first row). `index` must be dense.

    Rows are windowed in fixed-size blocks; the last row of a block is also sent to the next block, so a block's
    first row finds its predecessor without any per-key or global window.
    """
    block = F.floor(F.col(index) / block_rows)
    last_of_block = F.col(index) % block_rows == block_rows - 1
    spread = df.withColumn("_home", block).withColumn(
        "_block", F.explode(F.when(last_of_block, F.array("_home", F.col("_home") + 1)).otherwise(F.array("_home")))
    )
    w = Window.partitionBy("_block").orderBy(index)
    lagged = spread.select("*", *[F.lag(expr).over(w).alias(name) for name, expr in values.items()])
    return lagged.filter(F.col("_block") == F.col("_home")).drop("_block", "_home")


def gaps_on_index(df: DataFrame, index: str, ms: Column, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds `position` (0-based) and `_before` (`ms` of the row before) to rows that are some of an indexed timeline's.

    Rows are numbered inside blocks of the index; one row per block carries counts and last values from block to block. Nothing is sorted
    anew or written.
    """
    rows = df.withColumns({"_block": F.floor(F.col(index) / block_rows), "_ms": ms})
    earlier = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy("_block").agg(F.count("*").alias("_n"), F.max(F.struct(index, "_ms"))["_ms"].alias("_last")).select(
        "_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"), F.last("_last").over(earlier).alias("_carried"))
    inside = Window.partitionBy("_block").orderBy(index)
    return rows.join(carried, "_block").withColumns({
        "position": F.col("_start") + F.row_number().over(inside) - 1,
        "_before": F.coalesce(F.lag("_ms").over(inside), "_carried"),
    }).drop("_block", "_ms", "_start", "_carried")


def looked_up(rows: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Left join with a dimension on a key that most rows may lack: rows with a NULL key are spread, not sent to one task."""
    spread = F.when(F.col(key).isNull(), 1 + F.pmod(F.xxhash64("source_path", "line_no"), F.lit(4096))).otherwise(F.lit(0).cast("long"))
    keyed = dimension.withColumnRenamed(key, "_key").withColumn("_spread", F.lit(0).cast("long"))
    joined = rows.withColumns({"_key": F.coalesce(F.col(key), F.lit(0)), "_spread": spread}).join(keyed, ["_key", "_spread"], "left")
    return joined.drop("_key", "_spread")


def running_max(df: DataFrame, group: list[str], order: str, values: dict[str, Column], descending: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds the largest of `values` over the rows of the group that come before in `order`, a whole number; NULL on the first.

    Rows are windowed in blocks of `order`, one row per block carries the maxima on, so a group of any size spreads over tasks.
    """
    place = -F.col(order) if descending else F.col(order)
    rows = df.withColumns({"_block": F.floor(place / block_rows), **{f"_v_{n}": v for n, v in values.items()}})
    earlier = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy(*group, "_block").agg(*[F.max(f"_v_{n}").alias(f"_m_{n}") for n in values]).select(
        *group, "_block", *[F.max(f"_m_{n}").over(earlier).alias(f"_c_{n}") for n in values])
    inside = Window.partitionBy(*group, "_block").orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    found = {n: F.greatest(F.max(f"_v_{n}").over(inside), F.col(f"_c_{n}")) for n in values}
    return rows.join(carried, [*group, "_block"]).withColumns(found).drop("_block", *[f"{p}_{n}" for p in ("_v", "_c") for n in values])
