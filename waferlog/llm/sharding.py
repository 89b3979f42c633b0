"""Proportional stratified interleaving of rows into shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..staging import stage
from .common import ROW, hash60, packed, unpacked, with_positions

#: Rows that one group of a ranking window holds on average.
GROUP_ROWS = 50_000
#: Fewest slices of the mixed order, as bits.
LEAST_BITS = 10

OUTPUTS = ["position", "shard", "slot"]


def group_bits(rows: int) -> int:
    return min(40, max(LEAST_BITS, (rows // GROUP_ROWS).bit_length()))


def key_ranges(rows: DataFrame, order: Sequence[str], n_rows: int) -> DataFrame:
    """Adds `__u`, a number per row, and `__b`, which ascends with (order, `__u`); equal values of the order may be split. The rows are
    stored, as both must stay the same when tasks are repeated."""
    ranges = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_rows // GROUP_ROWS + 1)
    numbered = rows.withColumn("__u", F.monotonically_increasing_id())
    return stage(numbered.repartitionByRange(ranges, *order, "__u").withColumn("__b", F.spark_partition_id()), "ranges")


def stratified_shards(
    docs: DataFrame,
    n_shards: int,
    key: str = "doc_id",
    stratum: str = "source",
    seed: str = "mix-1",
    ties: Sequence[str] = (),
    carry: Sequence[str] | None = None,
) -> DataFrame:
    """Adds `position` (place in the mixed order), `shard` and `slot` (place in the shard), all from 0.

    Rows are put in a seeded random order inside each stratum. A row of rank r among the n of its stratum gets the fraction
    (r - u) / n, with u a seeded number in [0, 1) of the stratum; the rows sorted by fraction interleave the strata in proportion, and
    cuts at equal counts give shards that differ by one row at most and match the mixture.

    A stratum is never one group, nor is a key or null that many rows share: rows are split by ranges of stratum, hash, ties and a row
    number, whose counts give each range's first rank. The mixed order is split by ranges of the fraction.

    Null strata form a stratum of their own; a null key is hashed as an empty string. Rows with equal keys are ordered by `ties`
    (rows equal in those too are interchangeable). A carried column with the name of an output is replaced. No rows give no rows.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    text = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))
    label = F.when(F.col(f"`{stratum}`").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col(f"`{stratum}`").cast("string")))
    order = [f"__t{i}" for i in range(len(ties))]
    rows = docs.select(
        packed(docs, carry),
        label.alias("__s"),
        hash60(F.concat(F.lit(f"{seed}:"), text)).alias("__h"),
        *[F.col(f"`{c}`").alias(t) for c, t in zip(ties, order)],
    )
    n_rows = docs.count()
    ranged = key_ranges(rows, ["__s", "__h", *order], n_rows)
    by_stratum = Window.partitionBy("__s")
    earlier = by_stratum.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("__s", "__b").agg(F.count("*").alias("__n")).select(
        "__s", "__b",
        F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__start"),
        F.sum("__n").over(by_stratum).alias("__size"),
    )
    inside = Window.partitionBy("__s", "__b").orderBy("__h", *order, "__u")
    shift = hash60(F.concat(F.lit(f"{seed}:stratum:"), F.col("__s"))) / F.lit(float(2**60))
    rank = F.col("__start") + F.row_number().over(inside)
    ranked = ranged.join(starts, ["__s", "__b"]).withColumn("__rank", rank).select(
        ROW, "__s", "__rank", ((F.col("__rank") - shift) / F.col("__size")).alias("__f"))
    slices = 2 ** group_bits(n_rows)
    mixed = stage(ranked.withColumn("__g", F.least(F.floor(F.col("__f") * slices), F.lit(slices - 1))), "mixed")
    placed = with_positions(mixed, "__g", ["__f", "__s", "__rank"], "position", "__total")
    shard = F.expr(f"cast((position * {n_shards}) div __total as int)")
    first = F.expr(f"(cast(shard as long) * __total + {n_shards - 1}) div {n_shards}")
    return unpacked(placed.withColumn("shard", shard).withColumn("slot", F.col("position") - first), OUTPUTS)


def write_shards(sharded: DataFrame, path: str) -> None:
    """Writes one folder per shard; rows meet by (shard, range of slots), so a shard may take several tasks and files."""
    part = F.floor(F.col("slot") / 1_000_000)
    sharded.repartition("shard", part).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
