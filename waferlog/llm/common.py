"""Small helpers the corpus operators share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

ROW = "__row"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(df: DataFrame, carry: Sequence[str] | None = None) -> Column:
    """The carried columns (all by default) as one struct, so that no name of theirs can clash with an operator's own."""
    names = df.columns if carry is None else list(carry)
    return F.struct(*[F.col(f"`{c}`") for c in names]).alias(ROW) if names else F.struct(F.lit(0).alias("__none")).alias(ROW)


def unpacked(df: DataFrame, outputs: Sequence[str]) -> DataFrame:
    """Carried columns beside the operator's outputs; where a carried name equals an output's, the output stays."""
    taken = {c.lower() for c in outputs} | {"__none"}
    kept = [f.name for f in df.schema[ROW].dataType.fields if f.name.lower() not in taken]
    return df.select(*[F.col(f"{ROW}.`{c}`").alias(c) for c in kept], *outputs)


def hash60(text: Column) -> Column:
    """A seeded 60-bit number of a string: the first 15 hex digits of its MD5, the same in any SQL engine."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def with_positions(df: DataFrame, bucket: str, order: Sequence[str | Column], position: str, total: str) -> DataFrame:
    """Adds each row's 0-based place in the order (bucket, order) and the number of rows.

    `bucket` must be a number that ascends with the order and has a bounded number of values. Only bucket counts meet in one task;
    rows are numbered within buckets.
    """
    counts = df.groupBy(bucket).agg(F.count("*").alias("__n"))
    every = Window.partitionBy(F.lit(0))
    before = every.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        bucket,
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"),
        F.sum("__n").over(every).alias(total),
    )
    inside = Window.partitionBy(bucket).orderBy(*order)
    return df.join(offsets, bucket).withColumn(position, F.col("__before") + F.row_number().over(inside) - 1).drop("__before")
