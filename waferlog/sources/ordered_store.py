"""The ordered timeline of an incremental store: sorted time ranges, of which a run rewrites only those it touches.

A store's folder `order/` holds versions. Sorted rows lie in `order/run=<n>/range=<r>/`, numbered from 0 inside their range; a range is a fixed
span of time. `order/version=<n>/` has four small tables: `files` (source files and the ingest run each came from), `ranges` (run, rows and first
position of every range), `parts` (first and last row of every data file) and `held` (the lines of every source file in every data
file). A position is its range's first position and the row's number in the range, so a run that adds rows to one range shifts all later
ones without reading them. `ranges` is written last and publishes the version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..functions.text import to_millis
from ..operators.ordered import dense_index
from ..schema import ENTRIES, order_columns, text_once, text_whole
from ..staging import stage
from .manifest import published, stored_entries, stored_manifest

SPAN_MS = 86_400_000
#: Lines of a source file that a lookup treats as one block.
LINE_BLOCK = 65_536
INDEX = "timeline_index"
_ROWS = T.StructType([*ENTRIES.fields, T.StructField("pos", T.LongType())])


def range_of(span_ms: int = SPAN_MS) -> Column:
    """The time range of an entry; entries without a time come first, as in the timeline's order."""
    return F.coalesce(F.floor(to_millis(F.col("timestamp")) / span_ms), F.lit(-(2**40))).cast("long")


class OrderedStore:
    """One published version of the order: its tables, and reads that open only the data files they need."""

    def __init__(self, spark: SparkSession, store: str, version: int):
        self.spark, self.store, self.version = spark, store, version

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.store}/order/version={self.version}/{name}")

    def total(self) -> int:
        return self.table("ranges").agg(F.sum("rows")).first()[0] or 0

    def _rows(self, paths: list[str]) -> DataFrame:
        """Rows of data files or range folders, with their range; the paths are a listing, as any read has it."""
        schema = T.StructType([*_ROWS.fields, T.StructField("run", T.IntegerType()), T.StructField("range", T.LongType())])
        if not paths:
            return self.spark.createDataFrame([], schema).drop("run")
        return self.spark.read.schema(schema).option("basePath", f"{self.store}/order").parquet(*paths).drop("run")

    def _indexed(self, rows: DataFrame) -> DataFrame:
        starts = self.table("ranges").select("range", "start")
        return rows.join(starts, "range").withColumn(INDEX, F.col("start") + F.col("pos")).drop("range", "start", "pos")

    def timeline(self, ranges: DataFrame | None = None) -> DataFrame:
        """All entries with their `timeline_index`, or those of some `ranges(range)`."""
        return self._indexed(self.sorted_rows(ranges))

    def sorted_rows(self, ranges: DataFrame | None = None) -> DataFrame:
        live = self.table("ranges") if ranges is None else self.table("ranges").join(ranges, "range", "left_semi")
        folders = [f"{self.store}/order/run={r['run']}/range={r['range']}" for r in live.select("run", "range").collect()]
        return self._rows(folders)

    def between(self, first: int, last: int) -> DataFrame:
        """Entries of the positions `first` to `last`, from the data files that hold them."""
        placed = self.table("parts").join(self.table("ranges").select("range", "start"), "range")
        hit = placed.where((F.col("start") + F.col("first") <= last) & (F.col("start") + F.col("last") >= first))
        return self._indexed(self._rows([r["file"] for r in hit.select("file").distinct().collect()])).where(F.col(INDEX).between(first, last))

    def page(self, number: int, size: int) -> DataFrame:
        """Page `number` (0-based), of at least one row."""
        size = max(1, size)
        return self.between(number * size, number * size + size - 1)

    def centred(self, focus: int, size: int) -> DataFrame:
        """A window of `size` rows around a position, moved inwards at both ends."""
        total = self.total()
        width = min(max(1, size), total)
        start = max(0, min(focus - width // 2, total - width))
        return self.between(start, start + width - 1)

    def positions(self, keys: DataFrame) -> DataFrame:
        """(source_path, line_no, timeline_index) of the keys (source_path, line_no), from the data files that hold their lines."""
        block = F.floor(F.col("line_no") / LINE_BLOCK).alias("block")
        asked = keys.select("source_path", block).distinct()
        first, last = (F.floor(F.col(c) / LINE_BLOCK).cast("long") for c in ("first_line", "last_line"))
        held = self.table("held").select("source_path", "file", F.explode(F.sequence(first, last)).alias("block"))
        files = held.join(asked, ["source_path", "block"], "left_semi").select("file").distinct()
        found = self._indexed(self._rows([r["file"] for r in files.collect()]))
        return found.join(keys.select("source_path", "line_no").distinct(), ["source_path", "line_no"], "left_semi").select("source_path", "line_no", INDEX)


def open_order(spark: SparkSession, store: str) -> OrderedStore | None:
    versions = published(spark, f"{store}/order", "ranges")
    return OrderedStore(spark, store, versions[-1]) if versions else None


def update_order(spark: SparkSession, store: str, span_ms: int = SPAN_MS) -> dict:
    """Bring the order up to the newest manifest of an ingested store; a store with no manifest is an error."""
    manifest = stored_manifest(spark, store)
    if manifest is None:
        raise FileNotFoundError(f"no published manifest in {store}")
    return order_entries(stored_entries(spark, store), manifest.select("source_path", "run"), store, span_ms)


def order_entries(entries: DataFrame, files: DataFrame, store: str, span_ms: int = SPAN_MS) -> dict:
    """Bring a store's order up to `entries`, of `files` (source_path, run); returns how many ranges there are and how many were rewritten.

    Files that the order has and `files` hasn't, or has from another run, lose their rows; files new to the order bring theirs. Only
    ranges that lose or gain rows are read and written. An update that fails publishes nothing, and the next one starts from the same
    version. The span of a store's ranges must stay the same.
    """
    spark = entries.sparkSession
    now = stage(files.select("source_path", "run"), "order-files")
    old = open_order(spark, store)
    key = ["source_path", "run"]
    fresh = now if old is None else now.join(old.table("files"), key, "left_anti")
    added = entries.join(fresh.select("source_path"), "source_path", "left_semi").withColumn("range", range_of(span_ms))
    touched = added.select("range")
    if old is not None:
        gone = old.table("files").join(now, key, "left_anti").select("source_path")
        lost = old.table("held").join(gone, "source_path", "left_semi")
        touched = touched.unionByName(lost.select("range"))
    touched = stage(touched.distinct(), "touched")
    rewritten = touched.count()
    if not rewritten and old is not None and old.table("files").count() == now.count():
        return {"version": old.version, "ranges": old.table("ranges").count(), "rewritten": 0}
    version = 1 if old is None else old.version + 1
    rows = added
    if old is not None:
        rows = rows.unionByName(old.sorted_rows(touched).drop("pos").join(gone, "source_path", "left_anti").select(added.columns))
    folder = f"{store}/order/run={version}"
    _write_ranges(rows, folder)
    written = spark.read.schema(T.StructType([*_ROWS.fields, T.StructField("range", T.LongType())])).parquet(folder).withColumn("file", F.col("_metadata.file_path"))
    parts = written.groupBy("range", "file").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.count("*").alias("rows"))
    held = written.groupBy("source_path", "range", "file").agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"))
    parts = stage(parts, "parts")
    ranges = parts.groupBy("range").agg(F.sum("rows").alias("rows")).withColumn("run", F.lit(version))
    if old is not None:
        untouched = lambda name: old.table(name).join(touched, "range", "left_anti")
        parts, held = parts.unionByName(untouched("parts")), held.unionByName(untouched("held"))
        ranges = ranges.unionByName(untouched("ranges").drop("start"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    ranges = ranges.withColumn("start", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    for name, table in (("files", now), ("parts", parts), ("held", held), ("ranges", ranges.coalesce(1))):
        table.write.mode("overwrite").parquet(f"{store}/order/version={version}/{name}")
    return {"version": version, "ranges": OrderedStore(spark, store, version).table("ranges").count(), "rewritten": rewritten}


def _write_ranges(rows: DataFrame, folder: str) -> None:
    """Sorted rows, numbered inside their ranges. A range of any size is split over tasks: the sort is on the whole key."""
    sorted_rows = dense_index(text_once(rows), [F.col("range"), *order_columns()], "_at", "ranges")
    firsts = sorted_rows.groupBy("range").agg(F.min("_at").alias("_first"))
    placed = sorted_rows.join(firsts, "range").withColumn("pos", F.col("_at") - F.col("_first"))
    width = F.floor(F.col("pos") / 1_000_000)
    dealt = placed.repartition("range", width).sortWithinPartitions("range", "pos")
    (
        text_whole(dealt).select(*_ROWS.fieldNames(), "range")
        .write.mode("overwrite").partitionBy("range").parquet(folder)
    )


def ordered_timeline(spark: SparkSession, store: str) -> DataFrame:
    """The whole timeline of the newest published order."""
    order = open_order(spark, store)
    if order is None:
        raise FileNotFoundError(f"no published order in {store}")
    return order.timeline()


def drop_old_orders(spark: SparkSession, store: str) -> list[int]:
    """Delete older versions, and the runs that no range of the newest one names; no reader of older versions may be active."""
    order = open_order(spark, store)
    if order is None:
        return []
    live = {r["run"] for r in order.table("ranges").select("run").distinct().collect()}
    path = spark._jvm.org.apache.hadoop.fs.Path
    system = path(store).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in system.listStatus(path(f"{store}/order"))]
    runs = sorted({int(n.removeprefix("run=")) for n in names if n.startswith("run=")} - live)
    older = [int(n.removeprefix("version=")) for n in names if n.startswith("version=") and n != f"version={order.version}"]
    for name in [*(f"run={r}" for r in runs), *(f"version={v}" for v in older)]:
        system.delete(path(f"{store}/order/{name}"), True)
    return runs
