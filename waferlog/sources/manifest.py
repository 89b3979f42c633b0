"""Which files are new or changed, and the persisted entries per file."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..schema import ENTRIES
from ..staging import stage
from .raw import SUPPORTED, literal_path

SCHEMA_VERSION = 1
#: Keys that a file's rows are spread over when they meet the manifest.
SPREAD = 16
FINGERPRINT = ["source_path", "size", "modified", "options"]


def options_signature(skip_setup_dump: bool = True, excluded_ceids=()) -> str:
    """Changes with any parse option, never with reference data."""
    payload = [SCHEMA_VERSION, bool(skip_setup_dump), sorted([int(a), int(b)] for a, b in excluded_ceids)]
    return hashlib.sha256(json.dumps(payload).encode()).hexdigest()


def file_manifest(spark: SparkSession, paths, options: str = "", recursive: bool = True) -> DataFrame:
    """(source_path, size, modified, options) of the supported files, from the listing alone; contents stay unread."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(paths)
    return listing.filter(F.col("path").rlike(SUPPORTED)).select(
        F.col("path").alias("source_path"),
        F.col("length").alias("size"),
        F.unix_micros("modificationTime").alias("modified"),
        F.lit(options).alias("options"),
    )


def changed_files(current: DataFrame, previous: DataFrame | None) -> DataFrame:
    """Files whose path, size, time or parse options are not in the previous manifest."""
    return current if previous is None else current.join(previous, FINGERPRINT, "left_anti")


def reuse_counts(current: DataFrame, previous: DataFrame | None) -> DataFrame:
    """One row: files reused and files to parse."""
    todo = changed_files(current, previous).agg(F.count("*").alias("misses"))
    total = current.agg(F.count("*").alias("n"))
    return todo.select((total.scalar() - F.col("misses")).alias("hits"), "misses")


def stale_files(parsed: DataFrame, current: DataFrame) -> DataFrame:
    """Files of an earlier manifest that have changed or gone since: their text may not be served."""
    return parsed.join(current, ["source_path", "size", "modified"], "left_anti").select("source_path")


def require_unchanged(parsed: DataFrame, current: DataFrame) -> None:
    changed = [row["source_path"] for row in stale_files(parsed, current).limit(5).collect()]
    if changed:
        raise RuntimeError(f"files changed since they were analysed, e.g. {changed}")


def published(spark: SparkSession, parent: str, mark: str = "") -> list[int]:
    """Versions under `parent`, oldest first, whose writing has been completed: `_SUCCESS` lies in them, or in their table `mark`."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    folder = path(parent)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return []
    names = [status.getPath().getName() for status in system.listStatus(folder)]
    done = [n for n in names if n.startswith("version=") and system.exists(path(f"{parent}/{n}/{mark + '/' if mark else ''}_SUCCESS"))]
    return sorted(int(n.removeprefix("version=")) for n in done)


def _versions(spark: SparkSession, store: str) -> list[int]:
    return published(spark, f"{store}/manifests")


def stored_manifest(spark: SparkSession, store: str) -> DataFrame | None:
    """(source_path, size, modified, options, run): the files of the store and the run that holds each one's entries."""
    versions = _versions(spark, store)
    return spark.read.parquet(f"{store}/manifests/version={versions[-1]}") if versions else None


def ingest(spark: SparkSession, paths, store: str, parse, *, skip_setup_dump: bool = True, excluded_ceids=()) -> dict:
    """Parse only new or changed files and publish a store in which just their entries are replaced. Returns hits and misses.

    `parse(paths) -> entries` reads the given files, which are `paths` themselves where every file is new or changed: a listing of folders
    costs a call a folder, one of named files a call a file. The entries of a run go to a folder of their own; nothing stored before is touched. A
    manifest that names each file's run is then written as a new version, and from that moment readers see it; a run that
    fails, or whose files changed while it read them, publishes nothing. Files that are gone from the listing aren't in the new manifest.
    """
    options = options_signature(skip_setup_dump, excluded_ceids)
    current = stage(file_manifest(spark, paths, options), "manifest")
    previous = stored_manifest(spark, store)
    todo = changed_files(current, previous)
    # The list of changed files is driver metadata, as any file listing is.
    changed = [row["source_path"] for row in todo.select("source_path").collect()]
    total = current.count()
    versions = _versions(spark, store)
    run = versions[-1] + 1 if versions else 1
    if changed:
        parse(paths if len(changed) == total else [literal_path(p) for p in changed]).write.mode("overwrite").parquet(f"{store}/entries/run={run}")
        require_unchanged(todo, file_manifest(spark, paths, options))
    if changed or previous is None or previous.count() != total:
        kept = current.withColumn("run", F.lit(run)) if previous is None else current.join(
            previous.select(*FINGERPRINT, "run"), FINGERPRINT, "left").withColumn("run", F.coalesce("run", F.lit(run)))
        kept.write.mode("overwrite").parquet(f"{store}/manifests/version={run}")
    return {"hits": total - len(changed), "misses": len(changed)}


def stored_entries(spark: SparkSession, store: str) -> DataFrame:
    """The entries of the files in the newest manifest, each from the run it names.

    The manifest has a row per file. Where it is too large to be broadcast, a huge file's rows are spread over `SPREAD` keys.
    """
    manifest = stored_manifest(spark, store)
    if manifest is None:
        raise FileNotFoundError(f"no published manifest in {store}")
    named = stage(manifest.select("source_path", "run", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("_spread")), "files")
    spread = F.pmod(F.hash("line_no"), F.lit(SPREAD))
    stored = spark.read.schema(T.StructType([*ENTRIES.fields, T.StructField("run", T.IntegerType())])).parquet(f"{store}/entries")
    return stored.withColumn("_spread", spread).join(named, ["source_path", "run", "_spread"], "left_semi").drop("run", "_spread")


def drop_superseded(spark: SparkSession, store: str) -> list[int]:
    """Delete older manifests, and the runs that the newest one no longer names; no reader of older versions may be active."""
    manifest = stored_manifest(spark, store)
    live = {row["run"] for row in manifest.select("run").distinct().collect()} if manifest is not None else set()
    versions = _versions(spark, store)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    runs = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/entries")
    system = runs.getFileSystem(conf)
    stored = [int(s.getPath().getName().removeprefix("run=")) for s in system.listStatus(runs) if s.getPath().getName().startswith("run=")]
    gone = sorted(set(stored) - live)
    for folder in [*(f"entries/run={r}" for r in gone), *(f"manifests/version={v}" for v in versions[:-1])]:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/{folder}")
        system.delete(path, True)
    return gone
