"""Times the headline work and prints one JSON line.

The event log of the scale factor is written as log files first (not timed). `load_cold` is what users call: it lists and reads the
files, numbers their lines, settles their dialects, parses, sorts and indexes; the searches and analyses then run on the stored
timeline, as the published baseline does. Each query runs twice and the faster run counts, which matches the baseline's warm file cache.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession, functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from waferlog.operators import alarms as al, filters, objects, roundtrip, search, stats  # noqa: E402
from waferlog.plans import queries as registry  # noqa: E402
from waferlog.plans.load import load_files  # noqa: E402
from waferlog.sources import synth  # noqa: E402
from waferlog.spec import FilterSpec  # noqa: E402
from waferlog.staging import drop_staged, new_path  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "256k")
        .config("spark.checkpoint.dir", os.environ.get("BENCH_SCRATCH") or tempfile.mkdtemp(prefix="bench-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    raw = synth.staged_lines(synth.event_lines(spark, sf_dir))
    lines = raw.count()
    folder = new_path(spark, "logs")
    # One file per day (MMI) and hour (SECS), as the equipment writes them.
    synth.write_named_files(raw.withColumn("block_no", F.lit(0).cast("long")), folder)
    store = {}

    def load_cold():
        store["timeline"] = load_files(spark, folder)
        return store["timeline"]

    def warm():
        return store["timeline"]

    def hits(*words, **options):
        return lambda: search.search(warm(), words, **options).agg(F.count("*"))

    def trip():
        rows = warm()
        return roundtrip.carrier_roundtrip("LOT12", rows, objects.extract_object_events(rows), al.extract_alarms(rows))

    combination = FilterSpec(keywords=[("AND", "S6F11"), ("OR", "LOT27")], exclude_keywords=["note"])
    work = {
        "load_cold": load_cold,
        "keyword_S6F11": hits("S6F11"),
        "keyword_LOT27": hits("LOT27"),
        "keyword_frequent": hits("StateChange"),
        "keyword_two_chars": hits("PM"),
        "keyword_one_char": hits("1"),
        "keyword_absent_korean": hits("없는키워드"),
        "keyword_combination": lambda: filters.apply_spec(warm(), combination).agg(F.count("*")),
        "keyword_regex": hits(r"LOT00(27|28)|LOT2(7|8)\b", use_regex=True),
        "alarm_summary": lambda: al.summarize_alarms(al.extract_alarms(warm())),
        "object_events": lambda: objects.extract_object_events(warm()),
        "carrier_roundtrip": trip,
        "statistics": lambda: stats.statistics(warm()),
        "top_ceids": lambda: stats.top_ceids(warm()),
        "gaps": lambda: filters.gap_table(warm()),
        "annotated_messages": lambda: registry.enrich.annotate(
            warm(), registry.names(spark, sf_dir), registry.variables(spark, sf_dir)
        ),
        "document_search": lambda: registry.keyword_and_or_exclude(spark, sf_dir),
        "document_keyword_table": lambda: registry.keyword_matrix(spark, sf_dir),
        "document_line_diff": lambda: registry.line_diff(spark, sf_dir),
    }
    seconds = {}
    for name, run in work.items():
        best = None
        for _ in range(2):
            start = time.perf_counter()
            df = run()
            if name != "load_cold":  # loading stores its result by itself
                df.write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        seconds[name] = round(best, 3)
    entries = warm().count()
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "raw_lines": lines,
                "entries": entries,
                "entries_per_sec_load": round(entries / seconds["load_cold"]),
            }
        )
    )
    drop_staged(spark)
    spark.stop()


if __name__ == "__main__":
    main()
