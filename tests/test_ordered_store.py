import pytest
from pyspark.sql import functions as F

from waferlog.plans.load import load_files, load_incremental, load_ordered
from waferlog.sources import ordered_store as store_
from waferlog.sources.manifest import stored_entries

COLUMNS = ["timeline_index", "source_path", "line_no", "message"]


def write(path, day, seconds, word):
    path.write_text("".join(f"2026-09-{day:02d} 08:00:{s:02d}:000|1|{s}|{word} {s}\n" for s in seconds))


def same(timeline, spark, logs):
    return sorted(timeline.select(COLUMNS).collect()) == sorted(load_files(spark, str(logs)).select(COLUMNS).collect())


@pytest.fixture
def logs(tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    for day in range(3, 8):
        write(folder / f"2026_09_{day:02d}.log", day, range(10), f"d{day}")
    return folder


def test_runs_rewrite_only_the_ranges_they_touch(spark, tmp_path, logs):
    store = str(tmp_path / "store")
    rows, stats = load_ordered(spark, str(logs), store)
    assert (stats["ranges"], stats["rewritten"]) == (5, 5) and same(rows, spark, logs)
    assert load_ordered(spark, str(logs), store)[1] == {"hits": 5, "misses": 0, "version": 1, "ranges": 5, "rewritten": 0}
    # A changed file whose rows go to another day touches the day it leaves and the day it joins.
    write(logs / "2026_09_04.log", 6, range(5, 25), "moved")
    rows, stats = load_ordered(spark, str(logs), store)
    assert (stats["ranges"], stats["rewritten"]) == (4, 2) and same(rows, spark, logs)
    # A file older than all shifts every position and rewrites none of the other ranges.
    write(logs / "2026_09_01.log", 1, range(7), "old")
    rows, stats = load_ordered(spark, str(logs), store)
    assert (stats["ranges"], stats["rewritten"]) == (5, 1) and same(rows, spark, logs)
    order = store_.open_order(spark, store)
    assert {r["range"] - 20697: (r["run"], r["start"], r["rows"]) for r in order.table("ranges").collect()} == {
        0: (3, 0, 7), 2: (1, 7, 10), 4: (1, 17, 10), 5: (2, 27, 30), 6: (1, 57, 10)}
    (logs / "2026_09_03.log").unlink()
    rows, stats = load_ordered(spark, str(logs), store)
    assert (stats["ranges"], stats["rewritten"]) == (4, 1) and same(rows, spark, logs)
    assert store_.drop_old_orders(spark, store) == [4]
    assert same(store_.ordered_timeline(spark, store), spark, logs)


def test_an_order_catches_up_after_several_ingests(spark, tmp_path, logs):
    store = str(tmp_path / "store")
    load_incremental(spark, str(logs), store)
    write(logs / "2026_09_05.log", 5, range(3), "new")
    load_incremental(spark, str(logs), store)
    with pytest.raises(FileNotFoundError):
        store_.ordered_timeline(spark, store)
    assert store_.update_order(spark, store)["rewritten"] == 5
    assert same(store_.ordered_timeline(spark, store), spark, logs)


def test_reads_open_only_the_files_they_need(spark, tmp_path, logs):
    store = str(tmp_path / "store")
    timeline, _ = load_ordered(spark, str(logs), store)
    order = store_.open_order(spark, store)
    every = order.table("parts").count()
    assert every == 5
    page = order.page(1, 10)
    assert len(page.inputFiles()) - len(order.table("ranges").inputFiles()) == 1
    assert [r["timeline_index"] for r in page.orderBy("timeline_index").collect()] == list(range(10, 20))
    both = order.centred(20, 8)
    assert len(both.inputFiles()) - len(order.table("ranges").inputFiles()) == 2
    assert sorted(r["message"] for r in both.collect()) == sorted([f"d4 {i}" for i in range(6, 10)] + [f"d5 {i}" for i in range(4)])
    assert sorted(r["timeline_index"] for r in order.centred(1, 8).collect()) == list(range(8))
    assert sorted(r["timeline_index"] for r in order.centred(49, 8).collect()) == list(range(42, 50))
    assert order.centred(3, 10**9).count() == 50 and order.page(9, 10).count() == 0 and order.page(0, 0).count() == 1
    keys = timeline.where("message in ('d6 3', 'd6 4')").select("source_path", "line_no")
    found = order.positions(keys.unionByName(keys))
    assert sorted(r["timeline_index"] for r in found.collect()) == [33, 34]
    assert order.positions(keys.limit(0)).count() == 0


def test_a_range_of_many_parts(spark, tmp_path, logs, monkeypatch):
    """One day holds all rows of two files with equal times; positions follow the whole order, whatever the parts."""
    store = str(tmp_path / "store")
    entries = spark.range(5000).select(
        F.lit("p").alias("source_path"), F.concat(F.lit("f"), F.col("id") % 2).alias("source_file"), (F.col("id") + 1).alias("line_no"),
        F.lit("2026-09-01 00:00:00").cast("timestamp_ntz").alias("timestamp"), F.lit("MMI").alias("log_type"), F.lit("m").alias("message"))
    from waferlog.schema import ENTRIES
    full = entries.select(*[F.col(f.name) if f.name in entries.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in ENTRIES])
    files = spark.createDataFrame([("p", 1)], "source_path string, run int")
    assert store_.order_entries(full, files, store)["ranges"] == 1
    got = {(r["source_file"], r["line_no"]): r["timeline_index"] for r in store_.ordered_timeline(spark, store).collect()}
    assert got == {k: i for i, k in enumerate(sorted(got))} and len(got) == 5000


def test_empty_stores_and_missing_times(spark, tmp_path):
    from waferlog.schema import entry_frame
    store = str(tmp_path / "store")
    rows = entry_frame(spark, [{"source_file": "a.log", "line_no": 1, "log_type": "MMI", "message": "no time"}])
    files = spark.createDataFrame([("a.log", 1)], "source_path string, run int")
    assert store_.order_entries(rows, files, store)["ranges"] == 1
    assert store_.order_entries(rows.limit(0), files.limit(0), store) == {"version": 2, "ranges": 0, "rewritten": 1}
    assert store_.ordered_timeline(spark, store).count() == 0 and store_.open_order(spark, store).page(0, 5).count() == 0
    with pytest.raises(FileNotFoundError):
        store_.update_order(spark, str(tmp_path / "none"))
    with pytest.raises(FileNotFoundError):
        stored_entries(spark, str(tmp_path / "none"))


def test_ordered_ingest_of_a_log_whose_first_block_has_one_file(spark, tmp_path):
    from datetime import datetime, timedelta

    from waferlog.plans import queries as q

    # Three days of events: the first block of 4096 lies in the first day. Then a log of one file.
    for name, days in (("dense", 3), ("one", 1)):
        rows = [(i, datetime(2024, 1, 1 + i // 4096, 5) + timedelta(seconds=i % 4096), i % 7, "click", 1.0, '{"k": %d}' % (i % 9)) for i in range(0, 4096 * days, 512)]
        folder = str(tmp_path / name)
        spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{folder}/events.parquet")
        got = q.ordered_ingest(spark, folder)
        want = q.file_scan(spark, folder)
        assert got.count() == 8 * days and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
