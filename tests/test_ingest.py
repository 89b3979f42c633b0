import time

import pytest
from pyspark.sql import functions as F

from waferlog.plans.load import load_incremental
from waferlog.sources import manifest as mf
from waferlog.streaming.ingest import follow_folder


def write(path, count, word):
    path.write_text("".join(f"2026-09-01 08:00:{i:02d}:000|1|{i}|{word} {i}\n" for i in range(count)))


def contents(entries):
    return sorted((r["source_file"], r["n"], r["word"]) for r in entries.groupBy("source_file").agg(
        F.count("*").alias("n"), F.max(F.substring_index("message", " ", 1)).alias("word")).collect())


def test_only_changed_files_are_parsed(spark, tmp_path):
    logs, store = tmp_path / "logs", str(tmp_path / "store")
    logs.mkdir()
    write(logs / "2026_09_01.log", 3, "a")
    write(logs / "2026_09_02.log", 2, "b")
    entries, first = load_incremental(spark, str(logs), store)
    assert first == {"hits": 0, "misses": 2} and contents(entries) == [("2026_09_01.log", 3, "a"), ("2026_09_02.log", 2, "b")]
    assert load_incremental(spark, str(logs), store)[1] == {"hits": 2, "misses": 0}

    before = spark.createDataFrame(mf.stored_manifest(spark, store).collect())
    time.sleep(0.02)
    write(logs / "2026_09_02.log", 5, "c")
    with pytest.raises(RuntimeError):
        mf.require_unchanged(before, mf.file_manifest(spark, str(logs)))
    entries, again = load_incremental(spark, str(logs), store)
    assert again == {"hits": 1, "misses": 1} and contents(entries) == [("2026_09_01.log", 3, "a"), ("2026_09_02.log", 5, "c")]

    assert load_incremental(spark, str(logs), store, skip_setup_dump=False)[1] == {"hits": 0, "misses": 2}
    (logs / "2026_09_01.log").unlink()
    entries, last = load_incremental(spark, str(logs), store, skip_setup_dump=False)
    assert last == {"hits": 1, "misses": 0} and contents(entries) == [("2026_09_02.log", 5, "c")]
    assert mf.drop_superseded(spark, store) == [1, 2] and contents(mf.stored_entries(spark, store)) == [("2026_09_02.log", 5, "c")]


def test_emptied_file_loses_its_entries(spark, tmp_path):
    logs, store = tmp_path / "logs", str(tmp_path / "store")
    logs.mkdir()
    write(logs / "2026_09_01.log", 3, "a")
    write(logs / "2026_09_02.log", 2, "b")
    load_incremental(spark, str(logs), store)
    (logs / "2026_09_01.log").write_text("no header any more\n")
    assert contents(load_incremental(spark, str(logs), store)[0]) == [("2026_09_02.log", 2, "b")]


def test_signature():
    assert mf.options_signature(True, [(3, 4), (1, 2)]) == mf.options_signature(True, [(1, 2), (3, 4)])
    assert mf.options_signature(True) != mf.options_signature(False)


def test_stream_picks_up_new_files_once(spark, tmp_path):
    logs, store, checkpoint = tmp_path / "logs", str(tmp_path / "store"), str(tmp_path / "cp")
    logs.mkdir()
    for round_, name in enumerate(("2026_09_01.log", "2026_09_02.log")):
        write(logs / name, 3 + round_, name[8:10])
        query = follow_folder(spark, str(logs), store, checkpoint)
        query.awaitTermination(120)
        query.stop()
    entries = mf.stored_entries(spark, store)
    assert contents(entries) == [("2026_09_01.log", 3, "01"), ("2026_09_02.log", 4, "02")]

    write(logs / "2026_09_01.log", 6, "changed")
    write(logs / "2026_09_03.log", 1, "new")
    query = follow_folder(spark, str(logs), store, checkpoint)
    query.awaitTermination(120)
    assert contents(mf.stored_entries(spark, store)) == [("2026_09_01.log", 6, "changed"), ("2026_09_02.log", 4, "02"), ("2026_09_03.log", 1, "new")]


def test_file_names_are_no_patterns(spark, tmp_path):
    logs, store = tmp_path / "logs", str(tmp_path / "store")
    logs.mkdir()
    names = ["tool[1] 2026_09_01.log", "tool1 2026_09_01.log", "a{b,c}* 2026_09_02.log", "50% 2026_09_03.log"]
    for i, name in enumerate(names):
        write(logs / name, i + 1, f"w{i}")
    assert contents(load_incremental(spark, str(logs), store)[0]) == sorted((n, i + 1, f"w{i}") for i, n in enumerate(names))


def test_a_failed_run_leaves_the_store_as_it_was(spark, tmp_path):
    logs, store = tmp_path / "logs", str(tmp_path / "store")
    logs.mkdir()
    write(logs / "2026_09_01.log", 3, "a")
    entries, _ = load_incremental(spark, str(logs), store)
    time.sleep(0.02)
    write(logs / "2026_09_01.log", 4, "b")

    def touched_meanwhile(paths):
        time.sleep(0.02)
        write(logs / "2026_09_01.log", 5, "c")
        return entries.limit(0)

    with pytest.raises(RuntimeError, match="changed since"):
        mf.ingest(spark, str(logs), store, touched_meanwhile)
    assert contents(mf.stored_entries(spark, store)) == contents(entries) == [("2026_09_01.log", 3, "a")]
    assert load_incremental(spark, str(logs), store)[1] == {"hits": 0, "misses": 1}
    assert contents(mf.stored_entries(spark, store)) == [("2026_09_01.log", 5, "c")]
