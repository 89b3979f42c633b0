"""A load that reads every file is given the folder; one that reads some is given their names."""

import time

from waferlog.plans.load import load_incremental
from waferlog.sources import manifest as mf


def write(path, text):
    path.write_text(f"2026-09-01 00:00:00:000|1|1|{text}\n", encoding="utf-8")


def contents(entries):
    return sorted((r["source_file"], r["message"]) for r in entries.collect())


def test_the_folder_for_all_files_the_names_for_some(spark, tmp_path, monkeypatch):
    logs, store = tmp_path / "logs", str(tmp_path / "store")
    (logs / "b [1]").mkdir(parents=True)
    write(logs / "2026_09_01.log", "a")
    write(logs / "b [1]" / "2026_09_02.log", "b")
    from waferlog.plans import load

    asked, read = [], load.read_log_files
    monkeypatch.setattr(load, "read_log_files", lambda spark, paths, **options: asked.append(paths) or read(spark, paths, **options))
    assert contents(load_incremental(spark, str(logs), store)[0]) == [("2026_09_01.log", "a"), ("2026_09_02.log", "b")]
    time.sleep(0.02)
    write(logs / "b [1]" / "2026_09_02.log", "changed")
    assert contents(load_incremental(spark, str(logs), store)[0]) == [("2026_09_01.log", "a"), ("2026_09_02.log", "changed")]
    assert asked[0] == str(logs) and len(asked) == 2 and len(asked[1]) == 1 and asked[1][0].endswith("/2026_09_02.log")


def test_a_file_that_comes_meanwhile_waits_for_the_next_run(spark, tmp_path, monkeypatch):
    logs, store = tmp_path / "logs", str(tmp_path / "store")
    logs.mkdir()
    write(logs / "2026_09_01.log", "a")
    from waferlog.plans import load

    read = load.read_log_files

    def late(spark, paths, **options):
        write(logs / "2026_09_02.log", "late")
        return read(spark, paths, **options)

    monkeypatch.setattr(load, "read_log_files", late)
    assert contents(load_incremental(spark, str(logs), store)[0]) == [("2026_09_01.log", "a")]
    monkeypatch.setattr(load, "read_log_files", read)
    entries, did = load_incremental(spark, str(logs), store)
    assert contents(entries) == [("2026_09_01.log", "a"), ("2026_09_02.log", "late")] and did == {"hits": 1, "misses": 1}
    assert contents(mf.stored_entries(spark, store)) == contents(entries)
