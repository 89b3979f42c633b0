import pytest
from pyspark.sql import functions as F

from waferlog.functions import secs
from waferlog.operators import enrich
from waferlog.operators import detect, entries as en
from waferlog.plans.load import load_files, load_texts
from waferlog.schema import RAW_LINES
from waferlog.sources.raw import lines_from_texts, read_log_files


def raw_lines(spark, files, block=7):
    """Lines of {name: lines} in small blocks, so that entries and dumps cross block borders."""
    rows = [
        (f"dir/{name}", name, (i - 1) // block, i, line)
        for name, lines in files.items()
        for i, line in enumerate(lines, 1)
    ]
    return spark.createDataFrame(rows, RAW_LINES)


def mmi(number, text, color=1):
    return f"2026-09-01 08:00:{number:02d}:000|{color}|{number}|{text}"


# One file per case: its lines; the kept (line, message) with dumps skipped; the flagged lines with dumps kept.
DUMPS = {
    "no dump": ([mmi(1, "a"), "more", "   ", mmi(2, "b -->[Count:2]"), "tail"], [(1, "a\nmore"), (4, "b\ntail")], []),
    "opened and closed by headers": ([mmi(1, "a"), mmi(2, "[Setup.ini] LOGGING"), mmi(3, "inside"), mmi(4, "[setup.INI] finish"), mmi(5, "b")], [(1, "a"), (5, "b")], [2, 3]),
    "another colour ends it": ([mmi(1, "[Setup.ini] LOGGING"), mmi(2, "inside"), mmi(3, "out", 3), mmi(4, "after")], [(3, "out"), (4, "after")], [1, 2]),
    "opened by a continuation": ([mmi(1, "a"), "  [c.ini] logging", mmi(2, "inside"), mmi(3, "x [b.ini] FINISH y"), mmi(4, "b")], [(5, "b")], [1, 3]),
    "a finish inside an entry drops it": ([mmi(1, "a"), "[c.ini] FINISH", mmi(2, "b")], [(3, "b")], []),
    "start and finish in one entry": ([mmi(1, "a"), "[c.ini] LOGGING", "[c.ini] FINISH", mmi(2, "b")], [], [1, 4]),
    "dump across many lines": ([mmi(1, "[Setup.ini] LOGGING"), *["raw"] * 20, mmi(2, "inside"), *["raw"] * 20, mmi(3, "out", 3)], [(43, "out")], [1, 22]),
    "lines before any header": (["[Setup.ini] LOGGING", "x", mmi(1, "a")], [(3, "a")], []),
}


@pytest.mark.parametrize("skip", [True, False])
def test_setup_dumps(spark, skip):
    files = {f"{i}_2026_09_01.log": lines for i, (lines, _, _) in enumerate(DUMPS.values())}
    rows = en.parse_entries(raw_lines(spark, files), skip_setup_dump=skip).collect()
    for i, (case, (lines, kept, flagged)) in enumerate(DUMPS.items()):
        own = [r for r in rows if r["source_file"] == f"{i}_2026_09_01.log"]
        if skip:
            assert sorted((r["line_no"], r["message"]) for r in own) == kept, case
        else:
            assert sorted(r["line_no"] for r in own if r["is_setup_dump"]) == flagged, case
            assert len(own) == sum("|" in line for line in lines), case


def test_secs_assembly(spark):
    files = {
        "2026-09-01 00.log": [" lost", "loose", "08:00:00:000: [1] SEND S1F1", "  indented  ", "", "\ttab ", "loose", "  lost too", "08:00:01:000: [2]  RECV S1F2 "],
        "2026-09-01 01.log": ["08:00:00:000: [1] a", *[f"  line {i}" for i in range(20)], "x", "  lost", "08:00:02:000: [1] b"],
    }
    rows = en.parse_entries(raw_lines(spark, files)).collect()
    assert sorted((r["source_file"][11:13], r["line_no"], r["message"]) for r in rows) == [
        ("00", 3, "SEND S1F1\n  indented\n\ttab"), ("00", 9, "RECV S1F2"),
        ("01", 1, "\n".join(["a", *[f"  line {i}" for i in range(20)]])), ("01", 24, "b"),
    ]


def test_item_trees(spark):
    messages = [
        # line, parent line, place among its siblings; report ids
        ("SEND S6F11\n<L [3]>\n  <U4 [1] 0>\n  <U4 [1] 7>\n  <L [1]>\n    <L [2]>\n      <U4 [1] 10>\n      <L [1]>\n        <A [1] x>",
         [[1, None, None], [2, 1, 1], [3, 1, 2], [4, 1, 3], [5, 4, 1], [6, 5, 1], [7, 5, 2], [8, 7, 1]], [10]),
        ("S6F11\n <A [1] a>\n  <A [1] b>\n plain\n <A [1] c>", [[1, None, None], [2, 1, 1], [4, None, None]], []),
        # a parent's children may stand at several depths
        ("S6F11\n<L [3]>\n    <A [1] a>\n  <A [1] b>\n      <A [1] c>\n  <A [1] d>",
         [[1, None, None], [2, 1, 1], [3, 1, 2], [4, 3, 1], [5, 1, 3]], []),
        # incomplete reports have no id; ids beyond 64 bits are none
        ("S6F11\n<L [3]>\n <U4 [1] 0>\n <U4 [1] 7>\n <L [3]>\n  <L [1]>\n   <U4 [1] 5>\n  <L [2]>\n   <U8 [1] 99999999999999999999>\n   <L [0]>",
         [[1, None, None], [2, 1, 1], [3, 1, 2], [4, 1, 3], [5, 4, 1], [6, 5, 1], [7, 4, 2], [8, 7, 1], [9, 7, 2]], []),
        ("no items", [], []),
    ]
    df = spark.createDataFrame([(i, m) for i, (m, _, _) in enumerate(messages)], "i int, message string")
    nodes = F.transform(secs.item_nodes(F.col("message")), lambda n: F.array(n["line"], n["up1"], n["ord"]))
    for row in df.select("i", nodes.alias("nodes"), secs.message_rptids(F.col("message")).alias("ids")).collect():
        _, tree, ids = messages[row["i"]]
        assert [[n[0], n[1], None if n[1] is None else n[2]] for n in row["nodes"]] == tree and row["ids"] == ids


def test_trees_stay_in_the_jvm(spark):
    df = spark.createDataFrame([("f", 0, "S6F11"), ("f", 1, None)], "source_path string, line_no long, message string")
    for made in (enrich.item_table(df), df.select(secs.message_rptids(F.col("message")))):
        assert "Python" not in made._jdf.queryExecution().executedPlan().toString()
    assert df.where("line_no = 1").select(secs.message_rptids(F.col("message"))).first()[0] == []


def test_unknown_dialects_cost_no_further_pass(spark):
    """The default settles unknown files in the block pass: no more scans or exchanges than without it."""
    raw = raw_lines(spark, {"notes.txt": [mmi(1, "a"), "b"]})

    def shape(**options):
        plan = en.parse_entries(raw, **options)._jdf.queryExecution().executedPlan().toString()
        return [plan.count(x) for x in ("Scan", "Exchange")]

    assert shape() == shape(fallback=False)


SAMPLE = (
    "2026-09-01 08:00:00:000|1|1|Carrier ABC 한글\r\ncontinued\r\n"
    "2026-09-01 08:00:01:000|1|2|[Setup.ini] LOGGING\r\n2026-09-01 08:00:02:000|1|3|hidden\r\n"
    "2026-09-01 08:00:03:000|1|4|[Setup.ini] FINISH\r\n2026-09-01 08:00:04:000|31|5|Alarm AB -->[Count:3]\r\n"
    "2026-09-01 08:00:05:000|1|6|carrier abc\r\n"
)
REPORT = (
    "08:00:00:000: [1] SEND S6F11W\n  <L [3]>\n    <U4 [1] 0>\n    <U4 [1] 777>\n    <L [1]>\n      <L [2]>\n"
    "        <U4 [1] 10>\n        <L [2]>\n          <A [3] ABC>\n          <L [1]>\n            <U4 [1] 9>\n"
    "08:00:06:000: [2] RECV S6F12\n"
)


def test_files_end_to_end(spark, tmp_path):
    (tmp_path / "2026_09_01.log").write_text(SAMPLE, encoding="utf-8", newline="")
    (tmp_path / "2026-09-01 08.TSLOG").write_text(REPORT, encoding="utf-8")
    (tmp_path / "ignored.csv").write_text("x\n")
    rows = load_files(spark, str(tmp_path)).orderBy("timeline_index").collect()
    assert [(r["timeline_index"], r["log_type"], r["line_no"]) for r in rows] == [
        (0, "MMI", 1), (1, "SECS", 1), (2, "MMI", 6), (3, "MMI", 7), (4, "SECS", 12)
    ]
    assert rows[0]["message"] == "Carrier ABC 한글\ncontinued"
    assert (rows[1]["ceid"], rows[1]["s6f11_rptids"], rows[1]["sxfy_type"]) == (777, [10], "S6F11")
    assert (rows[2]["repeat_count"], rows[2]["is_alarm"], rows[2]["level_name"]) == (3, True, "Alarm")
    assert str(rows[4]["timestamp"]) == "2026-09-01 08:00:06"
    plain = {(r["source_file"], r["line_no"]): r for r in en.parse_entries(read_log_files(spark, str(tmp_path))).collect()}
    for r in rows:
        same = plain[r["source_file"], r["line_no"]]
        assert all(r[c] == same[c] for c in en.ENTRY_COLUMNS), r


@pytest.mark.parametrize("size", [97, 1000])
def test_split_size_does_not_change_numbers(spark, tmp_path, size):
    text = "".join(f"2026-09-01 08:00:00:000|1|{i}|row {i}\r\n" + ("tail\r\n" if i % 3 == 0 else "") for i in range(900))
    (tmp_path / "2026_09_01.log").write_text(text, newline="")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size * 11))
    try:
        raw = read_log_files(spark, str(tmp_path))
        assert raw.select("block_no").distinct().count() > 3
        got = [r["value"] for r in raw.orderBy("line_no").collect()]
        numbers = [r["line_no"] for r in raw.orderBy("line_no").collect()]
        whole = en.parse_entries(raw).agg(F.count("*"), F.sum("line_no"), F.sum(F.length("message"))).first()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == text.replace("\r\n", "\n").splitlines()
    assert numbers == list(range(1, len(got) + 1))
    assert whole[0] == 900


def test_dialects_and_fallback(spark):
    mmi, secs = "2026-09-01 08:00:00:000|1|1|a", "08:00:00:000: [1] b"
    files = [
        ("2026_09_01.log", f"{secs}\n{secs}"), ("2026-09-01 8.log", f"{secs}\n{secs}"), ("one.txt", mmi),
        ("two.txt", f"{mmi}\n{mmi}"), ("three.txt", f"{secs}\n{secs}"), ("four.txt", "nothing\nhere"),
        ("2026-09-01 9.log", mmi), ("dump.txt", f"2026-09-01 08:00:00:000|1|1|[x.ini] LOGGING\n{secs}\n{secs}"),
    ]
    raw = lines_from_texts(spark.createDataFrame(files, "source_file string, content string"))
    kinds = {r["source_path"]: r["dialect"] for r in detect.detect_dialects(raw).collect()}
    assert kinds == {
        "2026_09_01.log": "MMI", "2026-09-01 8.log": "SECS", "one.txt": "MMI", "two.txt": "UNKNOWN",
        "three.txt": "UNKNOWN", "four.txt": "UNKNOWN", "2026-09-01 9.log": "MMI", "dump.txt": "UNKNOWN",
    }
    rows = en.parse_entries(raw, default_date="2026-09-01").groupBy("source_file", "log_type").count().collect()
    assert sorted(tuple(r) for r in rows) == [
        ("2026-09-01 8.log", "SECS", 2), ("2026-09-01 9.log", "MMI", 1), ("dump.txt", "SECS", 2),
        ("one.txt", "MMI", 1), ("three.txt", "SECS", 2), ("two.txt", "MMI", 2),
    ]


def test_bad_times_are_rejected(spark):
    texts = spark.createDataFrame(
        [("2026_09_01.log", "2026-13-01 08:00:00:000|1|1|bad\ntail\n2026-09-01 08:00:00:000|1|2|good")],
        "source_file string, content string",
    )
    raw = lines_from_texts(texts)
    assert [r["message"] for r in en.parse_entries(raw).collect()] == ["good"]
    assert [(r["line_no"], r["raw_line"].split("\n")[1]) for r in en.rejected_lines(raw).collect()] == [(1, "tail")]


def test_ceid_exclusion_points(spark):
    body = "\n  <L [3]>\n    <U4 [1] 0>\n    <U4 [1] {}>\n    <L [0]>"
    texts = [
        ("2026-09-01 08.log", "08:00:00:000: [1] CEID=5 inline"), ("2026-09-01 09.log", "08:00:00:000: [1] S6F11" + body.format(7)),
        ("2026-09-01 10.log", "08:00:00:000: [1] S6F11" + body.format(70)), ("2026-09-01 11.log", "08:00:00:000: [1] S1F3" + body.format(7)),
    ]
    df = spark.createDataFrame(texts, "source_file string, content string")
    rows = load_texts(df, excluded_ceids=[(5, 9)]).collect()
    assert sorted((r["source_file"], r["ceid"]) for r in rows) == [("2026-09-01 10.log", 70), ("2026-09-01 11.log", None)]


def test_line_endings(spark):
    df = spark.createDataFrame([("a.log", "x\r\ny\rz\n\nw\n"), ("b.log", ""), ("c.log", "last")], "source_file string, content string")
    rows = lines_from_texts(df).orderBy("source_file", "line_no").collect()
    assert [(r["source_file"], r["line_no"], r["value"]) for r in rows] == [
        ("a.log", 1, "x"), ("a.log", 2, "y"), ("a.log", 3, "z"), ("a.log", 4, ""), ("a.log", 5, "w"), ("c.log", 1, "last")
    ]
