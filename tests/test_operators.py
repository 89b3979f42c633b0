import re
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from waferlog.functions.text import gap_text, report_gap_text
from waferlog.operators import alarms as al, compare, enrich, entries as en, filters, objects, related, roundtrip, rowwin, search, stats
from waferlog.plans import report as rp
from waferlog.schema import entry_frame
from waferlog.sources import dims, sinks
from waferlog.spec import FilterSpec, ceid_items, enabled_ranges, parse_ceid_ranges, parse_time_range

DAY = datetime(2026, 7, 1, 8)


def entry(message, line, seconds=0, log_type="MMI", **more):
    flags = {
        "is_alarm": more.get("color_index") == 31 or (more.get("level_name") or "").lower() == "alarm"
        or any(w in message.lower() for w in ("[alarm]", "alarm code")),
        "is_object_event": log_type == "MMI" and any(h in message.lower() for h in en.OBJECT_HINTS),
        "s6f11_rptids": [],
    }
    name = "mmi.log" if log_type == "MMI" else "secs.log"
    return {"timestamp": DAY + timedelta(seconds=seconds), "log_type": log_type, "source_file": name, "message": message,
            "line_no": line, **flags, **more}


def frame(spark, *rows):
    return entry_frame(spark, rows)


def lines(df):
    return [r["line_no"] for r in df.orderBy("line_no").collect()]


def test_alarm_rule(spark):
    df = spark.createDataFrame(
        [(1, "plain", 1, "Info"), (2, "x", 5, "ALARM"), (3, "x", 31, None), (4, "[alarm] y", None, None), (5, "an Alarm Code [1234] z", 2, "W")],
        "i int, message string, color int, level string",
    )
    hit = en.alarm_predicate(F.col("message"), F.col("color"), F.col("level"))
    assert [r[0] for r in df.orderBy("i").select(F.coalesce(hit, F.lit(False))).collect()] == [False, True, True, True, True]


def test_alarm_extraction_and_summary(spark):
    rows = frame(
        spark, entry("[ALARM]  Alarm Code [7] door \nsecond", 1, 1, repeat_count=0), entry("  odd  ", 2, 2, color_index=31, repeat_count=3),
        entry("x [ALARM] Alarm Code [7] again", 3, 3, repeat_count=4), entry("plain", 4, 4), entry("[ALARM] tie", 5, 5, repeat_count=3),
    )
    found = al.extract_alarms(rows).orderBy("line_no").collect()
    assert [(r["alarm_code"], r["message"], r["level_name"]) for r in found] == [
        ("7", "Alarm Code [7] door", "Alarm"), (None, "odd", "Alarm"), ("7", "Alarm Code [7] again", "Alarm"), (None, "tie", "Alarm")
    ]
    assert [tuple(r) for r in al.summarize_alarms(al.extract_alarms(rows)).collect()] == [("7", 5), ("odd", 3), ("tie", 3)]
    assert lines(al.extract_alarms(rows, DAY + timedelta(seconds=2), DAY + timedelta(seconds=3))) == [2, 3]


def test_keyword_case_and_sxfy(spark):
    rows = frame(spark, entry("Carrier ABC load", 0), entry("carrier abc mapping", 1), entry("other", 2))
    assert lines(search.search(rows, ["carrier ABC"])) == [0, 1]
    rows = frame(spark, entry("SEND S6F11W Carrier", 0), entry("SEND S6F11 carrier", 1), entry("SEND S6F12 Carrier", 2))
    assert lines(search.search(rows, ["S6F11"])) == [0, 1]
    assert lines(search.search(rows, ["s6f11w carrier"])) == [0, 1]
    assert lines(search.search(rows, ["Carrier"], case_sensitive=True)) == [0, 2]
    assert lines(search.search(rows, ["11 C"], case_sensitive=True)) == [0]
    assert lines(search.search(rows, ["11W"])) == []
    assert lines(search.search(rows, ["  "])) == []
    assert lines(search.search(rows, [], exclude_keywords=["S6F12"])) == [0, 1]
    found = search.search(rows, [r"s\d+f12", "("], use_regex=True, match_all=False).collect()
    assert [(r["line_no"], r["matched_text"], r["keyword"]) for r in found] == [(2, "S6F12", r"s\d+f12")]


def test_composed_filter_and_bookmarks(spark):
    rows = frame(spark, entry("carrier ready", 1), entry("S6F11 event", 2, log_type="SECS"), entry("carrier DEBUG", 3), entry("unrelated", 4))
    spec = FilterSpec(keywords=[("AND", "carrier"), ("OR", "S6F11")], exclude_keywords=["DEBUG"])
    kept = filters.apply_spec(rows, spec).orderBy("line_no").collect()
    assert [(r["line_no"], r["matched_keywords"]) for r in kept] == [(1, "carrier"), (2, "S6F11")]
    marks = spark.createDataFrame([("mmi.log|3|2026-07-01 08:00:00:000", "look"), ("mmi.log|4|2026-07-01 08:00:00:000", "")], "entry_key string, memo string")
    spec.always_include_bookmarks = True
    kept = filters.apply_spec(rows, spec, marks).orderBy("line_no").collect()
    assert [(r["line_no"], r["matched_keywords"]) for r in kept] == [(1, "carrier"), (2, "S6F11"), (3, ""), (4, "")]
    assert lines(filters.matches_of(filters.apply_spec(rows, spec, marks))) == [1, 2]
    spec.log_types = ["SECS"]
    assert lines(filters.apply_spec(rows, spec, marks)) == [2]
    assert lines(filters.apply_spec(rows, FilterSpec(bookmark_only=True), marks)) == [3, 4]
    assert lines(filters.apply_spec(rows, FilterSpec())) == [1, 2, 3, 4]
    assert lines(filters.apply_spec(rows, FilterSpec(log_types=[]))) == []
    named = {"carrier": rows.filter("line_no = 4").select("source_path", "line_no")}
    assert lines(filters.apply_spec(rows, FilterSpec(keywords=[("AND", "carrier")]), named=named)) == [1, 3, 4]
    assert stats.statistics(rows, marks).first().asDict() == {"total": 4, "mmi": 3, "secs": 1, "bookmarked": 2, "alarms": 0}


def test_spec_round_trip():
    spec = FilterSpec(keywords=[("AND", "a"), ("OR", "b")], exclude_keywords=["c"], start=datetime(2026, 7, 1, 1), sxfy=["S1F3"], always_include_bookmarks=True)
    again = FilterSpec.from_json(spec.to_json())
    assert again == spec
    assert spec.describe() == "AND: a / OR: b / 제외: c / 북마크 키워드 조건 예외 / 시간: 2026-07-01 01:00:00.000 ~ "
    assert parse_ceid_ranges("1-3, 7; 9 - 12") == [(1, 3), (7, 7), (9, 12)]
    assert ceid_items([{"start": 5}, 3, {"end": 4}]) == [{"start": 5, "end": 5, "enabled": True, "name": "", "memo": ""}]
    with pytest.raises(ValueError):
        parse_ceid_ranges("3-1")
    assert enabled_ranges(ceid_items([{"start": 9, "end": 4}, {"start": "x"}, {"start": 1, "enabled": False}])) == [(4, 9)]


def test_time_inputs():
    day = date(2026, 7, 2)
    assert parse_time_range("23:50", "00:10", day) == (datetime(2026, 7, 2, 23, 50), datetime(2026, 7, 3, 0, 10))
    assert parse_time_range("2026-07-01T10:00", "", day) == (datetime(2026, 7, 1, 10), None)
    for bad in (("", ""), ("2026-07-02 10:00", "2026-07-01"), ("x", "")):
        with pytest.raises(ValueError):
            parse_time_range(*bad, day)


def test_time_windows_equal_brute_force(spark):
    times = [0, 1, 29, 30, 31, 60, 61, 89, 90, 91, 200, 230, 231, 500]
    rows = frame(spark, *[entry(str(t), i, t) for i, t in enumerate(times)])
    for anchors in ([60], [0, 200], [61, 90, 91, 300]):
        for width in (0, 1, 30, 300):
            table = spark.createDataFrame([(DAY + timedelta(seconds=a),) for a in anchors], "timestamp timestamp_ntz")
            want = [i for i, t in enumerate(times) if any(abs(t - a) <= width for a in anchors)]
            assert lines(filters.within(rows, table, width)) == want, (anchors, width)


LOT = [
    entry("CarrierObject::StateChange model=Arrived, GetString()=Carrier idx: 1, CARRIER_ID: LOT01, CARRIERID_READ: YES, SLOTMAP_READ: NO", 10, 1),
    entry("LoadPortObject::StateChange model=Present, GetString()=PorNo: 1, LocID: LP1", 11, 2),
    entry("CarrierObject::StateChange model=Ready, GetString()=Carrier idx: 1, CARRIER_ID: LOT01, CARRIERID_READ: YES, SLOTMAP_READ: YES", 12, 5),
    entry("CarrierObject::ClearCarrierInfo Before Clear, this->CarrierID : LOT01, SEQPortNo : 1, MMIPortNo : 1", 13, 8),
    entry("S6F11 CEID=202 Carrier LOT01 completed", 20, 9, "SECS"),
]


def trip(spark, rows, carrier="LOT01", **more):
    df = frame(spark, *rows)
    out = roundtrip.carrier_roundtrip(carrier, df, objects.extract_object_events(df), al.extract_alarms(df), **more)
    return out.orderBy("timestamp", "source_file", "line_no").collect()


def test_roundtrip(spark):
    rows = trip(spark, LOT)
    assert [r["line_no"] for r in rows] == [10, 11, 12, 13, 20]
    assert [r["state"] for r in rows] == [
        "Carrier ID Read", "LoadPort StateChange", "Carrier ID / Slot Map Read", "Carrier Released", "Carrier Related Log"
    ]
    assert (rows[0]["level"], rows[1]["port_no"], rows[1]["gap_ms"], rows[0]["gap_ms"]) == ("WARN", "1", 1000, None)
    assert trip(spark, LOT, " ") == [] and trip(spark, LOT, "LOT99") == []


def test_roundtrip_alarm_and_late_rows(spark):
    extra = [entry("[ALARM] Alarm Code [5] clamp", 14, 3), entry("LOT01 late", 15, 100), entry("[ALARM] far LOT01", 16, 101),
             entry("[ALARM] outside", 17, 900)]
    rows = trip(spark, LOT + extra, context_seconds=1)
    shown = {r["line_no"]: (r["level"], r["state"], r["detail"], r["gap_ms"]) for r in rows}
    assert shown[14] == ("ERROR", "Alarm", "Alarm Code=5, Alarm Code [5] clamp", 1000)
    assert shown[15][0] == "WARN" and shown[15][3] == 91000
    assert shown[16][:2] == ("ERROR", "Alarm") and 17 not in shown


def test_roundtrips_of_two_carriers_restart_the_gap(spark):
    rows = LOT + [entry("LOT02 alone", 30, 50)]
    df = frame(spark, *rows)
    carriers = spark.createDataFrame([("LOT01",), ("LOT02",)], "carrier string")
    out = roundtrip.carrier_roundtrips(carriers, df, objects.extract_object_events(df), al.extract_alarms(df)).collect()
    assert sorted((r["carrier"], r["line_no"]) for r in out if r["gap_ms"] is None) == [("lot01", 10), ("lot02", 30)]


def test_roundtrips_over_short_cells_and_without_moving_made_rows(spark, monkeypatch):
    rows = [entry(f"CarrierObject::ClearCarrierInfo Before Clear, this->CarrierID : LOT{i % 5}, SEQPortNo : {i % 2}, MMIPortNo : 9", i, i * 40) for i in range(60)]
    rows += [entry(f"LoadPortObject::StateChange model=M, GetString()=PorNo: {i % 3}, LocID: LP1", 100 + i, i * 55) for i in range(40)]
    rows += [entry(f"[ALARM] Alarm Code [{i}] of LOT{i % 7}", 200 + i, i * 37 - 200, color_index=31) for i in range(80)]
    df = frame(spark, *rows)
    carriers = spark.createDataFrame([(f"LOT{i}",) for i in range(7)], "carrier string")
    found = lambda: roundtrip.carrier_roundtrips(carriers, df, objects.extract_object_events(df), al.extract_alarms(df))
    want = sorted(map(str, found().collect()))
    monkeypatch.setattr(roundtrip, "CELL_ROWS", 20)
    out = found()
    assert len(want) > 300 and sorted(map(str, out.collect())) == want
    # Rows are made after the last exchange: nothing between the join with the carriers and the result is shuffled.
    plan = out._jdf.queryExecution().sparkPlan().toString()
    top = out._jdf.queryExecution().executedPlan().toString().split("ShuffledHashJoin")[0]
    assert "ShuffledHashJoin" in plan and "Exchange" not in top and top.count("Sort [") == 1


BODY = "SEND S6F11W\n  <L [3]>\n    <U4 [1] 0>\n    <U4 [1] 777>\n    <L [1]>\n      <L [2]>\n        <U4 [1] 10>\n        <L [1]>\n          <A [3] ABC>"


def dimensions(spark):
    events = spark.createDataFrame([(777, " Carrier Arrived "), (888, None), (None, "x")], "CEId long, Name string")
    reports = spark.createDataFrame([(10, 2, 1002), (10, 1, 1001), (20, 1, 1003)], "RepId long, Index_No int, VId long")
    names = spark.createDataFrame([(1001, "CarrierID"), (1003, "ChamberPressure")], "VId long, Name string")
    return dims.event_names(events), dims.report_variables(reports, names)


def test_annotation(spark):
    events, variables = dimensions(spark)
    assert sorted(tuple(r) for r in events.collect()) == [(777, "Carrier Arrived"), (888, "")]
    rows = frame(spark, entry(BODY, 1, log_type="SECS", sxfy_type="S6F11", ceid=777), entry("plain", 2))
    shown = enrich.annotate(rows, events, variables).orderBy("line_no").collect()
    text = shown[0]["display_message"].split("\n")
    assert (text[3], text[8]) == ("    <U4 [1] 777> // (CEID 777) Carrier Arrived", "          <A [3] ABC> // (1001) CarrierID")
    assert shown[0]["message"] == BODY and shown[1]["display_message"] == "plain"
    text = enrich.annotate(rows, None, variables, "extended").orderBy("line_no").first()["display_message"].split("\n")
    assert (text[3], text[6], text[8]) == ("    <U4 [1] 777>", "        <U4 [1] 10> // (RPTID 10)", "          <A [3] ABC> // (VID 1001) CarrierID")


def test_reference_names(spark):
    events, variables = dimensions(spark)
    rows = frame(
        spark, entry("a", 0, ceid=777, s6f11_rptids=[10, 20]), entry("b", 1, ceid=777, s6f11_rptids=[20]), entry("c", 2, ceid=888),
    )
    assert sorted(r[0] for r in enrich.used_ceids(rows).collect()) == [777, 888]
    assert sorted(r[0] for r in enrich.used_rptids(rows).collect()) == [10, 20]
    assert lines(search.reference_matches(rows, "carrier arrived", events, variables)) == [0, 1]
    assert lines(search.reference_matches(rows, "(1003) chamber", events, variables)) == [0, 1]
    assert lines(search.search_with_references(rows, "(CEID 888)", events, variables)) == [2]
    with pytest.raises(ValueError):
        search.reference_matches(rows, "(", events, variables, use_regex=True)


def scene():
    return [
        entry("CarrierObject::StateChange CARRIER_ID=LOT01", 1, 0.1, level_name="Normal", ceid=101, event_name="Carrier Arrived"),
        entry("S2F41 START command before failure CARRIER_ID=LOT01", 10, 0.6, "SECS", ceid=777, event_name="Start Command"),
        entry("[ALARM] Alarm Code [3001] Load port failed to clamp", 2, 1.2, level_name="Alarm", ceid=3001, event_name="Clamp Failed"),
        entry("Operator checked load port after alarm", 3, 2, level_name="Info"),
    ]


def test_report(spark):
    rows = frame(spark, *scene())
    outside = frame(spark, entry("[ALARM] Alarm Code [9999] outside", 99, 300), entry("failed outside", 101, 400))
    both = rows.unionByName(outside)
    matches = search.search(both, ["failed"])
    out = rp.report(rows, objects.extract_object_events(both), al.extract_alarms(both), matches, keyword="failed", generated=DAY)
    text = [r["text"] for r in out.orderBy("section", "ord").collect()]
    for line in (
        "# Log Analysis Report", "- Generated: 2026-07-01 08:00:00", "- Total parsed entries: 4",
        "- Log span: 2026-07-01 08:00:00:100 -> 2026-07-01 08:00:02:000 (0:00:01.900000)",
        "- First alarm: 2026-07-01 08:00:01:200 code=3001 | Alarm Code [3001] Load port failed to clamp",
        "- First Fail/Alarm log: 2026-07-01 08:00:01:200 [MMI] mmi.log:2 | Alarm | [ALARM] Alarm Code [3001] Load port failed to clamp",
        "- Pre-problem signals: CEID 101 (Carrier Arrived); Carrier LOT01; CEID 777 (Start Command); SxFy S2F41",
        "- Largest pre-problem gap: +600ms before 2026-07-01 08:00:01:200 [MMI] mmi.log:2",
        "- Top CEID/Event: CEID 101 (Carrier Arrived): 1x; CEID 777 (Start Command): 1x; CEID 3001 (Clamp Failed): 1x",
        "- Top matched keywords: failed: 1x",
        "- before: 2026-07-01 08:00:00:600 +500ms | [SECS] secs.log:10 |  | S2F41 START command before failure CARRIER_ID=LOT01",
        "- after: 2026-07-01 08:00:02:000 +800ms | [MMI] mmi.log:3 | Info | Operator checked load port after alarm",
        "- Total alarm events: 1", "- [1x] 3001", "- Matches: 1",
    ):
        assert line in text, line
    assert any(t.startswith("- CENTER: 2026-07-01 08:00:01:200 +600ms | [MMI] mmi.log:2 | Alarm") for t in text)
    assert "9999" not in "\n".join(text) and "outside" not in "\n".join(text)


def test_report_of_nothing(spark):
    rows = frame(spark, entry("[ALARM] Alarm Code [4001] x", 20))
    none = rows.limit(0)
    out = rp.report(none, objects.extract_object_events(rows), al.extract_alarms(rows), search.search(rows, ["x"]), keyword="x", markdown=False)
    text = [r["text"] for r in out.orderBy("section", "ord").collect()]
    assert text[1] == "=" * len(text[0])
    for line in ("Total parsed entries: 0", "No entries available for investigation hints.", "No alarms detected in the reported entries.", "No matches for: x"):
        assert "  * " + line in text
    assert "Problem Context" not in text


def test_event_name_from_dimension(spark):
    rows = frame(spark, entry("S6F11 W CEID=777", 1, log_type="SECS", ceid=777))
    assert tuple(rp.top_ceid_hints(rows, dimensions(spark)[0]).first())[:3] == (777, "Carrier Arrived", 1)


def test_gap_texts(spark):
    values = [12, 3400, 130_000, -5, 5000, 3_723_000, 0, None, 59_960] + list(range(1050, 60_000, 100))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, ms long")
    rows = df.orderBy("i").select(gap_text(F.col("ms")), report_gap_text(F.col("ms"))).collect()
    assert [r[0] for r in rows[:9]] == ["+12ms", "+3.4s", "+2m 10s", "-5ms", "+5s", "+1h 2m 3s", "+0ms", "", "+60.0s"]
    assert [r[1] for r in rows[:9]] == ["+12ms", "+3.4s", "+2m 10s", "-5ms", "+5s", "+62m 3s", "+0ms", "", "+60s"]
    for ms, row in zip(values[9:], rows[9:]):
        assert row[0] == (f"+{ms / 1000:.1f}s" if ms % 1000 else f"+{ms // 1000}s"), ms


def test_keyword_table_ways_agree(spark):
    texts = ["Alpha beta", "beta éTé gamma", "a", "", "alphabet ab", "x" * 50 + "ab"]
    rows = frame(spark, *[entry(t, i) for i, t in enumerate(texts)])
    words = ["alpha", "AB", "a", "été", "zzz", "beta", "ta é", "xab", "Alpha"]
    want = sorted((i, w) for i, t in enumerate(texts) for w in words if w.lower() in t.lower())
    table = spark.createDataFrame([(w,) for w in words], "term string")
    got = search.match_terms(rows, ["line_no"], [F.col("message")], table).collect()
    assert sorted(tuple(r) for r in got) == want
    assert search.match_terms(rows, ["line_no"], [F.col("message")], table.filter("false")).collect() == []


def test_keyword_tables_move_no_rows_and_large_ones_agree(spark, monkeypatch):
    rows = frame(spark, *[entry(f"lot{i} port: {i % 4} W{i * 3}", i) for i in range(40)])
    table = spark.createDataFrame([(w,) for w in ("LOT1", "t2", "3", "w12", "none", "W")], "keyword string")
    few = search.match_keyword_table(rows, table)
    want = sorted(map(tuple, few.collect()))
    # Grams, texts and pairs of the rows stay in their tasks: no exchange but the broadcast of the terms.
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == plan.count("BroadcastExchange") > 0
    monkeypatch.setattr(search, "BROADCAST_TERMS", 1)
    assert sorted(map(tuple, search.match_keyword_table(rows, table).collect())) == want and len(want) > 40


def test_named_groups_and_back_references(spark):
    rows = frame(spark, entry("CARRIER_ID: LOT77 x", 1), entry("LOT78", 2), entry(r"(?P<a_b>", 3))
    found = search.search(rows, [r"LOT(?P<a_b>\d)(?P=a_b)"], use_regex=True)
    assert [(r["line_no"], r["matched_text"]) for r in found.collect()] == [(1, "LOT77")]
    assert lines(search.search(rows, [r"\(\?P<a_b>"], use_regex=True)) == [3]
    assert lines(search.search(rows, ["(?P<a_b>"], use_regex=True)) == [3]  # invalid: searched as text


def test_shown_text_is_searched(spark):
    rows = frame(spark, entry("plain", 1), entry("plain", 2)).withColumn("display_message", F.when(F.col("line_no") == 2, "plain // name").otherwise(F.col("message")))
    assert lines(search.search(rows, ["name"])) == [2]
    assert lines(filters.apply_spec(rows, FilterSpec(keywords=[("AND", "name")]))) == [2]


def test_null_keys_find_nothing(spark):
    rows = frame(spark, entry("a", 1, ceid=5), entry("b", 2), entry("c", 3, ceid=0))
    names = spark.createDataFrame([(5, "five"), (0, "zero")], "ceid long, name string")
    got = enrich.attach_event_names(rows, names).collect()
    assert sorted((r["line_no"], r["event_name"], r["ceid"]) for r in got) == [(1, "five", 5), (2, None, None), (3, "zero", 0)]


def test_gaps_with_and_without_an_index(spark):
    rows = en.timeline(frame(spark, *[entry(str(i), i, i * i) for i in range(300)])).filter("line_no % 3 <> 0")
    from waferlog.operators.ordered import gaps_on_index

    want = {r["line_no"]: (r["position"], r["gap_ms"]) for r in filters.gap_table(rows.drop("timeline_index")).collect()}
    assert {r["line_no"]: (r["position"], r["gap_ms"]) for r in filters.gap_table(rows).collect()} == want
    small = gaps_on_index(rows, "timeline_index", F.col("line_no"), block_rows=7).collect()
    kept = [i for i in range(300) if i % 3]
    assert {r["line_no"]: (r["position"], r["_before"]) for r in small} == {n: (i, kept[i - 1] if i else None) for i, n in enumerate(kept)}


def test_spans(spark):
    rows = frame(spark, entry("concat cat CAT été", 1), entry("none", 2))
    literal = search.span_table(rows, ["cat", "ÉTÉ"]).collect()
    assert sorted(tuple(r)[2:] for r in literal) == [("cat", 3, 6), ("cat", 7, 10), ("cat", 11, 14), ("ÉTÉ", 15, 18)]
    regex = search.span_table(rows, [r"\bcat"], use_regex=True).collect()
    assert sorted(tuple(r)[2:] for r in regex) == [(r"\bcat", 7, 10), (r"\bcat", 11, 14)]
    assert "Python" not in search.span_table(rows, ["cat"])._jdf.queryExecution().executedPlan().toString()


def test_spans_of_empty_matches_marks_and_many_matches(spark):
    texts = ["a\0b a\0b", "😀x😀 x", "", None, "x y" * 2000]
    rows = frame(spark, *[{**entry(t or "", i), "message": t} for i, t in enumerate(texts)])
    for pattern in ("x*", "b|😀", r"(?=y)|x"):
        got = sorted((r["line_no"], r["start"], r["end"]) for r in search.span_table(rows, [pattern], use_regex=True).collect())
        assert got == sorted((i, m.start(), m.end()) for i, t in enumerate(texts) for m in re.finditer(pattern, t or "") if m.group())
    assert search.span_table(rows, [" ", ""]).count() == 0


def test_context_pages_and_order(spark):
    rows = en.timeline(frame(spark, *[entry(f"m{i}", i, 500 - i) for i in range(40)]))
    assert [r["line_no"] for r in rows.orderBy("timeline_index").collect()] == list(range(39, -1, -1))
    around = rowwin.context(rows, spark.createDataFrame([(0,), (20,)], "anchor long"), 2)
    assert sorted((r["anchor"], r["timeline_index"], r["marker"]) for r in around.collect()) == [
        (0, 0, "CENTER"), (0, 1, "after"), (0, 2, "after"), (20, 18, "before"), (20, 19, "before"), (20, 20, "CENTER"), (20, 21, "after"), (20, 22, "after")
    ]
    assert sorted(r["timeline_index"] for r in rowwin.page(rows, 1, 15).collect()) == list(range(15, 30))
    assert sorted(r["timeline_index"] for r in rowwin.centred(rows, 39, 10).collect()) == list(range(30, 40))
    assert rowwin.page(rows, 0, 20_000).count() == 40
    swapped = rows.withColumn("timeline_index", F.when(F.col("timeline_index") < 2, 1 - F.col("timeline_index")).otherwise(F.col("timeline_index")))
    assert compare.timeline_digest(rows).first() != compare.timeline_digest(swapped).first()
    assert compare.timeline_digest(rows).first() == compare.timeline_digest(rows.repartition(3)).first()
    assert compare.order_violations(rows).first().asDict() == {"entries": 40, "violations": 0}


def test_previous_row_over_block_borders(spark):
    from waferlog.operators.ordered import with_previous

    df = spark.range(1000).withColumnRenamed("id", "i")
    got = with_previous(df, "i", {"before": F.col("i")}, block_rows=7).orderBy("i").collect()
    assert [r["before"] for r in got] == [None, *range(999)]


def test_related_and_flow(spark):
    message = "S6F11 SubstrateObject CARRIER_ID: 'LOT1', SubstrateID=W9, <SubstID> W10 </SubstID> LocID: LP1 CARRIERID = NULL, Carrier ID: LOT1"
    rows = frame(spark, entry(message, 1, sxfy_type="S6F11", ceid=12, event_name="Load done"))
    got = [(r["label"], r["value"]) for r in related.related_candidates(rows).orderBy("rank").collect()]
    assert got == [
        ("SxFy", "S6F11"), ("CEID", "12"), (related.EVENT_NAME_LABEL, "Load done"), (related.OBJECT_LABEL, "SubstrateObject"),
        ("Carrier ID", "LOT1"), ("Substrate ID", "W9"), ("Substrate ID", "W10"), ("Location ID", "LP1"),
    ]
    assert [r["term"] for r in related.flow_terms(rows).orderBy("rank").collect()] == ["Load done", "LOT1", "W10", "LP1"]
    assert related.spec_with_related(FilterSpec(keywords=[("AND", "a")]), "XOR", ["a", " b ", ""]).keywords == [("AND", "a"), ("AND", "b")]


def test_diffs(spark):
    pairs = spark.createDataFrame([(1, "same\nbefore", "same\nafter"), (2, "a\na\nb", "a\nb\nc")], "pair_id long, left string, right string")
    sets = sorted((r["mark"], r["line"]) for r in compare.line_diff(pairs).collect() if r["pair_id"] == 2)
    assert sets == [("delete", "a"), ("equal", "a"), ("equal", "b"), ("insert", "c")]


def test_log_text_and_sinks(spark, tmp_path):
    rows = frame(
        spark,
        entry("second\ncontinuation", 2, raw_line="2026-07-09 12:00:00:002|1|2|second\ncontinuation"),
        entry("message only", 3, 1), entry("cut", 4, 2, raw_line="2026-07-09 12:00:00:003|1|3|cut -->[Count:2]"),
    ).withColumn("display_message", F.when(F.col("line_no") == 2, "second\ncontinuation // x").otherwise(F.col("message")))
    got = [r["text"] for r in sinks.as_log_text(rows).orderBy("line_no").collect()]
    assert got == ["2026-07-09 12:00:00:002|1|2|second\ncontinuation // x", "message only", "2026-07-09 12:00:00:003|1|3|cut -->[Count:2]"]
    sinks.write_log_text(rows, str(tmp_path / "text"), [F.col("line_no")])
    sinks.write_csv(filters.display_rows(filters.with_gap(rows)), str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv"))
    assert back.columns == list(sinks.LABELS.values()) and back.count() == 3
    assert sorted(r["간격"] or "" for r in back.collect()) == ["", "+1s", "+1s"]


def test_levels_file(spark, tmp_path):
    path = tmp_path / "levels.yaml"
    path.write_text("# map\nlevels:\n  0: Plain\n  7: \"Big one\"\n")
    assert dims.load_levels(str(path)) == {0: "Plain", 7: "Big one"}
    assert dims.load_levels(str(tmp_path / "none.yaml"))[21] and len(dims.load_levels()) == 32
