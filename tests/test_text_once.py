"""Entries hold their text once while they are moved and staged, and read as before."""

from pyspark.sql import functions as F

from waferlog.operators.entries import timeline
from waferlog.schema import ENTRIES, entry_frame, text_once, text_whole

ROWS = [
    ("a|1|2|body\nmore", "body\nmore", "MMI", None),
    ("a|1|2|body -->[Count:3]", "body", "MMI", None),
    ("07: [1] SEND", "SEND", "SECS", "SEND"),
    ("07: [1] SEND", "SEND", "SECS", "other"),
    ("07: [1] SEND", "SEND", "SECS", None),
    ("x", "", "MMI", "kept"),
    ("é😀ſ", "😀ſ", "MMI", None),
    (None, "m", "MMI", None),
    ("m", None, "SECS", None),
    ("m", None, None, "m"),
    ("m", "m", None, None),
    (None, None, None, None),
]


def entries(spark):
    return entry_frame(spark, [
        {"source_file": "f", "line_no": i, "raw_line": raw, "message": message, "log_type": kind, "secs_message": secs}
        for i, (raw, message, kind, secs) in enumerate(ROWS)])


def test_rows_come_back_whole(spark):
    rows = entries(spark)
    back = text_whole(text_once(rows))
    assert back.columns == ENTRIES.fieldNames()
    assert back.orderBy("line_no").collect() == rows.orderBy("line_no").collect()
    assert timeline(rows).drop("timeline_index").orderBy("line_no").collect() == rows.orderBy("line_no").collect()


def test_the_timeline_moves_and_writes_a_text_once(spark, tmp_path):
    from waferlog import staging

    made = len(staging._written)
    text = "long " * 50
    timeline(entries(spark).filter("line_no = 0").withColumns({"message": F.lit(text), "raw_line": F.lit(f"head|{text}")}))
    table = next(p for p in staging._written[made:] if "/timeline-" in p and "offsets" not in p)
    row = spark.read.parquet(table).first()
    assert sum(v.count(text) for v in row if isinstance(v, str)) == 1
