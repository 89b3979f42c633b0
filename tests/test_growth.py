"""What follows a header line, looked up without walking it anew for each line."""

import re

from pyspark.sql import functions as F

from waferlog.operators import assemble
from waferlog.sources.raw import lines_from_texts


def plan_of(spark, frame):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return frame._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def raw(spark, texts):
    return lines_from_texts(spark.createDataFrame(texts, "source_file string, content string"))


def test_no_frame_from_a_line_to_the_end(spark):
    lines = raw(spark, [("notes.log", "2024-01-01 00:00:00:000|1|1|a\nb")])
    for flag_only in (False, True):
        assert not re.search(r"RowFrame, \d+, unboundedfollowing", plan_of(spark, assemble._block_carries(lines, flag_only)).replace("$", ""))


def test_an_entry_closed_by_a_marker_in_a_later_block(spark):
    """Whether a file of unknown dialect keeps an MMI entry depends on what follows its header, in this block or in a later one."""
    head, start, finish = "2024-01-01 00:00:00:000|1|1|a", "  [Setup.ini] LOGGING", "[Setup.ini] FINISH"
    texts = [("kept.log", f"{head}\nmore\n{head}\n{start}\n{finish}"), ("dumped.log", f"{head}\nmore\n{start}"), ("plain.log", f"{head}\nmore")]
    for size in (1, 2, 99):
        lines = raw(spark, texts).withColumn("block_no", F.floor((F.col("line_no") - 1) / size))
        found = assemble.assemble(lines).filter("NOT in_dump").groupBy("source_file", "dialect").agg(F.count("*").alias("n")).collect()
        got = {(r["source_file"], r["dialect"]): r["n"] for r in found}
        assert got == {("kept.log", "MMI"): 1, ("plain.log", "MMI"): 1}, (size, got)
