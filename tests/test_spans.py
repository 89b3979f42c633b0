"""Spans: running sums of any number of matches, and the pattern that looks behind only where it must."""

from pyspark.sql import functions as F

from waferlog.functions.arrays import sums_before
from waferlog.operators import search


def test_running_sums_of_any_number(spark):
    sizes = [0, 1, 7, 8, 9, 63, 64, 65, 82, 1000]
    rows = spark.createDataFrame([(n, [i * 3 % 11 for i in range(n)]) for n in sizes], "n int, xs array<int>")
    got = {r["n"]: r["sums"] for r in rows.select("n", sums_before(F.col("xs")).alias("sums")).collect()}
    assert got == {n: [sum(i * 3 % 11 for i in range(k)) for k in range(n)] for n in sizes}


def test_only_texts_with_surrogate_pairs_are_looked_behind(spark):
    texts = ["x été x", "😀x😀 x", "日x", ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    spans = rows.select("i", F.explode(search.highlight_spans(F.col("t"), ["x*"], use_regex=True)).alias("s"))
    assert sorted((r["i"], r["s"]["start"], r["s"]["end"]) for r in spans.collect()) == [(0, 0, 1), (0, 6, 7), (1, 1, 2), (1, 4, 5), (2, 1, 2)]
    plan = spans._jdf.queryExecution().executedPlan().toString()
    assert "octet_length" in plan and "(?iuU)x*" in plan.replace(search._WHOLE_CHARACTERS + "(?:(?iuU)x*)", "")
