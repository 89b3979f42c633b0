import random

import pytest
from pyspark.sql import functions as F

from waferlog.operators import bitmaps, compare, search
from waferlog.operators.entries import timeline
from waferlog.schema import entry_frame

WORDS = ["lot", "ready", "S6F11W", "한글", "x", "re", "absent"]


@pytest.fixture(scope="module")
def rows(spark):
    draw = random.Random(2)
    texts = [" ".join(draw.choices(["LOT 1", "Ready", "s6f11", "한글", "x y", "rest"], k=draw.randrange(5))) for _ in range(700)]
    made = entry_frame(spark, [
        {"source_file": "a.log", "line_no": i + 1, "log_type": "MMI", "message": t} for i, t in enumerate(texts)])
    return timeline(made.withColumn("timestamp", F.lit("2026-09-01 00:00:00").cast("timestamp_ntz")))


def words(spark, *ws):
    return spark.createDataFrame([(w,) for w in ws], "keyword string")


def found(frame):
    return sorted(r["timeline_index"] for r in frame.collect())


def test_combinations_like_direct_search(spark, rows, tmp_path):
    path = str(tmp_path / "maps")
    bitmaps.write(bitmaps.build(rows, words(spark, *WORDS, " LOT ", "")), path)
    stored = spark.read.parquet(path)
    draw = random.Random(3)
    for _ in range(12):
        spec = dict(
            keywords=draw.sample(WORDS, draw.randrange(3)), or_keywords=draw.sample(WORDS, draw.randrange(2)),
            exclude_keywords=draw.sample(WORDS, draw.randrange(2)), match_all=draw.random() < 0.6)
        combined = bitmaps.combine(stored, **spec)
        expected = found(search.search(rows, **spec))
        assert found(bitmaps.positions(combined)) == expected, spec
        assert bitmaps.count(combined).first()["entries"] == len(expected)
    plan = bitmaps.combine(stored, ["lot"])._jdf.queryExecution().executedPlan().toString()
    assert "message" not in plan and "Python" not in plan


def test_known_words_are_not_searched_again(spark, rows, tmp_path):
    path = str(tmp_path / "maps")
    bitmaps.write(bitmaps.build(rows, words(spark, "lot", "absent")), path)
    stored = spark.read.parquet(path)
    with pytest.raises(KeyError, match="ready"):
        bitmaps.combine(stored, ["lot"], ["Ready"])
    assert bitmaps.combine(stored, ["absent"]).count() == 0
    assert bitmaps.extend(stored, rows, words(spark, "LOT", "absent")).count() == 0
    bitmaps.write(bitmaps.extend(stored, rows, words(spark, "lot", "ready")), path)
    again = spark.read.parquet(path)
    assert again.count() == again.select("term", "word").distinct().count()
    assert found(bitmaps.positions(bitmaps.combine(again, ["lot"], ["Ready"]))) == found(search.search(rows, ["lot"], ["Ready"]))


def test_empty_timeline_and_no_words(spark, rows):
    none = bitmaps.build(rows.limit(0), words(spark, "lot"))
    assert bitmaps.combine(none, ["lot"]).count() == 0 and bitmaps.count(bitmaps.combine(none, [], [], ["lot"])).first()[0] == 0
    assert bitmaps.combine(none).count() == 0


def test_keyword_table_with_short_and_long_terms(spark):
    texts = {1: "Ab ab c", 2: "abc", 3: "", 4: None, 5: "c"}
    rows = spark.createDataFrame(list(texts.items()), "id int, text string")
    terms = spark.createDataFrame([("a",), ("AB",), ("abc",), ("b c",), ("zz",), ("",)], "term string")
    got = sorted(map(tuple, search.match_terms(rows, ["id"], [F.col("text")], terms).collect()))
    assert got == sorted((i, t) for i, text in texts.items() for t in ["a", "AB", "abc", "b c", "zz"] if t.lower() in (text or "").lower())
    two = spark.createDataFrame([("p", 1, 7, "ab c"), ("p", 2, 8, "c")], "source_path string, line_no int, seq int, text string")
    got = sorted(map(tuple, search.match_terms(two, ["source_path", "line_no", "seq"], [F.col("text")], terms).collect()))
    assert got == [("p", 1, 7, "AB"), ("p", 1, 7, "a"), ("p", 1, 7, "b c")]


def test_digest_trees(spark, rows):
    from waferlog.staging import stage
    tree = lambda t: stage(compare.digest_tree(t, 8, 3), "tree")
    one, same = tree(rows), tree(rows.repartition(5))
    root = lambda t: t.orderBy(F.desc("level")).first()
    assert root(one) == root(same) and root(one)["rows"] == 700 and root(one)["node"] == 0
    assert compare.differing_ranges(one, same, 8, 3).count() == 0
    other = rows.withColumn("message", F.when(F.col("timeline_index").isin(3, 5, 699), "other").otherwise(F.col("message")))
    assert sorted(map(tuple, compare.differing_ranges(one, tree(other), 8, 3).collect())) == [(0, 7, 8, 8), (696, 703, 4, 4)]
    shorter = tree(rows.filter("timeline_index < 690"))
    assert sorted(map(tuple, compare.differing_ranges(one, shorter, 8, 3).collect())) == [(688, 695, 8, 2), (696, 703, 4, 0)]
    few, none = tree(rows.filter("timeline_index < 9")), tree(rows.limit(0))
    assert root(none) is None and root(few)["level"] == 1
    assert compare.differing_ranges(few, one, 8, 3).count() == 87
    assert sorted(map(tuple, compare.differing_ranges(none, few, 8, 3).collect())) == [(0, 7, 0, 8), (8, 15, 0, 1)]
