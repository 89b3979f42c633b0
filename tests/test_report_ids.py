"""Report ids by one walk over the items: the same as those of the whole item tree."""

import random

from pyspark.sql import functions as F

from waferlog.functions import secs
from waferlog.functions.arrays import bind
from waferlog.functions.text import SXFY, extract, normalize_sxfy, sxfy_type


def of_tree(message):
    ids = bind(
        secs.item_nodes(message),
        lambda nodes: F.transform(bind(secs.body_line(nodes), lambda body: secs.report_ids(nodes, body)), lambda r: r["rptid"]))
    none = F.array().cast("array<bigint>")
    return F.coalesce(F.when(F.contains(message, F.lit("S6F11")), F.sort_array(F.array_distinct(ids))), none)


def tree(rng, depth=0):
    kind = "L" if depth < 4 and rng.random() < 0.85 else rng.choice(["U4", "A", "LL"])
    value = rng.choice(["", f" {rng.randint(-3, 40)}", f" x{rng.randint(0, 9)} 7", " 99999999999999999999"]) if kind != "L" else ""
    lines = [f"{' ' * (2 * depth + (rng.random() < 0.1))}<{kind} [{rng.randint(0, 4)}]{value}>"]
    if rng.random() < 0.05:
        lines.append(rng.choice(["note", "  <L 3>", ""]))
    for _ in range(rng.randint(0, 4) if kind == "L" else 0):
        lines += tree(rng, depth + 1)
    return lines


def test_walk_equals_the_tree(spark):
    rng = random.Random(3)
    texts = ["\n".join([rng.choice(["SEND S6F11W"] * 9 + ["S1F3"]), *tree(rng), *(tree(rng, 1) if rng.random() < 0.3 else [])]) for _ in range(1500)]
    rows = spark.createDataFrame([(t,) for t in [*texts, "", "S6F11", None]], "m string")
    found = rows.select("m", of_tree(F.col("m")).alias("a"), secs.message_rptids(F.col("m")).alias("b")).collect()
    assert [r for r in found if r["a"] != r["b"]] == []
    assert sum(len(r["a"]) > 0 for r in found) > 50 and sum(len(r["a"]) > 1 for r in found) > 10


def test_an_outer_list_takes_the_place_of_an_inner_one(spark):
    inner = ["  <L [3]>", "    <U4 [1] 1>", "    <U4 [1] 2>", "    <L [1]>", "      <L [2]>", "        <U4 [1] 5>", "        <L [0]>"]
    late = ["<L [3]>", *inner, "  <U4 [1] 8>", "  <L [1]>", "    <L [2]>", "      <U4 [1] 6>", "      <L [0]>"]
    rows = spark.createDataFrame([(0, "\n".join(["S6F11", "<L [3]>", *inner])), (1, "\n".join(["S6F11", *late]))], "i int, m string")
    assert [r[0] for r in rows.orderBy("i").select(secs.message_rptids(F.col("m"))).collect()] == [[5], [6]]


def test_no_tree_is_made_for_report_ids(spark):
    rows = spark.createDataFrame([("S6F11",)], "m string").select(secs.message_rptids(F.col("m")).alias("ids"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 1 and "flatten(" not in plan and plan.count("regexp_extract(") <= 2


def test_hints_keep_every_match(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("SsFfWwſ019_ .٣a\n") for _ in range(rng.randint(0, 12))) for _ in range(20000)]
    rows = spark.createDataFrame([(w,) for w in [*words, "S6F11W", "x S1F3w, s٣f9W.", None]], "m string")
    m = F.col("m")
    plain = F.regexp_replace(m, r"(?iuU)\b(S\d+F\d+)W\b", "$1")
    found = rows.select((sxfy_type(m).eqNullSafe(F.upper(extract(m, SXFY))) & normalize_sxfy(m).eqNullSafe(plain)).alias("same"), sxfy_type(m).alias("t")).collect()
    assert all(r["same"] for r in found) and sum(r["t"] is not None for r in found) > 20
