"""Embedded XML pieces, against a plain stack over one message."""

import re

from hypothesis import HealthCheck, given, settings, strategies as st

from waferlog.operators import xml

MARK = re.compile(r"<!--[\s\S]*?-->|<!\[CDATA\[[\s\S]*?\]\]>|<(?P<end>/?)(?P<name>[A-Za-z_][A-Za-z0-9_:.-]*)(?:\s[^<>]*)?>|<(?P<own>[A-Za-z_][A-Za-z0-9_:.-]*)(?:\s[^<>]*)?/>")


def plain(text):
    """Every piece by trying each start tag with a stack, outermost first."""
    found = []
    for m in MARK.finditer(text or ""):
        name = m["name"] or m["own"]
        if name and name.upper() not in xml.SECS_ITEMS:
            found.append((m.start(), m.end(), name, -1 if m["end"] else 0 if m[0].endswith("/>") else 1))
    pieces, at = [], 0
    while at < len(found):
        stack, stop = [], None
        for i in range(at, len(found)):
            _, _, name, step = found[i]
            if step == 1:
                stack.append(name)
            elif step == -1 and (not stack or stack.pop() != name):
                break
            if not stack:
                stop = i
                break
        if stop is None:
            at += 1
            continue
        pieces.append((found[at][0], found[stop][1], found[at][2], sum(f[3] >= 0 for f in found[at : stop + 1])))
        at = stop + 1
    return pieces


def pieces(spark, texts):
    messages = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, message string")
    out = {i: [] for i in range(len(texts))}
    for r in xml.xml_pieces(messages, ["id"]).orderBy("id", "start").collect():
        out[r["id"]].append((r["start"], r["end"], r["name"], r["tags"]))
    return [out[i] for i in range(len(texts))]


CASES = [
    None, "", "no tags", "<j>", "</j>", "<j></j>", "x <j k='1'>t<k/></j> y <c></c>", "<j><k></j></k>", "<c><j><k></c></j></k>",
    "<br> <p>one</p>", "</x> <p>one</p>", "<j><j></j>", "<j></j></j>", "<!-- <j> --><k><![CDATA[</k>]]></k>",
    "S6F11 W\n<L [2]\n  <U4 [1] 1043>\n  <A [3] 'x'>\n> <Job id='7'><Step/></Job>", "<j:b.c-d_1>é\U0001f600</j:b.c-d_1><z/>", "<a><j></j></a><B/>", "<j\n x='1'\n></j >",
    "<j><br></j><k></k>", "<A></A>", "<p>" * 300 + "</p>" * 299,
]


def test_cases(spark):
    assert pieces(spark, CASES) == [plain(t) for t in CASES]


def test_texts_of_pieces(spark):
    messages = spark.createDataFrame([(1, "\U0001f600 <j>é</j> <k/>"), (2, "none")], "id long, message string")
    rows = xml.with_texts(xml.xml_pieces(messages, ["id"]), messages, ["id"]).collect()
    assert sorted((r["id"], r["piece"]) for r in rows) == [(1, "<j>é</j>"), (1, "<k/>")]


def test_one_shuffle_and_no_python(spark):
    messages = spark.createDataFrame([(1, "<j></j>")], "id long, message string")
    plan = xml.xml_pieces(messages, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["<j>", "</j>", "<k>", "</k>", "<c/>", "<U4 1>", " t "]), max_size=14).map("".join), min_size=40, max_size=40))
def test_random_tags(spark, texts):
    assert pieces(spark, texts) == [plain(t) for t in texts]
