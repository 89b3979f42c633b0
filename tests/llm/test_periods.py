import hashlib
import random
import re
import zlib

import numpy as np
from hypothesis import given, settings, strategies as st

from waferlog.llm import periods, queries


def plain_runs(words, least=12):
    """Every distance is walked; a stretch with a smaller period is left out."""
    names: dict = {}
    a = [names.setdefault(w, len(names)) for w in words]
    out = []
    for q in range(1, len(a) // 2 + 1):
        i = 0
        while i + q < len(a):
            j = i
            while j + q < len(a) and a[j] == a[j + q]:
                j += 1
            length = j - i + q
            part = a[i : i + length]
            if j > i and length >= max(least, 2 * q) and not any(part[d:] == part[:-d] for d in range(1, q)):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def as_rows(runs):
    return [tuple(r) for r in runs.tolist()]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.sampled_from([2, 3, 4, 7, 12]))
def test_all_runs(words, least):
    assert as_rows(periods.word_runs([str(w) for w in words], least)) == plain_runs(words, least)


def test_many_stretches_and_trees(monkeypatch):
    draw = random.Random(3)
    words = []
    for _ in range(40):
        unit = [draw.choice("abcde") for _ in range(draw.randrange(1, 9))]
        words += (unit * 12)[: draw.randrange(10, 60)] + [f"u{draw.random()}" for _ in range(draw.randrange(0, 9))]
    expected = plain_runs(words)
    assert as_rows(periods.word_runs(words)) == expected and len(expected) > 20
    monkeypatch.setattr(periods, "TREE_SYMBOLS", 50)
    assert as_rows(periods.word_runs(words)) == expected


def test_common_extensions_and_ranks():
    draw = random.Random(4)
    text = [draw.randrange(1, 4) for _ in range(300)]
    tree = periods.SuffixTree(np.array(text))
    ended = [*text, 0]
    assert [i for _, i in sorted((ended[i:], i) for i in range(301))] == sorted(range(301), key=tree.rank.__getitem__)
    a, b = np.array([draw.randrange(301) for _ in range(500)]), np.array([draw.randrange(301) for _ in range(500)])
    pairs = [(x, y) for x, y in zip(a, b) if x != y]
    got = tree.common(np.array([x for x, _ in pairs]), np.array([y for _, y in pairs]))
    for (x, y), k in zip(pairs, got):
        assert ended[x : x + k] == ended[y : y + k] and ended[x + k] != ended[y + k]


def test_stretches_hold_the_runs():
    words = [f"w{i}" for i in range(500)] + ["a", "b", "c"] * 6 + ["once"] + [f"w{i}" for i in range(500)]
    ids = np.unique(words, return_inverse=True)[1]
    assert periods.stretches(ids, 12) == [(500, 518)]


def test_collapse():
    words = "x a b a b a b a b a b a b y y".split()
    runs = periods.word_runs(words, 12)
    assert as_rows(runs) == [(1, 12, 2)] and periods.collapse(words, runs) == "x a b y y"


def test_edges(spark, edge_docs, no_docs):
    rows = periods.find_runs(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    for r in rows:
        assert "text" not in r.asDict()
    kept = {r["doc_id"]: r for r in periods.find_runs(edge_docs.where("doc_id is not null")).collect()}
    assert kept[0]["n_words"] == 0 and kept[0]["runs"] == [] and kept[0]["collapsed"] == "" and kept[2]["collapsed"] == ""
    assert periods.find_runs(no_docs).count() == 0
    clash = spark.createDataFrame([("k", "a " * 20, "mine")], "id string, text string, runs string")
    assert [tuple(r["runs"][0]) for r in periods.find_runs(clash).collect()] == [(0, 20, 1)]


def test_one_very_long_document(spark):
    text = "one two three " * 40_000 + "end"
    row = periods.find_runs(spark.createDataFrame([(text,)], "text string")).first()
    assert [tuple(r) for r in row["runs"]] == [(0, 120_000, 3)] and row["collapsed"] == "one two three end"


def expected(key, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(key).encode())
    if h % 10 == 0 and n and key is not None:
        a = (h // 10) % n
        p = 1 + (n - a) // (3 + (h // 10) % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return (
        key, len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4),
        hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest(),
        hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest(),
    )


def test_query_like_a_plain_version(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").where("length(text) < 9000")
    more = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate([None, "", "a", "a b", "a " * 11, "a " * 12, "a b " * 6 + "b a " * 9])] + [(None, "a " * 30)], docs.schema)
    docs.unionByName(more).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: tuple(r) for r in queries.op12_periodic_runs(spark, str(tmp_path)).collect()}
    rows = docs.unionByName(more).collect()
    assert got == {r["doc_id"]: expected(r["doc_id"], r["text"]) for r in rows} and sum(r[1] > 0 for r in got.values()) > 10
