import math
import re

import numpy as np

from waferlog.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measure(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {i + d for i, w in enumerate(windows) if windows.count(w) > 1 for d in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered), len(lines))


def test_measures():
    texts = [None, "", " \x0b", "a b c d e", "a a a a a a a", "a b c d e a b c d e f", "x#| y<>\n\nx#| y<> z\n x", "é 日本 🎉\x1c\x85 a", "one two three four five six " * 3]
    for text in texts:
        assert quality.measure(text) == measure(text)


def test_tail_is_exact():
    for n, p in ((10, 0.0125), (400, 0.05), (1000, 0.3)):
        total = 0.0
        for k in range(0, n + 1, 1 if n < 50 else 37):
            total = math.fsum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1))
            assert math.isclose(quality.binomial_tail(np.array([k]), np.array([n]), p)[0], total, rel_tol=1e-9, abs_tol=1e-12)


def rows(n_good, n_bad, good_symbols, lang="en", start=0):
    good = [(start + i, "clean words are here in this text number again " * 1 + " ".join(f"w{i}{j}" for j in range(30)) + " #" * (i < good_symbols) * 30, lang) for i in range(n_good)]
    bad = [(start + 10_000 + i, " ".join(f"b{i}{j}###" for j in range(30)), lang) for i in range(n_bad)]
    return good + bad, [(r[0], 1) for r in good] + [(r[0], 0) for r in bad]


def test_cutoffs_reject_junk_and_keep_clean(spark):
    docs, labels = rows(900, 60, 0)
    few, few_labels = rows(20, 20, 0, "fr", 50_000)
    df = spark.createDataFrame(docs + few, "doc_id long, text string, lang string")
    told = spark.createDataFrame(labels + few_labels, "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.apply_rules(df, told).collect()}
    assert all(got[k]["kept"] for k, q in labels if q) and not any(got[k]["kept"] for k, q in labels if not q)
    assert got[10_000]["reasons"] == ["symbols"]
    # too few labels certify nothing
    assert all(got[k]["kept"] for k, _ in few_labels)


def test_a_cutoff_that_rejects_too_many_good_ones_is_not_certified(spark):
    docs, labels = rows(900, 60, 40)  # 40 of 900 good ones have many symbols, over a quarter of 5 %
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    got = quality.apply_rules(df, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    lost = sum(not r["kept"] and not r["base_failed"] for r in got if r["doc_id"] < 900)
    assert lost / 900 <= quality.MOST_REJECTED


def test_edges(edge_docs, no_docs, spark):
    labels = spark.createDataFrame([(4, 1), (4, 1), (4, 0), (8, None), (None, 1), (99, 1)], "doc_id long, quality int")
    got = quality.apply_rules(edge_docs, labels)
    all_rows = got.collect()
    assert len(all_rows) == edge_docs.count() and got.columns.count("kept") == 1
    for r in all_rows:
        assert tuple(r[m] for m in quality.MEASURES) == measure(r["text"]) if len(r["text"] or "") < 1000 else r["n_words"] == 40_000
    assert all(r["base_failed"] and not r["kept"] for r in all_rows if r["text"] is None)
    assert quality.apply_rules(no_docs, labels).count() == 0
    assert quality.apply_rules(edge_docs, labels.where("false")).where("kept").count() == quality.apply_rules(edge_docs, labels).where("not base_failed").count()
