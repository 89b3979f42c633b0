import re
from collections import Counter, defaultdict

from waferlog.llm import collocations

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def plain(rows, longest=3, least=10, first=2000, percent=50):
    """Phrase by phrase, over Python integers."""
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n["und" if lang is None else lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f["und" if lang is None else lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, count in f.items():
        known = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        longer = Counter()
        for q, b in known.items():
            for k in range(2, len(q)):
                for i in range(len(q) - k + 1):
                    longer[q[i : i + k]] = max(b, longer[q[i : i + k]])
        scored = []
        for p, a in known.items():
            if p in longer and 100 * longer[p] >= percent * a:
                continue
            cuts = [(1000000 * a * a // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            scored.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        for rank, (score, a, p, l, r) in enumerate(sorted(scored)[:first], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame(rows, "text string, lang string")


def test_like_a_plain_count(spark):
    rows = [(" ".join("abcd"[i * j % 4] + "  xy\t"[j % 6 :] for j in range(40)) + ". A b, c\nd;" * (i % 5), ["en", "de", None][i % 3]) for i in range(60)]
    for least, longest, percent in [(10, 3, 50), (2, 3, 100), (5, 2, 50), (10, 4, 80)]:
        got = sorted(map(tuple, collocations.collocations(frame(spark, rows), longest, least, covered_percent=percent).collect()))
        assert got == plain(rows, longest, least, percent=percent) and got


def test_a_few_first_ranks_with_ties(spark):
    rows = [(f"p{i % 30:02d} q{i % 30:02d}!", "en") for i in range(300)]
    got = collocations.collocations(frame(spark, rows), first=7).orderBy("rank").collect()
    assert [r["phrase"] for r in got] == [f"p{i:02d} q{i:02d}" for i in range(7)] and [r["rank"] for r in got] == list(range(1, 8))
    assert all(tuple(r)[3:] == (10, 10, 10, 600, 1000000) for r in got)


def test_overlaps_pieces_and_case(spark):
    # Ten a's in a piece hold nine pairs and eight triples; Ä stays as it is, line ends cut.
    rows = [("a " * 10 + "\n" + "Ä b\nA", "x")] * 2
    got = {r["phrase"]: r for r in collocations.collocations(frame(spark, rows), covered_percent=1000).collect()}
    assert set(got) == {"a a", "a a a"} and got["a a"]["a"] == 18 and got["a a"]["l"] == 22 and got["a a a"]["a"] == 16
    assert got["a a a"]["n"] == 26


def test_products_beyond_64_bits(spark):
    counts = spark.createDataFrame([("en", 0, "", 4 * 10**14), ("en", 1, "a", 3 * 10**14), ("en", 1, "b", 2 * 10**14), ("en", 2, "a b", 10**14)], "lang string, k int, phrase string, f long")
    found = collocations._ranked(counts, counts.where("k = 2").selectExpr("lang", "k", "phrase", "f as a", "split(phrase, ' ') as ws"), 5).collect()
    assert [tuple(r) for r in found] == [("en", 1, "a b", 10**14, 3 * 10**14, 2 * 10**14, 4 * 10**14, 166666)]


def test_edges(spark, edge_docs, no_docs):
    got = collocations.collocations(edge_docs, least=2)
    assert got.columns == COLUMNS and {t for _, t in got.dtypes} == {"string", "bigint"}
    rows = [(r["text"], r["lang"]) for r in edge_docs.collect()]
    assert sorted(map(tuple, got.collect())) == plain(rows, least=2)
    assert collocations.collocations(no_docs).collect() == []
    assert collocations.collocations(frame(spark, [(None, None), ("", "en"), (" .\t", "en")])).collect() == []


def test_one_exchange_of_windows(spark):
    """The whole windows and the rolled-up prefixes read the same shuffle."""
    counts = collocations.phrase_counts(frame(spark, [("a b c d " * 50, "en")] * 20))
    counts.collect()
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = collocations.phrase_counts(frame(spark, [("a b c d " * 50, "en")] * 20))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "ReusedExchange" in plan


def test_windows_end_before_a_rare_pair(spark):
    """windows that cannot be frequent are not shuffled as a whole; every one of them was."""
    rows = [(f"x{i} y{i} z{i}. in front of u{i} v{i}", ["en", "de"][i % 2]) for i in range(40)]
    windows = collocations.padded_windows(frame(spark, rows), 3)
    keys = [tuple(bytes.fromhex(h).decode() if j == 0 else h for j, h in enumerate(r["key"].split(" "))) for r in collocations.cut_windows(windows, 3, 10).collect()]
    assert len(keys) == 40 * 8 and max(map(len, keys)) == 4
    assert {k[1:] for k in keys if len(k) > 2} == {("in", "front", "of"), ("front", "of")}
    assert {k[1:] for k in keys if len(k) == 2} == {(f"{c}{i}",) for c in "xyzuv" for i in range(40)} | {("of",)}
    # Twenty times in either language are forty in all, and a pair of two languages is none.
    assert all(len(r["key"].split(" ")) == 2 for r in collocations.cut_windows(windows, 3, 21).collect())


def test_a_filter_too_small_only_lets_more_through(spark, monkeypatch):
    rows = [(" ".join(f"{'abcdefg'[i * j % 7]}{j % 5}" for j in range(30)) + f" p{i} q{i}! r s t u", ["en", None][i % 2]) for i in range(40)]
    want = {(least, longest): plain(rows, longest, least) for least, longest in [(3, 2), (10, 3), (2, 4)]}
    for each, row, most in [(16, 64, 1 << 28), (1, 64, 64), (16, 128, 256)]:
        for name, bits in [("BITS_EACH", each), ("ROW_BITS", row), ("MOST_BITS", most)]:
            monkeypatch.setattr(collocations, name, bits)
        for (least, longest), rows_wanted in want.items():
            got = sorted(map(tuple, collocations.collocations(frame(spark, rows), longest, least).collect()))
            assert got == rows_wanted and got
