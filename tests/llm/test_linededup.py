import random

from waferlog.llm import linededup

BLANKS = linededup.BLANKS


def expected(rows, width=3):
    """Documents in key order, one after another."""
    seen, out = set(), {}
    for key, text in sorted(rows, key=lambda r: r[0]):
        lines = [x.strip(BLANKS) for x in (text or "").split("\n")]
        lines = [x for x in lines if x]
        covered = set()
        for i in range(len(lines) - width + 1):
            window = tuple(lines[i : i + width])
            if window in seen:
                covered |= set(range(i, i + width))
            seen.add(window)
        kept, k, keep = [], -1, True
        for line in (text or "").split("\n"):
            if line.strip(BLANKS):
                k += 1
                keep = k not in covered
            if keep:
                kept.append(line)
        out[key] = (None if text is None else "\n".join(kept), len(lines), len(covered))
    return out


def test_like_one_pass(spark):
    rng = random.Random(4)
    pool = [f"line {i}" for i in range(12)] + ["", "  "]
    rows = [(i, "\n".join(rng.choice(pool) + rng.choice(["", " "]) for _ in range(rng.randrange(14)))) for i in range(300)]
    rows += [(1000, None), (1001, "\n".join(["same"] * 9)), (1002, "a\nb"), (1003, "a\nb")]
    got = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in got} == expected(rows)


def test_edges(edge_docs, no_docs):
    got = linededup.dedup_lines(edge_docs)
    rows = got.collect()
    assert len(rows) == edge_docs.count() and got.columns.count("text") == 1
    by = {r["doc_id"]: r for r in rows}
    assert by[6]["n_removed"] == 0 and by[7]["text"] == "other" and by[7]["n_removed"] == 3
    assert by[0]["text"] is None and by[2]["text"] == "   \n\t "
    assert linededup.dedup_lines(no_docs).count() == 0


def test_rows_equal_in_key_and_text_are_one_document(spark):
    text = "a\nb\nc\nd"
    df = spark.createDataFrame([(5, text), (5, text), (None, text), (None, text), (7, text)], "doc_id long, text string")
    assert sorted(linededup.dedup_lines(df).select("n_removed").toPandas()["n_removed"]) == [0, 0, 4, 4, 4]
