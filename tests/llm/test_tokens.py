from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from waferlog.llm import packing, tokens

TEXTS = ["", " ", "a b", "  a  b ", "a \n b\n\n", "don't  we'll 's", "x<|endoftext|> y", "日本 🎉 ▁", "Ünï\tçødé\r\n", "9" * 300, "ab" * 3000]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokens.vocabulary_path("byte_bpe_50k.json"))


def test_ids_are_the_library_s(library):
    bpe = tokens.byte_bpe(tokens.vocabulary_path("byte_bpe_50k.tiktoken"))
    for text in TEXTS:
        assert bpe.ids(text).tolist() == library.encode(text, add_special_tokens=False).ids
    assert bpe.ids(None).tolist() == []


def test_histogram_answers_every_limit(spark):
    lengths = [0, 0, 1, 5, 5, 5, 900, 1023, 1024, 1025, 5000, 5000]
    df = spark.createDataFrame([(n,) for n in lengths] + [(None,)], "n_tokens long")
    histogram = tokens.length_histogram(df)
    got = {r["n_tokens"]: r for r in histogram.collect()}
    assert {n: r["n_docs"] for n, r in got.items()} == Counter(lengths)
    for n, r in got.items():
        assert r["docs_to"] == sum(x <= n for x in lengths) and r["tokens_to"] == sum(x for x in lengths if x <= n)
        assert r["docs_over"] == sum(x > n for x in lengths) and r["tokens_over"] == sum(x for x in lengths if x > n)
        assert r["truncated_tokens"] == sum(min(x, n) for x in lengths) and r["share_to"] == r["docs_to"] / len(lengths)
    limits = [0, 1, 3, 1024, 2000, 10_000]
    answered = tokens.answer_limits(histogram, spark.createDataFrame([(x,) for x in limits], "context long")).collect()
    assert {r["context"]: (r["docs_whole"], r["tokens_whole"], r["truncated_tokens"]) for r in answered} == {
        x: (sum(n <= x for n in lengths), sum(n for n in lengths if n <= x), sum(min(n, x) for n in lengths)) for x in limits}
    quantiles = tokens.quantile_length(histogram, [0.5, 1.0]).first()
    assert tuple(quantiles) == (sorted(lengths)[5], 5000)


def test_edges(spark, edge_docs, no_docs, library):
    got = sorted(r[0] for r in tokens.token_lengths(edge_docs).collect())
    assert got == sorted(len(library.encode(r["text"] or "", add_special_tokens=False).ids) for r in edge_docs.collect())
    assert tokens.length_histogram(tokens.token_lengths(no_docs)).count() == 0


def check_packing(spark, docs, library, capacity):
    parts = packing.pieces(docs.withColumn("digest", F.md5("text")), capacity, with_ids=True, carry=["doc_id", "digest"])
    packed = packing.pack(parts, capacity).collect()
    texts = [r["text"] for r in docs.collect()]
    want = Counter(tuple(library.encode(t or "", add_special_tokens=False).ids + [0]) for t in texts)
    one_each = {}
    by_sequence = {}
    for r in packed:
        assert len(r["ids"]) == r["length"] <= capacity
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        one_each.setdefault((r["doc_id"], r["digest"]), {}).setdefault(r["piece"], []).append(r)
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    got = Counter()
    for numbered in one_each.values():
        ids, start = [], 0
        for i in range(len(numbered)):
            r = numbered[i][0]
            assert r["start"] == start
            ids += r["ids"]
            start += r["length"]
        assert all(numbered[i][0]["length"] == capacity for i in range(1, len(numbered)))
        got[tuple(ids)] += len(numbered[0])
    assert got == want
    return by_sequence, sum(r["length"] for r in packed)


def test_packing_keeps_every_id(spark, edge_docs, no_docs, library):
    check_packing(spark, edge_docs, library, 64)
    assert packing.pack(packing.pieces(no_docs, 64), 64).count() == 0


def test_packing_is_near_the_bound(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sequences, total = check_packing(spark, docs, library, 2048)
    assert len(sequences) <= 1.005 * -(-total // 2048) + 1


def test_genetic_steps_keep_the_documents():
    rng = np.random.default_rng(1)
    lengths = [int(x) for x in rng.integers(1, 100, 300)]
    one = packing.best_fit(sorted(lengths, reverse=True), 100)
    other = packing.best_fit(lengths, 100)
    child = packing.mutate(packing.crossover(one, other, 100, rng), 100, rng)
    assert sorted(x for b in child for x in b) == sorted(lengths) and max(map(sum, child)) <= 100
    best = packing.evolve(lengths, 100, [], 3)
    assert sorted(x for b in best for x in b) == sorted(lengths) and len(best) <= len(one)
    assert packing._bins(packing._flat(best)) == best


def test_hard_lengths_go_on_while_they_get_better():
    rng = np.random.default_rng(7)
    lengths = [int(x) for x in rng.integers(600, 1100, 4096)]
    best = packing.evolve(lengths, 2048, [], [5, 1])
    assert sorted(x for b in best for x in b) == sorted(lengths) and len(best) < 1880


def test_underfull_sequences_of_all_groups_meet(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_PIECES", 100)
    rows = [(i, 1 + i * 7919 % 97) for i in range(3000)]
    packed = packing.pack(spark.createDataFrame(rows, "doc_id long, length long"), 1000).collect()
    assert sorted((r["doc_id"], r["length"]) for r in packed) == rows
    ends = {}
    for r in sorted(packed, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 1000 and len(ends) == -(-sum(n for _, n in rows) // 1000)


def test_bad_lengths_fail(spark):
    with pytest.raises(Exception, match="needs 1 to 8 tokens"):
        packing.pack(spark.createDataFrame([(1, 9)], "doc_id long, length long"), 8).agg(F.sum("offset")).collect()


def test_single_spaces_need_no_lookahead():
    bpe = tokens.byte_bpe(tokens.vocabulary_path("byte_bpe_50k.tiktoken"))
    rng = np.random.default_rng(11)
    letters = ["a", "Zug", "9", "!", "'s", " ", "\n", "\t", " ", "\u0085", " ", "\x1c", "\x1f", "​", "é", "日本", "<|endoftext|>"]
    for _ in range(3000):
        text = "".join(letters[i] for i in rng.integers(0, len(letters), rng.integers(1, 12)))
        assert bpe.ids(text).tolist() == bpe.general.encode_to_numpy(text, allowed_special="all").tolist()
