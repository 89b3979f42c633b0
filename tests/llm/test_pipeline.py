"""The pipeline against a plain run over the same documents, stage by stage."""

import pytest
from pyspark.sql import functions as F

import brute
import corpus_pipeline
from test_linededup import expected as line_dedup
from waferlog.llm import language, quality
from waferlog.llm.tokens import byte_bpe, vocabulary_path

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    found = [("documents", docs)]
    for name, apply in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        apply(spark, found[-1][1], DATA).write.parquet(path)
        found.append((name, spark.read.parquet(path)))
    return found


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_stages(spark, steps):
    frames = dict(steps)
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert frames[name].columns == frames["documents"].columns
    docs = {r["doc_id"]: r for r in frames["documents"].collect()}
    model = language.fit_languages(frames["documents"].where(~language.held_out(F.col("doc_id"))))
    compressors = model.compressors()
    clear = {k for k, r in docs.items() if (p := language.classify(r["text"], compressors))[0] != "und" and p[1] >= language.LEAST_MARGIN}
    assert set(texts(frames["language_id"])) == clear

    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    judged = quality.apply_rules(frames["language_id"], labels).collect()
    good = {r["doc_id"]: r["text"] for r in judged if r["kept"]}
    assert texts(frames["quality_rules"]) == good
    assert all((m := quality.measure(t))[0] >= 10 and 100 * m[4] <= 20 * m[0] for t in good.values())

    cleaned = {k: t for k, (t, n, gone) in line_dedup(good.items()).items() if gone == 0 or gone < n}
    assert texts(frames["line_dedup"]) == cleaned
    assert frames["line_dedup"].where("n_chars <> char_length(text)").count() == 0

    groups = brute.simhash_groups(sorted(cleaned.items()))
    single = {k: cleaned[k] for k, (_, first) in groups.items() if k == first}
    assert texts(frames["simhash_dedup"]) == single

    bpe = byte_bpe(vocabulary_path("byte_bpe_50k.tiktoken"))
    lengths = {k: len(bpe.ids(t)) + 1 for k, t in single.items()}
    packed = frames["best_fit_packing"].collect()
    total = {}
    for r in packed:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
    assert total == lengths
    sequences = len({r["sequence_id"] for r in packed})
    assert sequences <= 1.01 * -(-sum(lengths.values()) // 2048) + 1


def test_run_gives_the_last_stage(spark, steps):
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(corpus_pipeline.run(spark, DATA).select(key).collect()) == sorted(steps[-1][1].select(key).collect())


def test_edges(spark, edge_docs, no_docs, tmp_path):
    for docs in (edge_docs, no_docs):
        for name, apply in corpus_pipeline.STAGES:
            out = apply(spark, docs, DATA)
            if name != "best_fit_packing":
                assert out.columns == docs.columns
            assert out.count() <= max(1, docs.count()) * 1000
