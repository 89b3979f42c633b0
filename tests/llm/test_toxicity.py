import zlib

import pytest

from waferlog.llm import queries, toxicity

DATA = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def scored(spark):
    return queries.op11_toxicity(spark, DATA).collect()


def test_held_out_documents(spark, scored):
    told = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    assert len(scored) == spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in scored)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in scored)
    held = [(r["score"], told[r["doc_id"]]) for r in scored if r["held_out"] and r["doc_id"] in told]
    toxic, clean = [s for s, y in held if y], [s for s, y in held if not y]
    above = sum((a > b) + 0.5 * (a == b) for a in toxic for b in clean) / len(toxic) / len(clean)
    # About one toxic label in eight is on a text without any of the words that the others share.
    assert above > 0.95
    assert sum(s >= 0.5 for s in toxic) / len(toxic) > 0.8 and sum(s >= 0.5 for s in clean) / len(clean) < 0.02
    # Calibrated: among held-out documents the mean score is near the share of toxic ones.
    assert abs(sum(s for s, _ in held) / len(held) - len(toxic) / len(held)) < 0.03


def documents(spark, n=800):
    """Every fourth document insults; words vary so that only the insult tells."""
    insults = ["moronface", "dirtbagger", "scumlord"]
    rows = []
    for i in range(n):
        words = [f"{'abcdefgh'[i * k % 8]}word{'xyzuvw'[(i + k) % 6]}" for k in range(20)]
        if i % 4 == 0:
            words[5:5] = ["you", insults[i % 3], insults[(i // 4) % 3]]
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_disguised_words_and_blind_scores(spark):
    docs = documents(spark)
    model = toxicity.fit_toxicity(docs, docs)
    assert {"moronface", "dirtbagger", "scumlord"} <= set(model.lexicon.weights) and model.curve is not None
    texts = ["you moronface and you dirtbagger here now", "you m0r0nf@ce and you d1rtbagger here now", "you SCUMLORD!! and moronfaaace here now", "you are a kind friend here and now"]
    got = {r["text"]: r for r in toxicity.score_toxicity(spark.createDataFrame([(t, 1, "x") for t in texts], "text string, toxic int, lang string"), model).collect()}
    assert [got[t]["predicted"] for t in texts] == [1, 1, 1, 0]
    blind = toxicity.score_toxicity(docs.select("text"), model).select("score").collect()
    assert sorted(blind) == sorted(toxicity.score_toxicity(docs, model).select("score").collect())


def test_features():
    words = toxicity.Lexicon({"moronface": 3.0, "annoying": 1.0})
    named = lambda t: dict(zip(toxicity.FEATURES, words.features(t)))
    got = named("You MORONFACE! so annoying, m-o-r-o-n-f-a-c-e moronf4ce")
    assert got["strong_density"] == 100 * 3 / 6 and got["mild_density"] == pytest.approx(100 / 6)
    assert got["proximity"] > 0.6 and got["obfuscated_strong"] == pytest.approx(100 * 2 / 6) and got["second_person_density"] == pytest.approx(100 / 6)
    assert named("moronface " + "x " * 20 + "you")["proximity"] == 0
    assert named("m o r o n f a c e")["strong_density"] > 0
    assert named("LOUD words")["shouted_words"] == 50 and named("a!!")["exclamations"] == pytest.approx(200 / 3)
    assert words.features(None) == words.features(" \n") == [0.0] * len(toxicity.FEATURES)


def test_same_rows_same_model(spark):
    docs = documents(spark, 400)
    one, two = (toxicity.fit_toxicity(d, d) for d in (docs.repartition(1), docs.repartition(7)))
    assert one.lexicon.weights == two.lexicon.weights and one.trees.toDebugString.split("\n")[1:] == two.trees.toDebugString.split("\n")[1:]


def test_edges(spark, edge_docs, no_docs):
    docs = documents(spark)
    model = toxicity.fit_toxicity(docs, docs)
    got = toxicity.score_toxicity(edge_docs, model)
    assert got.columns.count("score") == 1 and got.count() == edge_docs.count() and got.where("score is null or score < 0 or score > 1").count() == 0
    assert len({r["score"] for r in got.where("text is null or trim(text) = ''").collect()}) == 1
    assert toxicity.score_toxicity(no_docs, model).count() == 0
    nothing = spark.createDataFrame([], "doc_id long, toxic int")
    for labels, share in [(nothing, 0.0), (spark.createDataFrame([(1, 1), (2, None), (None, 0), (3, 7)], "doc_id long, toxic int"), 1.0)]:
        constant = toxicity.fit_toxicity(edge_docs, labels)
        assert constant.trees is None and {r["score"] for r in toxicity.score_toxicity(edge_docs, constant).collect()} == {share}
    both = spark.createDataFrame([(1, 0), (1, 1), (1, 1)], "doc_id long, toxic int")
    assert toxicity.fit_toxicity(edge_docs.union(edge_docs), both).share == 1.0
