import zlib

from waferlog.llm import language, queries

DATA = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    rows = queries.op7_language_id(spark, DATA).collect()
    told = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang").collect()}
    assert len(rows) == len(told)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == told[r["doc_id"]] for r in held) / len(held) > 0.99
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert sum(r["rejected"] for r in held) / len(held) < 0.01


def test_prediction_sees_the_text_only(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language.fit_languages(docs)
    text = [r["text"] for r in docs.collect()]
    blind = spark.createDataFrame([(t, None, "none") for t in text], "text string, lang string, source string")
    key = ["text", "lang_pred", "score"]
    assert sorted(language.identify(docs, model).select(key).collect()) == sorted(language.identify(blind, model).select(key).collect())


def test_dictionaries_are_bounded_and_whole_texts_count(spark):
    docs = spark.createDataFrame([(i, f"der die das und {i} " * 400, "de") for i in range(300)] + [(i + 300, "the and of to it " * 400, "en") for i in range(300)], "doc_id long, text string, lang string")
    model = language.fit_languages(docs)
    assert [x for x, _ in model.dictionaries] == ["de", "en"] and all(len(d) <= language.DICTIONARY_BYTES for _, d in model.dictionaries)
    compressors = model.compressors()
    assert language.classify("the and of " * 3 + "der die das und " * 2000, compressors)[0] == "de"


def test_edges(edge_docs, no_docs, spark):
    model = language.fit_languages(edge_docs)
    got = language.identify(edge_docs, model)
    assert got.columns.count("score") == 1 and got.count() == edge_docs.count()
    assert all(r["lang_pred"] == "und" and r["score"] == 0 and r["rejected"] for r in got.where("text is null or trim(text) = ''").collect())
    assert {r["lang_pred"] for r in got.collect()} <= {"en", "de", "und"}
    empty = language.fit_languages(no_docs)
    assert empty.dictionaries == [] and language.identify(no_docs, empty).count() == 0
    assert {r["lang_pred"] for r in language.identify(edge_docs, empty).collect()} == {"und"}
    assert language.classify("123 !!", model.compressors()) == ("und", 0.0)
