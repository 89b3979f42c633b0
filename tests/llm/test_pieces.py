import hashlib

import numpy as np
import pytest
import sentencepiece

from waferlog.llm import pieces
from waferlog.llm.tokens import vocabulary_path

PATH = vocabulary_path("piece_bpe_32k.model")
TEXTS = ["", " ", "   ", "a  b", " a ", "▁a▁▁b ▁", "日本語 🎉🎉 x", "a\nb\t c\n\n", "\0", "<s> </s> <unk> <0x41>", "x" * 900, "ab " * 90 + "y" * 700, "ﬁ Ａ é é", "ааа ббб" * 40, "﻿x", "𝔘nicode"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_like_the_library(spark, library):
    model = pieces.piece_model(PATH)
    texts = TEXTS + [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(150).collect()]
    for text in texts:
        ids, edges = model.encode(text)
        assert ids.tolist() == library.encode(text)
        assert model.decode([1, *ids.tolist(), 2]) == library.decode([1, *ids.tolist(), 2])
        if len(text) < 3000:
            raw = text.encode()
            assert [raw[a:b] for a, b in zip(edges, edges[1:])] == [p.surface.encode() for p in library.encode(text, return_type="proto").pieces]


def test_heap_and_scan_agree(monkeypatch):
    model = pieces.PieceModel(PATH)
    words = ["▁" + "thingereonthation" * n for n in (1, 3, 9)] + ["▁" + "aab" * 50, "▁" * 40]
    scanned = [model.merged(w) for w in words]
    monkeypatch.setattr(pieces, "SCANNED", 0)
    assert [model.merged(w) for w in words] == scanned


def test_words_merged_together_and_one_by_one(spark, monkeypatch):
    model = pieces.PieceModel(PATH)
    words = {u for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect() for u in model.units(model.normalise(r["text"])[0])}
    words |= {u for t in TEXTS for u in model.units(model.normalise(t)[0])}
    model.learn(words)
    assert all(model.memory[w] == model.unit_ids(w) for w in words if len(w) <= pieces.LONGEST_REMEMBERED)
    monkeypatch.setattr(pieces, "REMEMBERED", 5)
    monkeypatch.setattr(pieces, "TOGETHER", 2)
    few = pieces.PieceModel(PATH)
    assert [ids.tolist() for ids, _ in few.encode_many([*TEXTS, None, *TEXTS])] == [model.encode(t)[0].tolist() for t in [*TEXTS, None, *TEXTS]]


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf"])
def test_compiled_character_maps(rule):
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    proto = library.serialized_model_proto()
    rules = next(dict(pieces._fields(v)) for n, v in pieces._fields(proto) if n == 3)
    model = pieces.PieceModel.__new__(pieces.PieceModel)
    model.read_rules({**rules, 3: 0, 4: 0, 5: 0})
    assert model.map.units
    for text in ["ﬁne Ａ①", "é é ㌔", "ｶﾞ x  y", " a  ", "ÀÉ½", "", "日本"]:
        norm, starts = model.normalise(text)
        plain = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=False, escape_whitespaces=False, remove_extra_whitespaces=False)
        assert norm == plain.normalize(text)
        assert len(starts) == len(norm.encode()) + 1 and (np.diff(starts) >= 0).all() and starts[-1] == len(text.encode())


def test_query_digests(spark, library, edge_docs, no_docs):
    got = pieces.encode_documents(edge_docs, digest=True, carry=["text"]).collect()
    assert len(got) == edge_docs.count()
    for r in got:
        ids = library.encode(r["text"] or "", add_bos=True, add_eos=True)
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
        assert r["spanned_bytes"] == len((r["text"] or "").encode())
    assert pieces.encode_documents(no_docs).count() == 0


def test_ids_spans_and_round_trip(spark):
    df = spark.createDataFrame([(1, "Grüße an alle 🎉"), (2, None)], "doc_id long, text string")
    encoded = pieces.encode_documents(df)
    back = pieces.decode_documents(encoded, carry=["doc_id"])
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {1: "Grüße an alle 🎉", 2: ""}
    r = encoded.where("doc_id = 1").first()
    raw = r["text"].encode()
    assert b"".join(raw[a:b] for a, b in zip(r["begins"], r["ends"])) == raw and len(r["ids"]) == len(r["begins"]) == len(r["ends"])
    assert pieces.decode_documents(spark.createDataFrame([(None,)], "ids array<int>")).first()[0] is None
