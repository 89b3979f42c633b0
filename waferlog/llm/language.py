"""Language identification by compression against per-language dictionaries."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import ROW, hash60, packed, unpacked

UNKNOWN = "und"
#: A dictionary's size, and the most bytes that one document adds to it: the bounds of the labelled sample.
DICTIONARY_BYTES = 110_000
EXCERPT_CHARS = 1024
#: Whole texts are compressed in pieces of this size, so that the dictionary, not the text's own start, explains each of them.
PIECE_BYTES = 4096
#: Share by which the best language's encoding must be smaller than the next one's.
LEAST_MARGIN = 0.02

OUTPUTS = ["lang_pred", "score", "rejected"]
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str | None) -> bytes:
    """The lower-cased words of letters, in spaces; what remains when symbols, digits and shouting are set aside."""
    words = _NOT_LETTERS.sub(" ", (text or "").lower()).strip()
    return f" {words} ".encode() if words else b""


def held_out(key: Column) -> Column:
    """True for one key in five: CRC-32 of the key's text, modulo 5, is 0. A null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % 5 == 0


@dataclass
class LanguageModel:
    """Raw-content dictionaries, most frequent language first, which also settles ties."""

    dictionaries: list[tuple[str, bytes]]

    def compressors(self):
        import zstandard

        found = []
        for lang, content in self.dictionaries:
            kind = zstandard.ZstdCompressionParameters(
                window_log=17, hash_log=16, chain_log=16, search_log=3, min_match=4, strategy=zstandard.STRATEGY_LAZY,
                write_content_size=False, write_checksum=False, write_dict_id=False)
            words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            words.precompute_compress(compression_params=kind)
            found.append((lang, zstandard.ZstdCompressor(dict_data=words, compression_params=kind)))
        return found


def classify(text: str | None, compressors) -> tuple[str, float]:
    """The language whose dictionary encodes the whole text in the fewest bytes, and its margin 1 - best / next."""
    data = letters(text)
    if not data or not compressors:
        return UNKNOWN, 0.0
    parts = [data[i : i + PIECE_BYTES] for i in range(0, len(data), PIECE_BYTES)]
    sizes = sorted((sum(len(c.compress(p)) for p in parts), i) for i, (_, c) in enumerate(compressors))
    margin = 1 - sizes[0][0] / sizes[1][0] if len(sizes) > 1 else 1.0
    return compressors[sizes[0][1]][0], margin


def fit_languages(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", seed: str = "lang-1") -> LanguageModel:
    """Dictionaries from a bounded sample of labelled rows, the same rows at every layout of the table.

    Per language, rows come in the order of a seeded hash of their key, each with an excerpt of `EXCERPT_CHARS`, until
    `DICTIONARY_BYTES` are full. Only that sample reaches the driver: a first pass counts the languages, and a cut on the hash then passes
    about twice the rows that a dictionary takes. Rows with a null language or no letters teach nothing; no rows give an empty model.
    """
    rows = labelled.where(F.col(lang).isNotNull()).select(
        F.col(lang).cast("string").alias("lang"), F.substring(F.col(text), 1, EXCERPT_CHARS).alias("text"),
        hash60(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))).alias("h"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    order = sorted(counts, key=lambda x: (-counts[x], x))
    if not order:
        return LanguageModel([])
    wanted = 4 * DICTIONARY_BYTES // EXCERPT_CHARS
    cuts = F.create_map(*[x for name in order for x in (F.lit(name), F.lit(int(min(1.0, wanted / counts[name]) * 2**60)))])
    sample = sorted(rows.where(F.col("h") <= F.element_at(cuts, F.col("lang"))).collect(), key=lambda r: (r["lang"], r["h"], r["text"] or ""))
    content: dict[str, bytes] = {}
    for r in sample:
        have = content.get(r["lang"], b"")
        if len(have) < DICTIONARY_BYTES:
            content[r["lang"]] = have + letters(r["text"])
    return LanguageModel([(name, content[name][:DICTIONARY_BYTES]) for name in order if content.get(name)])


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", least_margin: float = LEAST_MARGIN, carry: list[str] | None = None) -> DataFrame:
    """Adds `lang_pred`, `score` (the margin, 0 to 1) and `rejected` (unknown, or a margin below `least_margin`).

    A null text, or one without letters, is `und` with score 0. Texts of any length are encoded whole, piece by piece. Equally small
    encodings go to the language with more training rows, with margin 0. An empty model calls every text `und`.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        compressors = shared.value.compressors()
        for texts in batches:
            yield pd.DataFrame([classify(t, compressors) for t in texts], columns=["lang_pred", "score"])

    found = docs.select(packed(docs, carry), F.pandas_udf(predict, "lang_pred string, score double")(F.col(f"`{text}`")).alias("__f"))
    narrow = (F.col("lang_pred") == UNKNOWN) | (F.col("score") < least_margin)
    return unpacked(found.select(ROW, "__f.*").withColumn("rejected", narrow), OUTPUTS)
