"""The corpus pipeline: language, quality, repeated passages, near copies, packing; each stage calls one operator of `waferlog.llm`.

Every stage works on all that the one before kept. The first four return the columns of their input, the last the packed pieces. A
document travels as one struct beside the columns an operator reads, so its own columns can't clash with an operator's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from waferlog.llm import language, linededup, packing, quality, simhash
from waferlog.llm.common import table
from waferlog.staging import stage

CAPACITY = 2048


def _whole(docs: DataFrame, *read: str) -> DataFrame:
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), *read)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known and clear go on; the dictionaries are learnt from documents that aren't held out."""
    model = language.fit_languages(docs.where(~language.held_out(F.col("doc_id"))))
    return language.identify(_whole(docs, "text"), model, carry=["doc"]).where(~F.col("rejected")).select("doc.*")


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base checks and the certified cutoffs of their language go on."""
    labels = table(spark, sf_dir, "labels")
    return quality.apply_rules(_whole(docs, "doc_id", "text", "lang"), labels, carry=["doc"]).where("kept").select("doc.*")


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose their repeated passages, and `n_chars` follows; a document that loses all its lines goes."""
    cleaned = linededup.dedup_lines(_whole(docs, "doc_id", "text"), carry=["doc"])
    left = cleaned.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    renewed = {"text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return left.select(*[renewed.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id goes on."""
    return simhash.simhash_groups(_whole(docs, "doc_id", "text"), carry=["doc"]).where("kept").select("doc.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all that is left, in sequences of `CAPACITY` tokens at most."""
    return packing.pack(packing.pieces(docs, CAPACITY, carry=["doc_id"]), CAPACITY)


STAGES = [
    ("language_id", identify_language),
    ("quality_rules", apply_quality_rules),
    ("line_dedup", remove_repeated_lines),
    ("simhash_dedup", drop_near_copies),
    ("best_fit_packing", pack_sequences),
]

#: SQL has no dictionary compression; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (name, apply) in enumerate(STAGES, 1):
        found = apply(spark, docs, sf_dir)
        docs = stage(found, name) if number < len(STAGES) else found
    return docs
