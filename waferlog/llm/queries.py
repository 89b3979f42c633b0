"""The registered corpus queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import collocations, embeddings, html, language, linededup, packing, periods, pieces, quality, sharding, simhash, tokens, toxicity
from .common import table

N_SHARDS = 40
CAPACITY = 2048


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), carry=["doc_id"])
    return judged.withColumn("reasons", F.array_join("reasons", ","))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.extract_text(table(spark, sf_dir, "pages"), carry=["page_id", "url"])
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(
        "doc_id", "source",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16).alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
    )
    sharded = sharding.stratified_shards(rows, N_SHARDS, ties=("size", "text_crc32"), carry=("doc_id", "size", "text_crc32"))
    return sharded.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.embedding_groups(table(spark, sf_dir, "embeddings"), carry=["vec_id"])


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.length_histogram(tokens.token_lengths(table(spark, sf_dir, "documents")))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"), carry=["doc_id"]).select("doc_id", "fingerprint", "component_id")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit_languages(docs.where(~language.held_out(F.col("doc_id"))))
    rows = docs.select("doc_id", "text", language.held_out(F.col("doc_id")).alias("held_out"))
    return language.identify(rows, model, carry=["doc_id", "held_out"])


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = packing.pieces(table(spark, sf_dir, "documents"), CAPACITY, carry=["doc_id"])
    return packing.pack(parts, CAPACITY)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(table(spark, sf_dir, "documents"), digest=True, carry=["doc_id"])


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents"), carry=["doc_id"])


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit_toxicity(docs, labels.where(~language.held_out(F.col("doc_id"))))
    rows = docs.select("doc_id", "text", language.held_out(F.col("doc_id")).alias("held_out"))
    return toxicity.score_toxicity(rows, model, carry=["doc_id", "held_out"])


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """One document in ten (by CRC-32 of its id) repeats a few of its words to its end; a null id leaves the text as it is."""
    h = F.crc32(F.col("doc_id").cast("string"))
    chosen = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("ws"))
    sized = chosen.withColumn("n", F.greatest(F.size("ws"), F.lit(0)))
    cut = sized.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    tail = cut.withColumn("m", F.col("n") - F.col("a")).withColumn("p", (1 + F.floor(F.col("m") / (3 + F.col("g") % 8))).cast("int"))
    unit = F.slice("ws", F.col("a") + 1, F.col("p"))
    repeated = F.slice(F.flatten(F.array_repeat(unit, F.ceil(F.col("m") / F.col("p")).cast("int"))), F.lit(1), F.col("m"))
    folded = F.array_join(F.concat(F.slice("ws", F.lit(1), F.col("a")), repeated), " ")
    return tail.select("doc_id", F.when(F.col("n") > 0, folded).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periods.find_runs(with_planted_periods(table(spark, sf_dir, "documents")), carry=["doc_id"])
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("q"))))
    listed = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    best = found.withColumn("best", longest)
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.s")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.q")).alias("period"),
        F.expr("(1000 * best.length) div (-best.q)").alias("exponent_milli"),
        F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}
