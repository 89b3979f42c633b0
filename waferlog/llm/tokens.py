"""Byte-level BPE ids of whole texts, and the exact histogram of encoded lengths."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..staging import stage

SPECIAL = "<|endoftext|>"
#: The split of the vocabulary's byte-level pre-tokenizer (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Its lookahead matters only where white space follows white space; without it a text is split in one linear scan.
LOOKAHEAD = r"|\s+(?!\S)"
_SPACES = re.compile(r"\s\s")


class ByteBpe:
    """The byte-level vocabulary, read from its file of ranks. The special token's string in a text is that token, as the vocabulary's own
    tokenizer has it by default."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.general, self.single = (
            tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={SPECIAL: len(ranks)})
            for pattern in (PATTERN, PATTERN.replace(LOOKAHEAD, "")))

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, dtype="uint32")
        return (self.general if _SPACES.search(text) else self.single).encode_to_numpy(text, allowed_special="all")


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    """One per worker process."""
    return ByteBpe(path)


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_lengths(docs: DataFrame, text: str = "text", vocabulary: str = "byte_bpe_50k.tiktoken", end_ids: int = 0) -> DataFrame:
    """One column `n_tokens`, a row per document: its ids and `end_ids` more. A null or empty text has no ids of its own."""

    def lengths(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = byte_bpe(vocabulary_path(vocabulary))
        for texts in batches:
            yield pd.Series([len(bpe.ids(t)) + end_ids for t in texts], dtype="int64")

    return docs.select(F.pandas_udf(lengths, "long")(F.col(f"`{text}`")).alias("n_tokens"))


def length_histogram(lengths: DataFrame, length: str = "n_tokens", block: int = 1024) -> DataFrame:
    """A row per distinct length, with the sums that answer every context limit L exactly.

    `n_docs` have this length; `docs_to`, `tokens_to` count documents and tokens up to it; `docs_over`, `tokens_over` those longer.
    `truncated_tokens` is what a limit of L = this length keeps (documents cut at L); `share_to` is the quantile the length reaches.
    Documents meet as counts per length. The lengths' own running sums are made in blocks of `block` lengths, and only block sums
    meet in one task. Null lengths are left out; an empty table gives no rows.
    """
    counts = lengths.where(F.col(length).isNotNull()).groupBy(F.col(length).alias("n_tokens")).agg(F.count("*").alias("n_docs"))
    # Block sums and rows both read the counts; written once, they cost one encoding.
    counts = stage(counts, "lengths")
    counts = counts.withColumn("__b", F.floor(F.col("n_tokens") / block)).withColumn("__t", F.col("n_tokens") * F.col("n_docs"))
    every = Window.partitionBy(F.lit(0))
    earlier = every.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = counts.groupBy("__b").agg(F.sum("n_docs").alias("__d"), F.sum("__t").alias("__bt")).select(
        "__b",
        F.coalesce(F.sum("__d").over(earlier), F.lit(0)).alias("__d0"), F.coalesce(F.sum("__bt").over(earlier), F.lit(0)).alias("__t0"),
        F.sum("__d").over(every).alias("__docs"), F.sum("__bt").over(every).alias("__tokens"),
    )
    running = Window.partitionBy("__b").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    summed = counts.join(blocks, "__b").select(
        "n_tokens", "n_docs", "__docs", "__tokens",
        (F.col("__d0") + F.sum("n_docs").over(running)).alias("docs_to"), (F.col("__t0") + F.sum("__t").over(running)).alias("tokens_to"),
    )
    over = F.col("__docs") - F.col("docs_to")
    return summed.select(
        "n_tokens", "n_docs", "docs_to", "tokens_to", over.alias("docs_over"), (F.col("__tokens") - F.col("tokens_to")).alias("tokens_over"),
        (F.col("tokens_to") + over * F.col("n_tokens")).alias("truncated_tokens"), (F.col("docs_to") / F.col("__docs")).alias("share_to"),
    )


def answer_limits(histogram: DataFrame, limits: DataFrame, limit: str = "context") -> DataFrame:
    """For a small table of limits: documents and tokens that fit whole, and tokens kept when longer documents are cut."""
    asked = limits.select(F.col(f"`{limit}`").cast("long").alias("context")).distinct()
    steps = histogram.select(F.col("n_tokens").alias("context"), "docs_to", "tokens_to", "docs_over", F.lit(False).alias("__asked"))
    nothing = histogram.agg(F.sum("n_docs").alias("docs_over")).select(
        F.lit(-1).cast("long").alias("context"), F.lit(0).cast("long").alias("docs_to"), F.lit(0).cast("long").alias("tokens_to"),
        F.coalesce("docs_over", F.lit(0)).alias("docs_over"), F.lit(False).alias("__asked"))
    blank = asked.select("context", *[F.lit(None).cast("long").alias(c) for c in ("docs_to", "tokens_to", "docs_over")], F.lit(True).alias("__asked"))
    last = Window.partitionBy(F.lit(0)).orderBy("context", "__asked").rowsBetween(Window.unboundedPreceding, 0)
    carried = steps.unionByName(nothing).unionByName(blank).select(
        "context", "__asked", *[F.last(c, ignorenulls=True).over(last).alias(c) for c in ("docs_to", "tokens_to", "docs_over")])
    return carried.where("__asked").select(
        "context", F.col("docs_to").alias("docs_whole"), F.col("tokens_to").alias("tokens_whole"),
        (F.col("tokens_to") + F.col("docs_over") * F.greatest("context", F.lit(0))).alias("truncated_tokens"))


def quantile_length(histogram: DataFrame, shares: Sequence[float]) -> DataFrame:
    """The smallest length that at least this share of the documents reach; one aggregation over the histogram."""
    wanted: list[Column] = [F.min(F.when(F.col("share_to") >= q, F.col("n_tokens"))).alias(f"q{q:g}") for q in shares]
    return histogram.agg(*wanted)
