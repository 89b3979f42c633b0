"""SimHash fingerprints, and near copies among them by pivot distance tables."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..staging import stage
from .common import ROW, packed, unpacked
from .neighbours import BLOCK, blocks, components, forest, long_groups, short_pairs, whole_groups

SHINGLE_WORDS = 4
HASH_SEED = 42
MAX_BITS = 4
BITS = 64
#: Reference fingerprints over all bits, whose distance tables discard pairs.
PIVOTS = 24
#: Reference fingerprints per set of bit blocks, whose distances form a key; ten distances of six bits fill a long.
KEY_PIVOTS = 10
#: Fingerprints that a key should hold on average when they spread evenly.
KEY_ROWS = 16
#: Shingles whose bits are counted at once.
COUNTED = 1 << 16

OUTPUTS = ["fingerprint", "component_id", "kept"]


def fingerprint(text: str | None) -> int:
    """64 bits of a whole text: a bit is set if more than half the shingle hashes have it. No words: 0."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE_WORDS:
        return xxhash.xxh64_intdigest(b" ".join(words), HASH_SEED)
    joined, digest = b" ".join(words), xxhash.xxh64_digest
    ends = np.cumsum(np.fromiter(map(len, words), "int64", len(words))) + np.arange(len(words))
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(starts[: len(words) - SHINGLE_WORDS + 1].tolist(), ends[SHINGLE_WORDS - 1 :].tolist())
    hashes = np.frombuffer(b"".join([digest(joined[a:b], HASH_SEED) for a, b in spans]), dtype="uint8").reshape(-1, 8)
    counts = sum(np.unpackbits(hashes[i : i + COUNTED], axis=1).sum(axis=0, dtype="int64") for i in range(0, len(hashes), COUNTED))
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Carried columns in one struct, and `fp`, the fingerprint as a signed long."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t) for t in texts], dtype="uint64").view("int64"))

    return docs.select(packed(docs, carry), F.pandas_udf(run, "long")(F.col(f"`{text}`")).alias("fp"))


def references(n: int, seed: int) -> list[int]:
    return [int(x) for x in np.random.default_rng(seed).integers(-(2**63), 2**63, n, dtype="int64")]


def block_sets(n_fingerprints: int, max_bits: int = MAX_BITS) -> list[int]:
    """Masks over the 64 bits: two fingerprints within `max_bits` agree in all bits of one mask at least.

    The bits are cut into blocks, of which `max_bits` at most can differ; a mask is a choice of all but `max_bits` of them. More blocks
    give longer and more masks: as many as keep an evenly used key at `KEY_ROWS` fingerprints, but 15 masks of 21 bits at least.
    """
    for extra in range(2, 6):
        n_blocks = max_bits + extra
        cuts = [BITS * i // n_blocks for i in range(n_blocks + 1)]
        parts = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
        masks = [sum(chosen) for chosen in combinations(parts, extra)]
        if n_fingerprints <= KEY_ROWS << (BITS * extra // n_blocks):
            break
    assert len(masks) == comb(n_blocks, extra)
    return masks


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def table_key(fp: Column, mask: Column, refs: list[int]) -> Column:
    """The distances to the references within the mask, six bits each; equal for fingerprints that agree in the mask."""
    key = F.lit(0).cast("long")
    for ref in refs:
        near = F.bit_count(fp.bitwiseXOR(F.lit(ref)).bitwiseAND(mask)).cast("long")
        key = F.shiftleft(key, 6).bitwiseOR(near)
    return key


def near_pairs(fps: np.ndarray, pivots: np.ndarray, starts: np.ndarray, chunk: np.ndarray, i: np.ndarray, j: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of rows of the same block that are within `max_bits`. A block of one chunk compares all its rows, one of two its chunks."""
    fps = fps.view("uint64")
    tables = np.bitwise_count(fps[:, None] ^ pivots.view("uint64")[None, :]).astype("int8")
    left, right = [], []

    def verify(a: np.ndarray, b: np.ndarray) -> None:
        for t in range(tables.shape[1]):
            if not len(a):
                return
            stay = np.abs(tables[a, t] - tables[b, t]) <= max_bits
            a, b = a[stay], b[stay]
        close = np.bitwise_count(fps[a] ^ fps[b]) <= max_bits
        left.append(a[close])
        right.append(b[close])

    for a, b in short_pairs(starts, chunk, i, j):
        verify(a, b)
    for one, two in long_groups(starts, chunk, i, j):
        stay = np.triu(np.ones((len(one), len(one)), dtype=bool), 1) if two is None else np.ones((len(one), len(two)), dtype=bool)
        two = one if two is None else two
        for t in range(4):
            stay &= np.abs(tables[one, t][:, None] - tables[two, t][None, :]) <= max_bits
        a, b = np.nonzero(stay)
        verify(one[a], two[b])
    none = np.zeros(0, dtype="int64")
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def near_links(distinct: DataFrame, n_fingerprints: int, max_bits: int = MAX_BITS) -> DataFrame:
    """Links (`u`, `v`) that join all fingerprints (`fp`, distinct) that near ones can reach; a spanning forest per block.

    For every mask, fingerprints meet by their distances to reference fingerprints within the mask, so no near pair is missed; there the
    tables of distances to `PIVOTS` references discard pairs that differ by more than `max_bits` in any coordinate, as two
    fingerprints within `max_bits` can't, and the rest are verified bit by bit.
    """
    pivots = np.array(references(PIVOTS, 11), dtype="int64")
    refs = references(KEY_PIVOTS, 7)
    masks = F.array(*[F.lit(_signed(m)) for m in block_sets(n_fingerprints, max_bits)])
    spread = distinct.select("fp", F.explode(masks).alias("t"))
    met = blocks(spread.withColumn("k", table_key(F.col("fp"), F.col("t"), refs)), ["t", "k"], "fp")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, starts in whole_groups(batches):
            fps = rows["fp"].to_numpy()
            a, b = near_pairs(fps, pivots, starts, rows["__c"].to_numpy(), rows["__i"].to_numpy(), rows["__j"].to_numpy(), max_bits)
            if len(a):
                u, v = forest(fps[a], fps[b])
                yield pd.DataFrame({"u": u, "v": v})

    return met.select("fp", "__c", *BLOCK).mapInPandas(run, "u long, v long")


def simhash_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS, carry: list[str] | None = None) -> DataFrame:
    """Adds `fingerprint` (16 hex digits), `component_id`, the smallest key in the row's group of near copies, and `kept`, true for one row
    of each group: the first with that key.

    Rows are in a group if fingerprints within `max_bits` bits lead from one to the other. Equal fingerprints are searched once, however
    many rows have them; texts without words, null ones too, have fingerprint zero and link like any other. Rows with a null key are
    grouped like others and sort last; a group of null keys only has a null component_id. Rows may be repeated. An empty table gives no rows.
    """
    rows = docs.select(F.col(f"`{key}`").alias("k"), packed(docs, carry), F.col(f"`{text}`").alias("__text"))
    found = fingerprints(rows, "__text", ["k", ROW]).select(f"{ROW}.k", F.col(f"{ROW}.{ROW}").alias(ROW), "fp")
    found = stage(found.withColumn("u", F.monotonically_increasing_id()), "fingerprints")
    distinct = stage(found.groupBy("fp").agg(F.min(F.struct(F.isnull("k").alias("none"), "k", "u")).alias("first")), "distinct")
    links = near_links(distinct, distinct.count(), max_bits)
    roots = components(links)
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    firsts = rooted.groupBy("root").agg(F.min("first").alias("least"))
    classes = stage(rooted.join(firsts, "root").select("fp", F.col("least.k").alias("component_id"), F.col("least.u").alias("least")), "classes")
    return unpacked(found.join(classes, "fp").select(
        ROW, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", (F.col("u") == F.col("least")).alias("kept")), OUTPUTS)
