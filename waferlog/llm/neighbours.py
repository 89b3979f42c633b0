"""What the pair searches share: bounded blocks of rows that meet by a key, and connected components."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..staging import stage

#: Most rows on average on one side of a block; a key with more rows is cut into chunks, and every two chunks meet in a block.
CHUNK_ROWS = 1024
BLOCK = ["__key", "__i", "__j"]
#: Groups up to this length are compared many at a time.
SHORT_RUN = 24


def blocks(rows: DataFrame, keys: Sequence[str], node: str, chunk: int = CHUNK_ROWS) -> DataFrame:
    """Rows that share the keys with others, dealt into blocks sorted by (`__key`, `__i`, `__j`), with the row's own chunk in `__c`.

    A key of n rows has ceil(n / chunk) chunks by the hash of `node`; chunk c goes to the blocks of c with each chunk, so every two rows
    of a key meet in exactly one block (twice at the most as chunk pairs are unordered), however many rows the key has.
    """
    keyed = rows.withColumn("__key", F.xxhash64(*keys))
    sizes = stage(keyed.groupBy("__key").agg(F.count("*").alias("__n")).where("__n > 1"), "keys")
    n_chunks = F.ceil(F.col("__n") / chunk).cast("int")
    chunked = keyed.join(sizes, "__key").withColumn("__m", n_chunks).withColumn("__c", F.pmod(F.xxhash64(F.col(node), F.lit("chunk")), F.col("__m")).cast("int"))
    met = chunked.withColumn("__o", F.explode(F.sequence(F.lit(0), F.col("__m") - 1)))
    paired = met.select("*", F.least("__c", "__o").alias("__i"), F.greatest("__c", "__o").alias("__j")).drop("__n", "__m", "__o")
    return paired.repartition(*BLOCK).sortWithinPartitions(*BLOCK)


def whole_groups(batches: Iterator[pd.DataFrame], keys: Sequence[str] = tuple(BLOCK)) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Sorted batches cut anew so that no group is split; with the edges of the groups."""
    rest: list[pd.DataFrame] = []
    for batch in batches:
        rest.append(batch)
        values = [batch[k].to_numpy() for k in keys]
        last = np.flatnonzero(np.logical_or.reduce([v[1:] != v[:-1] for v in values])) if len(batch) > 1 else np.zeros(0, int)
        if len(rest) > 1:
            before = rest[-2].iloc[-1]
            if any(before[k] != v[0] for k, v in zip(keys, values)):
                last = np.append(-1, last)
        if len(last):
            cut = last[-1] + 1
            done = pd.concat([*rest[:-1], batch.iloc[:cut]], ignore_index=True)
            rest = [batch.iloc[cut:]]
            if len(done):
                yield done, edges(done, keys)
    if rest:
        done = pd.concat(rest, ignore_index=True)
        if len(done):
            yield done, edges(done, keys)


def edges(rows: pd.DataFrame, keys: Sequence[str]) -> np.ndarray:
    values = [rows[k].to_numpy() for k in keys]
    change = np.flatnonzero(np.logical_or.reduce([v[1:] != v[:-1] for v in values])) + 1 if len(rows) > 1 else np.zeros(0, int)
    return np.concatenate([[0], change, [len(rows)]])


def short_pairs(starts: np.ndarray, own: np.ndarray, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places in the groups of at most `SHORT_RUN` rows, all groups at once, by the distance of the places. In a block of two
    chunks only rows of different chunks meet."""
    lengths = np.diff(starts)
    group = np.repeat(np.arange(len(lengths)), lengths)
    places = np.flatnonzero(np.repeat(lengths <= SHORT_RUN, lengths))
    for shift in range(1, SHORT_RUN):
        a, b = places[: max(0, len(places) - shift)], places[shift:]
        same = group[a] == group[b]
        if not same.any():
            return
        a, b = a[same], b[same]
        met = (i[a] == j[a]) | (own[a] != own[b])
        yield a[met], b[met]


def long_groups(starts: np.ndarray, own: np.ndarray, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """The places of the other groups: all rows of a block of one chunk and None, or those of its two chunks."""
    for start, stop in zip(starts, starts[1:]):
        if stop - start > SHORT_RUN:
            rows = np.arange(start, stop)
            if i[start] == j[start]:
                yield rows, None
            elif len(one := rows[own[rows] == i[start]]) and len(two := rows[own[rows] == j[start]]):
                yield one, two


def forest(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same values as all the given ones: each value with the smallest it can reach."""
    nodes, places = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = places[: len(left)], places[len(left) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            break
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(links: DataFrame) -> DataFrame:
    """(`u`, `v`) links to (`node`, `root`): the smallest value that each linked value can reach, itself included.

    Alternates large and small stars: every node's larger neighbours, then its smaller ones, are linked to the smallest node it
    sees, until nothing changes; the number of rounds grows with the logarithm of a component's size. Each round is written, so that lost
    executors cost one round. Minima are combined before the shuffle, and joins on a busy node are split.
    """
    current = stage(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    state = _state(current)
    while state[0]:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stage(large, "large-star")
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(below, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(below.select("u", F.col("m").alias("v")))
        current = stage(small.distinct(), "small-star")
        before, state = state, _state(current)
        if state == before:
            break
    return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
