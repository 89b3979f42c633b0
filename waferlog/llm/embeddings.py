"""Near copies among embeddings by counting collisions of one-dimensional projections."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, comb, erf, exp, log, pi, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from ..staging import stage
from .common import ROW, packed, unpacked
from .neighbours import BLOCK, blocks, components, edges, forest, long_groups, short_pairs, whole_groups

COSINE = 0.93
#: Projections whose collisions are counted, and in how many of them a near pair may miss the window.
PROJECTIONS = 48
MISSES = 5
#: Share of the pairs exactly at the cosine that the count must pass, and that must share a cell; closer pairs do more often.
RECALL = 0.9999
#: Width of a cell along a projection of unit vectors on a standard normal direction (deviation 1).
CELL_WIDTH = 2.5
#: Unrelated vectors that a cell should hold on average in the largest label.
CELL_ROWS = 128
#: Times the window's width within which the sorted projection holds every near pair; projections counted for whole ranges; queries at a time.
SURE = 2
WHOLE = 24
QUERIES = 256

OUTPUTS = ["n_links", "component_id", "kept"]


def window_width(cosine: float = COSINE, projections: int = PROJECTIONS, misses: int = MISSES, recall: float = RECALL) -> float:
    """The smallest half width of a window with which a pair of unit vectors at this cosine collides in all but `misses` projections,
    the sorted one aside, with the wanted probability. A projection on a standard normal direction differs by a normal number of deviation |x - y|."""
    deviation = sqrt(2 - 2 * cosine)
    width = 0.0
    while True:
        width += deviation / 100
        miss = 1 - erf(width / deviation / sqrt(2))
        if sum(comb(projections - 1, i) * miss**i * (1 - miss) ** (projections - 1 - i) for i in range(misses + 1)) >= recall:
            return width


def same_cell(cosine: float, width: float = CELL_WIDTH) -> float:
    """Probability that two unit vectors at this cosine share the cell of one projection, for a random offset of the cells."""
    distance = sqrt(2 - 2 * cosine)
    ratio = width / distance
    return erf(ratio / sqrt(2)) - sqrt(2 / pi) / ratio * (1 - exp(-ratio * ratio / 2))


def cell_tables(largest: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int]:
    """Projections per cell and number of tables: cells of unrelated vectors stay small however large a label is, and a pair at the cosine
    shares a cell in some table with the wanted probability."""
    depth = max(1, ceil(log(max(1.0, largest / CELL_ROWS)) / -log(same_cell(0.0))))
    return depth, ceil(log(1 - recall) / log(1 - same_cell(cosine) ** depth))


def directions(dimensions: int, number: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dimensions]).standard_normal((dimensions, number))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision, also where squares would overflow or vanish."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def cells_of(units: np.ndarray, depth: int, tables: int) -> np.ndarray:
    """A number per row and table: a mix of the cells that the table's projections, shifted by random offsets, fall into."""
    offsets = np.random.default_rng([6, units.shape[1]]).uniform(0, CELL_WIDTH, depth * tables)
    places = np.floor((units @ directions(units.shape[1], depth * tables, 4) + offsets) / CELL_WIDTH).astype("int64").view("uint64")
    mixed = np.full((len(units), tables), np.uint64(0x243F6A8885A308D3))
    for level in range(depth):
        mixed = (mixed ^ places[:, level::depth]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return mixed.view("int64")


class Counter:
    """Counts collisions of the rows of a batch: the columns of `table` are projections.

    A pair passes if it is within `SURE` windows in the first projection and within one window in all but `MISSES` of the others. Pairs
    that share an earlier table's cell (`cells`, of which row r has `earlier[r]`) have met before and are left out.
    """

    def __init__(self, table: np.ndarray, width: float, cells: np.ndarray, earlier: np.ndarray):
        self.columns, self.width, self.cells, self.earlier = np.ascontiguousarray(table.T), width, cells, earlier

    def passing(self, a: np.ndarray, b: np.ndarray, missed: np.ndarray | None = None, first: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """The given pairs that pass; `missed` says how often they missed before the projection `first`."""
        if missed is None:
            near = np.abs(self.columns[0][a] - self.columns[0][b]) <= SURE * self.width
            a, b = a[near], b[near]
            missed = np.zeros(len(a), dtype="int8")
        for c in range(int(self.earlier[a].max()) if len(a) else 0):
            new = (self.cells[a, c] != self.cells[b, c]) | (self.earlier[a] <= c)
            a, b, missed = a[new], b[new], missed[new]
        for c in range(first, PROJECTIONS):
            missed += np.abs(self.columns[c][a] - self.columns[c][b]) > self.width
            stay = missed <= MISSES
            a, b, missed = a[stay], b[stay], missed[stay]
        return a, b

    def windows(self, one: np.ndarray, two: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Passing pairs of a large group, some queries at a time: rows are sorted by the first projection, where a query's window is a
        range of places; collisions are counted for ranges as a whole at first, then for the pairs that can still pass. `two` are
        the rows to search for those of `one`; None searches `one` itself, each pair once."""
        main, reach = self.columns[0], SURE * self.width
        searched = one if two is None else two
        searched = searched[np.argsort(main[searched], kind="stable")]
        queries = searched if two is None else one[np.argsort(main[one], kind="stable")]
        values = main[searched]
        for start in range(0, len(queries), QUERIES):
            asked = queries[start : start + QUERIES]
            low = start + 1 if two is None else np.searchsorted(values, main[asked[0]] - reach, "left")
            candidates = searched[low : np.searchsorted(values, main[asked[-1]] + reach, "right")]
            missed = (np.abs(main[asked][:, None] - main[candidates][None, :]) > reach).astype("int8") * np.int8(MISSES + 1)
            for c in range(1, WHOLE):
                missed += np.abs(self.columns[c][asked][:, None] - self.columns[c][candidates][None, :]) > self.width
            i, j = np.nonzero(missed <= MISSES)
            if two is None:
                later = low + j > start + i
                i, j = i[later], j[later]
            yield self.passing(asked[i], candidates[j], missed[i, j], WHOLE)


def collision_links(reps: DataFrame, largest: int, cosine: float = COSINE) -> DataFrame:
    """For distinct vectors (`node`, `label`, `v`, `copies`): rows (`u`, `v`) of a spanning forest of the links, and rows (`u`, `n`) of
    partial sums of the copies that a vector is linked with.

    Counting every collision of every pair would be quadratic, so pairs are counted where they share a cell: each of some tables cuts the
    space by several projections, and vectors of a label meet in each table's cells. Labels of any size keep small cells of unrelated
    vectors: depth and number of tables follow the largest label. A crowded cell, as of many near copies, is cut into chunks whose pairs
    are blocks. In a block, pairs that pass the count are verified by their cosine; a pair counts in the first table in which it meets.
    """
    width = window_width(cosine)
    depth, tables = cell_tables(largest, cosine)

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, rows in batch.groupby(batch["v"].map(len)).indices.items():
                mine = batch.iloc[rows]
                numbers = cells_of(unit(np.stack(mine["v"].to_numpy()).astype("float64")), depth, tables)
                for t in range(tables):
                    yield mine.assign(t=np.int32(t), cell=numbers[:, t])

    given = reps.select("node", "label", "copies", "v")
    kind = T.StructType([*given.schema.fields]).add("t", T.IntegerType()).add("cell", T.LongType())
    placed = given.mapInPandas(cells, kind)
    met = blocks(placed, ["label", "t", "cell", F.size("v")], "node")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for every, _ in whole_groups(batches):
            for _, places in every.groupby(every["v"].map(len)).indices.items():
                rows = every.iloc[places].reset_index(drop=True)
                starts = edges(rows, BLOCK)
                nodes, copies = rows["node"].to_numpy(), rows["copies"].to_numpy()
                chunk = [rows[c].to_numpy() for c in ("__c", "__i", "__j")]
                units = unit(np.stack(rows["v"].to_numpy()).astype("float64"))
                counter = Counter(units @ directions(units.shape[1], PROJECTIONS, 3), width, cells_of(units, depth, tables), rows["t"].to_numpy())
                n = np.zeros(len(rows), dtype="int64")
                links = [(np.zeros(0, "int64"), np.zeros(0, "int64"))]

                def keep(a: np.ndarray, b: np.ndarray) -> None:
                    close = np.einsum("ij,ij->i", units[a], units[b]) >= cosine
                    a, b = a[close], b[close]
                    np.add.at(n, a, copies[b])
                    np.add.at(n, b, copies[a])
                    links.append(forest(nodes[a], nodes[b]))

                for a, b in short_pairs(starts, *chunk):
                    keep(*counter.passing(a, b))
                for one, two in long_groups(starts, *chunk):
                    for a, b in counter.windows(one, two):
                        keep(a, b)
                linked = np.flatnonzero(n)
                if len(linked):
                    u, v = forest(*map(np.concatenate, zip(*links)))
                    yield pd.DataFrame({"u": u, "v": v, "n": 0})
                    yield pd.DataFrame({"u": nodes[linked], "v": nodes[linked], "n": n[linked]})

    return met.select("node", "copies", "v", "t", "__c", *BLOCK).mapInPandas(run, "u long, v long, n long")


def embedding_groups(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE, carry: list[str] | None = None) -> DataFrame:
    """Adds `n_links` (other rows within the cosine and of the same label), `component_id` (the smallest key that links reach) and
    `kept` (the row's key is its component's).

    Null labels, null, empty and zero vectors and those with null or non-finite components link with nothing; each such row is its own
    component. Vectors of different lengths don't link. Rows with equal label and vector are searched as one and link with one another,
    however many there are; they meet as counts. A row with a null key takes part, and isn't kept; a component of such rows only has a
    null id. An empty table gives no rows.
    """
    v = F.col(f"`{vector}`")
    sound = F.coalesce(
        F.col(f"`{label}`").isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0),
        F.lit(False))
    rows = vectors.select(packed(vectors, carry), F.col(f"`{key}`").alias("__k"), F.col(f"`{label}`").alias("label"), v.alias("v"), sound.alias("__ok"))
    hashes = [F.xxhash64("label", "v").alias("__a"), F.xxhash64(F.lit("second"), "label", "v").alias("__b")]
    valid = rows.where("__ok").select(ROW, "__k", "label", "v", *hashes)
    reps = valid.groupBy("__a", "__b").agg(F.min("__k").alias("first"), F.count("*").alias("copies"), F.any_value("label").alias("label"), F.any_value("v").alias("v"))
    reps = stage(reps.withColumn("node", F.monotonically_increasing_id()), "vectors")
    largest = reps.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    found = stage(collision_links(reps, largest, cosine), "found")
    roots = components(found.where("n = 0").select("u", "v"))
    linked = found.where("n > 0").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("n"))
    rooted = reps.select("__a", "__b", "node", "first", "copies").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    firsts = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = stage(rooted.join(firsts, "root").join(linked, "node", "left").select(
        "__a", "__b", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"), "classes")
    near = valid.select(ROW, "__k", "__a", "__b").join(classes, ["__a", "__b"]).select(ROW, "__k", "n_links", "component_id")
    alone = rows.where(~F.col("__ok")).select(ROW, "__k", F.lit(0).cast("long").alias("n_links"), F.col("__k").alias("component_id"))
    every = near.unionByName(alone).withColumn("kept", F.coalesce(F.col("__k") == F.col("component_id"), F.lit(False)))
    return unpacked(every, OUTPUTS)
