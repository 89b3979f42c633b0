"""Packing of token pieces into sequences: a grouping genetic algorithm on islands."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..staging import stage
from .common import ROW, packed, unpacked
from .tokens import byte_bpe, vocabulary_path

#: Pieces that are packed together on average; the number of such groups grows with the input.
GROUP_PIECES = 4096
ISLANDS = 2
EPOCHS = 2
#: An epoch ends when so many generations bring no better packing.
PATIENCE = 10
#: Groups whose emptiest bins are packed again together: about a fiftieth of their bins, so some `GROUP_PIECES` pieces.
REPACKED = 50
#: Island rows a task takes at most on average.
ROWS_PER_TASK = 64
POPULATION = 4

PIECE_OUTPUTS = ["piece", "start", "length", "ids_crc32"]
OUTPUTS = ["sequence_id", "offset"]


def pieces(
    docs: DataFrame,
    capacity: int = 2048,
    text: str = "text",
    vocabulary: str = "byte_bpe_50k.tiktoken",
    end_id: int = 0,
    carry: list[str] | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """The pieces of every document: `piece`, `start`, `length`, `ids_crc32` and, if wanted, `ids`.

    A document is the ids of its whole text and then `end_id`; a null text is empty, so that its only id is `end_id`. A document over
    the capacity is cut into full pieces; the first takes the remainder. Documents that fit are one piece. All columns but the text are
    carried by default, as each piece has them.
    """
    row = packed(docs, [c for c in docs.columns if c != text] if carry is None else carry)
    fields = "piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = byte_bpe(vocabulary_path(vocabulary))
        for texts in batches:
            out = []
            for value in texts:
                ids = np.append(bpe.ids(value), np.uint32(end_id)).astype("<u4")
                first = len(ids) % capacity or capacity
                edges = [0, *range(first, len(ids) + 1, capacity)]
                out.append([
                    {"piece": i, "start": a, "length": b - a, "ids_crc32": zlib.crc32(ids[a:b].tobytes())} | ({"ids": ids[a:b].astype("int32")} if with_ids else {})
                    for i, (a, b) in enumerate(zip(edges, edges[1:]))
                ])
            yield pd.Series(out)

    found = docs.select(row, F.pandas_udf(cut, f"array<struct<{fields.replace(' ', ':').replace(',:', ',')}>>")(F.col(f"`{text}`")).alias("__p"))
    opened = found.select(ROW, F.inline("__p"))
    return unpacked(opened, [*PIECE_OUTPUTS, *(["ids"] if with_ids else [])])


class Fitter:
    """Best fit over bins of integer room: a bit per amount of room that some open bin has."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.open: list[list[list[int]]] = [[] for _ in range(capacity + 1)]
        self.mask = 0

    def add_bin(self, bin_: list[int], room: int) -> None:
        self.open[room].append(bin_)
        self.mask |= 1 << room

    def put(self, length: int) -> None:
        fits = self.mask >> length
        if fits:
            room = length + (fits & -fits).bit_length() - 1
            stack = self.open[room]
            bin_ = stack.pop()
            if not stack:
                self.mask ^= 1 << room
        else:
            room, bin_ = self.capacity, []
        bin_.append(length)
        self.add_bin(bin_, room - length)

    def bins(self) -> list[tuple[int, ...]]:
        return [tuple(b) for stack in self.open for b in stack]


Solution = list[tuple[int, ...]]


def best_fit(lengths: list[int], capacity: int, kept: Solution = ()) -> Solution:
    """Puts lengths, in the given order, into the fullest bins that hold them; `kept` bins are there already."""
    fitter = Fitter(capacity)
    for bin_ in kept:
        fitter.add_bin(list(bin_), capacity - sum(bin_))
    for length in lengths:
        fitter.put(length)
    return fitter.bins()


def fitness(solution: Solution, capacity: int) -> tuple[int, float]:
    """Fewer bins first, then fuller ones (mean square fill)."""
    return -len(solution), sum((sum(b) / capacity) ** 2 for b in solution) / max(1, len(solution))


def crossover(one: Solution, other: Solution, capacity: int, rng: np.random.Generator) -> Solution:
    """Injects well-filled bins of `other` whole into `one`; bins of `one` that now hold a document twice are opened, and their other
    documents are best-fitted again, longest first."""
    full = [b for b in other if sum(b) >= capacity - 1]
    if not full:
        full = sorted(other, key=sum, reverse=True)[: max(1, len(other) // 4)]
    chosen = [full[i] for i in np.flatnonzero(rng.random(len(full)) < 0.5)]
    taken = Counter(length for b in chosen for length in b)
    kept, displaced = [], []
    for i in rng.permutation(len(one)):
        bin_ = one[i]
        if any(taken[length] > 0 for length in bin_):
            for length in bin_:
                if taken[length] > 0:
                    taken[length] -= 1
                else:
                    displaced.append(length)
        else:
            kept.append(bin_)
    return best_fit(sorted(displaced, reverse=True), capacity, kept + chosen)


def mutate(solution: Solution, capacity: int, rng: np.random.Generator) -> Solution:
    """Opens the emptiest bins and some others and best-fits their documents again."""
    if len(solution) < 2:
        return solution
    order = sorted(range(len(solution)), key=lambda i: sum(solution[i]))
    opened = set(order[: max(1, len(order) // 50)]) | set(rng.integers(0, len(solution), max(1, len(solution) // 50)).tolist())
    loose = [length for i in opened for length in solution[i]]
    kept = [b for i, b in enumerate(solution) if i not in opened]
    return best_fit(sorted(loose, reverse=True), capacity, kept)


def evolve(lengths: list[int], capacity: int, elites: list[Solution], seed, patience: int = PATIENCE, population: int = POPULATION) -> Solution:
    """One island's epoch: the population starts from the elites, from best fit of the sorted documents and of slightly shuffled orders.

    It ends when `patience` generations have brought no better packing, or at the lower bound, which nothing can better."""
    least = -(-sum(lengths) // capacity)
    rng = np.random.default_rng(seed)
    own = list(elites)
    if not own:
        own.append(best_fit(sorted(lengths, reverse=True), capacity))
    while len(own) < population and len(min(own, key=len)) > least:
        noisy = np.array(lengths, dtype=float) * rng.uniform(0.85, 1.15, len(lengths))
        own.append(best_fit([lengths[i] for i in np.argsort(-noisy, kind="stable")], capacity))
    best, since = None, 0
    while True:
        own.sort(key=lambda s: fitness(s, capacity), reverse=True)
        now = fitness(own[0], capacity)
        best, since = (now, 0) if best is None or now > best else (best, since + 1)
        if len(own[0]) <= least or len(own) < 2 or since >= patience:
            return own[0]
        parents = own[: max(2, population // 2)]
        children = []
        while len(children) < population - len(parents):
            a, b = rng.choice(len(parents), 2, replace=False)
            children.append(mutate(crossover(parents[a], parents[b], capacity, rng), capacity, rng))
        own = parents + children


def _flat(solution: Solution) -> np.ndarray:
    """Bins one after another, each ended by a zero."""
    return np.array([x for b in solution for x in (*b, 0)], dtype="int32")


def _bins(flat: np.ndarray) -> Solution:
    ends = np.flatnonzero(flat == 0)
    values = flat.tolist()
    return [tuple(values[a:b]) for a, b in zip([0, *(ends[:-1] + 1)], ends)]


def _places(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The lengths of flat bins, their bins' numbers and their offsets."""
    at = np.cumsum(flat) - flat
    bin_no = np.cumsum(flat == 0) - (flat == 0)
    first = at[np.searchsorted(bin_no, bin_no)]
    return flat[flat > 0], bin_no[flat > 0], (at - first)[flat > 0]


def pack(parts: DataFrame, capacity: int = 2048, length: str = "length", islands: int = ISLANDS, epochs: int = EPOCHS, seed: int = 5) -> DataFrame:
    """Adds `sequence_id` and `offset` to pieces of 1 to `capacity` tokens; pieces in a sequence lie without gaps from 0.

    Full pieces are sequences of their own. The others are dealt by the hash of a row number into groups of about `GROUP_PIECES`,
    whose number grows with the input, so no group does. A group is packed by `islands` populations, each in its own row and task; after
    each epoch the best packing of every island joins the next island's population, and at the end the group's best one is used. The
    emptiest bins of `REPACKED` groups are then packed again together, so that underfull ones of different groups meet.
    Pieces of one length are interchangeable, so packings are lists of lengths, and only the last step deals out the pieces.

    An empty table gives no rows; a null length or one out of range is an error. Equal rows are packed each for itself.
    """
    spark = parts.sparkSession
    bad = F.col(length).isNull() | (F.col(length) < 1) | (F.col(length) > capacity)
    checked = F.when(bad, F.raise_error(F.lit(f"a piece needs 1 to {capacity} tokens"))).otherwise(F.col(length).cast("int"))
    # the staged row number stays the same when tasks are repeated
    rows = stage(parts.select(packed(parts), checked.alias("__l"), F.monotonically_increasing_id().alias("__u")), "pieces")
    loose = rows.where(F.col("__l") < capacity)
    n_groups = max(1, -(-loose.count() // GROUP_PIECES))
    grouped = loose.withColumn("__g", F.pmod(F.xxhash64("__u"), F.lit(n_groups)))
    histograms = grouped.groupBy("__g", "__l").agg(F.count("*").alias("__n")).groupBy("__g").agg(
        F.collect_list(F.struct(F.col("__l").alias("l"), F.col("__n").alias("n"))).alias("__lengths"))
    state = histograms.select(
        "__g", "__lengths", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("__i"), F.array().cast("array<array<int>>").alias("__elites"))
    kind = T.StructType([*state.schema.fields])
    n_rows = n_groups * islands
    tasks = max(-(-n_rows // ROWS_PER_TASK), min(n_rows, 3 * spark.sparkContext.defaultParallelism))

    def epoch(number: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                best = []
                for group, lengths, island, elites in zip(batch["__g"], batch["__lengths"], batch["__i"], batch["__elites"]):
                    every = [x["l"] for x in sorted(lengths, key=lambda x: -x["l"]) for _ in range(x["n"])]
                    start = np.random.SeedSequence([seed, int(group), int(island), number])
                    best.append([_flat(evolve(every, capacity, [_bins(np.asarray(e)) for e in elites], start))])
                yield batch.assign(__elites=best)

        return run

    for number in range(epochs):
        ran = stage(state.repartition(tasks, "__g", "__i").mapInPandas(epoch(number), kind), "islands")
        sent = ran.select("__g", F.pmod(F.col("__i") + 1, F.lit(islands)).cast("int").alias("__i"), F.col("__elites").alias("__sent"))
        state = ran.join(sent, ["__g", "__i"]).select("__g", "__lengths", "__i", F.array_distinct(F.concat("__elites", "__sent")).alias("__elites"))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for group, flat in zip(batch["__g"], batch["__flat"]):
                flat, bin_no, offset = _places(np.asarray(flat, dtype="int64"))
                fill = np.bincount(bin_no, flat)
                emptiest = np.argsort(fill, kind="stable")[: max(1, len(fill) // REPACKED)]
                placed = pd.DataFrame({
                    "__g": group, "__l": flat, "sequence_id": bin_no * n_groups + group, "offset": offset, "__again": np.isin(bin_no, emptiest[fill[emptiest] < capacity])})
                yield placed.assign(__k=placed.groupby("__l").cumcount() + 1)

    def repack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["__l", "__g", "__k"], ascending=[False, True, True], ignore_index=True)
        before = [tuple(x) for _, x in rows.groupby("sequence_id")["__l"]]
        every = rows["__l"].tolist()
        best = evolve(every, capacity, [before], np.random.SeedSequence([seed, int(rows["__g"].min()), islands, epochs]))
        if len(best) < len(before):
            flat, bin_no, offset = _places(_flat(best).astype("int64"))
            order = np.argsort(-flat, kind="stable")
            rows = rows.assign(sequence_id=np.unique(rows["sequence_id"])[bin_no[order]], offset=offset[order])
        return rows[found]

    found = ["__g", "__l", "sequence_id", "offset", "__k"]
    n_bins = F.size(F.filter("__flat", lambda x: x == 0))
    best = ran.select("__g", "__i", F.col("__elites")[0].alias("__flat")).groupBy("__g").agg(F.min_by("__flat", F.struct(n_bins, "__i")).alias("__flat"))
    dealt = stage(best.mapInPandas(deal, "__g long, __l int, sequence_id long, offset long, __again boolean, __k int"), "dealt")
    together = F.pmod("__g", F.lit(-(-n_groups // REPACKED)))
    again = dealt.where("__again").groupBy(together).applyInPandas(repack, "__g long, __l int, sequence_id long, offset long, __k int")
    spots = dealt.where("not __again").select(found).unionByName(again)
    same = Window.partitionBy("__g", "__l").orderBy("__u")
    numbered = grouped.withColumn("__k", F.row_number().over(same))
    short = numbered.join(spots, ["__g", "__l", "__k"]).select(ROW, "sequence_id", "offset")
    whole = rows.where(F.col("__l") == capacity).select(ROW, (-1 - F.col("__u")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return unpacked(short.unionByName(whole), OUTPUTS)
