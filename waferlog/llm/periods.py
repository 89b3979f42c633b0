"""Periodic runs of words: maximal repetitions of every document, by suffix trees of it and of its reversal."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import ROW, packed, unpacked

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LEAST = 12
#: Stretches of a document share a tree until it has so many symbols; a longer stretch has a tree of its own.
TREE_SYMBOLS = 1 << 16

OUTPUTS = ["n_words", "runs", "collapsed"]
_RUN = "struct<start:bigint,length:bigint,period:bigint>"


class SuffixTree:
    """Ukkonen's tree of a sequence of numbers >= 1, which gets the terminal 0; answers longest common extensions by an Euler tour."""

    def __init__(self, symbols: np.ndarray):
        self.text = [*symbols.tolist(), 0]
        self.n = len(self.text)
        self._build()
        self._tour()

    def _build(self) -> None:
        text, n = self.text, self.n
        sigma = max(text) + 1
        start, stop, link = [0], [0], [0]
        child: dict[int, int] = {}
        node = edge = length = pending = 0
        for i, symbol in enumerate(text):
            pending += 1
            made = -1
            while pending:
                if not length:
                    edge = i
                key = node * sigma + text[edge]
                below = child.get(key)
                if below is None:
                    child[key] = len(start)
                    start.append(i)
                    stop.append(n)
                    link.append(0)
                    if made >= 0:
                        link[made] = node
                        made = -1
                else:
                    span = min(stop[below], i + 1) - start[below]
                    if length >= span:
                        edge += span
                        length -= span
                        node = below
                        continue
                    at = start[below]
                    if text[at + length] == symbol:
                        length += 1
                        if made >= 0:
                            link[made] = node
                        break
                    fork = len(start)
                    start += [at, i]
                    stop += [at + length, n]
                    link += [0, 0]
                    child[key] = fork
                    child[fork * sigma + symbol] = fork + 1
                    start[below] = at + length
                    child[fork * sigma + text[at + length]] = below
                    if made >= 0:
                        link[made] = fork
                    made = fork
                pending -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - pending + 1
        keys = np.fromiter(child, dtype=np.int64, count=len(child))
        order = np.argsort(keys)
        self._children = np.fromiter(child.values(), dtype=np.int64, count=len(child))[order].tolist()
        self._first = np.searchsorted(keys[order] // sigma, np.arange(len(start) + 1)).tolist()
        self._start, self._stop = start, stop

    def _tour(self) -> None:
        """Euler tour of string depths, and the rank of every suffix among the suffixes."""
        first, children, start, stop, n = self._first, self._children, self._start, self._stop, self.n
        depth = [0] * len(start)
        tour: list[int] = []
        seen = [0] * n
        rank = [0] * n
        leaves = 0
        path, turn = [0], [first[0]]
        while path:
            node = path[-1]
            at = turn[-1]
            if at == first[node + 1]:
                path.pop()
                turn.pop()
                if path:
                    tour.append(depth[path[-1]])
                continue
            if at == first[node]:
                tour.append(depth[node])
            turn[-1] = at + 1
            below = children[at]
            deep = depth[node] + stop[below] - start[below]
            depth[below] = deep
            if first[below] == first[below + 1]:
                suffix = n - deep
                seen[suffix] = len(tour)
                rank[suffix] = leaves
                leaves += 1
                tour += [deep, depth[node]]
            else:
                path.append(below)
                turn.append(first[below])
        self.rank = rank
        self.seen = np.array(seen, dtype=np.int64)
        self.levels = [np.array(tour, dtype=np.int32)]
        width = 1
        while 2 * width <= len(tour):
            below = self.levels[-1]
            self.levels.append(np.minimum(below[:-width], below[width:]))
            width *= 2
        del self._children, self._first, self._start, self._stop

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For pairs of different places: how many symbols their suffixes share, the string depth of the leaves' lowest common ancestor."""
        left = np.minimum(self.seen[a], self.seen[b])
        right = np.maximum(self.seen[a], self.seen[b])
        power = np.frexp((right - left + 1).astype(np.float64))[1] - 1
        out = np.empty(len(a), dtype=np.int64)
        for p in np.unique(power):
            here = power == p
            row = self.levels[p]
            out[here] = np.minimum(row[left[here]], row[right[here] - (1 << int(p)) + 1])
        return out


def lyndon_lengths(rank: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the longest Lyndon word at each place, for the order of the ranks and for its reverse (0: it reaches the terminal).

    The word ends where the next smaller suffix starts; in the reversed order, where the next greater one does.
    """
    n = len(rank)
    found = []
    for sign in (1, -1):
        lengths = [0] * n
        open_: list[int] = []
        for i in range(n):
            r = sign * rank[i]
            while open_ and sign * rank[open_[-1]] > r:
                j = open_.pop()
                lengths[j] = i - j
            open_.append(i)
        found.append(np.array(lengths[: n - 1], dtype=np.int64))
    return found[0], found[1]


def tree_runs(symbols: np.ndarray, least: int) -> np.ndarray:
    """The runs (start, length, period) of a sequence of numbers >= 1 that are `least` long or more.

    Every run has its period's Lyndon root in one of two opposite orders as the longest Lyndon word of some place. Each such word is a
    candidate period, extended to the right by the tree and to the left by the tree of the reversal.
    """
    n = len(symbols)
    tree = SuffixTree(symbols)
    places = np.arange(n, dtype=np.int64)
    words = lyndon_lengths(tree.rank)
    at = np.concatenate([places, places])
    period = np.concatenate(words)
    real = period > 0
    at, period = at[real], period[real]
    right = tree.common(at, at + period)
    del tree
    # Left extension ends before place `at`: in the reversal, suffixes that start at n - at and n - at - period.
    left = np.zeros(len(at), dtype=np.int64)
    inner = np.flatnonzero(at > 0)
    back = SuffixTree(symbols[::-1])
    left[inner] = back.common(n - at[inner], n - at[inner] - period[inner])
    start, length = at - left, left + period + right
    good = (length >= 2 * period) & (length >= least)
    return np.unique(np.stack([start[good], length[good], period[good]], axis=1), axis=0)


def repeated_places(ids: np.ndarray, part: np.ndarray, grams: int) -> np.ndarray:
    """True for places of windows of `grams` words that occur more than once in their part (by a hash; a collision only adds places)."""
    n = len(ids) - grams + 1
    keys = part[:n].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(grams):
        keys = (keys ^ ids[k : k + n].astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        keys ^= keys >> np.uint64(32)
    inside = part[:n] == part[grams - 1 :]
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    often = np.zeros(n, dtype=bool)
    often[order[1:][same]] = True
    often[order[:-1][same]] = True
    return often & inside


def stretches(ids: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Stretches (start, stop) that together hold every run whole.

    A run of period q and length L >= 2 q repeats L - q >= L / 2 words at distance q inside itself, so windows of half the least
    length that repeat inside the run cover it. Words that no such window covers cut the document; what remains is looked at again
    stretch by stretch, until a second look or a later one hardly removes words.
    """
    grams = max(1, least // 2)
    places, part = np.arange(len(ids)), np.zeros(len(ids), dtype=np.int64)
    looks = 0
    while len(places) >= least:
        looks += 1
        often = repeated_places(ids[places], part, grams)
        edges = np.zeros(len(places) + 1, dtype=np.int64)
        at = np.flatnonzero(often)
        np.add.at(edges, at, 1)
        np.add.at(edges, at + grams, -1)
        covered = np.cumsum(edges[:-1]) > 0
        before, places, part = len(places), places[covered], part[covered]
        part = np.cumsum(np.diff(places, prepend=-2) > 1) if len(places) else part
        if looks > 1 and 10 * len(places) > 9 * before:
            break
    if len(places) < least:
        return []
    cuts = np.flatnonzero(np.diff(places) > 1)
    starts, stops = places[np.append(0, cuts + 1)], places[np.append(cuts, len(places) - 1)] + 1
    return [(int(a), int(b)) for a, b in zip(starts, stops) if b - a >= least]


def word_runs(words: list[str], least: int = LEAST) -> np.ndarray:
    """All runs of `least` words or more, as rows (start, length, period) by start and period."""
    known: dict[str, int] = {}
    ids = np.array([known.setdefault(w, len(known) + 1) for w in words], dtype=np.int64)
    found = [np.zeros((0, 3), dtype=np.int64)]
    waiting: list[tuple[int, int]] = []

    def search() -> None:
        if not waiting:
            return
        # Stretches follow each other, each closed by a separator of its own that nothing equals.
        top = len(known) + 1
        joined = np.concatenate([np.append(ids[a:b], top + i) for i, (a, b) in enumerate(waiting)])
        _, dense = np.unique(joined, return_inverse=True)
        offset = np.repeat([a for a, _ in waiting], [b - a + 1 for a, b in waiting]) - np.repeat(
            np.cumsum([0] + [b - a + 1 for a, b in waiting])[:-1], [b - a + 1 for a, b in waiting])
        runs = tree_runs(dense + 1, least)
        runs[:, 0] += offset[runs[:, 0]]
        found.append(runs)
        waiting.clear()

    size = 0
    for a, b in stretches(ids, least) if len(words) >= least else []:
        if waiting and size + b - a > TREE_SYMBOLS:
            search()
            size = 0
        waiting.append((a, b))
        size += b - a
    search()
    runs = np.concatenate(found)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def collapse(words: list[str], runs: np.ndarray) -> str:
    """The words in single spaces, without those that some run holds after its first period."""
    if not len(runs):
        return " ".join(words)
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    return " ".join([words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()])


def find_runs(docs: DataFrame, text: str = "text", least: int = LEAST, carry: list[str] | None = None) -> DataFrame:
    """Adds `n_words`, `runs` (start, length, period; by start, then period) and `collapsed`, the text without repeated periods.

    A run is a stretch of words with smallest period q, `least` or more and 2 q or more words long, that can't be extended. A null or
    empty text has no words, no runs and an empty `collapsed`. Every whole text counts; repeated rows give a result each. Trees are built
    where a window of half the least length repeats near by: elsewhere no run can be. The memory of a task follows its longest such stretch.
    """

    def search(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = []
            for value in texts:
                words = WORDS.findall(value or "")
                runs = word_runs(words, least)
                out.append((len(words), [{"start": a, "length": b, "period": c} for a, b, c in runs.tolist()], collapse(words, runs)))
            yield pd.DataFrame(out, columns=OUTPUTS)

    kind = f"n_words bigint, runs array<{_RUN}>, collapsed string"
    found = docs.select(packed(docs, [c for c in docs.columns if c != text] if carry is None else carry), F.pandas_udf(search, kind)(F.col(f"`{text}`")).alias("__f"))
    return unpacked(found.select(ROW, "__f.*"), OUTPUTS)
