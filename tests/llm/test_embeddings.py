import math

import numpy as np
import pytest

import brute
from waferlog.llm import embeddings, neighbours


def expected(rows):
    sound = [i for i, (_, v, label) in enumerate(rows) if label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = [
        (i, j) for n, i in enumerate(sound) for j in sound[:n]
        if rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]) and brute.cosine(rows[i][1], rows[j][1]) >= 0.93]
    roots = brute.groups(len(rows), links)
    degree = [0] * len(rows)
    for i, j in links:
        degree[i] += 1
        degree[j] += 1
    least = {}
    for i, g in enumerate(roots):
        if rows[i][0] is not None:
            least[g] = min(rows[i][0], least.get(g, rows[i][0]))
    return sorted((-1 if rows[i][0] is None else rows[i][0], degree[i], -1 if least.get(g) is None else least[g]) for i, g in enumerate(roots))


@pytest.mark.parametrize("chunk", [1024, 9])
def test_like_all_pairs(spark, monkeypatch, chunk):
    rng = np.random.default_rng(chunk)
    rows = []
    for _ in range(60):
        centre = rng.standard_normal(32)
        for _ in range(rng.integers(1, 6)):
            rows.append((len(rows), (centre + rng.standard_normal(32) * rng.uniform(0, 0.45)).astype("float32").tolist(), int(rng.integers(0, 2))))
    hot = rng.standard_normal(32)
    rows += [(len(rows) + i, (hot + rng.standard_normal(32) * 0.05).astype("float32").tolist(), 1) for i in range(60)]
    rows += [(len(rows) + i, hot.astype("float32").tolist(), 1) for i in range(20)]
    rows += [(len(rows), None, 1), (len(rows) + 1, [0.0] * 32, 1), (len(rows) + 2, [float("nan")] * 32, 1), (len(rows) + 3, [], 1), (len(rows) + 4, hot.tolist(), None)]
    rows += [(len(rows), [None] + [1.0] * 31, 1), (len(rows) + 1, [float("inf")] + [1.0] * 31, 0), (len(rows) + 2, [1.0, 2.0], 1), (len(rows) + 3, [2.0, 4.0], 1), (None, [1.0, 2.0], 1), (5, rows[5][1], rows[5][2])]
    monkeypatch.setattr(neighbours.blocks, "__defaults__", (chunk,))
    monkeypatch.setattr(embeddings, "CELL_ROWS", chunk // 8)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = embeddings.embedding_groups(df).collect()
    assert sorted((-1 if r["vec_id"] is None else r["vec_id"], r["n_links"], -1 if r["component_id"] is None else r["component_id"]) for r in got) == expected(rows)
    assert all(r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"]) for r in got)


def test_empty_and_clashing_columns(spark):
    kind = "vec_id long, embedding array<float>, label int, n_links string, kept string"
    assert embeddings.embedding_groups(spark.createDataFrame([], kind)).count() == 0
    got = embeddings.embedding_groups(spark.createDataFrame([(1, [1.0, 0.0], 0, "x", "y")], kind))
    assert sorted(got.columns) == ["component_id", "embedding", "kept", "label", "n_links", "vec_id"] and got.first()["kept"] is True


def test_window_recalls_the_limit_pair():
    rng = np.random.default_rng(0)
    width = embeddings.window_width()
    differences = rng.standard_normal((20_000, embeddings.PROJECTIONS)) * math.sqrt(2 - 2 * embeddings.COSINE)
    assert ((np.abs(differences) > width).sum(axis=1) <= embeddings.MISSES).mean() > 0.999


def test_counting_finds_each_pair_once():
    rng = np.random.default_rng(1)
    table = np.repeat(rng.standard_normal((40, embeddings.PROJECTIONS)), 3, axis=0) + rng.standard_normal((120, embeddings.PROJECTIONS)) * 0.3
    width = 0.8
    cells = np.stack([np.arange(120), np.arange(120) // 2, np.zeros(120)], axis=1)
    counter = embeddings.Counter(table, width, cells, np.full(120, 2))
    apart = np.abs(table[:, None] - table[None])
    misses = (apart[:, :, 1:] > width).sum(axis=2) + 100 * (apart[:, :, 0] > embeddings.SURE * width)
    passing = {(i, j) for i in range(120) for j in range(i + 1, 120) if misses[i, j] <= embeddings.MISSES and i // 2 != j // 2}
    for one, two in ((np.arange(120), None), (np.arange(50), np.arange(50, 120))):
        got = [tuple(sorted(p)) for a, b in counter.windows(one, two) for p in zip(a.tolist(), b.tolist())]
        assert len(got) == len(set(got)) and set(got) == {(i, j) for i, j in passing if two is None or i < 50 <= j}
    a, b = np.triu_indices(120, 1)
    assert set(zip(*(x.tolist() for x in counter.passing(a, b)))) == passing


def test_cells_hold_near_pairs_together():
    """The measured share of limit pairs that meet in some table, for a small and a large label."""
    rng = np.random.default_rng(2)
    x = embeddings.unit(rng.standard_normal((3000, 64)))
    side = rng.standard_normal((3000, 64))
    side = embeddings.unit(side - (side * x).sum(axis=1, keepdims=True) * x)
    y = embeddings.COSINE * x + math.sqrt(1 - embeddings.COSINE**2) * side
    for largest in (1000, 10_000_000):
        depth, tables = embeddings.cell_tables(largest)
        a, b = embeddings.cells_of(x, depth, tables), embeddings.cells_of(y, depth, tables)
        assert (a == b).any(axis=1).mean() > 0.99
        assert (a[:1500, 0] == a[1500:, 0]).mean() < 1.5 * embeddings.CELL_ROWS / largest + 0.002
