import random

import numpy as np
import pandas as pd
import pytest

import brute
from waferlog.llm import neighbours, queries, simhash

DATA = "/root/testdata/sf0.001"


def test_query_like_all_pairs(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op6_simhash(spark, DATA).collect()}
    assert got == brute.simhash_groups(rows)


@pytest.mark.parametrize("chunk,assumed", [(1024, 10), (7, 1 << 20), (1024, 1 << 28)])
def test_no_near_pair_is_missed(spark, monkeypatch, chunk, assumed):
    """Clusters within a few bits, for short and long keys, whole and chunked blocks."""
    rng = random.Random(chunk)
    fps = {rng.getrandbits(64) for _ in range(150)}
    for centre in list(fps)[:30]:
        for _ in range(6):
            near = centre
            for bit in rng.sample(range(64), rng.randrange(1, 7)):
                near ^= 1 << bit
            fps.add(near)
    fps = sorted(fps)
    monkeypatch.setattr(neighbours.blocks, "__defaults__", (chunk,))
    df = spark.createDataFrame([(int(np.uint64(f).astype("int64")),) for f in fps], "fp long")
    links = simhash.near_links(df, assumed)
    roots = {r["node"]: r["root"] for r in neighbours.components(links).collect()}
    near = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    want = brute.groups(len(fps), near)
    signed = [int(np.uint64(f).astype("int64")) for f in fps]
    classes = {}
    for s, g in zip(signed, want):
        classes.setdefault(g, set()).add(s)
    for members in classes.values():
        assert {roots.get(m, m) for m in members} == {min(members)}


def test_masks_leave_no_choice_of_bits_out():
    rng = random.Random(2)
    for n in (10, 10**6, 10**9, 10**12):
        masks = simhash.block_sets(n)
        for _ in range(300):
            differ = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(not differ & m for m in masks)


def test_edges(edge_docs, no_docs, spark):
    got = simhash.simhash_groups(edge_docs)
    rows = got.collect()
    assert len(rows) == edge_docs.count() and got.columns.count("kept") == 1
    blank = [r for r in rows if not (r["text"] or "").split()]
    assert {r["fingerprint"] for r in blank} == {"0" * 16} and {r["component_id"] for r in blank} == {0} and sum(r["kept"] for r in blank) == 1
    assert all(int(r["fingerprint"], 16) == brute.simhash(r["text"]) for r in rows)
    for c in {r["component_id"] for r in rows}:
        assert sum(r["kept"] for r in rows if r["component_id"] == c) == 1
    assert simhash.simhash_groups(no_docs).count() == 0


def test_components_of_long_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 105), (105, 103), (7, 7)], "u long, v long")
    got = {r["node"]: r["root"] for r in neighbours.components(links).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {105: 100, 103: 100}


def test_groups_survive_any_batches():
    rng = np.random.default_rng(5)
    for _ in range(200):
        sizes = rng.integers(1, 9, rng.integers(1, 12))
        rows = pd.DataFrame({"__key": np.repeat(np.arange(len(sizes)) // 3, sizes), "__i": np.repeat(np.arange(len(sizes)) % 3, sizes), "__j": 0, "n": np.arange(sizes.sum())})
        cuts = sorted(set(rng.integers(0, len(rows) + 1, rng.integers(0, 8)).tolist()) | {0, len(rows)})
        seen = []
        for part, starts in neighbours.whole_groups(iter([rows.iloc[a:b] for a, b in zip(cuts, cuts[1:])])):
            seen += [part["n"].tolist()[a:b] for a, b in zip(starts, starts[1:])]
        assert seen == [g["n"].tolist() for _, g in rows.groupby(["__key", "__i"], sort=False)]
