"""Operator 10's index against brute force at sizes of one node and of many levels."""

import numpy as np
import pytest

from assayer.llm import simhash


def crowd(rng, n, families=8, edits=6):
    """Distinct fingerprints: families whose members differ in few bits, and as many others."""
    centres = rng.integers(0, 2**64, families, np.uint64)
    near = [centres[rng.integers(families)] ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, edits), replace=False))) for _ in range(n // 2)]
    return np.unique(np.concatenate([np.array(near, np.uint64), rng.integers(0, 2**64, n - n // 2, np.uint64)]))


def least_reached(fps, bits):
    label = np.arange(len(fps))
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= bits
    while True:
        after = np.where(near, label[None, :], len(fps)).min(1)
        if (after == label).all():
            return label
        label = after


@pytest.mark.parametrize(("node", "fan"), [(16_384, 16), (40, 4), (25, 2)])
def test_links_are_brute_forces(spark, monkeypatch, node, fan):
    monkeypatch.setattr(simhash, "NODE", node)
    monkeypatch.setattr(simhash, "FAN", fan)
    fps = crowd(np.random.default_rng(node), 900)
    df = spark.createDataFrame([(i, int(x)) for i, x in enumerate(fps.view(np.int64).tolist())], "rep bigint, fp bigint").repartition(5)
    found = [(r.u, r.v) for r in simhash.links(df, 3).collect()]
    assert all((int(fps[u]) ^ int(fps[v])).bit_count() <= 3 for u, v in found)
    of = dict(simhash.components(simhash.links(df, 3)).collect())
    assert [of.get(i, i) for i in range(len(fps))] == least_reached(fps, 3).tolist()


def test_pruned_pairs_have_no_links(spark, monkeypatch):
    """Pairs of nodes that the upper levels prune, and the rank's order."""
    monkeypatch.setattr(simhash, "NODE", 4)
    fps = np.random.default_rng(5).integers(0, 2**64, 600, np.uint64)
    df = spark.createDataFrame([(i, int(x)) for i, x in enumerate(fps.view(np.int64).tolist())], "rep bigint, fp bigint")
    index = simhash.nodes(df).collect()
    assert sorted(len(r.fps) for r in index)[1:] == [4] * 149 and {r.node for r in index} == set(range(150))
    order = [x for r in sorted(index, key=lambda r: r.node) for x in r.fps]
    assert np.array(order).view(np.uint64).tolist() == fps[simhash.gray_order(fps)].tolist()
    kept = {(r.a, r.b) for r in simhash.near_nodes(simhash.nodes(df).select("node", "set", "clear"), 3).collect()}
    exact = {(a.node, b.node) for a in index for b in index if a.node <= b.node and ((a.set & b.clear | a.clear & b.set) & (2**64 - 1)).bit_count() <= 3}
    assert kept == exact and len(kept) < 150 * 151 // 2


def test_a_hub_is_no_hot_key(spark, monkeypatch):
    """A star whose hub has most edges, and a chain."""
    from assayer.llm import common

    monkeypatch.setattr(common, "HEAVY", 3)
    edges = [(500, i) for i in range(100)] + [(600 + i, 601 + i) for i in range(20)]
    of = dict(simhash.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect())
    assert all(of.get(i, i) == 0 for i in [500, *range(100)]) and all(of.get(600 + i, 600 + i) == 600 for i in range(21))


def test_clashing_names_and_other_ids(spark):
    """Columns named like the operator's own, ids of strings, repeated rows, nulls and a long text."""
    rows = [("b", "one two three four"), ("a", "one two three four"), ("a", "one two three four"), ("c", None), ("d", ""), (None, "x"), ("e", "word " * 400_000)]
    df = spark.createDataFrame([(i, t, 7, 7, "k") for i, t in rows], "doc_id string, text string, fp int, id int, component_id string").repartition(3)
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()}
    assert got == {("b", "a"), ("a", "a"), ("c", "c"), ("d", "c"), (None, None), ("e", "e")}
    assert sorted((r.doc_id or "", r.fp) for r in simhash.dedupe(df).collect()) == [("a", 7), ("a", 7), ("c", 7), ("e", 7)]
