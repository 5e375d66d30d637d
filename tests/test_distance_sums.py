"""Silhouettes through cells: every pair counts, and few are computed."""

import numpy as np
import pandas as pd
import pytest

from shelfmark.operators import distance_sums as ds
from shelfmark.operators import silhouette


def brute(x, labels):
    distance = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))
    onehot = np.eye(labels.max() + 1)[labels]
    return silhouette._scores(labels, distance @ onehot, onehot.sum(axis=0)) / len(x)


@pytest.mark.parametrize("d", [1, 2, 3, 4])
def test_silhouette_through_cells(spark, monkeypatch, d):
    monkeypatch.setattr(silhouette, "BLOCK_ROWS", 40)
    rng = np.random.default_rng(d)
    x = rng.normal(size=(3000, d))
    x[:, 0] = np.exp(2 * x[:, 0])  # a long tail
    x[:900, -1] = 0.5  # a flat part
    x[:60] = x[0]  # one place many times
    labels = {
        "near": ((x[:, None, :] - x[100:105]) ** 2).sum(axis=2).argmin(axis=1),
        "mixed": rng.integers(0, 9, 3000), "also": rng.integers(0, 9, 3000),
    }
    df = spark.createDataFrame(
        pd.DataFrame({**{f"f{j}": x[:, j] for j in range(d)}, **labels, "id": np.arange(3000)})
    )
    found = silhouette.silhouette(df, [f"f{j}" for j in range(d)], [*labels], "id").collect()
    got = {r["label"]: r["silhouette"] for r in found}
    for name, mine in labels.items():
        assert got[name] == pytest.approx(brute(x, mine), abs=1e-9)


def distances(n):
    """Distances computed for n points of a plane, and the cells' own count of their pairs."""
    x = np.random.default_rng(5).normal(size=(n, 2))
    tree = ds.grow_tree(x, 64)
    leaf = tree.leaf_of(x)
    cells = ds.Cells.of(tree, {
        c: (x[leaf == c].min(axis=0), x[leaf == c].max(axis=0), int((leaf == c).sum())) for c in tree.leaves()
    })
    computed = counted = 0
    for target, cell, gap, grid in cells.pairs(tree, [0], tree.leaves()):
        counted += cells.size[target] * cells.size[cell]
        to = cells.grid(target, gap)
        own = cells.size[target] if to < 0 else min(cells.size[target], cells.count(target, to))
        computed += own * (cells.size[cell] if grid < 0 else cells.count(cell, grid))
    return computed, counted


def test_distances_grow_almost_as_the_points():
    few, few_pairs = distances(4_000)
    many, many_pairs = distances(32_000)
    assert (few_pairs, many_pairs) == (4_000 ** 2, 32_000 ** 2)
    assert many < 24 * few  # all pairs are 64 times as many


def test_a_number_of_nodes_is_right_from_its_gap_on():
    t = np.linspace(-1, 1, 301)
    for gap, n in ds.NODES_FROM:
        basis, nodes = ds.lagrange(t, -1.0, 1.0, n), ds._chebyshev(n)[0]
        for turn in np.linspace(0, np.pi / 2, 9):
            end = np.array([1 + np.sin(turn) * gap, np.cos(turn) * gap])
            exact = np.hypot(end[0] - t, end[1])
            assert np.abs(basis @ np.hypot(end[0] - nodes, end[1]) / exact - 1).max() < 1.1e-9
