"""Neighbours in many dimensions against brute force."""

import numpy as np
import pytest

from flowspark.operators import projections, smote

K = 5


def table_of(spark, x):
    points, copies = np.unique(x, axis=0, return_counts=True)
    rows = [(i, [float(v) for v in p], int(c)) for i, (p, c) in enumerate(zip(points, copies))]
    return points, copies, spark.createDataFrame(rows, smote.POINT).repartition(4)


def recall(found, points, copies, asked):
    hits = 0
    for i in asked:
        squared = ((points - points[i]) ** 2).sum(axis=1)
        weights = copies.copy()
        weights[i] -= 1
        nearest = np.sort(np.repeat(squared, np.minimum(weights, K)))[K - 1]
        assert len(found[i]) == K
        hits += (((np.array(found[i]) - points[i]) ** 2).sum(axis=1) <= nearest * (1 + 1e-9)).sum()
    return hits / (K * len(asked))


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(smote, "CELL_POINTS", 100)
    monkeypatch.setattr(smote, "MAX_VISITS", 4)
    monkeypatch.setattr(projections, "LEAF_POINTS", 150)


def wide(rows, dimensions=60, inner=8, seed=0):
    """Points near a surface of few dimensions in a space of many, on scales that differ a thousandfold."""
    rng = np.random.default_rng(seed)
    made = rng.normal(size=(rows, inner)) @ rng.normal(size=(inner, dimensions)) + 0.05 * rng.normal(size=(rows, dimensions))
    return made * np.logspace(0, 3, dimensions)


def test_trees_find_neighbours_in_sixty_dimensions(spark, small, monkeypatch):
    x = wide(3_000)
    x = np.concatenate([x, np.tile(x[:1], (500, 1)), x[1:4]])
    points, copies, table = table_of(spark, x)
    met = []
    search = projections.forest_neighbours
    monkeypatch.setattr(projections, "forest_neighbours", lambda p, q, k: met.append(q.count()) or search(p, q, k))
    found = {r["_pid"]: r["neighbours"] for r in smote.nearest_neighbours(table, table, K).collect()}
    assert set(found) == set(range(len(points)))
    assert met[0] > 2_000
    assert recall(found, points, copies, range(0, len(points), 7)) >= 0.9
    hot = int(copies.argmax())
    assert (np.array(found[hot]) == points[hot]).all()


def test_too_low_a_recall_falls_back_to_all_cells(spark, small, monkeypatch):
    monkeypatch.setattr(projections, "RECALL", 1.1)
    monkeypatch.setattr(projections, "MAX_TREES", 8)
    points, copies, table = table_of(spark, wide(900, 20))
    found = {r["_pid"]: r["neighbours"] for r in smote.nearest_neighbours(table, table, K).collect()}
    assert recall(found, points, copies, range(len(points))) == 1.0


def test_leaves_are_bounded_and_lose_nobody():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(500, 6)), np.zeros((400, 6))])
    leaves = list(projections.leaves_of(x, rng, 50))
    assert max(map(len, leaves)) <= 50
    assert sorted(np.concatenate(leaves)) == list(range(900))
    tree = projections.fit_tree(x, 8, rng)
    cells = projections.cell_of(tree, x)
    assert cells.min() == 0 and cells.max() == len(tree[1])
    assert (projections.cell_of(projections.fit_tree(x[:1], 4, rng), x) == 0).all()


def test_true_radius_is_that_of_all_points(spark):
    points, copies, table = table_of(spark, np.round(np.random.default_rng(5).random((300, 2)), 2))
    asked = table.where("_pid % 10 = 0").toPandas()
    for i, radius in projections.true_radius(table, asked, K).items():
        squared = np.repeat(((points - points[i]) ** 2).sum(axis=1), copies - (np.arange(len(points)) == i))
        assert np.isclose(radius, np.sort(squared)[K - 1])
