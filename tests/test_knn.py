"""Pruned exact k-NN (O152) against brute force."""

import numpy as np
import pytest

from pitwise.operators import models as MD


def brute(queries, train, k):
    ids = np.array([t[0] for t in train])
    m = np.array([t[1] for t in train], float)
    y = np.array([t[2] for t in train], float)
    out = {}
    for i, v in queries:
        d = ((m - np.array(v)) ** 2).sum(-1)
        out[i] = y[np.lexsort((ids, d))[:k]].mean()
    return out


def frames(spark, queries, train):
    q = spark.createDataFrame(queries, "id long, v array<double>")
    return q, spark.createDataFrame(train, "id long, v array<double>, y double")


def clustered(n, seed, dim=6, clusters=40):
    """Clusters far apart, where cells and their radii are small against the distances."""
    rng = np.random.default_rng(seed)
    centres = np.random.default_rng(0).uniform(-100, 100, (clusters, dim))
    return centres[rng.integers(0, clusters, n)] + rng.normal(0, 1, (n, dim))


@pytest.mark.parametrize("make", [
    clustered,
    lambda n, seed: np.random.default_rng(seed).integers(0, 3, (n, 3)).astype(float),  # ties and copies
    lambda n, seed: np.random.default_rng(seed).normal(0, 1, (n, 12)) + 1e4,  # no structure, far from the origin
])
def test_equals_brute_force(spark, make):
    train = [(i, v.tolist(), float(i % 17)) for i, v in enumerate(make(700, 1))]
    queries = [(i, v.tolist()) for i, v in enumerate(make(90, 2))]
    got = {r["id"]: r["knn_pred"] for r in MD.knn_regress(*frames(spark, queries, train), "id", "v", "y", 4, block=50).collect()}
    want = brute(queries, train, 4)
    assert got.keys() == want.keys()
    assert all(got[i] == pytest.approx(want[i], abs=1e-12) for i in want)


def test_unusable_vectors_and_small_training_sets(spark):
    nan = float("nan")
    train = [(1, [0.0, 0.0], 1.0), (2, None, 9.0), (3, [nan, 0.0], 9.0), (4, [None, 1.0], 9.0), (5, [3.0, 4.0], 3.0), (6, [], 9.0)]
    queries = [(10, [0.0, 1.0]), (11, None), (12, [float("inf"), 0.0])]
    q, t = frames(spark, queries, train)
    assert {r["id"]: r["knn_pred"] for r in MD.knn_regress(q, t, "id", "v", "y", 4).collect()} == {10: 2.0, 11: None, 12: None}
    assert {r["id"]: r["knn_pred"] for r in MD.knn_regress(q, t.limit(0), "id", "v", "y", 4).collect()} == {10: None, 11: None, 12: None}
    assert MD.knn_regress(q.limit(0), t, "id", "v", "y", 4).count() == 0


def test_cells_seen_grow_slower_than_the_cells():
    """Four times the rows have twice the cells; a query of clustered data sees a few of them at either size."""
    share = []
    for n in (1600, 6400):
        m = clustered(n, 3)
        cells = MD.Cells(m[: int(n ** 0.5)])
        home = cells.squares(m)[0].argmin(1)
        dist = np.sqrt(((m - cells.pivots[home]) ** 2).sum(1))
        cells.count = np.bincount(home, minlength=len(cells.pivots))
        np.maximum.at(cells.radius, home, dist)
        q = clustered(200, 4)
        mine = cells.squares(q)[0].argmin(1)
        kth = np.array([np.sort(np.sqrt(((m[home == h] - v) ** 2).sum(1)))[3:4].max(initial=0) or np.inf for v, h in zip(q, mine)])
        rows = sum(int(cells.count[c].sum()) for c in cells.to_see(q, mine, kth, 4)) + int(cells.count[mine].sum())
        share.append(rows / (len(q) * n))
    assert share[0] < 0.25 and share[1] < share[0]


def test_copies_do_not_swell_a_cell(spark):
    """A third of the rows share one vector: of these only the k smallest ids are met."""
    train = [(i, [1.0, 1.0] if i % 3 == 0 else [float(i), i % 7 + 0.5], float(i)) for i in range(600)]
    got = MD.knn_regress(*frames(spark, [(1, [1.0, 1.0])], train), "id", "v", "y", 4).collect()
    assert got[0]["knn_pred"] == np.mean([0, 3, 6, 9])
